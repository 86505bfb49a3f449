"""keysieve: hardcoded-credential analytics over tables of source files, on Spark.

Every public function takes and returns Spark DataFrames (or Columns).
"""

from keysieve.catalog import Catalog, Rule, default_catalog
from keysieve.operators.detect import annotate_spans, detect, detect_located

__all__ = [
    "Catalog",
    "Rule",
    "annotate_spans",
    "default_catalog",
    "detect",
    "detect_located",
]
