"""Predicates and normal forms for file paths and repository references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keysieve.functions.text import js_trim

# Scanned extensions, skipped folder names, editor languages.
SUPPORTED_EXTENSIONS = (
    "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "go", "java", "rb", "php", "rs", "cs", "kt", "swift", "scala",
    "env", "json", "yml", "yaml", "toml", "ini", "cfg", "conf", "sh", "bash", "zsh", "ps1", "tf", "hcl",
)
SKIPPED_NAMES = ("node_modules", ".git", "out", "web")
EDITOR_LANGUAGES = ("javascript", "typescript", "javascriptreact", "typescriptreact")
EXTENSION_LANGUAGE = {
    "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascriptreact",
    "ts": "typescript", "tsx": "typescriptreact",
}


def is_supported(path: Column) -> Column:
    return F.rlike(path, F.lit(rf"(?i)\.(?:{'|'.join(SUPPORTED_EXTENSIONS)})\z"))


def is_skipped(path: Column) -> Column:
    """True when any segment of the path, at any depth, is a skipped name."""
    return F.arrays_overlap(F.split(path, "/", -1), F.array(*[F.lit(name) for name in SKIPPED_NAMES]))


def editor_language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1))
    language = F.lit(None).cast("string")
    for name, value in EXTENSION_LANGUAGE.items():
        language = F.when(extension == name, F.lit(value)).otherwise(language)
    return language


def has_editor_language(language: Column) -> Column:
    """The editor's gate; table scans do not apply it."""
    return language.isin(*EDITOR_LANGUAGES)


def normal_path(path: Column) -> Column:
    return js_trim(F.translate(path, "\\", "/"))


def is_confined(path: Column) -> Column:
    """A non-empty path that stays below its root."""
    return (path != "") & ~F.startswith(path, F.lit("../")) & ~F.startswith(path, F.lit("/"))


_GIT_SUFFIX = r"(?i)\.git\z"
# Accepted forms of a repository reference.
_REFERENCE_FORMS = (
    r"(?i)^https?://github\.com/([^/]+)/([^/]+)/?\z",
    r"(?i)^git@github\.com:([^/]+)/([^/]+)\z",
    r"^([^/]+)/([^/]+)\z",
)


def repo_owner_and_name(reference: Column) -> Column:
    """``struct<owner,name>`` of the first form that fits; null when none does."""
    value = F.regexp_replace(js_trim(reference), _GIT_SUFFIX, "")
    parsed = F.lit(None).cast("struct<owner:string,name:string>")
    for form in reversed(_REFERENCE_FORMS):
        parsed = F.when(
            F.rlike(value, F.lit(form)),
            F.struct(
                F.regexp_extract(value, form, 1).alias("owner"),
                F.regexp_replace(F.regexp_extract(value, form, 2), _GIT_SUFFIX, "").alias("name"),
            ),
        ).otherwise(parsed)
    return parsed


def clone_slug(url: Column) -> Column:
    """Folder name for a clone: last two segments joined by '-', other characters as '_'."""
    segments = F.filter(F.split(F.regexp_replace(url, _GIT_SUFFIX, ""), "/", -1), lambda s: s != "")
    tail = F.slice(segments, -F.least(F.size(segments), F.lit(2)), F.lit(2))
    joined = F.when(F.size(segments) > 0, F.array_join(tail, "-")).otherwise(F.lit(""))
    slug = F.regexp_replace(joined, r"[^A-Za-z0-9_.-]+", "_")
    return F.when(slug == "", F.lit("repo")).otherwise(slug)
