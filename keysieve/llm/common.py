"""What the corpus operators share: input columns and intermediate tables."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysieve.sources.shared import shared_folder

#: ASCII white space: what separates words in every operator of this package.
WHITE_CLASS = r"[ \t-\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder not used before, below the one that the cluster's machines share."""
    return f"{shared_folder(spark)}/keysieve-llm/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: later steps neither recompute it nor depend on its executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``keys``, before anything moves; the join that follows is exact.

    The marks are bitmaps of 32 to 64 bits a key, at most 16 MB in all however
    many keys there are: beyond that more rows pass than need be.
    """
    bits = 1 << min(27, max(15, (32 * keys.count()).bit_length()))
    place = F.pmod(F.xxhash64(key), F.lit(bits)).alias("__place")
    bucket, bit = F.bitmap_bucket_number("__place"), F.bitmap_bit_position("__place")
    marks = keys.select(place).groupBy(bucket.alias("__bucket")).agg(F.bitmap_construct_agg(bit).alias("__marks"))
    placed = rows.withColumn("__place", place).withColumn("__bucket", bucket)
    byte = F.conv(F.hex(F.substring("__marks", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.expr("__byte & (1 << cast(__bit % 8 as int))") != 0
    found = placed.join(F.broadcast(marks), "__bucket").withColumns({"__byte": byte, "__bit": bit}).filter(there)
    return found.select(*rows.columns)


def first_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (``node`` and more) of ``nodes``, without most of the others, in place: wide rows need not move to be told apart."""
    return marked(rows, nodes.select("node"), "node")


def press(numbers: np.ndarray) -> bytes:
    """Whole numbers, byte by byte of their value, compressed."""
    kind = np.dtype(f"<u{min(8, max(1, 1 << max(0, (int(numbers.max(initial=0)).bit_length() - 1) // 8).bit_length()))}")
    planes = np.ascontiguousarray(numbers.astype(kind)).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpress(data: bytes) -> np.ndarray:
    width = data[0]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.int64)
