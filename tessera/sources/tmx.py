"""Translation memories: TMX files as strings of each language.

A file is split at the end of every translation unit by the text source, so one file is read by as many tasks as it has
blocks, and units are taken apart by native expressions. Segments keep their markup and entities as they stand, for the
segment parser.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VARIANT = r"(?s)<tuv\b([^>]*)>(.*?)</tuv>"
_SEGMENT = r"(?s)<seg\b[^>]*?(?:/>|>(.*?)</seg>)"
_LANG = r"""\b(?:xml:)?lang\s*=\s*["']([^"']*)["']"""
_ID = r"""(?s)<tu\b[^>]*?\btuid\s*=\s*["']([^"']*)["']"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """(tuid, unit, nth, language, segment): one row a variant; tuid is null where the unit has none, unit tells units of one read apart.

    Language tags are as they stand in the file; a variant without a segment has an empty one. Files are UTF-8.
    """
    units = spark.read.option("lineSep", "</tu>").text(path).where(F.col("value").contains("<tuv"))
    named = units.select(F.nullif(F.regexp_extract("value", _ID, 1), F.lit("")).alias("tuid"), F.monotonically_increasing_id().alias("unit"), "value")
    pair = F.arrays_zip(F.regexp_extract_all("value", F.lit(_VARIANT), F.lit(1)).alias("head"), F.regexp_extract_all("value", F.lit(_VARIANT), F.lit(2)).alias("body"))
    rows = named.select("tuid", "unit", F.posexplode(pair).alias("nth", "v"))
    return rows.select("tuid", "unit", "nth", F.regexp_extract(F.col("v")["head"], _LANG, 1).alias("language"), F.regexp_extract(F.col("v")["body"], _SEGMENT, 1).alias("segment"))
