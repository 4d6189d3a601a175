"""OBO files: term and relation tables, parsed stanza by stanza in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """One row per ``[Term]`` stanza, its lines as an array; stanzas are the read's records, so large files split."""
    raw = spark.read.option("lineSep", "\n[").text(path)
    return raw.where(F.startswith("value", F.lit("Term]"))).select(F.split("value", "\n").alias("lines"))


def _values(lines, tag: str):
    prefix = f"{tag}: "
    return F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(prefix))), lambda x: F.trim(F.regexp_replace(F.substring(x, len(prefix) + 1, 1_000_000), r"\s+!.*$", "")))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, synonyms, related_synonyms, parent_ids, obsolete); terms without id or name are dropped."""
    lines = F.col("lines")
    quoted = lambda kind: F.transform(F.filter(_values(lines, "synonym"), lambda s: F.rlike(s, F.lit(rf'"\s+{kind}\b'))), lambda s: F.regexp_extract(s, r'^"((?:[^"\\]|\\.)*)"', 1))
    t = stanzas(spark, path).select(F.try_element_at(_values(lines, "id"), F.lit(1)).alias("id"), F.try_element_at(_values(lines, "name"), F.lit(1)).alias("label"), F.array_sort(quoted("EXACT")).alias("synonyms"), F.array_sort(quoted("RELATED")).alias("related_synonyms"), F.array_sort(_values(lines, "is_a")).alias("parent_ids"), F.array_contains(_values(lines, "is_obsolete"), "true").alias("obsolete"))
    return t.where("id is not null and label is not null")


def is_a(term_rows: DataFrame) -> DataFrame:
    return term_rows.select(F.col("id").alias("child"), F.explode("parent_ids").alias("parent")).distinct()


def relations(spark: SparkSession, path: str, source_prefix: str, target_prefixes: tuple[str, ...]) -> DataFrame:
    """(src, rel, dst) of relationships between listed prefixes."""
    lines = F.col("lines")
    r = stanzas(spark, path).select(F.try_element_at(_values(lines, "id"), F.lit(1)).alias("src"), F.explode(_values(lines, "relationship")).alias("r")).select("src", F.substring_index("r", " ", 1).alias("rel"), F.substring_index("r", " ", -1).alias("dst"))
    return r.where(F.startswith("src", F.lit(source_prefix + ":")) & F.substring_index("dst", ":", 1).isin(*target_prefixes))
