"""Chunk readers: CSV corpus, JSON lines, Parquet, gold sets."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import section_of, year_of
from ..schema import schema_of

CSV_COLUMNS = ("chunk_id", "chunk_text", "type", "chunk_metadata")
KINDS = ("abstract", "textbook", "guide")


@F.pandas_udf(T.StringType())
def literal_to_json(values: pd.Series) -> pd.Series:
    """Python dict literals as JSON with sorted keys; null where a text is no dict literal."""

    def one(v):
        try:
            d = ast.literal_eval(v) if isinstance(v, str) and v.strip() else {}
            return json.dumps(d, sort_keys=True, default=str) if isinstance(d, dict) else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return None

    return values.map(one)


def read_csv(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """A CSV corpus: quoted, multi-line, four columns. Bad rows raise (strict) or are left out."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1).csv(path)
    missing = [c for c in CSV_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = raw.select("chunk_id", F.col("chunk_text").alias("text"), F.lower(F.trim("type")).alias("source_type"), literal_to_json("chunk_metadata").alias("source_metadata"))
    good = (F.trim(F.coalesce("chunk_id", F.lit(""))) != "") & (F.trim(F.coalesce("text", F.lit(""))) != "") & F.coalesce("source_type", F.lit("")).isin(*KINDS) & F.col("source_metadata").isNotNull()
    if strict:
        good = F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad corpus row: "), F.coalesce("chunk_id", F.lit("?")))).cast("boolean"))
    return normalise(rows.where(good))


def first_filled(*values) -> Column:
    """The first value that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def normalise(rows: DataFrame) -> DataFrame:
    """Section, source document and year from the metadata."""
    at = lambda k: F.get_json_object("source_metadata", f"$.{k}")
    doc = F.when(F.col("source_type") == "abstract", first_filled(at("DOI"), at("doi"), at("title"))).otherwise(first_filled(at("file")))
    out = rows.withColumn("section_type", section_of(F.col("source_type"))).withColumn("source_doc_id", F.coalesce(doc, "chunk_id")).withColumn("year", year_of(at("year")))
    return complete(out)


def complete(rows: DataFrame) -> DataFrame:
    """All columns of the chunk schema, missing ones null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of("chunks")])


def read_chunks(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """By kind of path: a folder's CSVs, ``.csv``, ``.jsonl``/``.ndjson``, ``.parquet``; on any file system Spark knows."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise FileNotFoundError(path)
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        return read_csv(spark, path, strict)
    if name.endswith((".jsonl", ".ndjson")):
        return complete(spark.read.schema(schema_of("chunks")).json(path))
    if name.endswith(".parquet"):
        return complete(spark.read.parquet(path))
    if files.getFileStatus(place).isDirectory():
        if not any(s.getPath().getName().endswith(".csv") for s in files.listStatus(place)):
            raise ValueError(f"no CSV files in {path}")
        return read_csv(spark, f"{path.rstrip('/')}/*.csv", strict)
    raise ValueError(f"unknown kind of corpus: {path}")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schema_of("gold")).json(path)


def map_texts(chunks: DataFrame, mapper, schema: str) -> DataFrame:
    """Apply a picklable ``mapper(texts) -> rows`` (NER, language model, encoder) batch by batch next to chunk_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame(mapper(list(b["text"])))
            out.insert(0, "chunk_id", b["chunk_id"].to_numpy())
            yield out

    return chunks.select("chunk_id", "text").mapInPandas(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, {schema}")


def multi_get(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` in the order of ``ids(pos, key)``; unknown keys are left out, a key asked twice comes twice."""
    return ids.join(table, key).orderBy("pos")


def of_source_types(chunks: DataFrame, wanted: tuple[str, ...] | None = None, unwanted: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the wanted kinds of source (None: all) without the unwanted ones."""
    rows = chunks if wanted is None else chunks.where(F.col("source_type").isin(*wanted))
    return rows.where(~F.col("source_type").isin(*unwanted)) if unwanted else rows


def scan(table: DataFrame, batch_size: int) -> Iterator[list]:
    """All rows in batches for a client that pages; at most one partition is on the driver at a time."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    def batches() -> Iterator[list]:
        held: list = []
        for row in table.toLocalIterator():
            held.append(row)
            if len(held) == batch_size:
                yield held
                held = []
        if held:
            yield held

    return batches()


def skipped_rows(chunks: DataFrame) -> DataFrame:
    """One row: chunks in all, and those without any text."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_skipped"))


def embed(chunks: DataFrame, encode: Column, only_missing: bool = True) -> DataFrame:
    """Fill ``embedding`` from ``encode`` (an expression or pandas UDF over the text); by default only where it is missing."""
    if not only_missing:
        return chunks.withColumn("embedding", encode)
    return chunks.withColumn("embedding", F.when(F.col("embedding").isNull() | (F.size("embedding") == 0), encode).otherwise(F.col("embedding")))


def cached(spark: SparkSession, source: str, folder: str, build) -> DataFrame:
    """``build(source)`` as a Parquet table below ``folder``, made anew when size or time of the source changes."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(source)
    files = path.getFileSystem(conf)
    if not files.exists(path):
        raise FileNotFoundError(source)
    parts = files.listStatus(path)
    mark = "-".join(f"{s.getLen()}.{s.getModificationTime()}" for s in parts)
    table = f"{folder.rstrip('/')}/{hashlib.sha256(f'{source}|{mark}'.encode()).hexdigest()[:16]}"
    done = jvm.org.apache.hadoop.fs.Path(f"{table}/_SUCCESS")
    if not done.getFileSystem(conf).exists(done):
        build(source).write.mode("overwrite").parquet(table)
    return spark.read.parquet(table)
