"""Shared parts of the corpus operators.

Texts travel as UTF-8 bytes through ``mapInArrow`` so that splitting, lower-casing of
``A-Z`` and hashing run at C speed without decoding. Intermediate results are written as
Parquet tables below the cluster's shared folder (``spark.checkpoint.dir``); a lost
executor is replaced by recomputing one stage, never the whole query.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes table that lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes table that also turns ASCII other than digits and letters into a blank.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: White space of the line and word contracts: blank, tab, line feed, VT, FF, CR.
BLANKS = b" \t\n\x0b\x0c\r"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one is set in local mode; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not (spark.conf.get("spark.master", "local").split("[")[0] == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Tables of one query run, in a folder of its own below the shared folder."""

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark = spark
        self.root = folder.rstrip("/") if folder else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def _files(self, table: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(table) if table else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def tables(self) -> list[str]:
        files, root = self._files("")
        return [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []

    def complete(self, table: str) -> bool:
        """Whether a table was written to its end."""
        files, path = self._files(f"{table}/_SUCCESS")
        return files.exists(path)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str, *partition_by: str) -> DataFrame:
        """Write ``df`` once and return a scan of what was written. Shuffle files of the write are released."""
        with released_shuffles(self.spark):
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(table))
        return self.read(table, df)

    def read(self, table: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        """Remove a table that nothing returned still reads."""
        files, path = self._files(table)
        files.delete(path, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets: as many as shuffle partitions, which the cluster sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spark_hash(values: np.ndarray) -> np.ndarray:
    """Spark's hash of ints (Murmur3, seed 42), as signed 32-bit numbers."""
    mask = np.uint64(0xFFFFFFFF)
    turn = lambda x, r: ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & mask
    k = (values.astype(np.uint64) & mask) * np.uint64(0xCC9E2D51) & mask
    k = turn(k, 15) * np.uint64(0x1B873593) & mask
    h = (turn(np.uint64(42) ^ k, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & mask
    h ^= np.uint64(4)
    h = (h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B) & mask
    h = (h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35) & mask
    return (h ^ (h >> np.uint64(16))).astype(np.uint32).view(np.int32)


def even_keys(n: int) -> list[int]:
    """One int per partition that hash partitioning into ``n`` sends there."""
    found = np.full(n, -1, np.int64)
    at, step = 0, 64 * n
    while (found < 0).any():
        values = np.arange(at, at + step)
        place = spark_hash(values) % n
        fresh, first = np.unique(place, return_index=True)
        new = found[fresh] < 0
        found[fresh[new]] = values[first[new]]
        at += step
    return found.tolist()


def by_bucket(df: DataFrame, n: int, number: Column | None = None):
    """``df`` grouped by bucket, exactly one bucket (``number``, below ``n``) to a partition."""
    number = F.col("bucket") if number is None else number
    keys = F.array(*[F.lit(k) for k in even_keys(n)])
    return df.withColumn("place", F.element_at(keys, (number + 1).cast("int"))).repartition(n, "place").groupBy("place")


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that other columns, whatever their names, never travel."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def pack(*arrays: np.ndarray) -> bytes:
    """Numeric arrays as one zstd frame, bytes of equal significance side by side."""
    head, body = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(f"{a.dtype.str}:{len(a)}")
        body.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    top = ",".join(head).encode()
    return len(top).to_bytes(4, "little") + top + zstandard.ZstdCompressor(level=1).compress(b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    size = int.from_bytes(data[:4], "little")
    body = zstandard.ZstdDecompressor().decompress(data[4 + size :])
    out, at = [], 0
    for part in data[4 : 4 + size].decode().split(","):
        kind, n = part.split(":")
        dtype, n = np.dtype(kind), int(n)
        raw = np.frombuffer(body, np.uint8, n * dtype.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(dtype.itemsize, n).T).view(dtype).reshape(n))
        at += n * dtype.itemsize
    return out


def smallest(counts: np.ndarray) -> np.ndarray:
    """The same counts in the narrowest unsigned type that holds them."""
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser over whole arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * _C1
    x = x ^ (x >> np.uint64(27))
    x = x * _C2
    return x ^ (x >> np.uint64(31))


def connected(spark: SparkSession, edges: DataFrame, workspace: Workspace, name: str) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, root)`` with the smallest node as root.

    Alternates large-star and small-star steps; every round is written as a table, so
    lineage stays short and no component is ever gathered in one task. A node's
    neighbours are reduced with ``min`` before they meet, so a hub costs one row per edge.
    Nodes without an edge do not appear. Empty edges give an empty result.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = workspace.write(pairs, f"{name}-0")
    k, before = 0, None
    while True:
        k += 1
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        pairs = workspace.write(small, f"{name}-{k}")
        workspace.drop(f"{name}-{k - 1}")
        # A star forest is the fixed point: then every node points at its root and the edge set repeats.
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())


def remove_local(path: str) -> None:
    """Delete a folder that ``shared_folder`` made for a test session."""
    shutil.rmtree(Path(path.removeprefix("file://")), ignore_errors=True)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster than hashing for long integer arrays."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]
