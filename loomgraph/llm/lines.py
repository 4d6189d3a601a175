"""Operator 2, line dedup over levelled sorted runs of line hashes.

A batch of texts names each distinct line key it holds, with the number of its texts
that hold it, to the hash bucket that owns the key. Per bucket these become one sorted
run of level 0. When a level has ``fanout`` runs they are merged into one run of the next
level, counts added. To filter a batch, its sorted keys are merged with the runs of each
bucket, and the bucket replies one bit per key: drop or keep. So only packed hashes meet
in a bucket, buckets stay equal in size however often one line occurs, and a line held
by a third of all texts costs one entry per block of texts.

``LineRuns`` serves continuous use: ``add`` and ``filter`` batch by batch, against all
texts added so far. With a ``folder`` it is durable: every change of the levels is a new
manifest (a Parquet table that names the runs of each level), written after the runs
it names and before those it no longer names are deleted, so a driver that was lost goes on from the
last complete manifest. ``drop_common_lines`` adds all batches of a table first and
filters afterwards, so that every text is judged by the whole table.

A key is the line without white space at its ends, A-Z lower-cased; keys are told apart
by 128-bit hashes. Nulls: a null or empty text is one empty line, whose key is too short
to count. A null id is kept. Rows are counted, not ids: repeated rows are texts of their own. An empty table
gives an empty result. Other columns travel untouched, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, LOWER, Workspace, as_bytes, buckets, by_bucket, pack, smallest, unpack
from .words import batches_of

#: Runs of one level that are merged into one of the next.
FANOUT = 3
_KEYS = "block long, bucket int, payload binary"


def _pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _line_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines, and each line's 16-byte key (None where the key is too short)."""
    lines = (text or b"").split(b"\n")
    keys = []
    for line in lines:
        key = line.strip(BLANKS)
        if len(key) < least or (least > 1 and len(key.decode()) < least):
            keys.append(None)
        else:
            keys.append(xxhash.xxh3_128_digest(key.translate(LOWER)))
    return lines, keys


def _sorted_keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)
    return raw[:, 0], raw[:, 1]


def _order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.lexsort((low, high))


def _read_blocks(text_at: int, n_buckets: int, least: int, piece: int):
    """Blocks of rows (kind 0), and the sorted keys of a block by bucket (kind 1)."""
    schema = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        for table in batches_of(batches, piece):
            counts: dict[bytes, int] = {}
            for text in as_bytes(table.column(text_at)):
                for key in set(_line_keys(text, least)[1]):
                    if key is not None:
                        counts[key] = counts.get(key, 0) + 1
            rows = [(block, 0, -1, _pack_table(table))]
            if counts:
                high, low = _sorted_keys(list(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                bucket = (low % np.uint64(n_buckets)).astype(np.int64)
                order = np.lexsort((low, high, bucket))
                high, low, n, bucket = high[order], low[order], n[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(n_buckets + 1))
                rows += [(block, 1, b, pack(high[i:j], low[i:j], smallest(n[i:j]))) for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)
            block += 1

    return run


def merge_sorted(one: tuple, two: tuple) -> tuple:
    """Two sorted runs (high, low, count) into one; equal keys add their counts."""
    at, to = np.searchsorted(one[0], two[0], "left"), np.searchsorted(one[0], two[0], "right")
    # Where 64 bits tie, the other 64 decide; ties are few, as keys are hashes.
    for i in np.flatnonzero(to > at).tolist():
        at[i] += np.searchsorted(one[1][at[i] : to[i]], two[1][i], "left")
    place = at + np.arange(len(at))
    mine = np.ones(len(one[0]) + len(at), bool)
    mine[place] = False
    high, low, n = (np.empty(len(mine), np.int64 if k == 2 else np.uint64) for k in range(3))
    for out, x, y in zip((high, low, n), one, two, strict=True):
        out[mine], out[place] = x, y
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[first], low[first], np.add.reduceat(n, first)


def _merge_runs(table: pa.Table) -> pa.Table:
    """Sorted runs of one bucket into one, always the two shortest first."""
    runs = [tuple(unpack(p)) for p in table.column("payload").to_pylist()]
    heap = [(len(r[0]), i, r) for i, r in enumerate(runs)]
    heapify(heap)
    while len(heap) > 1:
        a, b = heappop(heap), heappop(heap)
        merged = merge_sorted(a[2], b[2])
        heappush(heap, (len(merged[0]), a[1], merged))
    high, low, n = heap[0][2]
    return pa.table({"block": pa.array([-1], pa.int64()), "bucket": table.column("bucket").slice(0, 1).combine_chunks(), "payload": pa.array([pack(high, low, smallest(n))], pa.binary())})


def _anti_join(min_texts: int):
    """One bucket: asked keys (block >= 0) against runs (block -1); replies a bit per asked key, set where it must go."""

    def run(table: pa.Table) -> pa.Table:
        blocks, parts = table.column("block").to_pylist(), [unpack(p) for p in table.column("payload").to_pylist()]
        high, low = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        weight = np.concatenate([p[2].astype(np.int64) * (b < 0) for b, p in zip(blocks, parts, strict=True)])
        order = _order(high, low)
        h, v = high[order], low[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (v[1:] != v[:-1])])
        total = np.add.reduceat(weight[order], np.flatnonzero(head))
        drop = np.empty(len(h), bool)
        drop[order] = (total >= min_texts)[np.cumsum(head) - 1]
        ends = np.cumsum([len(p[0]) for p in parts])
        asked = [(b, drop[e - len(p[0]) : e]) for b, p, e in zip(blocks, parts, ends, strict=True) if b >= 0]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"block": pa.array([b for b, _ in asked], pa.int64()), "bucket": pa.array([bucket] * len(asked), pa.int32()), "payload": pa.array([pack(np.packbits(d)) for _, d in asked], pa.binary())})

    return run


def _rewrite(text_at: int, n_buckets: int, least: int, schema: pa.Schema):
    """One block: its rows with the remaining lines; lines before, lines dropped."""

    def run(table: pa.Table) -> pa.Table:
        bucket, payload = table.column("bucket").to_pylist(), table.column("payload").to_pylist()
        replies = {b: np.unpackbits(unpack(p)[0]).astype(bool) for b, p in zip(bucket, payload, strict=True) if b >= 0}
        rows = _unpack_table(payload[bucket.index(-1)])
        split = [_line_keys(text, least) for text in as_bytes(rows.column(text_at))]
        distinct = list({k for _, keys in split for k in keys if k is not None})
        gone = set()
        if distinct:
            high, low = _sorted_keys(distinct)
            owner = (low % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((low, high, owner))
            edges = np.searchsorted(owner[order], np.arange(n_buckets + 1))
            for b, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if j > i:
                    gone.update(distinct[x] for x in order[i:j][replies[b][: j - i]].tolist())
        kept, before, dropped = [], [], []
        for lines, keys in split:
            stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone] if not gone.isdisjoint(keys) else lines
            kept.append(b"\n".join(stay))
            before.append(len(lines))
            dropped.append(len(lines) - len(stay))
        columns = [c.combine_chunks() for c in rows.columns]
        columns[text_at] = pa.array(kept, pa.binary()).cast(schema.field(text_at).type)
        columns += [pa.array(before, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


class LineRuns:
    """Sorted runs of line keys, by level, each a Parquet table of one row per bucket.

    Without ``folder`` the runs live as long as the session; with one (shared by all
    executors) they are durable, and the same folder opened again goes on where its last
    manifest stood. The number of buckets is fixed by the first manifest.
    """

    def __init__(self, spark, least: int = 1, min_texts: int = 10, fanout: int = FANOUT, piece: int = 4_000_000, folder: str | None = None):
        self.spark, self.durable, self.n = spark, folder is not None, buckets(spark)
        self.ws = Workspace(spark, "lines", folder)
        self.least, self.min_texts, self.fanout, self.piece = least, min_texts, fanout, piece
        self.levels: list[list[str]] = []
        self._version = -1
        if folder is not None:
            self._open()

    def _open(self) -> None:
        """Take over the newest manifest that was written to its end."""
        versions = [int(name.removeprefix("manifest-")) for name in self.ws.tables() if name.startswith("manifest-") and self.ws.complete(name)]
        if versions:
            self._version = max(versions)
            rows = self.spark.read.schema("level int, nth int, run string, buckets int").parquet(self.ws.path(f"manifest-{self._version}")).orderBy("level", "nth").collect()
            self.n = rows[0].buckets
            for r in rows:
                while len(self.levels) <= r.level:
                    self.levels.append([])
                if r.run:
                    self.levels[r.level].append(r.run)

    def _publish(self, levels: list[list[str]]) -> None:
        """Make ``levels`` the runs in force; then delete what they no longer name."""
        gone = {run for level in self.levels for run in level} - {run for level in levels for run in level}
        if self.durable:
            self._version += 1
            rows = [(i, k, run, self.n) for i, level in enumerate(levels) for k, run in enumerate(level or [""])]
            self.ws.write(self.spark.createDataFrame(rows, "level int, nth int, run string, buckets int").coalesce(1), f"manifest-{self._version}")
            self.ws.drop(f"manifest-{self._version - 2}")
        self.levels = levels
        for run in gone:
            self.ws.drop(run)

    def _write(self, df: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        self.ws.write(df, name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(_KEYS).parquet(self.ws.path(name))

    def read(self, docs: DataFrame, text: str) -> DataFrame:
        """Cut a batch into blocks, written once; both ``add_blocks`` and ``filter_blocks`` take it."""
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
        at = docs.columns.index(text)
        found = plain.mapInArrow(_read_blocks(at, self.n, self.least, self.piece), "block long, kind int, bucket int, payload binary")
        return self.ws.write(found, f"blocks-{uuid.uuid4().hex}", "kind")

    def _merge(self, keys: DataFrame) -> DataFrame:
        return by_bucket(keys, self.n).applyInArrow(_merge_runs, _KEYS)

    def add_blocks(self, blocks: DataFrame, which: str = "true") -> None:
        """Add a batch's keys as a run of level 0, then compact every level that is full."""
        levels = [list(level) for level in self.levels]
        level, run = 0, self._write(self._merge(blocks.where("kind = 1").where(which).select("block", "bucket", "payload")))
        passing = []
        while True:
            if len(levels) == level:
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                break
            runs, levels[level] = levels[level], []
            keys = self._run(runs[0])
            for other in runs[1:]:
                keys = keys.union(self._run(other))
            passing += runs
            run, level = self._write(self._merge(keys)), level + 1
        self._publish(levels)
        for name in passing:
            self.ws.drop(name)

    def filter_blocks(self, blocks: DataFrame, docs: DataFrame, text: str) -> DataFrame:
        """Rows of the batch with their remaining lines, and two more columns: n_lines, n_dropped."""
        from pyspark.sql.pandas.types import to_arrow_schema

        at = docs.columns.index(text)
        keys = blocks.where("kind = 1").select("block", "bucket", "payload")
        for level in self.levels:
            for run in level:
                keys = keys.union(self._run(run))
        replies = self.ws.write(by_bucket(keys, self.n).applyInArrow(_anti_join(self.min_texts), _KEYS), f"replies-{uuid.uuid4().hex}")
        plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).schema
        out = T.StructType([*plain.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        both = blocks.where("kind = 0").select("block", "bucket", "payload").union(replies)
        return both.groupBy("block").applyInArrow(_rewrite(at, self.n, self.least, to_arrow_schema(out)), out)

    def add(self, docs: DataFrame, text: str = "text") -> None:
        self.add_blocks(self.read(docs, text))

    def filter(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The batch's rows without lines that ``min_texts`` of the texts added so far hold; columns as in ``docs``."""
        rows = self.filter_blocks(self.read(docs, text), docs, text)
        return rows.drop("n_lines", "n_dropped").toDF(*docs.columns)


def drop_common_lines(docs: DataFrame, text: str = "text", least: int = 1, min_texts: int = 10, batches: int = 3) -> DataFrame:
    """All rows without the lines that at least ``min_texts`` rows hold.

    Columns are c0, c1, ... in the order of ``docs``, then n_lines (before) and n_dropped.
    """
    runs = LineRuns(docs.sparkSession, least, min_texts)
    blocks = runs.read(docs, text)
    for i in range(batches):
        runs.add_blocks(blocks, f"pmod(xxhash64(block), {batches}) = {i}")
    return runs.filter_blocks(blocks, docs, text)


def without_common_lines(docs: DataFrame, text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """``docs`` with the remaining lines as text; a column ``n_chars`` follows the new text. A null text becomes an empty one."""
    rows = drop_common_lines(docs, text, **options)
    names = docs.columns
    t = F.col(f"c{names.index(text)}")
    out = []
    for i, name in enumerate(names):
        c = F.col(f"c{i}")
        if name == n_chars and name != text:
            c = F.length(t).cast(docs.schema[i].dataType)
        out.append(c.alias(name))
    return rows.select(*out)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = drop_common_lines(docs)
    return rows.select(F.col("c0").alias("doc_id"), "n_lines", "n_dropped", F.sha2("c1", 256).alias("kept_sha256"))


OP2_SQL = """
WITH r AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
l AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM r),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r, doc_id
"""
