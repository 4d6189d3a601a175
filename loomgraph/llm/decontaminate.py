"""Operator 7, benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``width`` consecutive words of benchmark items; an item of fewer
words is one window. Windows of one length form one automaton over blocks of two words:

* the shift table tells how far the end of a window may move when the block read there
  occurs nowhere, or only earlier, in any window; most positions are never read;
* blocks that end a window lead to a bucket of windows by the suffix block, parted by
  their first two words;
* the windows left are compared with the text word by word.

All texts of a batch advance together, one array step per read position. Words are
numbered by the patterns' vocabulary (by 64-bit hash); other words match nothing.

Windows are counted first. Up to ``part_windows`` of them make one set of automata, which
is sent to all tasks; more are parted by hash into sets of that size, and the texts are
searched once per set, so that what is sent at a time stays bounded however large the
benchmark is. The places hit and the items found are added up per row.

Nulls: a null text has no words, a null item none either; windows of items without an id
are searched like others, but only ids that are known are counted and listed.
Repeated items count once. Repeated rows are judged each for itself. Empty tables: no
texts, no rows; no items, nothing is hit. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, texts
from .words import batches_of, words_of

#: Words that texts are cut into for the common advance; cuts overlap, so nothing is lost.
SEGMENT = 2048


class Automaton:
    """Wu-Manber tables for windows of one length, as rows of vocabulary numbers."""

    def __init__(self, windows: np.ndarray, vocabulary: int):
        self.windows, self.v = windows, np.int64(vocabulary)
        self.m = windows.shape[1]
        self.b = min(2, self.m)
        codes, shifts = [], []
        for end in range(self.b - 1, self.m):
            codes.append(self.code(windows, end))
            shifts.append(np.full(len(windows), self.m - 1 - end))
        code, shift = np.concatenate(codes), np.concatenate(shifts)
        order = np.lexsort((shift, code))
        code, shift = code[order], shift[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])
        #: Blocks that occur, and the shift each allows; other blocks allow ``far``.
        self.blocks, self.shifts, self.far = code[first], shift[first], self.m - self.b + 1
        suffix, prefix = self.code(windows, self.m - 1), self.code(windows, self.b - 1)
        order = np.lexsort((prefix, suffix))
        self.windows, self.number = windows[order], order
        self.suffix, self.prefix = suffix[order], prefix[order]

    def code(self, rows: np.ndarray, end: int) -> np.ndarray:
        last = rows[:, end].astype(np.int64)
        return last if self.b == 1 else rows[:, end - 1].astype(np.int64) * self.v + last

    def _code_at(self, ids, at: np.ndarray) -> np.ndarray:
        last = ids(at)
        if self.b == 1:
            return last
        before = ids(at - 1)
        return np.where((last < 0) | (before < 0), -1, before * self.v + last)

    def search(self, ids, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start position and window number of every occurrence. ``ids(positions)`` numbers words; ``first`` bounds the texts."""
        lengths = np.diff(first)
        pieces = np.maximum(-(-np.maximum(lengths - self.m + 1, 0) // SEGMENT), 0)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[:-1][text] + nth * SEGMENT + self.m - 1
        stop = np.minimum(at + SEGMENT, first[1:][text])
        starts, found = [], []
        while len(at):
            code = self._code_at(ids, at)
            slot = np.minimum(np.searchsorted(self.blocks, code), len(self.blocks) - 1)
            shift = np.where(self.blocks[slot] == code, self.shifts[slot], self.far)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                begin = at[hit] - self.m + 1
                lo, hi = np.searchsorted(self.suffix, code[hit], "left"), np.searchsorted(self.suffix, code[hit], "right")
                each = np.repeat(np.arange(len(hit)), hi - lo)
                window = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
                head = self._code_at(ids, begin + self.b - 1)
                same = head[each] == self.prefix[window]
                each, window = each[same], window[same]
                for k in range(self.m):
                    same = ids(begin[each] + k) == self.windows[window, k]
                    each, window = each[same], window[same]
                starts.append(begin[each])
                found.append(self.number[window])
            at = at + np.maximum(shift, 1)
            more = at < stop
            at, stop = at[more], stop[more]
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(found)


class Patterns:
    """All windows by length, and the items of each window."""

    def __init__(self, windows: list[tuple[list[int], list[str]]]):
        words = sorted({h for w, _ in windows for h in w})
        self.vocabulary = np.array(words, np.int64).view(np.uint64)
        order = np.argsort(self.vocabulary)
        self.vocabulary = self.vocabulary[order]
        number = {int(h): i for i, h in enumerate(self.vocabulary.view(np.int64).tolist())}
        self.automata, self.items = [], []
        for m in sorted({len(w) for w, _ in windows}):
            some = [(w, i) for w, i in windows if len(w) == m]
            self.automata.append(Automaton(np.array([[number[h] for h in w] for w, _ in some], np.int64), len(words) + 1))
            self.items.append([i for _, i in some])

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set]]:
        """Whether each word is hit, and the items that occur in each text."""
        n = len(first) - 1
        items: list[set] = [set() for _ in range(n)]
        if not len(self.vocabulary):
            return np.zeros(len(h), bool), items

        def ids(at: np.ndarray) -> np.ndarray:
            word = h[at]
            slot = np.minimum(np.searchsorted(self.vocabulary, word), len(self.vocabulary) - 1)
            return np.where(self.vocabulary[slot] == word, slot, -1)

        cover = np.zeros(len(h) + 1, np.int32)
        for automaton, owners in zip(self.automata, self.items, strict=True):
            starts, window = automaton.search(ids, first)
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + automaton.m, -1)
            text = np.searchsorted(first, starts, "right") - 1
            for t, w in set(zip(text.tolist(), window.tolist(), strict=True)):
                items[t].update(owners[w])
        return np.cumsum(cover[:-1]) > 0, items


def _per_text(hit: np.ndarray, first: np.ndarray) -> np.ndarray:
    covered = np.concatenate([[0], np.cumsum(hit)])
    return covered[first[1:]] - covered[first[:-1]]


def benchmark_windows(benchmark: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """Distinct windows (word hashes) with the ids, as text, of the items that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, _, _, first = words_of(batch.column(1), alnum=True)
            h = h.view(np.int64)
            names, rows = [], []
            for name, i, j in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if j > i:
                    some = np.lib.stride_tricks.sliding_window_view(h[i:j], min(width, j - i))
                    rows += some.tolist()
                    names += [name] * len(some)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(rows, pa.list_(pa.int64()))], names=["item", "words"])

    items = texts(benchmark, item_id, text).toDF("item", "text").withColumn("item", F.col("item").cast("string"))
    found = items.mapInArrow(run, "item string, words array<long>").distinct()
    return found.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _out(schema: T.StructType) -> T.StructType:
    plain = [T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(schema.fields)]
    return T.StructType([*plain, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])


def _sent(spark: SparkSession, windows: DataFrame):
    return spark.sparkContext.broadcast(Patterns([(r.words, r.items) for r in windows.toLocalIterator()]))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, part_windows: int = 500_000, piece: int = 4_000_000) -> DataFrame:
    """All rows: columns c0, c1, ... in the order of ``docs``, then n_words, n_hit and items (sorted ids, as text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, at = docs.sparkSession, docs.columns.index(text)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    ws = Workspace(spark, "decontaminate")
    windows = ws.write(benchmark_windows(benchmark, item_id, item_text, width), "windows")
    parts = -(-windows.count() // part_windows)
    if parts > 1:
        return _in_parts(plain, windows, parts, at, piece, ws)
    patterns = _sent(spark, windows)
    out = _out(plain.schema)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, piece):
            h, _, _, first = words_of(table.column(at), alnum=True)
            hit, items = patterns.value.hits(h, first)
            columns = [c.combine_chunks() for c in table.columns] + [pa.array(np.diff(first)), pa.array(_per_text(hit, first)), pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches()

    return plain.mapInArrow(run, out)


def _in_parts(plain: DataFrame, windows: DataFrame, parts: int, at: int, piece: int, ws: Workspace) -> DataFrame:
    """The same search with one set of automata after the other; only rows with a hit are kept between sets."""
    spark, names = plain.sparkSession, plain.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = words_of(batch.column(at + 1), alnum=True)[3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(first))], names=[*batch.schema.names, "n_words"])

    def search(patterns):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in batches_of(batches, piece):
                h, _, _, first = words_of(table.column(1), alnum=True)
                hit, items = patterns.value.hits(h, first)
                some = np.flatnonzero(_per_text(hit, first))
                places = [np.flatnonzero(hit[first[i] : first[i + 1]]) for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks().take(pa.array(some)), pa.array(places, pa.list_(pa.int64())), pa.array([sorted(items[i]) for i in some.tolist()], pa.list_(pa.string()))], names=["row", "places", "items"])

        return run

    numbered = ws.write(plain.select(F.monotonically_increasing_id().alias("row"), *names).mapInArrow(count, T.StructType([T.StructField("row", T.LongType(), False), *[T.StructField(f.name, f.dataType) for f in plain.schema], T.StructField("n_words", T.LongType())])), "rows")
    found = None
    for k in range(parts):
        patterns = _sent(spark, windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == k))
        part = ws.write(numbered.select("row", names[at]).mapInArrow(search(patterns), "row long, places array<long>, items array<string>"), f"found-{k}")
        patterns.destroy()
        found = part if found is None else found.union(part)
    found = found.groupBy("row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return numbered.join(found, "row", "left").select(*names, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs."""
    rows = contaminated_words(docs, benchmark, **options).where("n_hit = 0")
    return rows.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)])


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.select(F.col("c0").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.k = bw.k),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots ON d.doc_id = spots.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
