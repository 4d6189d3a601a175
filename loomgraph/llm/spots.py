"""Operator 8, document fingerprints by SpotSigs.

A spot is a common word (anchor) with the chain of the next ``chain`` content words
(words that are no anchors). The set of a text's spots, as 32-bit hashes, is its
fingerprint; a text with words but without spots has one signature of all its words.
Fingerprints are compared by Jaccard similarity; their lengths bound it
(``min / max``), which prunes pairs that can't reach a threshold before sets are met.

``similar_spots`` is the join: fingerprints are partitioned by length, so that a partner
lies in the same or the next partition; within a partition rare spots lead to candidates
(the first ones in order of frequency that a partner must share), which are verified.
``compare_next`` compares each text with an edited form and with the next text by id;
rows are laid out by ranges of ids, and only the first row of a range travels twice.

Nulls: a null text is an empty one with an empty fingerprint; two empty fingerprints
have likeness 1, an empty and a filled one 0. Null ids come last, ordered by text hash;
rows of equal id likewise. Repeated rows stay and follow one another. A single row is its
own next. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, buckets, distinct, mix, texts
from .words import batches_of, words_of

#: Common words of several languages.
ANCHORS = tuple(
    "the of and in is it that was for on are as with be by this to from at or he an a not but have has had his her they we you "
    "der die das und ist den dem des ein eine zu mit auf für von im nicht sich auch als bei "
    "le la les de des du un une et est que qui dans pour sur en au aux par pas ce il elle "
    "el los las y es una del se por con para su al lo como más o".split()
)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def _anchor_hashes(anchors: tuple[str, ...]) -> np.ndarray:
    return np.sort(words_of(pa.array(sorted(set(anchors))))[0])


def fingerprints(column: pa.Array, anchors: tuple[str, ...] = ANCHORS, chain: int = 2) -> list[np.ndarray]:
    """Sorted distinct 32-bit spot hashes of each text."""
    h, _, _, first = words_of(column)
    n = len(first) - 1
    if not len(h):
        return [np.zeros(0, np.uint32)] * n
    known = _anchor_hashes(anchors)
    slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
    anchor = known[slot] == h
    content = np.flatnonzero(~anchor)
    text = np.repeat(np.arange(n), np.diff(first))
    spots = np.flatnonzero(anchor)
    sig = mix(h[spots] * _M[0])
    at = np.searchsorted(content, spots)
    whole = at + chain <= len(content)
    spots, sig, at = spots[whole], sig[whole], at[whole]
    if len(spots):
        inside = text[content[at + chain - 1]] == text[spots]
        spots, sig, at = spots[inside], sig[inside], at[inside]
    for k in range(chain):
        sig = mix(sig * _M[1] + h[content[at + k]]) if len(spots) else sig
    key = distinct((text[spots].astype(np.uint64) << np.uint64(32)) | (sig >> np.uint64(32)))
    edges = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = [low[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
    for i in np.flatnonzero((np.diff(edges) == 0) & (np.diff(first) > 0)).tolist():
        out[i] = np.array([xxhash.xxh3_64_intdigest(h[first[i] : first[i + 1]].tobytes()) & 0xFFFFFFFF], np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two fingerprints; 0 where the lengths alone keep it below ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def written(fingerprint: np.ndarray) -> str:
    """A fingerprint as text: its sorted 32-bit spots in base 64."""
    return base64.b64encode(fingerprint.astype("<u4").tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the first code points of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _placed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows by ranges of ids (``target``), in order; the first row of the next range follows as ``tail``."""
    spark = docs.sparkSession
    n = buckets(spark)
    rows = texts(docs, doc_id, text).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("h", F.xxhash64("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)], 10_000)).first()[0] if n > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), "right").astype(np.int32))

    # Null ids come last, cut by their texts' hashes.
    nulls = F.lit(len(cuts) + 33) + F.shiftright("h", 58).cast("int")
    placed = rows.withColumn("target", F.when(F.col("doc_id").isNull(), nulls).otherwise(place(F.coalesce("doc_id", F.lit(0).cast("long")))))
    # One small row per range reaches the driver: its first row's id and hash.
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "h")
    heads = placed.groupBy("target").agg(F.min(order).alias("head")).orderBy("target").collect()
    if not heads:
        return placed.withColumn("tail", F.lit(False))
    ring = [(r.head.none, r.head.id, r.head.h, heads[i - 1].target) for i, r in enumerate(heads)]
    small = F.broadcast(spark.createDataFrame(ring, "none boolean, id long, hh long, before int"))  # one row per range
    on = (placed.doc_id.isNull() == small.none) & (F.coalesce(placed.doc_id, F.lit(0).cast("long")) == small.id) & (placed.h == small.hh)
    tails = placed.join(small, on).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "h", F.col("before").alias("target"), F.lit(True).alias("tail"))
    both = placed.withColumn("tail", F.lit(False)).unionByName(tails)
    return both.repartition(n, "target").sortWithinPartitions("target", "tail", F.col("doc_id").isNull(), "doc_id", "h")


def compare_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int = 2, piece: int = 2_000_000) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    fields = [("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())]
    placed = _placed(docs, doc_id, text)
    out = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(*f) for f in fields]])

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        """All rows but the last of each range; the last one is the tail."""
        pairs = [i for i in range(len(rows) - 1) if rows[i][2] == rows[i + 1][2] and not rows[i][3]]
        own = fingerprints(pa.array([r[1] for r in rows], pa.string()), chain=chain)
        new = [edited(rows[i][1], rows[i + 1][1]) for i in pairs]
        other = fingerprints(pa.array(new, pa.string()), chain=chain)
        columns = [
            pa.array([rows[i][0] for i in pairs], pa.int64()),
            pa.array([len(rows[i][1]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array([written(own[i]) for i in pairs], pa.string()),
            pa.array([written(f) for f in other], pa.string()),
            pa.array([likeness(own[i], f) for i, f in zip(pairs, other, strict=True)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in pairs], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for table in batches_of(batches, piece):
            held += zip(*[table.column(c).to_pylist() for c in ("doc_id", "text", "target", "tail")], strict=True)
            yield flush(held)
            held = held[-1:]

    return placed.select("doc_id", "text", "target", "tail").mapInArrow(run, out)


def similar_spots(docs: DataFrame, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", chain: int = 2) -> DataFrame:
    """Pairs of representatives of equal fingerprints (a, b: fingerprint hashes) with likeness >= threshold, and nothing twice.

    Columns: a, b, likeness. ``fingerprint_members`` tells which rows share a fingerprint.
    """
    spark = docs.sparkSession
    ws, n = Workspace(spark, "spots"), buckets(spark)
    sets = fingerprint_members(docs, doc_id, text, chain).where("size(spots) > 0").dropDuplicates(["fp"]).select("fp", "spots", F.size("spots").alias("n"))
    # Partition p holds lengths in [g^p, g^(p+1)) with g = 1 / threshold: partners lie in p or p + 1.
    part = F.floor(F.log(F.col("n")) / float(np.log(1 / threshold)) + 1e-9).cast("int")
    sets = ws.write(sets.withColumn("part", part), "sets")
    spots = sets.select("fp", "n", "part", F.explode("spots").alias("spot"))
    ranked = spots.join(spots.groupBy("spot").agg(F.count("*").alias("df")), "spot")
    heads = ranked.groupBy("fp", "n", "part").agg(F.sort_array(F.collect_list(F.struct("df", "spot"))).alias("all")).select("fp", "n", "part", F.explode(F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))).alias("x")).select("fp", "n", "part", F.col("x.spot").alias("spot"))
    heads = ws.write(heads, "heads")
    left, right = heads.toDF("a", "na", "pa", "spot"), heads.toDF("b", "nb", "pb", "spot")
    near = (F.col("pb") - F.col("pa")).isin(0, 1) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
    pairs = left.join(right, "spot").where(near).select("a", "b").distinct()
    one, two = sets.select(F.col("fp").alias("a"), F.col("spots").alias("sa")), sets.select(F.col("fp").alias("b"), F.col("spots").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(one, "a").join(two, "b").withColumn("likeness", common / (F.size("sa") + F.size("sb") - common))
    return met.where(F.col("likeness") >= threshold).select("a", "b", "likeness")


def fingerprint_members(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chain: int = 2) -> DataFrame:
    """Per row: doc_id, fp (hash of its fingerprint), spots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, 4_000_000):
            found = fingerprints(table.column(1), chain=chain)
            ids = [xxhash.xxh3_64_intdigest(f.tobytes()) for f in found]
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array([f.astype(np.int64).tolist() for f in found], pa.list_(pa.int64()))], names=["doc_id", "fp", "spots"])

    rows = texts(docs, doc_id, text).toDF("doc_id", "text")
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("fp", T.LongType()), T.StructField("spots", T.ArrayType(T.LongType()))]))


def op8_spot_signatures(spark, sf_dir: str) -> DataFrame:
    return compare_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
