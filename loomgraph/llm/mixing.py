"""Operator 10, mixing sources to target weights by Sainte-Lague apportionment.

Every source's tokens are cut into blocks of (nearly) ``block`` tokens, per shard; a
shard holds some millions of tokens of one source, so no task holds a whole source.

1. Targets: the total is shared by weight; a target above ``cap`` times its source's size
   stops there and the excess is reshared by weight until none is above.
2. Seats: each source is due ``target / size * blocks`` blocks. Sainte-Lague (highest
   quotients ``v / (2 s + 1)``) turns these votes into whole quotas for the sources, and
   each source's quota into quotas of its shards.
3. Blocks: a quota above the shard's number of blocks takes all of them so often as it
   goes; the rest goes to the blocks that come first by a seeded hash.

A row takes the tokens of its text that lie in taken blocks, repeats counted. It follows
that no row is taken more than ``cap`` times. Reruns agree: all depends on ids, sizes,
sources and the seed. Only ids and sizes are shuffled, never texts.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null id
counts as the number 0 in the order of its shard. Repeated rows are taken each by the
place it has. An empty table gives an empty result, size 0 everywhere targets of 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, texts

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int, limit: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients ``v / (2 s + 1)``; ties go to the earlier entry. ``limit`` bounds an entry's seats."""
    votes = np.asarray(votes, np.float64)
    limit = np.full(len(votes), np.iinfo(np.int64).max) if limit is None else np.asarray(limit)
    seats = int(min(seats, limit[votes > 0].sum() if (limit < np.iinfo(np.int64).max).all() else seats))
    if not len(votes) or votes.sum() <= 0 or seats <= 0:
        return np.zeros(len(votes), np.int64)
    at = lambda d: np.minimum(np.floor(votes / d + 0.5), limit).astype(np.int64)
    low, high = votes.sum() / (seats + len(votes)) / 2, 2 * votes.max() + 1
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if at(middle).sum() >= seats else (low, middle)
    given = at(high)
    while given.sum() < seats:  # entries whose quotients tie at the last seats
        quotient = np.where(given < limit, votes / (2 * given + 1), -1)
        given[int(np.argmax(quotient))] += 1
    return given


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with its rank (from 0) in a total order, without moving all rows to one task."""
    spark = df.sparkSession
    ws = Workspace(spark, "ranked")
    parts = ws.write(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "parts")
    before = parts.groupBy("__part").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return parts.join(before, "__part").withColumn("rank", rank + F.col("__before")).drop("__part", "__n", "__before")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """``sources(source, source_size)`` with ``weight`` and ``target``."""
    spark = sources.sparkSession
    ws = Workspace(spark, "targets")
    nth = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    table = ws.write(ranked(sources, F.col("source").isNull(), F.col("source")).select("source", "source_size", nth.alias("weight")), "sources")
    level, before = 0.0, -1.0
    ceiling = F.lit(cap) * F.col("source_size")
    while level > before:  # the level rises until no further target meets its ceiling
        before = level
        full = F.col("weight") * F.lit(level) >= ceiling
        r = table.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, ceiling)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        if not r["all"] or not r["w"]:
            break
        level = max(level, (r["all"] - (r["held"] or 0.0)) / r["w"])
    return table.withColumn("target", F.least(F.col("weight") * F.lit(level), ceiling).cast("double"))


def _quotas_of_sources(sources: DataFrame, steps: int = 32, rounds: int = 9) -> DataFrame:
    """Sainte-Lague over all sources: the divisor is narrowed by distributed sums of seats; ties at the last seats go by name."""
    votes = F.col("votes")
    total = sources.agg(F.sum(F.round("votes").cast("double")).alias("v"), F.sum("votes").alias("x"), F.max("votes").alias("m")).first()
    if not total["x"]:
        return sources.withColumn("quota", F.lit(0).cast("long"))
    seats = round(total["x"])
    low, high = 0.25, 2 * total["m"] + 1
    given = lambda d: F.least(F.floor(votes / F.lit(d) + 0.5), F.col("most"))
    for _ in range(rounds):
        ds = [low * (high / low) ** (i / steps) for i in range(1, steps)]
        sums = sources.agg(*[F.sum(given(d)).alias(f"s{i}") for i, d in enumerate(ds)]).first()
        enough = [d for i, d in enumerate(ds) if (sums[f"s{i}"] or 0) >= seats]
        few = [d for d in ds if d not in enough]
        low, high = (max(enough) if enough else low), (min(few) if few else high)
    fixed = sources.withColumn("quota", given(high).cast("long"))
    missing = seats - (fixed.agg(F.sum("quota")).first()[0] or 0)
    if missing <= 0:
        return fixed
    close = fixed.where("quota < most").orderBy((votes / (2 * F.col("quota") + 1)).desc(), F.col("source").isNull(), "source").limit(int(missing)).select(F.col("source").alias("__s"), F.lit(1).alias("__more"))
    return fixed.join(close, fixed["source"].eqNullSafe(close["__s"]), "left").withColumn("quota", F.col("quota") + F.coalesce("__more", F.lit(0))).drop("__s", "__more")


def _take(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "id", "size"], kind="stable")
        size = rows["size"].to_numpy(np.int64)
        n, quota = int(rows["n_blocks"].iloc[0]), int(rows["quota"].iloc[0])
        ends = np.cumsum(size)
        total = int(ends[-1])
        edges = (np.arange(n + 1) * total) // n
        times = np.full(n, quota // n, np.int64)
        rest = quota % n
        if rest:
            name = f"{seed}:{rows['source_key'].iloc[0]}:{rows['shard'].iloc[0]}:"
            luck = np.fromiter((xxhash.xxh3_64_intdigest(name + str(i)) for i in range(n)), np.uint64, n)
            times[np.argsort(luck, kind="stable")[:rest]] += 1
        sofar = np.concatenate([[0], np.cumsum(times * np.diff(edges))])

        def upto(x: np.ndarray) -> np.ndarray:
            b = np.minimum(np.searchsorted(edges, x, "right") - 1, n - 1)
            return sofar[b] + times[b] * (x - edges[b])

        return pd.DataFrame({"row": rows["row"].to_numpy(), "taken": upto(ends) - upto(ends - size)})

    return run


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, block: int = 256, shard_tokens: int = 2_000_000, seed: int = 1) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target (its source's), taken."""
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    rows = texts(docs, doc_id, text, source).toDF("doc_id", "text", "source").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    place = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = ws.write(rows.select("doc_id", "source", "size", place.alias("place"), F.monotonically_increasing_id().alias("row")), "rows")
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sized = ws.write(sized.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)).cast("int")), "targets")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    placed = rows.where("size > 0").join(sized, same(rows, sized)).select(rows["source"], "doc_id", "size", "place", "row", F.pmod(F.shiftright("place", 20), F.col("n_shards")).cast("int").alias("shard"))
    placed = ws.write(placed.withColumn("source_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-"))), "placed")
    shards = placed.groupBy("source_key", "source", "shard").agg(F.sum("size").alias("tokens")).withColumn("n_blocks", F.greatest(F.lit(1), F.round(F.col("tokens") / block)).cast("long"))
    shards = ws.write(shards, "shards")
    blocks = shards.groupBy("source").agg(F.sum("n_blocks").alias("blocks"))
    due = sized.join(blocks, same(sized, blocks)).select(sized["source"], (F.col("target") / F.col("source_size") * F.col("blocks")).alias("votes"), (F.col("blocks") * cap).cast("long").alias("most"))
    quotas = ws.write(_quotas_of_sources(ws.write(due, "due")), "quotas")

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        n = pdf["n_blocks"].to_numpy(np.int64)
        return pd.DataFrame({"source_key": pdf["source_key"], "shard": pdf["shard"], "n_blocks": n, "quota": sainte_lague(n, int(pdf["quota"].iloc[0]), (n * cap).astype(np.int64))})

    shares = shards.join(quotas, same(shards, quotas)).select("source_key", "shard", "n_blocks", "quota").groupBy("source_key").applyInPandas(share, "source_key string, shard int, n_blocks long, quota long")
    shares = ws.write(shares, "shares")
    chosen = placed.join(shares, ["source_key", "shard"]).select("source_key", "shard", "row", "size", "place", F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("id"), "n_blocks", "quota")
    taken = chosen.groupBy("source_key", "shard").applyInPandas(_take(seed), "row long, taken long")
    facts = rows.join(sized, same(rows, sized)).select("row", "doc_id", rows["source"], "size", "source_size", "target")
    return facts.join(taken, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op10_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).drop("source")
