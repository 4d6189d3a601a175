"""Chunks to shelves: direct, by see-also, by the deepest shelved ancestor, else the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve(ids: DataFrame, shelves: DataFrame, see_also: DataFrame, anc: DataFrame, root_id: str | None) -> DataFrame:
    """``ids(chunk_id, term_id)`` to ``(chunk_id, term_id, shelf_id, mode)``.

    ``shelves(shelf_id, term_id, depth)``; ``see_also(term_id, shelf_id)``. Terms are
    resolved once each, before they meet the chunks, so a hot term costs one look-up.
    Without a root, what nothing holds is dropped.
    """
    terms = ids.select("term_id").distinct()
    direct = shelves.select("term_id", F.col("shelf_id").alias("s1"))
    aliased = see_also.groupBy("term_id").agg(F.max("shelf_id").alias("s2"))
    # An ancestor counts by the shelf it is, else by the shelf that lists it.
    by_see = see_also.join(shelves.select("shelf_id", "depth"), "shelf_id").select(F.col("term_id").alias("ancestor"), "shelf_id", "depth", F.lit(1).alias("rank"))
    by_term = shelves.select(F.col("term_id").alias("ancestor"), "shelf_id", "depth", F.lit(0).alias("rank"))
    holder = by_term.union(by_see).groupBy("ancestor").agg(F.min(F.struct("rank", "shelf_id", "depth")).alias("h")).select("ancestor", "h.shelf_id", "h.depth")
    lifted = terms.join(anc, F.col("term_id") == F.col("term")).join(holder, "ancestor").groupBy("term_id").agg(F.min(F.struct((-F.col("depth")).alias("d"), "ancestor", "shelf_id")).alias("x")).select("term_id", F.col("x.shelf_id").alias("s3"))
    found = terms.join(direct, "term_id", "left").join(aliased, "term_id", "left").join(lifted, "term_id", "left")
    mode = F.when(F.col("s1").isNotNull(), "direct").when(F.col("s2").isNotNull(), "collapsed").when(F.col("s3").isNotNull(), "lifted").otherwise("orphan")
    found = found.select("term_id", F.coalesce("s1", "s2", "s3", F.lit(root_id).cast("string")).alias("shelf_id"), mode.alias("mode")).where("shelf_id is not null")
    return ids.select("chunk_id", "term_id").distinct().join(found, "term_id").select("chunk_id", "term_id", "shelf_id", "mode")


def edges(resolved: DataFrame) -> DataFrame:
    """(chunk, shelf, lifted_from): empty where any id was direct, else the sorted ids."""
    g = resolved.repartition("chunk_id").groupBy("chunk_id", "shelf_id").agg(F.bool_or(F.col("mode") == "direct").alias("direct"), F.array_sort(F.collect_set("term_id")).alias("ids"))
    return g.select("chunk_id", "shelf_id", F.when(F.col("direct"), F.array().cast("array<string>")).otherwise(F.col("ids")).alias("lifted_from"))


def direct_edges(resolved: DataFrame) -> DataFrame:
    """The direct ones of ``edges``, for which nothing is gathered; an edge is repeated for each id that gives it."""
    return resolved.where("mode = 'direct'").select("chunk_id", "shelf_id", F.array().cast("array<string>").alias("lifted_from"))


def shelf_ids(attached: DataFrame) -> DataFrame:
    """(chunk_id, sorted shelf_ids); a chunk's shelves are made distinct after they have met, with one exchange."""
    return attached.select("chunk_id", "shelf_id").repartition("chunk_id").groupBy("chunk_id").agg(F.array_sort(F.array_distinct(F.collect_list("shelf_id"))).alias("shelf_ids"))


def mode_counts(resolved: DataFrame) -> DataFrame:
    """Chunks by their best way in: direct, collapsed, lifted, or orphan only."""
    order = F.when(F.col("mode") == "direct", 0).when(F.col("mode") == "collapsed", 1).when(F.col("mode") == "lifted", 2).otherwise(3)
    best = resolved.groupBy("chunk_id").agg(F.min(order).alias("k"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("direct", "collapsed", "lifted", "orphan")]), F.col("k") + 1)
    return best.groupBy(name.alias("mode")).agg(F.count("*").alias("n_chunks"))
