"""Links to support: routing to facets, floors and block lists, distinct chunks per term and subtree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import prefix_of


def _mapped(key: Column, table: dict[str, str]) -> Column:
    if not table:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def route(links: DataFrame, by_type: dict[str, str], by_prefix: dict[str, str], home_prefix: str, home_facet: str) -> DataFrame:
    """Facet of a link: by entity type, else the home facet for the home prefix, else by the id's prefix, else null."""
    home = F.when(F.startswith("term_id", F.lit(home_prefix)), F.lit(home_facet))
    return links.withColumn("facet", F.coalesce(_mapped(F.col("entity_type"), by_type), home, _mapped(prefix_of(F.col("term_id")), by_prefix)))


def above_floor(links: DataFrame, floor: float) -> DataFrame:
    return links.where(F.col("confidence") >= floor)


def not_blocked(links: DataFrame, blocked: DataFrame) -> DataFrame:
    """Without the listed ``(surface, term_id)``; surfaces compare in lower case."""
    b = blocked.select(F.lower("surface").alias("__s"), F.col("term_id").alias("__t"))
    return links.join(b, (F.lower("surface") == F.col("__s")) & (F.col("term_id") == F.col("__t")), "left_anti")


def direct_pairs(links: DataFrame, *keys: str) -> DataFrame:
    """Distinct (chunk, term), so that hot terms shrink before any roll-up."""
    return links.select("chunk_id", "term_id", *keys).distinct()


def propagated_pairs(direct: DataFrame, anc: DataFrame, *keys: str) -> DataFrame:
    """Distinct (chunk, term or ancestor)."""
    up = direct.join(anc, F.col("term_id") == F.col("term")).select("chunk_id", F.col("ancestor").alias("term_id"), *keys)
    return direct.select("chunk_id", "term_id", *keys).union(up).distinct()


def one_below(direct: DataFrame, anc: DataFrame, terms: DataFrame) -> DataFrame:
    """(chunk_id, term_id): each mention of ``terms(term_id)`` or of a descendant, under one of them; enough to count their chunks."""
    tops = terms.select("term_id")
    own = tops.select(F.col("term_id").alias("term"), F.col("term_id").alias("ancestor"))
    home = anc.join(own.select("ancestor"), "ancestor", "left_semi").select("term", "ancestor").union(own).groupBy("term").agg(F.min("ancestor").alias("top"))
    return direct.join(home, F.col("term_id") == F.col("term")).select("chunk_id", F.col("top").alias("term_id"))


def support(direct: DataFrame, anc: DataFrame, *keys: str) -> DataFrame:
    """Per term (and keys): distinct chunks that mention it, and those that mention it or a descendant. ``direct`` is distinct.

    A mention takes its ancestors along as one list; a chunk's lists meet in one place,
    where each ancestor counts once. Terms that nothing is below count their own mentions.
    """
    near = direct.groupBy("term_id", *keys).agg(F.count("*").alias("direct"))
    lists = anc.repartition("term").groupBy("term").agg(F.collect_list("ancestor").alias("up"))
    inner = anc.select(F.col("ancestor").alias("term_id")).distinct()
    met = direct.join(lists, F.col("term_id") == F.col("term")).select("chunk_id", *keys, "up")
    own = direct.join(inner, "term_id", "left_semi").select("chunk_id", *keys, F.array("term_id").alias("up"))
    once = met.union(own).repartition("chunk_id").groupBy("chunk_id", *keys).agg(F.array_distinct(F.flatten(F.collect_list("up"))).alias("up"))
    wide = once.select(*keys, F.explode("up").alias("term_id")).groupBy("term_id", *keys).agg(F.count("*").alias("with_descendants"))
    return near.join(wide, ["term_id", *keys], "full").select("term_id", *keys, F.coalesce("direct", F.lit(0)).alias("direct"), F.coalesce("with_descendants", "direct").alias("with_descendants"))
