"""Semantic consolidation of shelves: candidate pairs, filters, clusters, rewrite."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise
from .graphs import capped_clusters

QUALIFIERS = ("raw", "fresh", "dried", "frozen", "canned", "cooked", "whole", "organic", "ground", "sliced", "product", "food")
SUBTYPES = ("non-", "low ", "no ", "reduced ", "decaffeinated ")


def subtype_collision(a: Column, b: Column) -> Column:
    """Exactly one of the two labels starts with a subtype pattern."""
    starts = lambda c: F.exists(F.array(*[F.lit(p) for p in SUBTYPES]), lambda p: F.startswith(F.lower(c), p))
    return starts(a) != starts(b)


def compound(a: Column, b: Column) -> Column:
    """One label's words are a contiguous part of the other's, and what is more isn't only qualifiers."""
    x, y = normalise(a), normalise(b)
    long, short = F.when(F.length(x) >= F.length(y), x).otherwise(y), F.when(F.length(x) >= F.length(y), y).otherwise(x)
    inside = F.instr(F.concat(F.lit(" "), long, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" "))) > 0
    extra = F.array_except(F.split(long, " "), F.split(short, " "))
    strange = F.size(F.filter(extra, lambda w: ~w.isin(*QUALIFIERS))) > 0
    return (short != "") & (x != y) & inside & strange


def already_merged(a_term: Column, a_see: Column, b_term: Column, b_see: Column) -> Column:
    return F.array_contains(a_see, b_term) | F.array_contains(b_see, a_term)


def filtered(pairs: DataFrame, shelves: DataFrame) -> DataFrame:
    """``pairs(a, b, sim)`` over ``shelves(shelf_id, term_id, label, see_also)`` without the rejected; the reason of each is in ``reason``."""
    one, two = shelves.select(*[F.col(c).alias(f"a_{c}") for c in shelves.columns]), shelves.select(*[F.col(c).alias(f"b_{c}") for c in shelves.columns])
    j = pairs.join(one, F.col("a") == F.col("a_shelf_id")).join(two, F.col("b") == F.col("b_shelf_id"))
    reason = F.when(subtype_collision(F.col("a_label"), F.col("b_label")), "subtype").when(compound(F.col("a_label"), F.col("b_label")), "compound").when(already_merged(F.col("a_term_id"), F.col("a_see_also"), F.col("b_term_id"), F.col("b_see_also")), "merged")
    return j.select("a", "b", "sim", reason.alias("reason"))


def cap_per_shelf(pairs: list[tuple], cap: int) -> list[tuple]:
    """In order of similarity, keep a pair while both ends have fewer than ``cap``; shelves are a bounded list."""
    used: dict = {}
    out = []
    for a, b, sim in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if used.get(a, 0) < cap and used.get(b, 0) < cap:
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            out.append((a, b, sim))
    return out


def clusters(pairs: DataFrame, cap: int = 12) -> DataFrame:
    return capped_clusters(pairs.select("a", "b", F.col("sim").alias("weight")), cap)


def judged(found: DataFrame, shelves: DataFrame, judge: Callable[[list[str]], float], least: float = 0.80, blocked: frozenset[tuple[str, str]] = frozenset()) -> DataFrame:
    """Clusters that a pluggable judge (labels to confidence) accepts; one with a blocked pair is out as a whole."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(pdf["node"])
        bad = any((a, b) in blocked or (b, a) in blocked for a in names for b in names)
        score = 0.0 if bad else float(judge(sorted(pdf["label"])))
        return pdf.assign(confidence=score)[["cluster", "node", "confidence"]]

    j = found.join(shelves.select(F.col("shelf_id").alias("node"), "label"), "node")
    return j.groupBy("cluster").applyInPandas(run, "cluster string, node string, confidence double").where(F.col("confidence") >= least)


def apply_groups(shelves: DataFrame, groups: DataFrame) -> DataFrame:
    """Fold each group (cluster, node) into its canonical shelf: least depth, then shortest label, then label, then id.

    Supports add up, the others' terms become see-also, their children are re-parented.
    ``shelves(shelf_id, term_id, label, parent, depth, direct, chunk_count, see_also)``.
    """
    g = groups.select("cluster", F.col("node").alias("shelf_id")).join(shelves, "shelf_id")
    canon = g.groupBy("cluster").agg(F.min(F.struct("depth", F.length("label").alias("n"), "label", "shelf_id")).alias("x"), F.sum("direct").alias("sum_direct"), F.sum("chunk_count").alias("sum_chunks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("term_id"), "see_also"))))).alias("all_terms")).withColumn("canonical", F.col("x.shelf_id"))
    moved = g.join(canon.select("cluster", "canonical"), "cluster").where("shelf_id <> canonical").select("shelf_id", "canonical")
    kept = shelves.join(moved.select("shelf_id"), "shelf_id", "left_anti")
    merged = kept.join(canon.select(F.col("canonical").alias("shelf_id"), "sum_direct", "sum_chunks", "all_terms"), "shelf_id", "left")
    up = moved.select(F.col("shelf_id").alias("parent"), F.col("canonical").alias("new_parent"))
    see = F.when(F.col("all_terms").isNotNull(), F.array_sort(F.array_except(F.array_union("see_also", "all_terms"), F.array("term_id")))).otherwise(F.col("see_also"))
    out = merged.join(up, "parent", "left")
    parent = F.when(F.col("new_parent") == F.col("shelf_id"), None).otherwise(F.coalesce("new_parent", "parent"))
    return out.select("shelf_id", "term_id", "label", parent.alias("parent"), "depth", F.coalesce("sum_direct", "direct").alias("direct"), F.coalesce("sum_chunks", "chunk_count").alias("chunk_count"), see.alias("see_also"))
