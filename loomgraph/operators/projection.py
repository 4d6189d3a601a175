"""From support to a shelf tree: pruning, nearest parents, depths, roots, backbone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Rounds
from .ontology import SMALL


@dataclass(frozen=True)
class PruneConfig:
    min_support: int = 20
    max_depth: int = 5
    direct_share_max: float = 0.10
    lifted_share_min: float = 0.85
    umbrella_min_count: int = 25
    blacklist: tuple[str, ...] = ()
    whitelist: tuple[str, ...] = ()


def is_umbrella(direct: Column, wide: Column, c: PruneConfig) -> Column:
    """Mostly lifted, hardly mentioned itself; a share limit of 0 switches the rule off."""
    if c.direct_share_max <= 0:
        return F.lit(False)
    return (wide >= c.umbrella_min_count) & (direct / wide < c.direct_share_max) & ((wide - direct) / wide > c.lifted_share_min)


def survivors(support: DataFrame, c: PruneConfig, terms: DataFrame | None = None) -> DataFrame:
    """Terms kept: whitelisted ones, and those allowed, no umbrella and with enough support.

    The black list names ids or labels, whatever their case and outer blanks; labels need
    ``terms(id, label)``. Whitelisted terms without support are added with none, if
    ``terms`` has them and the black list doesn't.
    """
    rows = support
    barred = F.lit(False)
    if c.blacklist:
        names = [b.strip().lower() for b in c.blacklist]
        barred = F.lower(F.trim("term_id")).isin(*names)
        if terms is not None:
            by_label = terms.where(F.lower(F.trim("label")).isin(*names)).select(F.col("id").alias("term_id"), F.lit(True).alias("__barred")).distinct()
            rows = rows.join(by_label, "term_id", "left")
            barred = barred | F.col("__barred").isNotNull()
    listed = F.col("term_id").isin(*c.whitelist) if c.whitelist else F.lit(False)
    keep = listed | (~barred & ~is_umbrella(F.col("direct"), F.col("with_descendants"), c) & (F.col("with_descendants") >= c.min_support))
    kept = rows.where(keep).select(*support.columns)
    if c.whitelist and terms is not None:
        absent = terms.where(F.col("id").isin(*c.whitelist)).select(F.col("id").alias("term_id"), "label").distinct().join(support.select("term_id"), "term_id", "left_anti")
        if c.blacklist:
            absent = absent.where(~F.lower(F.trim("term_id")).isin(*names) & ~F.coalesce(F.lower(F.trim("label")).isin(*names), F.lit(False)))
        zeros = [F.col(f.name) if f.name == "term_id" else F.lit(0).cast(f.dataType).alias(f.name) for f in support.schema]
        kept = kept.unionByName(absent.select(*zeros))
    return kept


def nearest_parents(kept: DataFrame, anc: DataFrame, depth: DataFrame, cap: int) -> DataFrame:
    """Deepest kept ancestor (at most ``cap`` deep), ties by id; null where there is none."""
    a = anc.join(kept.select(F.col("term_id").alias("ancestor")), "ancestor").join(depth.select(F.col("term").alias("ancestor"), "depth"), "ancestor").where(F.col("depth") <= cap)
    best = a.groupBy("term").agg(F.min(F.struct((-F.col("depth")).alias("d"), F.col("ancestor").alias("parent"))).alias("x"))
    return kept.join(best, F.col("term_id") == F.col("term"), "left").select(*kept.columns, F.col("x.parent").alias("parent"))


def _placed_depths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kids, level, found, d = {}, [], {}, 0
    for b in batches:
        for term, parent in zip(b["term_id"], b["parent"], strict=True):
            if parent is None:
                level.append(term)
            else:
                kids.setdefault(parent, []).append(term)
    while level:
        found.update(dict.fromkeys(level, d))
        level, d = [k for p in level for k in kids.get(p, ())], d + 1
    if found:
        yield pd.DataFrame({"term_id": list(found), "depth": np.fromiter(found.values(), np.int32, len(found))})


def projected_depths(tree: DataFrame, cap: int) -> DataFrame:
    """Root 0, else parent + 1 up to ``cap``; ``tree(term_id, parent, ...)``. A tree of checked, small size is walked in one task."""
    rounds = Rounds(tree.sparkSession, "projected")
    tree = rounds.write(tree)
    links = tree.select("term_id", "parent")
    if links.limit(SMALL + 1).count() <= SMALL:
        done = links.coalesce(1).mapInPandas(_placed_depths, f"term_id {tree.schema['term_id'].dataType.simpleString()}, depth int")
    else:
        done = new = rounds.write(links.where("parent is null").select("term_id", F.lit(0).alias("depth")))
        level = 0
        while True:  # each round writes its own level only
            level += 1
            new = rounds.write(links.join(new.select(F.col("term_id").alias("parent")), "parent").select("term_id", F.lit(level).alias("depth")))
            if new.isEmpty():
                break
            done = done.union(new)
    d = done.select("term_id", F.least("depth", F.lit(cap)).alias("depth"))
    return tree.join(d, "term_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def with_single_root(shelves: DataFrame, pairs: DataFrame, root_id: str) -> DataFrame:
    """Add a root above several parentless shelves, one level up; its count is that of the union of their chunks.

    ``pairs`` are the propagated (chunk_id, term_id). A tree with one root stays as it is.
    """
    tops = shelves.where("parent is null")
    if tops.limit(2).count() < 2:
        return shelves
    n = pairs.join(tops.select("term_id"), "term_id").agg(F.count_distinct("chunk_id").alias("with_descendants"))
    root = n.select(F.lit(root_id).alias("term_id"), F.lit(0).cast("bigint").alias("direct"), "with_descendants", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"))
    below = shelves.select("term_id", "direct", "with_descendants", F.coalesce("parent", F.lit(root_id)).alias("parent"), (F.col("depth") + 1).alias("depth"))
    return root.unionByName(below)


def collapse_single_children(rows: list[dict]) -> list[dict]:
    """To a fixed point: the first parent (by id) with exactly one child goes, the child takes its place.

    A pruned tree is small; the order of steps matters, so this runs on the driver.
    """
    by = {r["term_id"]: dict(r, see_also=list(r.get("see_also") or [])) for r in rows}
    while True:
        kids: dict[str, list[str]] = {}
        for r in by.values():
            if r["parent"] is not None:
                kids.setdefault(r["parent"], []).append(r["term_id"])
        lone = sorted(p for p, c in kids.items() if len(c) == 1 and p in by)
        if not lone:
            return [by[k] for k in sorted(by)]
        gone = by.pop(lone[0])
        child = by[kids[lone[0]][0]]
        child["parent"], child["depth"] = gone["parent"], gone["depth"]
        for x in [gone["term_id"], *gone["see_also"]]:
            if x not in child["see_also"]:
                child["see_also"].append(x)


def backbone(kids: dict[str, list[str]], direct: dict[str, int], wide: dict[str, int], min_support: int, max_depth: int, root: str | None = None, blocked: frozenset[str] = frozenset(), parents: dict[str, list[str]] | None = None) -> list[dict]:
    """Supported subtree of the hierarchy as shelves.

    Filing tiers (no direct support, one supported child) fold into their child; each term
    is placed once, depth first, best supported first; dead ends without direct support
    and without kept children go. Works on supported terms only, whose number is bounded
    by the vocabulary, so it runs on the driver.
    """

    def supported(term: str) -> list[str]:
        return sorted(c for c in kids.get(term, ()) if c not in blocked and wide.get(c, 0) >= min_support)

    def resolve(term: str) -> tuple[str, list[str]]:
        folded, seen = [], {term}
        while direct.get(term, 0) == 0 and len(supported(term)) == 1:
            child = supported(term)[0]
            if child in seen:
                break
            folded.append(term)
            term = child
            seen.add(term)
        return term, folded

    if root is not None:
        roots = sorted(supported(root), key=lambda t: (-wide.get(t, 0), t))
    else:
        ok = {t for t, n in wide.items() if n >= min_support and t not in blocked}
        above: dict[str, set[str]] = {}

        def ancestors(term: str) -> set[str]:
            if term not in above:
                above[term] = set()
                for p in (parents or {}).get(term, []):
                    above[term] |= {p} | ancestors(p)
            return above[term]

        roots = sorted((t for t in ok if not ancestors(t) & ok), key=lambda t: (-wide.get(t, 0), t))
    placed: dict[str, dict] = {}

    def place(term: str, parent: str | None, depth: int, folded: list[str]) -> None:
        todo = [(term, parent, depth, folded)]
        while todo:
            term, parent, depth, folded = todo.pop()
            if term in placed:
                for f in folded:
                    if f not in placed[term]["see_also"]:
                        placed[term]["see_also"].append(f)
                continue
            placed[term] = {"term_id": term, "parent": parent, "depth": depth, "see_also": list(dict.fromkeys(folded))}
            if depth >= max_depth:
                continue
            below: dict[str, list[str]] = {}
            for c in supported(term):
                end, via = resolve(c)
                below.setdefault(end, []).extend(via)
            todo += [(c, term, depth + 1, below[c]) for c in sorted(below, key=lambda t: (wide.get(t, 0), [-ord(x) for x in t]))]

    for r in roots:
        place(r, None, 0, [])
    while True:
        used = {p["parent"] for p in placed.values()}
        dead = [t for t in placed if t not in used and direct.get(t, 0) == 0]
        if not dead:
            break
        for t in dead:
            del placed[t]
    for p in placed.values():
        p["status"] = "folded" if p["see_also"] else "active"
    return [placed[t] for t in sorted(placed)]


def supported_children(edges: DataFrame, support: DataFrame, min_support: int) -> DataFrame:
    """(parent, child) with enough support, best supported child first."""
    s = support.where(F.col("with_descendants") >= min_support).select(F.col("term_id").alias("child"), "direct", "with_descendants")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("with_descendants"), "child"))
    return edges.distinct().join(s, "child").withColumn("rank", rank)


def filing_tiers(edges: DataFrame, support: DataFrame, min_support: int) -> DataFrame:
    """Terms without direct support that have exactly one supported child, with that child."""
    kids = supported_children(edges, support, min_support).groupBy("parent").agg(F.count("*").alias("n"), F.min("child").alias("child"))
    return support.where("direct = 0").join(kids, F.col("term_id") == F.col("parent")).where("n = 1").select("term_id", "child")


def merge_tiers(shelves: DataFrame, doomed: DataFrame) -> DataFrame:
    """Re-home the children of demoted shelves ``doomed(term_id)`` to their nearest kept ancestor."""
    rounds = Rounds(shelves.sparkSession, "rehome")
    up = rounds.write(shelves.join(doomed, "term_id", "left_semi").select(F.col("term_id").alias("gone"), F.col("parent").alias("to")))
    tree = rounds.write(shelves.join(doomed, "term_id", "left_anti"))
    while True:
        moved = tree.join(up, F.col("parent") == F.col("gone"))
        if moved.isEmpty():
            return tree
        tree = rounds.write(tree.join(up, F.col("parent") == F.col("gone"), "left").withColumn("parent", F.when(F.col("gone").isNotNull(), F.col("to")).otherwise(F.col("parent"))).select(*shelves.columns))


def _checked(df: DataFrame, most: int, what: str) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return rows


_SHELF = "term_id string, parent string, depth int, see_also array<string>, status string"


def backbone_shelves(edges: DataFrame, support: DataFrame, min_support: int, max_depth: int, root: str | None = None, blocked: tuple[str, ...] = (), most: int = 500_000) -> DataFrame:
    """``backbone`` over tables: support is filtered and joined in Spark, the placed walk runs over supported terms only.

    Their number is bounded by the vocabulary and checked: more than ``most`` raise.
    """
    ok = support.where(F.col("with_descendants") >= min_support).select("term_id", "direct", "with_descendants")
    rows = _checked(ok, most, "supported terms")
    ids = ok.select("term_id")
    inside = edges.select("child", "parent").distinct().join(ids.withColumnRenamed("term_id", "child"), "child", "left_semi")
    kids, parents = {}, {}
    for r in _checked(inside, 4 * most, "edges of supported terms"):
        kids.setdefault(r.parent, []).append(r.child)
        parents.setdefault(r.child, []).append(r.parent)
    placed = backbone(kids, {r.term_id: r.direct for r in rows}, {r.term_id: r.with_descendants for r in rows}, min_support, max_depth, root, frozenset(blocked), parents)
    return edges.sparkSession.createDataFrame([(p["term_id"], p["parent"], p["depth"], p["see_also"], p["status"]) for p in placed], _SHELF)


def collapsed(tree: DataFrame, most: int = 500_000) -> DataFrame:
    """``collapse_single_children`` over a pruned tree (term_id, parent, depth), whose checked size is small: (term_id, parent, depth, see_also)."""
    rows = [r.asDict() for r in _checked(tree.select("term_id", "parent", "depth"), most, "shelves")]
    out = collapse_single_children(rows)
    return tree.sparkSession.createDataFrame([(r["term_id"], r["parent"], r["depth"], r["see_also"]) for r in out], "term_id string, parent string, depth int, see_also array<string>")


def insert_tier(shelves: DataFrame, tier: DataFrame, children: DataFrame) -> DataFrame:
    """Put new shelves ``tier(shelf_id, parent)`` in, and hang ``children(child, shelf_id)`` below them. (shelf_id, parent)."""
    moved = children.select(F.col("child").alias("shelf_id"), F.col("shelf_id").alias("__to"))
    old = shelves.select("shelf_id", "parent").join(moved, "shelf_id", "left").select("shelf_id", F.coalesce("__to", "parent").alias("parent"))
    return old.join(tier.select("shelf_id"), "shelf_id", "left_anti").unionByName(tier.select("shelf_id", "parent"))


def capped_children(edges: DataFrame, support: DataFrame, cap: int) -> DataFrame:
    """What a fan-out cap would hide: per parent, children beyond the ``cap`` best supported and the chunks they hold."""
    s = support.select(F.col("term_id").alias("child"), "with_descendants")
    rank = F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("with_descendants"), "child"))
    beyond = edges.select("parent", "child").distinct().join(s, "child").withColumn("rank", rank)
    return beyond.groupBy("parent").agg(F.count("*").alias("n_children"), F.count_if(F.col("rank") > cap).alias("n_hidden"), F.sum(F.when(F.col("rank") > cap, F.col("with_descendants")).otherwise(0)).alias("hidden_chunks"))


def leaf_homes(ids: DataFrame, shelves: DataFrame, see_also: DataFrame, anc: DataFrame) -> DataFrame:
    """``ids(term_id)``: home shelf and kind of edge: ``is-a`` where the shelf is the term or above it, ``fabricated`` where only a list puts it there."""
    by_term = shelves.select("term_id", F.col("shelf_id").alias("own"))
    listed = see_also.groupBy("term_id").agg(F.min("shelf_id").alias("listed"))
    up = ids.join(anc.select(F.col("term").alias("term_id"), "ancestor"), "term_id").join(shelves.select(F.col("term_id").alias("ancestor"), "shelf_id", "depth"), "ancestor")
    deepest = up.groupBy("term_id").agg(F.min(F.struct((-F.col("depth")).alias("d"), "ancestor", "shelf_id")).alias("x")).select("term_id", F.col("x.shelf_id").alias("above"))
    j = ids.distinct().join(by_term, "term_id", "left").join(listed, "term_id", "left").join(deepest, "term_id", "left")
    real = listed.join(shelves.select(F.col("shelf_id").alias("listed"), F.col("term_id").alias("ancestor")), "listed").join(anc.select(F.col("term").alias("term_id"), "ancestor"), ["term_id", "ancestor"]).select("term_id", F.lit(True).alias("real"))
    kind = F.when(F.col("own").isNotNull(), "is-a").when(F.col("listed").isNotNull(), F.when(F.col("real"), "is-a").otherwise("fabricated")).when(F.col("above").isNotNull(), "is-a")
    return j.join(real, "term_id", "left").select("term_id", F.coalesce("own", "listed", "above").alias("home"), kind.alias("edge_type"))
