"""Term hierarchy: closure, depths, look-ups. Edges are ``(child, parent)``, closures ``(term, ancestor)``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..session import Rounds


#: Up to so many edges a hierarchy is walked in one task; beyond it, round by round over the cluster.
SMALL = 200_000


def _is_small(edges: DataFrame) -> bool:
    return edges.limit(SMALL + 1).count() <= SMALL


def _parents(batches: Iterator[pd.DataFrame]) -> dict:
    up: dict = {}
    for b in batches:
        for child, parent in zip(b["child"], b["parent"], strict=True):
            up.setdefault(child, set()).add(parent)
    return up


def _walk_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, ancestor) of all terms, some thousand rows at a time."""
    up, rows = _parents(batches), []
    for term in up:
        seen, todo = set(), [term]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        rows += [(term, x) for x in seen]
        if len(rows) > 50_000:
            yield pd.DataFrame(rows, columns=["term", "ancestor"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["term", "ancestor"])


def _walk_down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, depth) by breadth first search from the terms without parents."""
    up, down = _parents(batches), {}
    for child, parents in up.items():
        for p in parents:
            down.setdefault(p, []).append(child)
    depth = {p: 0 for p in down if p not in up}
    level, d = list(depth), 0
    while level:
        d += 1
        level = [c for c in dict.fromkeys(c for p in level for c in down.get(p, ())) if c not in depth]
        depth.update(dict.fromkeys(level, d))
    if depth:
        yield pd.DataFrame({"term": list(depth), "depth": np.fromiter(depth.values(), np.int32, len(depth))})


def closure(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """All strict ancestors of each term (a term on a cycle is its own); empty edges give none.

    A hierarchy of a checked, small number of edges is walked in one task and written once.
    Larger ones double their paths per round; cycles end by de-duplication.
    """
    rounds = Rounds(edges.sparkSession, "closure")
    e = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    kind = e.schema["child"].dataType.simpleString()
    if _is_small(e):
        return rounds.write(e.coalesce(1).mapInPandas(_walk_up, f"term {kind}, ancestor {kind}"))
    known = rounds.write(e.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")))
    count = known.count()
    for _ in range(max_rounds):
        step = known.select(F.col("term").alias("ancestor"), F.col("ancestor").alias("up"))
        known = rounds.write(known.union(known.join(step, "ancestor").select("term", F.col("up").alias("ancestor"))).distinct())
        now = known.count()
        if now == count:
            return known
        count = now
    raise RuntimeError("the hierarchy is deeper than the rounds allow")


def depths(edges: DataFrame) -> DataFrame:
    """Least number of steps from a term without parents, however deep; terms on a cycle without root do not appear."""
    rounds = Rounds(edges.sparkSession, "depths")
    e = edges.select("child", "parent").where("child is not null and parent is not null").distinct()
    if _is_small(e):
        return rounds.write(e.coalesce(1).mapInPandas(_walk_down, f"term {e.schema['child'].dataType.simpleString()}, depth int"))
    roots = e.select(F.col("parent").alias("term")).distinct().join(e.select(F.col("child").alias("term")).distinct(), "term", "left_anti")
    done = new = rounds.write(roots.withColumn("depth", F.lit(0)))
    d = 0
    while True:  # each round writes its own level only
        d += 1
        new = new.join(e, F.col("term") == F.col("parent")).select(F.col("child").alias("term")).distinct().join(done, "term", "left_anti").withColumn("depth", F.lit(d))
        new = rounds.write(new)
        if new.isEmpty():
            return done
        done = done.union(new)


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy("parent").agg(F.count_distinct("child").alias("n_children"), F.min("child").alias("first_child"))


def descendant_counts(anc: DataFrame) -> DataFrame:
    return anc.groupBy("ancestor").agg(F.count_distinct("term").alias("n_descendants"))


def lowest_common_ancestors(groups: DataFrame, anc: DataFrame) -> DataFrame:
    """Of each ``(group, term)`` set: the ancestor-or-self of all its terms that has most ancestors; ties by id."""
    reach = anc.union(groups.select("term", F.col("term").alias("ancestor")).distinct()).distinct()
    size = groups.groupBy("group").agg(F.count_distinct("term").alias("n"))
    common = groups.distinct().join(reach, "term").groupBy("group", "ancestor").agg(F.count_distinct("term").alias("m")).join(size, "group").where("m = n")
    rank = anc.groupBy("term").agg(F.count("*").alias("above")).withColumnRenamed("term", "ancestor")
    ranked = common.join(rank, "ancestor", "left").withColumn("above", F.coalesce("above", F.lit(0)))
    w = Window.partitionBy("group").orderBy(F.desc("above"), "ancestor")
    return ranked.withColumn("r", F.row_number().over(w)).where("r = 1").select("group", F.col("ancestor").alias("lca"))


def name_index(terms: DataFrame) -> DataFrame:
    """Normalised names to ids; the first of a name is the smallest id. Obsolete terms are left out."""
    names = terms.where("not obsolete").select("id", F.explode(F.array_union(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>")))).alias("name"))
    return names.select(normalise(F.col("name")).alias("name"), "id").where("name <> ''").distinct()


def lookup_names(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``queries(query)``: first id and number of ids that bear the name; null and 0 without a match."""
    found = name_index(terms).groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("n_ids"))
    return queries.withColumn("name", normalise(F.col("query"))).join(found, "name", "left").select("query", "id", F.coalesce("n_ids", F.lit(0)).alias("n_ids"))


def search_terms(terms: DataFrame, needle: str, limit: int) -> DataFrame:
    """Labels that contain the needle, shortest first, then by id."""
    hit = terms.where(~F.col("obsolete") & F.contains(F.lower("label"), F.lit(needle.lower())))
    return hit.orderBy(F.length("label"), "id").limit(limit).select("id", "label")


def subclass_pairs(pairs: DataFrame, anc: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``is_subclass``: b is a or an ancestor of a."""
    hit = anc.select(F.col("term").alias("a"), F.col("ancestor").alias("b"), F.lit(True).alias("up"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", (F.col("up").isNotNull() | (F.col("a") == F.col("b"))).alias("is_subclass"))


def is_a_distance(leaves: DataFrame, anc: DataFrame) -> DataFrame:
    """``leaves(term, home)``: ancestors of the term that are the home or below it."""
    up = anc.select("term", F.col("ancestor").alias("mid"))
    below = anc.select(F.col("term").alias("mid"), F.col("ancestor").alias("home")).union(leaves.select(F.col("home").alias("mid"), "home").distinct()).distinct()
    hops = leaves.join(up, "term").join(below, ["mid", "home"]).groupBy("term", "home").agg(F.count("*").alias("distance"))
    return leaves.join(hops, ["term", "home"], "left").select("term", "home", F.coalesce("distance", F.lit(0)).alias("distance"))


def prefix_filter(terms: DataFrame, prefixes: tuple[str, ...] | None) -> DataFrame:
    """Terms whose id starts with one of the prefixes: None keeps all, an empty tuple none."""
    if prefixes is None:
        return terms
    keep = F.lit(False)
    for p in prefixes:
        keep = keep | F.startswith("id", F.lit(p))
    return terms.where(keep)


def membership(ids: DataFrame, terms: DataFrame) -> DataFrame:
    """``ids(id)`` with ``known``: whether the term is loaded."""
    return ids.join(terms.select("id", F.lit(True).alias("hit")).distinct(), "id", "left").select("id", F.col("hit").isNotNull().alias("known"))


def names_of(ids: DataFrame, terms: DataFrame) -> DataFrame:
    """``ids(id)`` with label and synonyms; null and an empty array for unknown ids."""
    t = terms.select("id", "label", "synonyms").dropDuplicates(["id"])
    return ids.join(t, "id", "left").select("id", "label", F.coalesce("synonyms", F.array().cast("array<string>")).alias("synonyms"))


def lookup_all(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """``queries(query)``: one row per id that bears the name."""
    return queries.withColumn("name", normalise(F.col("query"))).join(name_index(terms), "name").select("query", "id")


def within_hops(edges: DataFrame, pairs: DataFrame, hops: int) -> DataFrame:
    """``pairs(a, b)`` with ``near``: b is reached from a in at most ``hops`` steps up. Only the pairs' own terms are walked."""
    up = edges.select(F.col("child").alias("at"), F.col("parent").alias("to")).distinct()
    front = pairs.select("a", F.col("a").alias("at")).distinct()
    reach = None
    for _ in range(hops):
        front = front.join(up, "at").select("a", F.col("to").alias("at")).distinct()
        reach = front if reach is None else reach.union(front)
    hit = reach.distinct().select("a", F.col("at").alias("b"), F.lit(True).alias("hit"))
    return pairs.join(hit, ["a", "b"], "left").select("a", "b", F.col("hit").isNotNull().alias("near"))


def subtree_view(terms: DataFrame, anc: DataFrame, root: str, limit: int) -> DataFrame:
    """A term's surroundings for a view: itself, all its ancestors and its first ``limit`` descendants by id. (id, label, role)."""
    above = anc.where(F.col("term") == root).select(F.col("ancestor").alias("id"), F.lit("ancestor").alias("role"))
    below = anc.where((F.col("ancestor") == root) & (F.col("term") != root)).select(F.col("term").alias("id")).distinct().orderBy("id").limit(limit).withColumn("role", F.lit("descendant"))
    own = terms.where(F.col("id") == root).select("id", F.lit("self").alias("role"))
    return own.unionByName(above).unionByName(below).dropDuplicates(["id"]).join(terms.select("id", "label").dropDuplicates(["id"]), "id", "left").select("id", "label", "role")


def shared_names(terms: DataFrame, support: DataFrame, shortest: int = 3) -> DataFrame:
    """Names that several terms bear, with the best supported of them (ties by id) as target.

    Junk names (shorter than ``shortest``, or digits only) lead nowhere and are left out.
    """
    names = name_index(terms).where((F.length("name") >= shortest) & ~F.rlike("name", F.lit("^[0-9 ]+$")))
    s = names.join(support.select(F.col("term_id").alias("id"), "with_descendants"), "id", "left").withColumn("n", F.coalesce("with_descendants", F.lit(0)))
    g = s.groupBy("name").agg(F.count("*").alias("n_ids"), F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("best"))
    return g.where("n_ids > 1").select("name", "n_ids", F.col("best.id").alias("target"))


def index_fingerprint(terms: DataFrame, *models: str) -> DataFrame:
    """One row: the number of terms that are not obsolete, and SHA-256 over their sorted ids and the model names."""
    ids = F.array_sort(F.collect_set("id"))
    return terms.where("not obsolete").agg(F.count_distinct("id").alias("n_terms"), F.sha2(F.array_join(F.concat(ids, F.array(*[F.lit(m) for m in models]).cast("array<string>")), "\n"), 256).alias("fingerprint"))
