"""Evaluation: linkers, findability, scorecards, agreement of partitions, coherence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def linker_report(gold: DataFrame, got: DataFrame) -> DataFrame:
    """``gold(text, expected_id, tier)``, ``got(text, id)``: per tier rows, linked, right; coverage and accuracy.

    A miss tier is right when nothing is linked; coverage counts linked rows of the other tiers.
    """
    j = gold.join(got, "text", "left")
    right = F.coalesce("id", F.lit("")) == F.coalesce("expected_id", F.lit(""))
    g = j.groupBy("tier").agg(F.count("*").alias("n"), F.count("id").alias("n_linked"), F.count_if(right).alias("n_right"))
    return g.select("tier", "n", "n_linked", "n_right", (F.col("n_right") / F.col("n")).alias("accuracy"))


def findability(clicks: DataFrame, within: int = 3) -> DataFrame:
    """``clicks(query, depth)``, depth null when unreachable: median, nearest-rank p90, shares over all queries."""
    g = clicks.agg(F.count("*").alias("n"), F.count("depth").alias("reached"), F.count_if(F.col("depth") <= within).alias("near"), F.median("depth").alias("median_clicks"))
    # Nearest rank over a histogram of depths, which is as small as the tree is deep.
    hist = clicks.where("depth is not null").groupBy("depth").agg(F.count("*").alias("c"))
    at = F.bround(0.9 * (F.col("reached") - 1)).cast("long")
    cum = hist.groupBy().agg(F.array_sort(F.collect_list(F.struct("depth", "c"))).alias("h"))
    found = g.crossJoin(F.broadcast(cum)).withColumn("p90_clicks", F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("d")), lambda s, x: F.struct((s.seen + x.c).alias("seen"), F.when(s.d.isNull() & (s.seen + x.c > at), x.depth.cast("int")).otherwise(s.d).alias("d")), lambda s: s.d))
    return found.select("n", "median_clicks", "p90_clicks", (F.col("near") / F.col("n")).alias("share_within"), (F.col("reached") / F.col("n")).alias("share_reachable"))


def scorecard(shelves: DataFrame, covered: DataFrame, method: str) -> DataFrame:
    """One method's row: coverage, fan-out, depth, mean specificity (1 / ln(1 + chunks)). ``covered(chunk_id, homed)``."""
    c = covered.agg((F.count_if("homed") / F.count("*")).alias("coverage"))
    fan = shelves.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_fanout"), F.median("n").alias("median_fanout"))
    s = shelves.agg(F.max("depth").alias("depth"), F.count("*").alias("n_shelves"))
    return s.crossJoin(F.broadcast(fan)).crossJoin(F.broadcast(c)).select(F.lit(method).alias("method"), "n_shelves", "coverage", "max_fanout", "median_fanout", "depth")


def partition_agreement(labels: DataFrame) -> DataFrame:
    """``labels(id, a, b)``: adjusted Rand index, normalised mutual information (arithmetic), homogeneity, completeness, V-measure."""
    cell = labels.groupBy("a", "b").agg(F.count("*").cast("double").alias("n"))
    pair = lambda c: F.col(c) * (F.col(c) - 1) / 2
    rows = cell.groupBy("a").agg(F.sum("n").alias("na"))
    cols = cell.groupBy("b").agg(F.sum("n").alias("nb"))
    total = cell.agg(F.sum("n").alias("t"), F.sum(pair("n")).alias("s"))
    ra, cb = rows.agg(F.sum(pair("na")).alias("sa")), cols.agg(F.sum(pair("nb")).alias("sb"))
    t = total.crossJoin(F.broadcast(ra)).crossJoin(F.broadcast(cb))
    tot = F.broadcast(total.select(F.col("t").alias("tt")))
    ha = rows.crossJoin(tot).agg((-F.sum(F.col("na") / F.col("tt") * F.log(F.col("na") / F.col("tt")))).alias("ha"))
    hb = cols.crossJoin(tot).agg((-F.sum(F.col("nb") / F.col("tt") * F.log(F.col("nb") / F.col("tt")))).alias("hb"))
    mi = cell.join(rows, "a").join(cols, "b").crossJoin(tot).agg(F.sum(F.col("n") / F.col("tt") * F.log(F.col("n") * F.col("tt") / (F.col("na") * F.col("nb")))).alias("mi"))
    x = t.crossJoin(F.broadcast(ha)).crossJoin(F.broadcast(hb)).crossJoin(F.broadcast(mi))
    expected = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    ari = (F.col("s") - expected) / ((F.col("sa") + F.col("sb")) / 2 - expected)
    r = lambda c: F.round(c, 9)
    hom, com = F.col("mi") / F.col("ha"), F.col("mi") / F.col("hb")
    return x.select(r(ari).alias("ari"), r(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), r(hom).alias("homogeneity"), r(com).alias("completeness"), r(2 * hom * com / (hom + com)).alias("v_measure"))


def mean_pairwise_cosine(members: DataFrame) -> DataFrame:
    """Per theme over unit vectors: (|sum v|^2 - n) / (n (n - 1)); no pair is formed. ``members(theme_id, embedding)``."""
    sums = members.select("theme_id", F.posexplode("embedding").alias("d", "x")).groupBy("theme_id", "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count("*").alias("n"))
    g = sums.groupBy("theme_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n"))
    return g.select("theme_id", "n", F.when(F.col("n") > 1, F.round((F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1)), 9)).alias("mean_cosine"))


def reproducibility(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of two node sets; 1 when both are empty."""
    x, y = a.select("node").distinct().withColumn("x", F.lit(1)), b.select("node").distinct().withColumn("y", F.lit(1))
    return x.join(y, "node", "full").agg(F.coalesce(F.sum(F.col("x") * F.col("y")) / F.count("*"), F.lit(1.0)).alias("jaccard"))


def specificity(distances: DataFrame) -> DataFrame:
    """``distances(term, distance)`` of homed leaves: mean and median; 0 without any."""
    return distances.agg(F.coalesce(F.avg("distance"), F.lit(0.0)).alias("mean_distance"), F.coalesce(F.median("distance"), F.lit(0.0)).alias("median_distance"))


def faithfulness(homes: DataFrame) -> DataFrame:
    """``homes(term_id, edge_type)``: shares of is-a, other relations and fabricated edges among leaves with a home."""
    kinds = {"is-a": "is_a", "other-relation": "other_relation", "fabricated": "fabricated"}
    n = F.greatest(F.count_if(F.col("edge_type").isin(*kinds)), F.lit(1))
    return homes.agg(*[(F.count_if(F.col("edge_type") == k) / n).alias(v) for k, v in kinds.items()])


def settled(homes: DataFrame, direct: DataFrame) -> DataFrame:
    """Distinct chunks that settle at each home: ``homes(term_id, home)``, ``direct(chunk_id, term_id)``."""
    return direct.join(homes.where("home is not null").select("term_id", "home").distinct(), "term_id").groupBy("home").agg(F.count_distinct("chunk_id").alias("n_chunks"))


def rolled_up_below(root: str, direct: DataFrame, anc: DataFrame) -> DataFrame:
    """Distinct chunks of each term, rolled up within the subtree of ``root`` only (the root included)."""
    inside = anc.where(F.col("ancestor") == root).select(F.col("term").alias("t")).union(direct.sparkSession.createDataFrame([(root,)], "t string")).distinct()
    d = direct.join(inside, direct["term_id"] == inside["t"], "left_semi")
    up = anc.join(inside.withColumnRenamed("t", "ancestor"), "ancestor", "left_semi").select(F.col("term").alias("term_id"), "ancestor")
    wide = d.select("chunk_id", "term_id").union(d.join(up, "term_id").select("chunk_id", F.col("ancestor").alias("term_id"))).distinct()
    return wide.groupBy("term_id").agg(F.count("*").alias("n_chunks"))


def concentration(counts: DataFrame, top: int = 5) -> DataFrame:
    """``counts(topic, term_id, n)``: share of each topic's mentions that its ``top`` terms have; ties by id."""
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("n"), "term_id"))
    some = counts.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("topic").agg(F.sum("n").alias("head"))
    return counts.groupBy("topic").agg(F.sum("n").alias("all")).join(some, "topic").select("topic", (F.col("head") / F.col("all")).alias("share"))


def nameability(labels: DataFrame, recognised) -> DataFrame:
    """Share of ``labels(label)`` that ``recognised`` (an expression or UDF over the label) accepts; what it can't judge (null) counts as no."""
    return labels.agg(F.count("*").alias("n_labels"), F.when(F.count("*") == 0, 0.0).otherwise(F.count_if(F.coalesce(recognised(F.col("label")), F.lit(False))) / F.count("*")).alias("share"))


def macro_topics(names: list[str], vectors: list[list[float]], k: int) -> dict[str, int]:
    """Agglomerative clustering (average linkage, cosine) of topics into ``k`` groups, numbered by first name.

    Topics are what people look at, so their vectors are a bounded list; ties merge the pair that comes first.
    """
    if not names:
        return {}
    x = np.asarray(vectors, np.float64).reshape(len(names), -1)
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    far = 1 - x @ x.T
    np.fill_diagonal(far, np.inf)
    groups: dict[int, list[int]] = {i: [i] for i in range(len(names))}
    while len(groups) > max(1, k):
        i, j = divmod(int(np.argmin(far)), len(names))
        i, j = min(i, j), max(i, j)
        a, b = len(groups[i]), len(groups[j])
        merged = (a * far[i] + b * far[j]) / (a + b)
        far[i], far[:, i] = merged, merged
        far[i, i] = np.inf
        far[j], far[:, j] = np.inf, np.inf
        groups[i] += groups.pop(j)
    order = sorted(groups.values(), key=lambda g: min(names[i] for i in g))
    return {names[i]: n for n, g in enumerate(order) for i in g}
