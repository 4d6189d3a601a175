"""Audits and quality reports as long-form frames of checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import source_of


def parity(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """One row: size of either edge set, of both, and the ratio of common to all (1 when both are empty)."""
    x, y = a.select(*keys).distinct().withColumn("in_a", F.lit(1)), b.select(*keys).distinct().withColumn("in_b", F.lit(1))
    met = x.join(y, list(keys), "full").agg(F.count("in_a").alias("n_a"), F.count("in_b").alias("n_b"), F.count(F.col("in_a") + F.col("in_b")).alias("n_both"))
    union = F.col("n_a") + F.col("n_b") - F.col("n_both")
    return met.withColumn("ratio", F.when(union == 0, 1.0).otherwise(F.col("n_both") / union))


def coverage(chunks: DataFrame, attached: DataFrame) -> DataFrame:
    """Chunks with terms, and how many of them are attached."""
    a = attached.select("chunk_id").distinct().withColumn("ok", F.lit(1))
    g = chunks.select("chunk_id").distinct().join(a, "chunk_id", "left").agg(F.count("*").alias("n_bearing"), F.count("ok").alias("n_attached"))
    return g.withColumn("share", F.when(F.col("n_bearing") == 0, 1.0).otherwise(F.col("n_attached") / F.col("n_bearing")))


def mention_buckets(denorm: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks by how their two term sets relate: exact, more in the denormalised one, more in the mentions, partial."""
    d = denorm.select("chunk_id", "term_id").distinct().withColumn("d", F.lit(1))
    m = mentions.select("chunk_id", "term_id").distinct().withColumn("m", F.lit(1))
    per = d.join(m, ["chunk_id", "term_id"], "full").groupBy("chunk_id").agg(F.count("d").alias("nd"), F.count("m").alias("nm"), F.count(F.col("d") + F.col("m")).alias("both"))
    kind = F.when((F.col("nd") == F.col("both")) & (F.col("nm") == F.col("both")), "exact").when(F.col("nm") == F.col("both"), "denorm_superset").when(F.col("nd") == F.col("both"), "mentions_superset").otherwise("partial")
    return per.groupBy(kind.alias("bucket")).agg(F.count("*").alias("n_chunks"))


def drift(shelves: DataFrame, edges: DataFrame) -> DataFrame:
    """Shelves whose recorded direct support differs from the attached direct chunks, largest difference first."""
    real = edges.where(F.size("lifted_from") == 0).groupBy("shelf_id").agg(F.count_distinct("chunk_id").alias("actual"))
    j = shelves.join(real, "shelf_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return j.withColumn("delta", F.col("actual") - F.col("direct")).where("delta <> 0").select("shelf_id", "direct", "actual", "delta").orderBy(F.desc(F.abs("delta")), "shelf_id")


def structure(shelves: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Dangling parents, cycles, roots: one row of counts."""
    ids = shelves.select(F.col("shelf_id").alias("parent"))
    dangling = shelves.where("parent is not null").join(ids, "parent", "left_anti").agg(F.count("*").alias("dangling"))
    cycles = ancestors.where("term = ancestor").agg(F.count("*").alias("cycles"))
    roots = shelves.where("parent is null").agg(F.count("*").alias("roots"))
    return dangling.crossJoin(F.broadcast(cycles)).crossJoin(F.broadcast(roots))


def report(checks: list[tuple[str, DataFrame, Column, str]]) -> DataFrame:
    """(name, one-row frame, pass condition, severity) to the long table of checks."""
    out = None
    for name, frame, ok, severity in checks:
        row = frame.select(F.lit(name).alias("check"), ok.alias("passed"), F.lit(severity).alias("severity"))
        out = row if out is None else out.unionByName(row)
    return out


def passes(checks: DataFrame) -> DataFrame:
    """A report passes if and only if no critical check fails."""
    return checks.agg((F.count_if(~F.col("passed") & (F.col("severity") == "critical")) == 0).alias("passed"))


def suspicious(shelves: DataFrame) -> DataFrame:
    """First rule that fits: coded label, data label, preparation suffix, single leaf child, empty shelf."""
    kids = shelves.where("parent is not null").groupBy(F.col("parent").alias("shelf_id")).agg(F.count("*").alias("n_children"), F.min("shelf_id").alias("only"))
    leafless = kids.select(F.col("shelf_id").alias("only"), F.lit(True).alias("inner"))
    j = shelves.join(kids, "shelf_id", "left").join(leafless, "only", "left")
    label = F.lower("label")
    rule = (
        F.when(F.rlike("label", F.lit("^[0-4]")) & F.contains("label", F.lit(" - ")), "coded")
        .when(F.contains(label, F.lit("datum")) | F.rlike(label, F.lit(r"\bdata\b")), "data")
        .when(F.endswith(label, F.lit(" (raw)")) | F.endswith(label, F.lit(" (canned)")), "preparation")
        .when((F.col("n_children") == 1) & F.col("inner").isNull(), "single_leaf_child")
        .when(F.col("chunk_count") == 0, "empty")
    )
    return j.withColumn("rule", rule).where("rule is not null").select("shelf_id", "rule")


def vocabulary(words: DataFrame, shelves: DataFrame, terms: DataFrame) -> DataFrame:
    """For each word: shelf by label, shelf by term name, term by name, or not found; the first that fits."""
    by_label = shelves.groupBy(F.lower("label").alias("w")).agg(F.min("shelf_id").alias("s1"))
    by_name = terms.groupBy(F.lower("label").alias("w")).agg(F.min("id").alias("t"))
    on_shelf = shelves.groupBy(F.col("term_id").alias("t")).agg(F.min("shelf_id").alias("s2"))
    j = words.withColumn("w", F.lower("word")).join(by_label, "w", "left").join(by_name, "w", "left").join(on_shelf, "t", "left")
    how = F.when(F.col("s1").isNotNull(), "label").when(F.col("s2").isNotNull(), "term_shelf").when(F.col("t").isNotNull(), "term_only").otherwise("not_found")
    return j.select("word", how.alias("how"), F.coalesce("s1", "s2").alias("shelf_id"))


def shelf_metrics(shelves: DataFrame) -> DataFrame:
    """One row: depths, fan-out, sizes, direct and lifted sums."""
    fan = shelves.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n")).agg(F.max("n").alias("max_fanout"))
    lifted = F.greatest(F.col("chunk_count") - F.col("direct"), F.lit(0))
    g = shelves.agg(F.count("*").alias("n_shelves"), F.max("depth").alias("max_depth"), F.median("depth").alias("median_depth"), F.count_if(F.col("direct") == 0).alias("n_zero_direct"), F.sum("direct").alias("sum_direct"), F.sum(lifted).alias("sum_lifted"), F.min("chunk_count").alias("min_chunks"), F.median("chunk_count").alias("median_chunks"), F.max("chunk_count").alias("max_chunks"))
    return g.crossJoin(F.broadcast(fan))


def warnings(shelves: DataFrame, themes: DataFrame, signature_size: int = 8) -> DataFrame:
    """(kind, subject): inflated shelves, big shelves without themes, one-sided passes, long signatures.

    ``themes(theme_id, shelf_id, label, pass, n_signature)``.
    """
    lifted = F.greatest(F.col("chunk_count") - F.col("direct"), F.lit(0))
    inflated = shelves.where((F.col("direct") < 3) & (lifted / F.greatest(F.col("direct"), F.lit(1)) >= 4)).select(F.lit("inflated").alias("kind"), F.col("shelf_id").alias("subject"))
    bare = shelves.where("chunk_count >= 50").join(themes.select("shelf_id").distinct(), "shelf_id", "left_anti").select(F.lit("no_themes").alias("kind"), F.col("shelf_id").alias("subject"))
    counts = themes.groupBy("shelf_id", "pass").agg(F.count("*").alias("n"))
    sided = counts.groupBy("shelf_id").agg(F.sum("n").alias("all"), F.max("n").alias("top")).where("all >= 2 and top / all > 0.9").select(F.lit("one_sided").alias("kind"), F.col("shelf_id").alias("subject"))
    wide = themes.where(F.col("n_signature") > signature_size).select(F.lit("wide_signature").alias("kind"), F.col("theme_id").alias("subject"))
    same = themes.alias("t").join(shelves.alias("s"), F.lower("t.label") == F.lower("s.label")).select(F.lit("label_repeats_shelf").alias("kind"), F.col("t.theme_id").alias("subject")).distinct()
    return inflated.unionByName(bare).unionByName(sided).unionByName(wide).unionByName(same)


@dataclass(frozen=True)
class SweepBand:
    low: int = 3
    per_shelf: int = 12


def sweep_score(runs: DataFrame, band: SweepBand = SweepBand()) -> DataFrame:
    """``runs(run, coverage, n_themes, n_merged, n_duplicate, n_tiny, n_leaky, n_shelves)`` with their score, best first."""
    n = F.greatest("n_themes", F.lit(1))
    high = F.greatest(band.per_shelf * F.greatest("n_shelves", F.lit(1)), F.lit(band.low))
    over = F.when(F.col("n_themes") < band.low, (band.low - F.col("n_themes")) / band.low).when(F.col("n_themes") > high, (F.col("n_themes") - high) / high).otherwise(0.0)
    score = F.col("coverage") + 0.5 * F.col("n_merged") / n - 0.5 * F.col("n_duplicate") / n - 0.5 * F.col("n_tiny") / n - F.col("n_leaky") / n - 0.3 * F.least(F.lit(1.0), over)
    return runs.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), "run")


def near_labels(themes: DataFrame, least: float = 0.80) -> DataFrame:
    """Pairs of themes of one shelf whose labels' token sets have a Jaccard similarity of ``least`` or more. ``themes(theme_id, shelf_id, label)``.

    Pairs meet under a token they share, once per shelf; labels without tokens meet nothing.
    """
    t = themes.select("shelf_id", "theme_id", F.array_distinct(F.regexp_extract_all(F.lower("label"), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w")).withColumn("n", F.size("w")).where("n > 0").distinct()
    e = t.select("shelf_id", "theme_id", "n", F.explode("w").alias("word"))
    a, b = e.toDF("shelf_id", "a", "na", "word"), e.toDF("shelf_id", "b", "nb", "word")
    both = a.join(b, ["shelf_id", "word"]).where("a < b").groupBy("shelf_id", "a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return both.where(F.col("c") >= least * (F.col("na") + F.col("nb") - F.col("c"))).select("shelf_id", "a", "b")


def theme_stats(themes: DataFrame, members: DataFrame, attached: DataFrame, tiny: int = 15) -> DataFrame:
    """One row: coverage of attached chunks, themes by source, repeated labels, tiny and leaking themes, orphan chunks.

    ``themes(theme_id, label, pass, shelf_ids)``, ``members(theme_id, chunk_id)``, ``attached(chunk_id)``.
    A label repeats if two themes of one shelf bear it, whatever its case; a theme leaks
    if it has more than one shelf.
    """
    themed = members.select("chunk_id").distinct().withColumn("t", F.lit(1))
    cover = attached.select("chunk_id").distinct().join(themed, "chunk_id", "left").agg(F.count("*").alias("n"), F.count("t").alias("m"))
    cover = cover.select(F.when(F.col("n") == 0, 0.0).otherwise(F.col("m") / F.col("n")).alias("coverage"), (F.col("n") - F.col("m")).alias("n_orphans"))
    labels = themes.select(F.explode("shelf_ids").alias("s"), F.lower(F.trim("label")).alias("l")).groupBy("s", "l").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias("n_repeated"))
    sizes = themes.select("theme_id").join(members.groupBy("theme_id").agg(F.count_distinct("chunk_id").alias("k")), "theme_id", "left").agg(F.count_if(F.coalesce("k", F.lit(0)) < tiny).alias("n_tiny"))
    source = lambda s: F.count_if(source_of(F.col("pass")) == s)
    t = themes.agg(F.count("*").alias("n_themes"), source("merged").alias("n_merged"), source("similarity_only").alias("n_similarity"), source("relatedness_only").alias("n_relatedness"), F.count_if(F.size("shelf_ids") > 1).alias("n_leaking"))
    return t.crossJoin(F.broadcast(cover)).crossJoin(F.broadcast(labels)).crossJoin(F.broadcast(sizes))


def audit_themes(themes: DataFrame, members: DataFrame, denorm: DataFrame) -> DataFrame:
    """One row: do theme edges and the chunks' own theme ids agree, and are there dangling, empty or shelfless themes.

    ``themes(theme_id, pass, shelf_ids)``, ``members(theme_id, chunk_id)``, ``denorm(chunk_id, theme_id)``.
    It passes with full parity and none of the three.
    """
    known = themes.select("theme_id")
    same = parity(members, denorm, "theme_id", "chunk_id").select(F.col("ratio").alias("parity"))
    dangling = denorm.select("chunk_id", "theme_id").distinct().join(known, "theme_id", "left_anti").agg(F.count("*").alias("n_dangling"))
    empty = known.join(members.select("theme_id").distinct(), "theme_id", "left_anti").agg(F.count("*").alias("n_empty"))
    t = themes.agg(F.count("*").alias("n_themes"), F.count_if(F.size("shelf_ids") <= 0).alias("n_orphan"), F.count_if(F.col("pass") == "merged").alias("m"))
    row = t.crossJoin(F.broadcast(same)).crossJoin(F.broadcast(dangling)).crossJoin(F.broadcast(empty))
    good = (F.col("parity") == 1) & (F.col("n_dangling") == 0) & (F.col("n_empty") == 0) & (F.col("n_orphan") == 0)
    return row.select("n_themes", "parity", "n_dangling", "n_empty", "n_orphan", F.when(F.col("n_themes") == 0, 0.0).otherwise(F.col("m") / F.col("n_themes")).alias("merged_rate"), good.alias("passed"))


def first_orphans(chunks: DataFrame, attached: DataFrame, limit: int = 10) -> DataFrame:
    """The first chunks by id that bear terms but are attached nowhere."""
    return chunks.select("chunk_id").distinct().join(attached.select("chunk_id").distinct(), "chunk_id", "left_anti").orderBy("chunk_id").limit(limit)


def inventory(tables: dict[str, DataFrame], by: str = "facet") -> DataFrame:
    """(kind, group, n): rows of each table by ``by`` (null where a table has no such column)."""
    out = None
    for kind, df in tables.items():
        group = F.col(by).cast("string") if by in df.columns else F.lit(None).cast("string")
        part = df.groupBy(group.alias("group")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "group", "n")
        out = part if out is None else out.unionByName(part)
    return out


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A sample of ``n`` rows (a feature) that reruns repeat: those of least seeded hash."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(n)
