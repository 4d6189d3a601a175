"""Themes: merge decisions, keywords, signatures, shelves, parity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, is_garbage, slug
from ..session import Rounds
from .graphs import with_near


def overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Jaccard of member sets of all candidate pairs that share a member: ``left(i, member)``, ``right(j, member)``."""
    a, b = left.select("i", "member").distinct(), right.select("j", "member").distinct()
    na, nb = a.groupBy("i").agg(F.count("*").alias("ni")), b.groupBy("j").agg(F.count("*").alias("nj"))
    both = a.join(b, "member").groupBy("i", "j").agg(F.count("*").alias("common"))
    return both.join(na, "i").join(nb, "j").select("i", "j", "common", (F.col("common") / (F.col("ni") + F.col("nj") - F.col("common"))).alias("jaccard"))


def merge_scores(chunk_overlap: DataFrame, entity_overlap: DataFrame, chunk_weight: float = 0.6, entity_weight: float = 0.4) -> DataFrame:
    """Weighted Jaccard of chunks and entities; a missing one counts 0."""
    c = chunk_overlap.select("i", "j", F.col("jaccard").alias("jc"))
    e = entity_overlap.select("i", "j", F.col("jaccard").alias("je"))
    met = c.join(e, ["i", "j"], "full").select("i", "j", F.coalesce("jc", F.lit(0.0)).alias("jc"), F.coalesce("je", F.lit(0.0)).alias("je"))
    return met.withColumn("score", chunk_weight * F.col("jc") + entity_weight * F.col("je"))


def greedy_pairs(decisions: list[tuple], threshold: float) -> list[tuple]:
    """One-to-one pairs in order (-score, i, j); candidates are themes, a bounded list on the driver."""
    used_i, used_j, out = set(), set(), []
    for i, j, score in sorted(decisions, key=lambda d: (-d[2], d[0], d[1])):
        if score >= threshold and i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append((i, j, score))
    return out


def merge_candidates(sim: dict, rel: dict, chunk_weight: float = 0.6, entity_weight: float = 0.4, threshold: float = 0.70) -> list[dict]:
    """``sim`` and ``rel``: name to (chunks, entities). Merged themes, then what is left of either side."""

    def j(a: set, b: set) -> float:
        return len(a & b) / len(a | b) if a | b else 0.0

    scores = [(i, k, chunk_weight * j(sim[i][0], rel[k][0]) + entity_weight * j(sim[i][1], rel[k][1])) for i in sim for k in rel]
    pairs = greedy_pairs(scores, threshold)
    out = [{"pass": "merged", "chunks": sim[i][0] | rel[k][0], "entities": sim[i][1] | rel[k][1]} for i, k, _ in pairs]
    out += [{"pass": "global_similarity", "chunks": sim[i][0], "entities": sim[i][1]} for i in sorted(sim) if i not in {p[0] for p in pairs}]
    return out + [{"pass": "relatedness", "chunks": rel[k][0], "entities": rel[k][1]} for k in sorted(rel) if k not in {p[1] for p in pairs}]


#: So many different terms of its themes a task counts before it passes the counts on.
MOST_TERMS = 500_000
_WORD = re.compile(r"[a-z0-9_]{2,}")


def theme_terms(docs: DataFrame) -> DataFrame:
    """1- and 2-grams (stop words removed first) with their counts per theme: ``docs(theme_id, text)``.

    Each task counts its own texts, so that counts are shuffled and not words.
    """
    stop, most = frozenset(STOP_WORDS), MOST_TERMS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        kind = pa.null()

        def passed_on() -> Iterator[pa.RecordBatch]:
            for theme, c in seen.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([theme] * len(c), kind), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["theme_id", "term", "n"])
            seen.clear()

        size = 0
        for b in batches:
            kind = b.schema.field("theme_id").type
            for theme, text in zip(b.column("theme_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                w = [x for x in _WORD.findall(text.lower()) if x not in stop]
                c = seen.setdefault(theme, Counter())
                size -= len(c)
                c.update(w)
                c.update(map(" ".join, zip(w, w[1:])))  # noqa: B905
                size += len(c)
                if size > most:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    counts = docs.select("theme_id", "text").mapInArrow(count, f"theme_id {docs.schema['theme_id'].dataType.simpleString()}, term string, n long")
    return counts.groupBy("theme_id", "term").agg(F.sum("n").alias("tf"))


def keywords(docs: DataFrame, top: int = 5, max_features: int = 2000, drop_garbage: bool = True) -> DataFrame:
    """Class-based tf-idf: tf * (ln((1 + n) / (1 + df)) + 1) over the most frequent terms overall; ties by term."""
    rounds = Rounds(docs.sparkSession, "terms")
    tf = rounds.write(theme_terms(docs))  # read twice
    overall = tf.groupBy("term").agg(F.sum("tf").alias("all"), F.count("*").alias("df")).orderBy(F.desc("all"), "term").limit(max_features)
    n = docs.agg(F.count_distinct("theme_id").alias("n"))
    if drop_garbage:
        overall = overall.where(~is_garbage(F.col("term")))
    # Written, lest the pattern be tried on every term of every theme.
    idf = rounds.write(overall.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    scored = tf.join(idf, "term").withColumn("score", F.round(F.col("tf") * F.col("idf"), 9))
    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("score"), "term"))
    return scored.where("score > 0").withColumn("rank", rank).where(F.col("rank") <= top).select("theme_id", "term", "score", "rank")


def signatures(members: DataFrame, links: DataFrame, top: int = 10) -> DataFrame:
    """Most linked entities per theme: ``members(theme_id, chunk_id)``, ``links(chunk_id, term_id)``; ties by id."""
    counts = members.join(links, "chunk_id").groupBy("theme_id", "term_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("n"), "term_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def shelf_backfill(members: DataFrame, shelf_edges: DataFrame, top: int = 1) -> DataFrame:
    """Shelf (or shelves) that hold most chunks of each theme; ties by id."""
    counts = members.join(shelf_edges, "chunk_id").groupBy("theme_id", "shelf_id").agg(F.count_distinct("chunk_id").alias("n"))
    rank = F.row_number().over(Window.partitionBy("theme_id").orderBy(F.desc("n"), "shelf_id"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top).select("theme_id", "shelf_id", "n")


def npmi(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Mean normalised PMI of each topic's term pairs: ``pairs(topic, t1, t2)``, ``docs(doc, term)`` distinct.

    A pair that never co-occurs counts -1, one with an unseen term 0.
    """
    n = docs.agg(F.count_distinct("doc").alias("n"))
    df = docs.groupBy("term").agg(F.count("*").alias("df"))
    d1, d2 = docs.select(F.col("term").alias("t1"), "doc"), docs.select(F.col("term").alias("t2"), "doc")
    wanted = pairs.select("t1", "t2").distinct()
    both = wanted.join(d1, "t1").join(d2, ["t2", "doc"]).groupBy("t1", "t2").agg(F.count("*").alias("both"))
    p = pairs.join(both, ["t1", "t2"], "left").join(df.select(F.col("term").alias("t1"), F.col("df").alias("a")), "t1", "left").join(df.select(F.col("term").alias("t2"), F.col("df").alias("b")), "t2", "left").crossJoin(F.broadcast(n))
    pab = F.col("both") / F.col("n")
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).when(F.col("both").isNull(), -1.0).when(F.col("both") == F.col("n"), 1.0).otherwise(F.log(pab * F.col("n") * F.col("n") / (F.col("a") * F.col("b"))) / -F.log(pab))
    return p.groupBy("topic").agg(F.avg(score).alias("npmi"))


def origin_shelves(merged: DataFrame, candidates: DataFrame) -> DataFrame:
    """Shelves of all candidates whose chunks lie within a merged theme: ``merged(theme_id, member)``, ``candidates(j, shelf_id, member)``."""
    c = candidates.select("j", "shelf_id", "member").distinct()
    n = c.groupBy("j", "shelf_id").agg(F.count("*").alias("n"))
    inside = c.join(merged.select("theme_id", "member").distinct(), "member").groupBy("theme_id", "j", "shelf_id").agg(F.count("*").alias("m"))
    full = inside.join(n, ["j", "shelf_id"]).where("m = n")
    return full.groupBy("theme_id").agg(F.array_sort(F.collect_set("shelf_id")).alias("shelf_ids"))


def theme_ids(themes: DataFrame, facet: str) -> DataFrame:
    """``themes(key, shelf_id, label, pass)`` with ``theme_id``: facet/shelf/label, the pass's letter and a number within the pass by key."""
    letter = F.when(F.col("pass") == "relatedness", "r").when(F.col("pass") == "merged", "m").otherwise("g")
    seq = F.row_number().over(Window.partitionBy("pass").orderBy("key"))
    name = F.concat(F.lit(f"{facet}/"), slug(F.substring_index("shelf_id", "/", -1)), F.lit("/"), slug(F.col("label")), F.lit("_"), letter, seq.cast("string"))
    return themes.withColumn("theme_id", name)


def eligible_shelves(attached: DataFrame, min_chunks: int, root_id: str, vectors: DataFrame | None = None, embedded: float = 0.80) -> DataFrame:
    """Shelves worth clustering: no synthetic root, enough chunks; with ``vectors(chunk_id)`` also enough of them with a vector."""
    a = attached.where(F.col("shelf_id") != root_id).select("shelf_id", "chunk_id").distinct()
    if vectors is not None:
        a = a.join(vectors.select("chunk_id", F.lit(1).alias("v")).distinct(), "chunk_id", "left")
    g = a.groupBy("shelf_id").agg(F.count("*").alias("n_chunks"), *([F.count("v").alias("n_vectors")] if vectors is not None else [])).where(F.col("n_chunks") >= min_chunks)
    return g if vectors is None else g.where((F.col("n_vectors") >= min_chunks) & (F.col("n_vectors") >= embedded * F.col("n_chunks")))


def directness(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(theme_id, chunk_id, badge): similarity themes hold chunks directly, relatedness ones indirectly; in merged themes a chunk is direct if another one's vector is near.

    ``members(theme_id, pass, chunk_id)``, ``vectors(chunk_id, embedding)`` of length one.
    """
    m = members.where("pass = 'merged'").join(vectors.where("embedding is not null and size(embedding) > 0"), "chunk_id").select("theme_id", F.col("chunk_id").alias("id"), F.col("embedding").alias("v"))
    near = with_near(m, threshold).select("theme_id", F.col("id").alias("chunk_id"), F.lit(True).alias("near"))
    badge = F.when(F.col("pass") == "global_similarity", "direct").when(F.col("pass") == "relatedness", "indirect").when(F.col("near"), "direct").otherwise("indirect")
    return members.join(near, ["theme_id", "chunk_id"], "left").select("theme_id", "chunk_id", badge.alias("badge"))
