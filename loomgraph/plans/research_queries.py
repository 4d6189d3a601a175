"""Queries of the analytics that go beyond the build: consolidation, grouping, re-tiering, profiles, sampling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import consolidation, evaluation, grouping, navigation, ontology, quality, themes
from .standin import FLOOR, SQL, Tables

QUERIES, ORACLE = {}, {}


def query(sql: str | None, standin: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = SQL + sql if standin else sql
        return f

    return add


_LABELS = "(SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'non-' ELSE '' END || CASE s_suppkey % 3 WHEN 0 THEN 'red ring' WHEN 1 THEN 'ring' ELSE 'ring fresh' END AS label FROM supplier)"


@query(f"SELECT a.id AS a, b.id AS b, CASE WHEN (a.label LIKE 'non-%') <> (b.label LIKE 'non-%') THEN 'subtype' WHEN replace(a.label, 'non-', 'non ') <> replace(b.label, 'non-', 'non ') AND (contains(' ' || replace(a.label, 'non-', 'non ') || ' ', ' ' || replace(b.label, 'non-', 'non ') || ' ') OR contains(' ' || replace(b.label, 'non-', 'non ') || ' ', ' ' || replace(a.label, 'non-', 'non ') || ' ')) AND (contains(a.label, 'red') <> contains(b.label, 'red')) THEN 'compound' WHEN b.id = a.id + 7 THEN 'merged' END AS reason FROM {_LABELS} a JOIN {_LABELS} b ON b.id - a.id BETWEEN 1 AND 9", False)
def consolidation_filters(t):
    k = F.col("s_suppkey")
    label = F.concat(F.when(k % 4 == 0, "non-").otherwise(""), F.when(k % 3 == 0, "red ring").when(k % 3 == 1, "ring").otherwise("ring fresh"))
    s = t.read("supplier").select(k.alias("shelf_id"), k.cast("string").alias("term_id"), label.alias("label"), F.array((k + 7).cast("string")).alias("see_also"))
    pairs = s.select(F.col("shelf_id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(9))).alias("d")).select("a", (F.col("a") + F.col("d")).alias("b"), F.lit(1.0).alias("sim"))
    return consolidation.filtered(pairs, s).select("a", "b", "reason")


@query(f", g AS (SELECT shelf_id AS sid, parent AS p FROM shelves WHERE shelf_id LIKE 'P:%' AND direct >= 33), c AS (SELECT s.*, s.parent AS cluster FROM shelves s JOIN g ON sid = shelf_id), k AS (SELECT cluster, arg_min(shelf_id, depth * 1000000000000 + length(label) * 1000000000 + CAST(substr(shelf_id, 3) AS BIGINT) * 0) AS x FROM c GROUP BY cluster), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY depth, length(label), label, shelf_id) AS n FROM c), a AS (SELECT cluster, CAST(sum(direct) AS BIGINT) AS d, CAST(sum(chunk_count) AS BIGINT) AS w, string_agg(term_id, ',' ORDER BY term_id) FILTER (WHERE n > 1) AS see FROM r GROUP BY cluster) SELECT s.shelf_id, coalesce(a.d, s.direct) AS direct, coalesce(a.w, s.chunk_count) AS chunk_count, coalesce(a.see, '') AS see_also FROM shelves s LEFT JOIN r ON r.shelf_id = s.shelf_id LEFT JOIN a ON a.cluster = r.cluster WHERE r.n IS NULL OR r.n = 1")
def consolidation_apply(t):
    s = t.shelves.withColumn("see_also", F.array().cast("array<string>"))
    g = t.shelves.where("shelf_id like 'P:%' and direct >= 33").select(F.col("parent").alias("cluster"), F.col("shelf_id").alias("node"))
    out = consolidation.apply_groups(s, g)
    return out.select("shelf_id", "direct", "chunk_count", F.array_join("see_also", ",").alias("see_also"))


@query("SELECT term_id, count(DISTINCT chunk_id) AS n_chunks FROM links GROUP BY term_id")
def leaf_chunks(t):
    return grouping.leaf_chunks(t.links)


_ANCHORS = ", an AS (SELECT DISTINCT p_type AS grp, 'T:' || p_type AS anchor FROM part WHERE p_type < 'P' UNION ALL SELECT DISTINCT 'brand', 'BT:' || p_brand || '/PROMO' FROM part), ab AS (SELECT term, count(*) AS above FROM anc GROUP BY term), reach AS (SELECT DISTINCT l.term_id, a.ancestor AS anchor FROM links l JOIN anc a ON a.term = l.term_id UNION SELECT term_id, term_id FROM links), asg AS (SELECT term_id, grp FROM (SELECT r.term_id, an.grp, row_number() OVER (PARTITION BY r.term_id ORDER BY coalesce(above, 0) DESC, an.grp) AS k FROM reach r JOIN an ON an.anchor = r.anchor LEFT JOIN ab ON ab.term = r.anchor) WHERE k = 1)"


def _anchors(t):
    p = t.read("part")
    types = p.where("p_type < 'P'").select(F.col("p_type").alias("group"), F.concat(F.lit("T:"), "p_type").alias("anchor"))
    return types.union(p.select(F.lit("brand"), F.concat(F.lit("BT:"), "p_brand", F.lit("/PROMO")))).distinct()


@query(_ANCHORS + ' SELECT term_id, grp AS "group" FROM asg')
def leaf_assignment(t):
    return grouping.assign_leaves(t.links, _anchors(t), t.anc)


@query(_ANCHORS + ", pr AS (SELECT DISTINCT grp, chunk_id FROM links JOIN asg USING (term_id)) SELECT grp AS shelf_id, 'root' AS parent, count(*) AS chunk_count FROM pr GROUP BY grp UNION ALL SELECT 'root', NULL, count(DISTINCT chunk_id) FROM pr")
def grouped_shelves(t):
    return grouping.grouped_shelves(t.links, grouping.assign_leaves(t.links, _anchors(t), t.anc))


@query("SELECT c_custkey AS id, list_reduce(list_transform(list_filter(string_split(regexp_replace(lower(c_mktsegment || ' And ' || c_name || 's, x'), '\\s+and\\s+|\\s*,\\s*|\\s*/\\s*', chr(1), 'g'), chr(1)), lambda p: length(regexp_replace(trim(p), 's+$', '')) > 0), lambda p: regexp_replace(trim(p), 's+$', '')), lambda a, b: a || '|' || b) AS concepts FROM customer", False)
def group_concepts(t):
    label = F.concat("c_mktsegment", F.lit(" And "), "c_name", F.lit("s, x"))
    return t.read("customer").select(F.col("c_custkey").alias("id"), F.array_join(grouping.concepts(label), "|").alias("concepts"))


@query(", ab AS (SELECT term, count(*) AS above FROM anc GROUP BY term), c AS (SELECT u.ancestor AS tier, count(DISTINCT s.shelf_id) AS cover FROM shelves s JOIN anc u ON u.term = s.term_id WHERE s.parent = 'facet:all' AND u.ancestor NOT IN (SELECT term_id FROM shelves) GROUP BY u.ancestor HAVING count(DISTINCT s.shelf_id) >= 2) SELECT tier, cover FROM c ORDER BY cover DESC, tier LIMIT 20")
def tier_candidates(t):
    s = t.shelves
    kids = s.where("parent = 'facet:all'").select("shelf_id", "term_id")
    up = kids.join(t.anc, F.col("term_id") == F.col("term")).select("shelf_id", F.col("ancestor").alias("tier"))
    new = up.join(s.select(F.col("term_id").alias("tier")), "tier", "left_anti")
    return new.groupBy("tier").agg(F.count_distinct("shelf_id").alias("cover")).where("cover >= 2").orderBy(F.desc("cover"), "tier").limit(20)


@query(f", ab AS (SELECT term, count(*) AS above FROM anc GROUP BY term), r AS (SELECT l.term_id, u.ancestor, row_number() OVER (PARTITION BY l.term_id ORDER BY coalesce(above, 0) DESC, u.ancestor) AS k FROM (SELECT DISTINCT term_id FROM links) l JOIN (SELECT term, ancestor FROM anc UNION SELECT DISTINCT term, term FROM anc) u ON u.term = l.term_id JOIN support s ON s.term_id = u.ancestor AND s.with_descendants >= 200 LEFT JOIN ab ON ab.term = u.ancestor) SELECT l.term_id, coalesce(r.ancestor, l.term_id) AS entry FROM (SELECT DISTINCT term_id FROM links) l LEFT JOIN r ON r.term_id = l.term_id AND r.k = 1")
def entry_points(t):
    leaves = t.links.select("term_id").distinct()
    rank = t.anc.groupBy("term").agg(F.count("*").alias("above")).withColumnRenamed("term", "ancestor")
    reach = t.anc.select(F.col("term").alias("term_id"), "ancestor").union(leaves.select("term_id", F.col("term_id").alias("ancestor")))
    ok = t.support.where("with_descendants >= 200").select(F.col("term_id").alias("ancestor"))
    ranked = leaves.join(reach, "term_id").join(ok, "ancestor").join(rank, "ancestor", "left")
    best = ranked.groupBy("term_id").agg(F.min(F.struct((-F.coalesce("above", F.lit(0))).alias("n"), "ancestor")).alias("x"))
    return leaves.join(best, "term_id", "left").select("term_id", F.coalesce("x.ancestor", "term_id").alias("entry"))


@query("SELECT regexp_replace(label, '(^| )(small|large|red|blue)( |$)', ' ', 'g') AS concept, max_by(term_id, (with_descendants, term_id)) AS representative, CAST(count(*) AS BIGINT) AS n FROM support JOIN terms ON id = term_id WHERE id LIKE 'P:%' GROUP BY 1")
def concept_merge(t):
    key = F.regexp_replace("label", "(^| )(small|large|red|blue)( |$)", " ")
    j = t.support.join(t.terms.where("id like 'P:%'").select(F.col("id").alias("term_id"), "label"), "term_id")
    return j.groupBy(key.alias("concept")).agg(F.max_by("term_id", F.struct("with_descendants", "term_id")).alias("representative"), F.count("*").alias("n"))


@query("SELECT term_id, bucket, rank FROM (SELECT term_id, 'head' AS bucket, row_number() OVER (ORDER BY count(*) DESC, term_id) AS rank FROM links GROUP BY term_id UNION ALL SELECT term_id, 'tail', row_number() OVER (ORDER BY count(*), term_id) FROM links GROUP BY term_id) WHERE rank <= 15")
def stratified_sample(t):
    n = t.links.groupBy("term_id").agg(F.count("*").alias("n"))
    head = n.orderBy(F.desc("n"), "term_id").limit(15)
    tail = n.orderBy("n", "term_id").limit(15)
    return head.select("term_id", F.lit("head").alias("bucket"), F.row_number().over(Window.orderBy(F.desc("n"), "term_id")).alias("rank")).unionByName(tail.select("term_id", F.lit("tail").alias("bucket"), F.row_number().over(Window.orderBy("n", "term_id")).alias("rank")))


@query("SELECT a.id AS theme_id, arg_max(b.id, (j, -b.id)) AS topic, round(max(j), 9) AS jaccard FROM (SELECT x.i AS id, y.j2 AS b_id, y.c / (x.n + z.n - y.c) AS j FROM (SELECT label AS i, count(*) AS n FROM embeddings GROUP BY 1) x JOIN (SELECT label AS i2, vec_id % 7 AS j2, count(*) AS c FROM embeddings GROUP BY ALL) y ON y.i2 = x.i JOIN (SELECT vec_id % 7 AS k, count(*) AS n FROM embeddings GROUP BY 1) z ON z.k = y.j2) a JOIN (SELECT DISTINCT vec_id % 7 AS id FROM embeddings) b ON b.id = a.b_id GROUP BY a.id", False)
def best_match_topic(t):
    v = t.vectors
    o = themes.overlap(v.select(F.col("label").alias("i"), F.col("vec_id").alias("member")), v.select((F.col("vec_id") % 7).alias("j"), F.col("vec_id").alias("member")))
    return o.groupBy(F.col("i").alias("theme_id")).agg(F.max_by("j", F.struct("jaccard", -F.col("j"))).alias("topic"), F.round(F.max("jaccard"), 9).alias("jaccard"))


@query("SELECT count(*) FILTER (WHERE a AND b) / count(*) AS jaccard FROM (SELECT p_partkey, p_size < 30 AS a, p_size > 10 AS b FROM part) WHERE a OR b", False)
def reproducibility(t):
    p = t.read("part")
    return evaluation.reproducibility(p.where("p_size < 30").select(F.col("p_partkey").alias("node")), p.where("p_size > 10").select(F.col("p_partkey").alias("node")))


@query("SELECT spans, count(*) AS n_themes FROM (SELECT o_custkey % 50 AS theme, count(DISTINCT shelf_id) // 20 AS spans FROM orders JOIN resolved ON chunk_id = o_orderkey GROUP BY 1) GROUP BY spans")
def bridge_stats(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 50).alias("theme"))
    per = o.join(t.resolved, "chunk_id").groupBy("theme").agg(F.expr("count(distinct shelf_id) div 20").alias("spans"))
    return per.groupBy("spans").agg(F.count("*").alias("n_themes"))


@query(f"SELECT o.term_id, h.ancestor AS home, o.n FROM (SELECT term_id, count(DISTINCT chunk_id) AS n FROM links WHERE confidence < {FLOOR} AND term_id NOT IN (SELECT term_id FROM shelves) GROUP BY term_id) o JOIN (SELECT term, ancestor, row_number() OVER (PARTITION BY term ORDER BY d.depth DESC, ancestor) AS k FROM anc JOIN (SELECT term AS t, depth FROM depth) d ON d.t = ancestor WHERE ancestor NOT IN ('ROOT')) h ON h.term = o.term_id AND h.k = 1")
def whitelist_candidates(t):
    gone = t.links.where(F.col("confidence") < FLOOR).join(t.shelves.select("term_id"), "term_id", "left_anti").groupBy("term_id").agg(F.count_distinct("chunk_id").alias("n"))
    d = t.depth.select(F.col("term").alias("ancestor"), "depth")
    best = t.anc.where("ancestor <> 'ROOT'").join(d, "ancestor").groupBy("term").agg(F.min(F.struct((-F.col("depth")).alias("k"), "ancestor")).alias("x"))
    return gone.join(best, F.col("term_id") == F.col("term")).select("term_id", F.col("x.ancestor").alias("home"), "n")


@query("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(label, '#') THEN 'garbled' WHEN regexp_matches(label, '(ing|tion)$') THEN 'process' ELSE 'recognizable' END AS kind FROM terms) GROUP BY kind")
def label_shares(t):
    kind = F.when(F.contains("label", F.lit("#")), "garbled").when(F.rlike("label", F.lit("(ing|tion)$")), "process").otherwise("recognizable")
    return t.terms.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT least(CAST(floor(j * 10) AS INT), 9) AS bin, count(*) AS n FROM (SELECT c / (x.n + z.n - c) AS j FROM (SELECT label AS i, vec_id % 7 AS k, count(*) AS c FROM embeddings GROUP BY ALL) y JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) x ON x.label = y.i JOIN (SELECT vec_id % 7 AS k, count(*) AS n FROM embeddings GROUP BY 1) z ON z.k = y.k) GROUP BY 1", False)
def jaccard_histogram(t):
    v = t.vectors
    o = themes.overlap(v.select(F.col("label").alias("i"), F.col("vec_id").alias("member")), v.select((F.col("vec_id") % 7).alias("j"), F.col("vec_id").alias("member")))
    return o.groupBy(F.least(F.floor(F.col("jaccard") * 10).cast("int"), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT c.shelf_id, count(DISTINCT x.shelf_id) AS n_children FROM shelves c LEFT JOIN shelves x ON x.parent = c.shelf_id GROUP BY c.shelf_id")
def shelf_children(t):
    s = t.shelves
    kids = s.where("parent is not null").groupBy(F.col("parent").alias("shelf_id")).agg(F.count("*").alias("n_children"))
    return s.select("shelf_id").join(kids, "shelf_id", "left").select("shelf_id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


@query("SELECT lang AS source_type, doc_id AS chunk_id, length(text) AS n, CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) <= 40 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) ELSE rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 39)) || '…' END AS snippet FROM documents", False)
def chunk_snippets(t):
    from ..functions.text import snippet

    return t.chunks.select("source_type", "chunk_id", F.length("text").cast("long").alias("n"), snippet(F.col("text"), 40).alias("snippet"))


@query("SELECT shelf_id AS node, 'x' AS side FROM shelves WHERE chunk_count >= 60 EXCEPT SELECT shelf_id, 'x' FROM shelves WHERE depth > 2")
def shelf_difference(t):
    s = t.shelves
    return s.where("chunk_count >= 60").select(F.col("shelf_id").alias("node"), F.lit("x").alias("side")).exceptAll(s.where("depth > 2").select("shelf_id", F.lit("x")))


@query("SELECT (SELECT count(*) FROM shelves) AS n_shelves, (SELECT count(*) FROM shelves WHERE parent IS NULL) AS n_roots, (SELECT count(DISTINCT label) FROM embeddings) AS n_themes")
def graph_summary(t):
    s = t.shelves.agg(F.count("*").alias("n_shelves"), F.count_if(F.col("parent").isNull()).alias("n_roots"))
    return s.crossJoin(F.broadcast(t.vectors.agg(F.count_distinct("label").alias("n_themes"))))


@query("SELECT 'attached' AS \"check\", (SELECT count(DISTINCT chunk_id) FILTER (WHERE mode <> 'orphan') / count(DISTINCT chunk_id) FROM resolved) >= 0.95 AS passed, 'critical' AS severity UNION ALL SELECT 'one_root', (SELECT count(*) FROM shelves WHERE parent IS NULL) <= 1, 'warning'")
def audit_report(t):
    s = t.shelves
    anc = ontology.closure(s.where("parent is not null").select(F.col("shelf_id").alias("child"), "parent"))
    return quality.report([("attached", quality.coverage(t.links, t.resolved.where("mode <> 'orphan'")), F.col("share") >= 0.95, "critical"), ("one_root", quality.structure(s, anc), F.col("roots") <= 1, "warning")])



_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(f"WITH w AS (SELECT source AS shelf_id, doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}'), lambda x: x NOT IN ({_STOP}))) AS term FROM documents), tf AS (SELECT shelf_id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term), s AS (SELECT shelf_id, term, round(tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 9) AS score FROM tf JOIN df USING (term)) SELECT shelf_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY shelf_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 100", False)
def shelf_terms(t):
    return navigation.shelf_terms(t.chunks.select(F.col("source_doc_id").alias("shelf_id"), "chunk_id", "text"))


@query("SELECT shelf_id, source, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY shelf_id ORDER BY n DESC, source) AS rank FROM (SELECT shelf_id, o_custkey % 100 AS source, count(*) AS n FROM (SELECT DISTINCT chunk_id, shelf_id FROM resolved) JOIN orders ON o_orderkey = chunk_id GROUP BY ALL)) WHERE rank <= 40")
def shelf_sources(t):
    return navigation.shelf_sources(t.resolved, t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 100).alias("source")))


@query(", seed AS (SELECT DISTINCT shelf_id FROM resolved WHERE term_id IN ('P:3', 'P:7', 'P:11')), act AS (SELECT shelf_id FROM seed UNION SELECT parent FROM shelves WHERE shelf_id IN (SELECT shelf_id FROM seed) AND parent IS NOT NULL UNION SELECT shelf_id FROM shelves WHERE parent IN (SELECT shelf_id FROM seed)) SELECT o_custkey % 200 AS theme_id, count(DISTINCT shelf_id) AS n_shelves FROM orders JOIN resolved ON chunk_id = o_orderkey WHERE shelf_id IN (SELECT shelf_id FROM act) GROUP BY 1 ORDER BY n_shelves DESC, theme_id LIMIT 20")
def activated_themes(t):
    terms = t.spark.createDataFrame([("P:3",), ("P:7",), ("P:11",)], "term_id string")
    members = t.read("orders").select((F.col("o_custkey") % 200).alias("theme_id"), F.col("o_orderkey").alias("chunk_id"))
    return navigation.activated_themes(terms, t.resolved, t.shelves, members)


@query("SELECT chunk_id, string_agg(DISTINCT term_id, ',' ORDER BY term_id) AS term_ids FROM links GROUP BY chunk_id")
def mention_map(t):
    return navigation.mention_map(t.links).select("chunk_id", F.array_join("term_ids", ",").alias("term_ids"))
