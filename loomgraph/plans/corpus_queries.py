"""Queries over texts, vectors, communities, themes, retrieval and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import cards, community, evaluation, graphs, quality, retrieval, themes, views
from ..sources import chunks, nel, sinks
from .standin import SQL, TAU, Tables

QUERIES, ORACLE = {}, {}


def query(sql: str | None, standin: bool = False):
    """Register a query under its function's name, with its SQL twin over the raw tables (or the stand-in views)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = SQL + sql if standin else sql
        return f

    return add


def joined(column: str):
    return F.array_join(F.array_sort(column), ",")


_E = f", x AS (SELECT DISTINCT chunk_id, term_id FROM links WHERE confidence >= {TAU}), n AS (SELECT count(DISTINCT chunk_id) AS n FROM x), df AS (SELECT term_id, count(*) AS df FROM x GROUP BY term_id)"


@query(_E + " SELECT term_id, df FROM df", True)
def doc_frequency(t):
    return graphs.document_frequency(t.links.where(F.col("confidence") >= TAU))


_EDGES = _E + ", co AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS shared, sum(1 / ln(1 + df)) AS weight FROM x a JOIN df ON df.term_id = a.term_id CROSS JOIN n JOIN x b ON a.term_id = b.term_id AND a.chunk_id < b.chunk_id WHERE df / n <= 0.4 GROUP BY ALL HAVING count(*) >= 2)"


@query(_EDGES + " SELECT a, b, shared, round(weight, 9) AS weight FROM co", True)
def cooccurrence_edges(t):
    return graphs.cooccurrence_edges(t.links, TAU, 2, 0.4).withColumn("weight", F.round("weight", 9))


@query(_EDGES + """, m AS (SELECT DISTINCT chunk_id, chunk_id % 11 AS theme_id FROM links), ew AS (SELECT m.theme_id, m.chunk_id, round(coalesce(sum(e.weight), 0), 9) AS w FROM m LEFT JOIN (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co) e ON e.a = m.chunk_id AND e.b % 11 = m.theme_id GROUP BY ALL)
SELECT theme_id, primary_id, score FROM (SELECT theme_id, chunk_id AS primary_id, w AS score, row_number() OVER (PARTITION BY theme_id ORDER BY w DESC, chunk_id) AS k FROM ew) WHERE k = 1""", True)
def edge_degree_primary(t):
    members = t.links.select("chunk_id", (F.col("chunk_id") % 11).alias("theme_id")).distinct()
    return graphs.degree_primary(graphs.cooccurrence_edges(t.links, TAU, 2, 0.4), members)


_SIM = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings)"
_KNN = f"{_SIM}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS neighbour_id, list_dot_product(a.e, b.e) AS sim FROM v a, v b WHERE a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, neighbour_id) AS rank FROM s)"


@query(f"WITH {_KNN} SELECT query_id, neighbour_id, round(sim, 9) AS sim, rank FROM r WHERE rank <= 15")
def knn_topk(t):
    return graphs.knn(t.vectors, t.vectors, 15).withColumn("sim", F.round("sim", 9))


@query(f"WITH {_KNN}, k AS (SELECT * FROM r WHERE rank <= 15 AND sim >= 0.2) SELECT query_id AS a, neighbour_id AS b, round(sim, 9) AS weight FROM k WHERE query_id < neighbour_id AND (neighbour_id, query_id) IN (SELECT query_id, neighbour_id FROM k)")
def mutual_knn_edges(t):
    return graphs.knn_edges(t.vectors, 15, 0.2).withColumn("weight", F.round("weight", 9))


_CENTROID = f"{_SIM}, d AS (SELECT label AS theme_id, i AS dim, avg(e[i + 1]) AS m FROM v, (SELECT unnest(range(64)) AS i) GROUP BY ALL), c AS (SELECT theme_id, dim, m / sqrt(sum(m * m) OVER (PARTITION BY theme_id)) AS value FROM d)"


@query(f"WITH {_CENTROID} SELECT theme_id, CAST(dim AS INT) AS dim, round(value, 9) AS value FROM c")
def centroids(t):
    return graphs.centroids(t.vectors.withColumnRenamed("label", "theme_id")).withColumn("value", F.round("value", 9))


@query(f"WITH {_CENTROID}, w AS (SELECT label AS theme_id, vec_id, round(sum(e[dim + 1] * value), 9) AS s FROM v JOIN c ON c.theme_id = v.label GROUP BY ALL) SELECT theme_id, vec_id AS primary_id FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY s DESC, vec_id) AS k FROM w) WHERE k = 1")
def centroid_primary(t):
    return graphs.centroid_primary(t.vectors.withColumnRenamed("label", "theme_id"))


@query(f"WITH {_SIM}, s AS (SELECT label, count(*) AS n, list_sum([0.0]) AS z FROM v GROUP BY label), d AS (SELECT label, i, sum(e[i + 1]) AS s, sum(e[i + 1] * e[i + 1]) AS q FROM v, (SELECT unnest(range(64)) AS i) GROUP BY ALL) SELECT d.label AS theme_id, any_value(s.n) AS n, round((sum(d.s * d.s) - sum(d.q)) / (any_value(s.n) * (any_value(s.n) - 1)), 9) AS mean_cosine FROM d JOIN s USING (label) GROUP BY d.label")
def mean_pairwise_cosine(t):
    return evaluation.mean_pairwise_cosine(t.vectors.select(F.col("label").alias("theme_id"), "embedding"))


@query(f"WITH RECURSIVE {_KNN}, k AS (SELECT * FROM r WHERE rank <= 3 AND sim >= 0.3), e AS (SELECT query_id AS a, neighbour_id AS b FROM k UNION SELECT neighbour_id, query_id FROM k), reach(n, m) AS (SELECT a, a FROM e UNION SELECT reach.n, e.b FROM reach JOIN e ON e.a = reach.m) SELECT n AS node, min(m) AS component FROM reach GROUP BY n")
def connected_components(t):
    return graphs.components(graphs.knn_edges(t.vectors, 3, 0.3, mutual=False))


@query(None)
def leiden_communities(t):
    return community.communities(graphs.knn_edges(t.vectors, 15, 0.2).withColumn("shelf_id", F.lit("all")))


@query(None)
def kmeans_topics(t):
    return community.kmeans_topics(t.vectors)


@query(None)
def capped_clusters(t):
    return graphs.capped_clusters(graphs.knn_edges(t.vectors, 3, 0.3, mutual=False), 12)


def _sides(t):
    v = t.vectors
    return v.select(F.col("label").cast("long").alias("i"), F.col("vec_id").alias("member")), v.select((F.col("vec_id") % 7).alias("j"), F.col("vec_id").alias("member"))


_J = "o AS (SELECT label AS i, vec_id % 7 AS j, count(*) AS common FROM embeddings GROUP BY ALL), oj AS (SELECT CAST(i AS BIGINT) AS i, j, common, common / (ni + nj - common) AS jaccard FROM o JOIN (SELECT label, count(*) AS ni FROM embeddings GROUP BY 1) a ON a.label = i JOIN (SELECT vec_id % 7 AS k, count(*) AS nj FROM embeddings GROUP BY 1) b ON b.k = j)"


@query(f"WITH {_J} SELECT i, j, common, round(jaccard, 9) AS jaccard FROM oj")
def candidate_jaccard(t):
    return themes.overlap(*_sides(t)).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {_J}, e AS (SELECT i, j, jaccard AS je FROM oj WHERE (i + j) % 2 = 0) SELECT oj.i, oj.j, round(jaccard, 9) AS jc, round(coalesce(je, 0), 9) AS je, round(0.6 * jaccard + 0.4 * coalesce(je, 0), 9) AS score FROM oj LEFT JOIN e ON e.i = oj.i AND e.j = oj.j")
def merge_decisions(t):
    o = themes.overlap(*_sides(t))
    m = themes.merge_scores(o, o.where((F.col("i") + F.col("j")) % 2 == 0))
    return m.select("i", "j", *[F.round(c, 9).alias(c) for c in ("jc", "je", "score")])


def _docs(t):
    return t.read("documents").select(F.col("source").alias("theme_id"), "text")


_STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)
_TERMS = f"""w AS (SELECT source AS theme_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9_]{{2,}}'), lambda x: x NOT IN ({_STOP})) AS w FROM documents),
g AS (SELECT theme_id, unnest(list_concat(w, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS term FROM w),
tf AS (SELECT theme_id, term, count(*) AS tf FROM g GROUP BY ALL), al AS (SELECT term, sum(tf) AS s, count(*) AS df FROM tf GROUP BY term ORDER BY s DESC, term LIMIT 2000),
sc AS (SELECT tf.theme_id, tf.term, round(tf * (ln((1 + (SELECT count(DISTINCT source) FROM documents)) / (1 + df)) + 1), 9) AS score FROM tf JOIN al ON al.term = tf.term WHERE NOT list_bool_or(list_transform(string_split(tf.term, ' '), lambda p: regexp_matches(p, '\\d') OR length(p) <= 2 OR regexp_full_match(p, '[A-Z0-9]{{4,}}'))))"""


@query(f"WITH {_TERMS} SELECT theme_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, term) AS rank FROM sc WHERE score > 0) WHERE rank <= 5")
def theme_keywords(t):
    return themes.keywords(_docs(t))


@query(""", m AS (SELECT o_orderkey AS chunk_id, o_custkey % 9 AS theme_id FROM orders), c AS (SELECT theme_id, term_id, count(*) AS n FROM m JOIN links USING (chunk_id) GROUP BY ALL) SELECT theme_id, term_id, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, term_id) AS rank FROM c) WHERE rank <= 10""", True)
def theme_signature(t):
    m = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 9).alias("theme_id"))
    return themes.signatures(m, t.links.select("chunk_id", "term_id"))


@query(""", m AS (SELECT o_orderkey AS chunk_id, o_custkey % 9 AS theme_id FROM orders), c AS (SELECT theme_id, shelf_id, count(DISTINCT chunk_id) AS n FROM m JOIN resolved USING (chunk_id) GROUP BY ALL) SELECT theme_id, shelf_id, n FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY n DESC, shelf_id) AS k FROM c) WHERE k = 1""", True)
def theme_shelf_backfill(t):
    m = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), (F.col("o_custkey") % 9).alias("theme_id"))
    return themes.shelf_backfill(m, t.resolved.select("chunk_id", "shelf_id"))


@query("""WITH d AS (SELECT DISTINCT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), n AS (SELECT count(DISTINCT doc) AS n FROM d), f AS (SELECT term, count(*) AS df FROM d GROUP BY term),
p(topic, t1, t2) AS (VALUES ('en', 'the', 'of'), ('en', 'the', 'and'), ('mixed', 'the', 'les'), ('mixed', 'der', 'las'), ('none', 'the', 'zzzz')),
b AS (SELECT topic, t1, t2, (SELECT count(*) FROM d x JOIN d y ON x.doc = y.doc WHERE x.term = t1 AND y.term = t2) AS both_n, (SELECT df FROM f WHERE term = t1) AS a, (SELECT df FROM f WHERE term = t2) AS c FROM p)
SELECT topic, round(avg(CASE WHEN a IS NULL OR c IS NULL THEN 0 WHEN both_n = 0 THEN -1 WHEN both_n = n THEN 1 ELSE ln((both_n / n) * n * n / (a * c)) / -ln(both_n / n) END), 9) AS npmi FROM b, n GROUP BY topic""")
def npmi_coherence(t):
    docs = t.read("documents").select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(fx.tokens(F.col("text")))).alias("term"))
    pairs = t.spark.createDataFrame([("en", "the", "of"), ("en", "the", "and"), ("mixed", "the", "les"), ("mixed", "der", "las"), ("none", "the", "zzzz")], "topic string, t1 string, t2 string")
    return themes.npmi(pairs, docs).withColumn("npmi", F.round("npmi", 9))


@query("""WITH c AS (SELECT label AS a, vec_id % 5 AS b, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY ALL), r AS (SELECT a, sum(n) AS na FROM c GROUP BY a), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), z AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS s FROM c),
x AS (SELECT t, s, (SELECT sum(na * (na - 1) / 2) FROM r) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM k) AS sb, (SELECT -sum(na / t * ln(na / t)) FROM r) AS ha, (SELECT -sum(nb / t * ln(nb / t)) FROM k) AS hb, (SELECT sum(n / t * ln(n * t / (na * nb))) FROM c JOIN r USING (a) JOIN k USING (b)) AS mi FROM z)
SELECT round((s - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 9) AS ari, round(2 * mi / (ha + hb), 9) AS nmi, round(mi / ha, 9) AS homogeneity, round(mi / hb, 9) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 9) AS v_measure FROM x""")
def partition_agreement(t):
    return evaluation.partition_agreement(t.vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("a"), (F.col("vec_id") % 5).alias("b")))


_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"


@query(f"SELECT doc_id AS chunk_id, CAST(len(list_intersect({_TOK}, ['the', 'der', 'les', 'las', 'of'])) AS INT) AS score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 50")
def token_overlap_search(t):
    return retrieval.overlap_search(t.chunks, ["the", "der", "les", "las", "of"], 50)


def _bm25_sql(words: list[str], k: int) -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(words))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(words)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * l / al))" for i in range(len(words)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(words)))
    return f"bw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), bt AS (SELECT doc_id, len(w) AS l, {tf} FROM bw), bs AS (SELECT count(*) AS n, avg(l) AS al, {df} FROM bt), bm AS (SELECT doc_id AS id, round({score}, 9) AS score FROM bt, bs WHERE {some}), bm25 AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm ORDER BY score DESC, id LIMIT {k})"


_Q = ["thea", "inges", "ention"]


@query(f"WITH {_bm25_sql(_Q, 50)} SELECT id AS chunk_id, score, rank FROM bm25")
def bm25_search(t):
    return retrieval.bm25(t.chunks, _Q, 50)


_NEAR = f"{_SIM}, nn AS (SELECT v.vec_id AS id, round(list_dot_product(v.e, q.e), 9) AS score FROM v, (SELECT e, vec_id FROM v WHERE vec_id = 3) q WHERE v.vec_id <> q.vec_id), knn AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM nn ORDER BY score DESC, id LIMIT 50)"


@query(f"WITH {_NEAR} SELECT id AS vec_id, score, rank FROM knn")
def knn_search(t):
    return retrieval.knn_search(t.vectors, t.vectors.where("vec_id = 3"), 50)


def _arms(t):
    lexical = retrieval.bm25(t.chunks, _Q, 50).select(F.col("chunk_id").alias("id"), "rank")
    dense = retrieval.knn_search(t.vectors, t.vectors.where("vec_id = 3"), 50).select(F.col("vec_id").alias("id"), "rank")
    return lexical, dense


@query(f"WITH {_bm25_sql(_Q, 50)}, {_NEAR}, f AS (SELECT id, round(sum(1 / (61 + rank)), 12) AS score FROM (SELECT id, rank FROM bm25 UNION ALL SELECT id, rank FROM knn) GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM f ORDER BY score DESC, id LIMIT 20")
def rrf_hybrid(t):
    return retrieval.rrf(list(_arms(t)), 20)


@query(f"WITH {_bm25_sql(_Q, 50)}, {_NEAR}, ov AS (SELECT doc_id AS id, row_number() OVER (ORDER BY CAST(len(list_intersect({_TOK}, ['the', 'of'])) AS INT) DESC, doc_id) - 1 AS rank FROM documents WHERE len(list_intersect({_TOK}, ['the', 'of'])) > 0 ORDER BY rank LIMIT 15), f AS (SELECT id, round(sum(1 / (60 + rank)), 12) AS score, min(arm) AS arm FROM (SELECT id, rank, 0 AS arm FROM bm25 UNION ALL SELECT id, rank, 1 FROM knn UNION ALL SELECT id, rank, 2 FROM ov) GROUP BY id) SELECT id, score, row_number() OVER (ORDER BY score DESC, arm, id) - 1 AS rank FROM f ORDER BY score DESC, arm, id LIMIT 20")
def tri_hybrid_rrf(t):
    lexical, dense = _arms(t)
    third = retrieval.overlap_search(t.chunks, ["the", "of"], 15).select(F.col("chunk_id").alias("id"), "rank")
    return retrieval.rrf([lexical, dense, third], 20, offset=60, priority=True)


@query(f"SELECT doc_id AS chunk_id, CAST(len(list_intersect({_TOK}, ['der', 'die'])) AS INT) AS score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM documents WHERE score > 0 AND source IN ('src1', 'src3') ORDER BY score DESC, doc_id LIMIT 20")
def scoped_search(t):
    e = t.chunks.select("chunk_id", F.col("source_doc_id").alias("shelf_id"))
    return retrieval.overlap_search(retrieval.in_scope(t.chunks, e, ["src1", "src3"], "shelf_id"), ["der", "die"], 20)


_SENT = "st AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\|[^\\n]*\\|', ' ', 'g'), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 0) AS s FROM documents)"


@query(f"WITH {_SENT} SELECT doc_id AS chunk_id, CAST(len(s) AS INT) AS n_sentences, md5(array_to_string(s, chr(2))) AS digest FROM st")
def sentence_split(t):
    c = t.chunks.select("chunk_id", fx.sentences(F.regexp_replace("text", r"\|[^\n]*\|", " ")).alias("s"))
    return c.select("chunk_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "\u0002")).alias("digest"))


@query(f"""WITH {_SENT}, x AS (SELECT doc_id, i - 1 AS pos, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM st)),
w AS (SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(sentence), '[a-z0-9]+'), lambda t: t NOT IN ({_STOP}))) AS w FROM x), f AS (SELECT doc_id, w, count(*) AS f FROM w GROUP BY ALL), m AS (SELECT doc_id, max(f) AS m FROM f GROUP BY doc_id),
sc AS (SELECT w.doc_id, pos, round(sum(f / m), 9) AS score FROM w JOIN f ON f.doc_id = w.doc_id AND f.w = w.w JOIN m ON m.doc_id = w.doc_id GROUP BY ALL),
r AS (SELECT x.doc_id, x.pos, sentence, row_number() OVER (PARTITION BY x.doc_id ORDER BY coalesce(score, 0) DESC, x.pos) AS k FROM x LEFT JOIN sc ON sc.doc_id = x.doc_id AND sc.pos = x.pos) SELECT doc_id AS chunk_id, md5(string_agg(sentence, ' ' ORDER BY pos)) AS summary_md5 FROM r WHERE k <= 3 GROUP BY doc_id""")
def freq_summary(t):
    return cards.frequency_summary(t.chunks.select("chunk_id", "text"), 3).select("chunk_id", F.md5("summary").alias("summary_md5"))


def _members(t):
    return t.chunks.select(F.col("source_doc_id").alias("theme_id"), "chunk_id", "text")


@query(f"SELECT source AS theme_id, CAST(sum(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: length(s) > 0))) AS BIGINT) AS n_sentences, CASE WHEN n_sentences <= 400 THEN 'single' ELSE 'map_reduce' END AS strategy FROM documents WHERE trim(text) <> '' GROUP BY source")
def stage1_strategy(t):
    return cards.stage_strategy(_members(t))


@query("""WITH RECURSIVE o AS (SELECT source AS theme_id, doc_id AS chunk_id, CAST(length(text) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
p AS (SELECT theme_id, chunk_id, k, n AS used, 0 AS group_no FROM o WHERE k = 1 UNION ALL SELECT o.theme_id, o.chunk_id, o.k, CASE WHEN p.used > 0 AND p.used + o.n > 20000 THEN o.n ELSE p.used + o.n END, CASE WHEN p.used > 0 AND p.used + o.n > 20000 THEN p.group_no + 1 ELSE p.group_no END FROM p JOIN o ON o.theme_id = p.theme_id AND o.k = p.k + 1) SELECT theme_id, chunk_id, group_no FROM p""")
def char_budget_groups(t):
    return cards.budget_groups(_members(t), 20_000)


@query(None)
def lexrank_summary(t):
    return cards.summaries(_members(t), "lexrank")


@query(None)
def theme_cards(t):
    m = _members(t)
    labels = m.select("theme_id").distinct().withColumn("label", F.concat(F.lit("theme "), "theme_id"))
    c = cards.cards(cards.summaries(m, "luhn", n=3), m, labels)
    return c.withColumn("cited_chunk_ids", joined("cited_chunk_ids"))


@query("SELECT doc_id AS chunk_id, array_to_string(list_transform(range(8), lambda i: printf('%.6f', CAST('0x' || substr(sha256(text), CAST(1 + 2 * i AS BIGINT), 2) AS INT) / 255.0)), ',') AS v FROM documents")
def hash_embedding(t):
    return t.chunks.select("chunk_id", F.array_join(F.transform(fx.hash_embedding(F.col("text"), 8), lambda x: F.format_string("%.6f", x)), ",").alias("v"))


@query("SELECT doc_id AS chunk_id, sha256(octet_length(encode(lang)) || ':' || lang || octet_length(encode(source)) || ':' || source || octet_length(encode(text)) || ':' || text) AS key FROM documents")
def cache_key(t):
    return t.read("documents").select(F.col("doc_id").alias("chunk_id"), fx.cache_key(F.col("lang"), F.col("source"), F.col("text")).alias("key"))


@query("""SELECT s_suppkey AS id, coalesce(u.name, s_name) AS name, coalesce(u.bal, s_acctbal) AS bal FROM supplier LEFT JOIN (SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal < 3000) u ON u.id = s_suppkey UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 3000 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def upsert_last_wins(t):
    base = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = t.read("customer").where("c_acctbal < 3000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    stale = new.select("id", F.lit("old").alias("name"), F.lit(0.0).alias("bal"), F.lit(0).alias("v"))
    return sinks.upsert(base, stale.unionByName(new.withColumn("v", F.lit(1))), "id", "v")


@query("SELECT s_suppkey AS id, s_name AS name, coalesce(CASE WHEN s_acctbal < 3000 THEN CAST(s_suppkey AS DOUBLE) END, s_acctbal) AS bal FROM supplier")
def field_update(t):
    base = t.read("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    return sinks.update_fields(base, base.where("bal < 3000").select("id", F.col("id").cast("double").alias("bal")), "id")


@query("""WITH s AS (SELECT o_orderkey AS chunk_id, string_split(o_orderpriority || ';' || o_orderstatus || ';', ';') AS a, string_split('http://purl.obolibrary.org/obo/ORD_' || o_custkey || ';', ';') AS b FROM orders), z AS (SELECT chunk_id, trim(a[i]) AS surface, trim(b[i]) AS uri, i FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM s))
SELECT chunk_id, CAST(count(*) AS BIGINT) AS n_mentions, string_agg(CASE WHEN uri <> '' THEN regexp_replace(uri, '^https?:[/][/]purl[.]obolibrary[.]org[/]obo[/]([A-Z]{1,})_([[:alnum:]]{1,})$', '\\1:\\2') END, ',' ORDER BY i) AS ids FROM z WHERE surface <> '' GROUP BY chunk_id""")
def nel_zip_align(t):
    rows = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat("o_orderpriority", F.lit(";"), "o_orderstatus", F.lit(";")).alias("surfaces"), F.concat(F.lit("http://purl.obolibrary.org/obo/ORD_"), F.col("o_custkey"), F.lit(";")).alias("uris"))
    m = nel.mentions(rows)
    return m.groupBy("chunk_id").agg(F.count("*").alias("n_mentions"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("term_id").isNotNull(), F.struct("pos", "term_id")))), lambda x: x.term_id), ",").alias("ids"))


@query("SELECT page_id, CASE WHEN l <> '' AND n <> '' THEN upper(l) || ':' || n ELSE 'http://purl.obolibrary.org/obo/' || upper(l) || '_' || n END AS short FROM (SELECT page_id, regexp_extract(url, '/([a-z]+)/([0-9]+)', 1) AS l, regexp_extract(url, '/([a-z]+)/([0-9]+)', 2) AS n FROM pages)")
def uri_shorten(t):
    at = lambda i: F.regexp_extract("url", "/([a-z]+)/([0-9]+)", i)
    uri = F.concat(F.lit("http://purl.obolibrary.org/obo/"), F.upper(at(1)), F.lit("_"), at(2))
    return t.read("pages").select("page_id", fx.shorten_uri(uri).alias("short"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS year, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN event_type ELSE json_extract_string(props, '$.k') END AS source_doc FROM events")
def metadata_fields(t):
    k = F.get_json_object("props", "$.k")
    return t.read("events").select("event_id", fx.year_of(k).alias("year"), chunks.first_filled(k, F.col("event_type")).alias("source_doc"))


@query("SELECT label, n, regexp_extract(lower(label), '([a-z0-9]+)$', 1) IN ('product', 'food', 'material', 'type', 'group', 'category', 'class') AND n = 0 AS scaffolding FROM (SELECT c_mktsegment || CASE WHEN c_nationkey < 9 THEN ' product' ELSE '' END AS label, c_custkey % 4 AS n FROM customer)")
def scaffolding(t):
    label = F.when(F.col("c_nationkey") < 9, F.concat("c_mktsegment", F.lit(" product"))).otherwise(F.col("c_mktsegment"))
    n = F.col("c_custkey") % 4
    return t.read("customer").select(label.alias("label"), n.alias("n"), fx.is_scaffolding(label, n).alias("scaffolding"))


@query(f"WITH {_SIM} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 9) AS sim FROM v a, v b WHERE a.vec_id < b.vec_id AND list_dot_product(a.e, b.e) > 0.5")
def consolidation_pairs(t):
    return graphs.pairs_above(t.vectors, 0.5).withColumn("sim", F.round("sim", 9))


@query("""WITH g AS (SELECT p_name AS text, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS expected_id, CASE WHEN p_size % 5 = 0 THEN 'miss' WHEN p_size % 2 = 0 THEN 'exact' ELSE 'fuzzy' END AS tier, CASE WHEN p_size % 7 = 0 THEN NULL WHEN p_size % 11 = 0 THEN 'x' ELSE p_brand END AS id FROM part)
SELECT tier, count(*) AS n, count(id) AS n_linked, count(*) FILTER (WHERE coalesce(id, '') = coalesce(expected_id, '')) AS n_right, count(*) FILTER (WHERE coalesce(id, '') = coalesce(expected_id, '')) / count(*) AS accuracy FROM g GROUP BY tier""")
def linker_eval(t):
    p = t.read("part").withColumn("text", F.concat("p_name", F.lit("#"), F.col("p_partkey")))
    size = F.col("p_size")
    gold = p.select("text", F.when(size % 5 != 0, F.col("p_brand")).alias("expected_id"), F.when(size % 5 == 0, "miss").when(size % 2 == 0, "exact").otherwise("fuzzy").alias("tier"))
    got = p.select("text", F.when(size % 7 == 0, None).when(size % 11 == 0, "x").otherwise(F.col("p_brand")).alias("id"))
    return evaluation.linker_report(gold, got)


@query("""SELECT count(*) AS n, median(depth) AS median_clicks, CAST((SELECT depth FROM (SELECT depth, row_number() OVER (ORDER BY depth) - 1 AS k FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS depth FROM lineitem) WHERE depth IS NOT NULL) WHERE k = (SELECT CAST(round_even(0.9 * (count(*) - 1), 0) AS BIGINT) FROM lineitem WHERE l_linenumber < 7)) AS INT) AS p90_clicks,
count(*) FILTER (WHERE depth <= 3) / count(*) AS share_within, count(depth) / count(*) AS share_reachable FROM (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS depth FROM lineitem)""")
def findability(t):
    return evaluation.findability(t.read("lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_linenumber")).alias("depth")))


@query("SELECT 'prune' AS method, (SELECT count(*) FROM shelves) AS n_shelves, (SELECT count(*) FILTER (WHERE mode <> 'orphan') / count(*) FROM resolved) AS coverage, max(n) AS max_fanout, median(n) AS median_fanout, (SELECT max(depth) FROM shelves) AS depth FROM (SELECT count(*) AS n FROM shelves WHERE parent IS NOT NULL GROUP BY parent)", True)
def bakeoff_scorecard(t):
    return evaluation.scorecard(t.shelves, t.resolved.select("chunk_id", (F.col("mode") != "orphan").alias("homed")), "prune")


_RUNS = "r AS (SELECT c_nationkey AS run, round(avg(c_acctbal) / 10000, 6) AS coverage, count(*) AS n_themes, count(*) FILTER (WHERE c_custkey % 3 = 0) AS n_merged, count(*) FILTER (WHERE c_custkey % 5 = 0) AS n_duplicate, count(*) FILTER (WHERE c_custkey % 7 = 0) AS n_tiny, count(*) FILTER (WHERE c_custkey % 11 = 0) AS n_leaky, CAST(c_nationkey % 4 AS BIGINT) AS n_shelves FROM customer GROUP BY c_nationkey)"


@query(f"WITH {_RUNS}, h AS (SELECT *, greatest(12 * greatest(n_shelves, 1), 3) AS high FROM r) SELECT run, round(coverage + (0.5 * n_merged - 0.5 * n_duplicate - 0.5 * n_tiny - n_leaky) / greatest(n_themes, 1) - 0.3 * least(1.0, CASE WHEN n_themes < 3 THEN (3 - n_themes) / 3 WHEN n_themes > high THEN (n_themes - high) / high ELSE 0 END), 6) AS score FROM h")
def sweep_score(t):
    c = F.col("c_custkey")
    part = lambda k: F.count_if(c % k == 0)
    runs = t.read("customer").groupBy(F.col("c_nationkey").alias("run")).agg(F.round(F.avg("c_acctbal") / 10000, 6).alias("coverage"), F.count("*").alias("n_themes"), part(3).alias("n_merged"), part(5).alias("n_duplicate"), part(7).alias("n_tiny"), part(11).alias("n_leaky")).withColumn("n_shelves", (F.col("run") % 4).cast("bigint"))
    return quality.sweep_score(runs).select("run", F.round("score", 6).alias("score"))


_THEMES = "th AS (SELECT 't' || s_suppkey AS theme_id, 'BT:' || 'Brand#' || (1 + s_suppkey % 25) || '/' || CASE s_suppkey % 2 WHEN 0 THEN 'SMALL' ELSE 'LARGE' END AS shelf_id, lower(s_name) AS label, CASE WHEN s_suppkey % 3 = 0 THEN 'merged' ELSE 'relatedness' END AS pass, s_nationkey AS n_signature FROM supplier)"


@query(f", {_THEMES} SELECT 'inflated' AS kind, shelf_id AS subject FROM shelves WHERE direct < 3 AND greatest(chunk_count - direct, 0) / greatest(direct, 1) >= 4 UNION ALL SELECT 'no_themes', shelf_id FROM shelves WHERE chunk_count >= 50 AND shelf_id NOT IN (SELECT shelf_id FROM th) UNION ALL SELECT 'one_sided', shelf_id FROM (SELECT shelf_id, sum(n) AS a, max(n) AS m FROM (SELECT shelf_id, pass, count(*) AS n FROM th GROUP BY ALL) GROUP BY shelf_id) WHERE a >= 2 AND m / a > 0.9 UNION ALL SELECT 'wide_signature', theme_id FROM th WHERE n_signature > 8 UNION ALL SELECT DISTINCT 'label_repeats_shelf', theme_id FROM th JOIN shelves s ON lower(s.label) = lower(th.label)", True)
def quality_warnings(t):
    k = F.col("s_suppkey")
    th = t.read("supplier").select(F.concat(F.lit("t"), k).alias("theme_id"), F.concat(F.lit("BT:Brand#"), 1 + k % 25, F.lit("/"), F.when(k % 2 == 0, "SMALL").otherwise("LARGE")).alias("shelf_id"), F.lower("s_name").alias("label"), F.when(k % 3 == 0, "merged").otherwise("relatedness").alias("pass"), F.col("s_nationkey").alias("n_signature"))
    return quality.warnings(t.shelves, th)


def _graph(t):
    s = t.shelves
    th = t.read("supplier").select(F.concat(F.lit("t"), F.col("s_suppkey")).alias("theme_id"), F.lower("s_name").alias("label"), F.array(F.lit("facet:all")).alias("shelf_ids"))
    cd = th.select(F.concat(F.lit("card:theme:"), "theme_id").alias("card_id"), F.col("theme_id").alias("target_id"), F.upper("label").alias("title"))
    return s, th, cd


@query(", th AS (SELECT 't' || s_suppkey AS id, lower(s_name) AS label FROM supplier) SELECT shelf_id AS id, 'shelf' AS kind, label FROM shelves UNION ALL SELECT id, 'theme', label FROM th UNION ALL SELECT 'card:theme:' || id, 'card', upper(label) FROM th", True)
def graph_nodes(t):
    return views.nodes(*_graph(t))


@query(", th AS (SELECT 't' || s_suppkey AS id FROM supplier) SELECT parent AS source, shelf_id AS target, 'parent_of' AS kind FROM shelves WHERE parent IS NOT NULL UNION ALL SELECT 'facet:all', id, 'has_theme' FROM th UNION ALL SELECT id, 'card:theme:' || id, 'has_card' FROM th", True)
def graph_edges(t):
    return views.edges(*_graph(t))


@query("SELECT lang AS source_type, count(*) AS n FROM documents WHERE lang NOT IN ('fr') GROUP BY lang")
def source_filter(t):
    return chunks.of_source_types(t.chunks, unwanted=("fr",)).groupBy("source_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS chunk_id, pos FROM (SELECT unnest(range(10)) AS pos, unnest(list_transform(range(10), lambda i: 97 * (9 - i))) AS doc_id) JOIN documents USING (doc_id)")
def multi_get(t):
    ids = t.spark.createDataFrame([(i, 97 * (9 - i)) for i in range(10)], "pos long, chunk_id long")
    return chunks.multi_get(ids, t.chunks, "chunk_id").select("chunk_id", "pos")


@query("SELECT source AS theme_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS chunk_ids FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents) WHERE k <= 3 GROUP BY source")
def longest_per_source(t):
    w = Window.partitionBy("theme_id").orderBy(F.desc(F.length("text")), "chunk_id")
    top = _members(t).withColumn("k", F.row_number().over(w)).where("k <= 3")
    return top.groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: x.cast("string")), ",").alias("chunk_ids"))


@query("SELECT doc_id AS chunk_id, lang || '/' || CASE WHEN s = '' THEN 'unlabeled' ELSE s END AS slug FROM (SELECT doc_id, lang, substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS s FROM documents)")
def theme_slugs(t):
    return t.chunks.select("chunk_id", F.concat("source_type", F.lit("/"), fx.slug(F.col("text"))).alias("slug"))
