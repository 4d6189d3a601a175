"""Queries of single operators: look-ups, filters, links, theme statistics, audits, search, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import entities, evaluation, graphs, linking, navigation, ontology, projection, quality, retrieval, support, themes
from ..sources import chunks, sinks
from .standin import FLOOR, SQL, TAU, Tables

QUERIES, ORACLE = {}, {}


def query(sql: str | None, standin: bool = True):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = SQL + sql if standin else sql
        return f

    return add


def joined(c: str):
    return F.array_join(F.array_sort(F.col(c).cast("array<string>")), ",")


_MEMBERS = "tm AS (SELECT source || '/' || lang AS theme_id, CASE lang WHEN 'en' THEN 'merged' WHEN 'de' THEN 'global_similarity' ELSE 'relatedness' END AS pass, source AS shelf_id, CASE lang WHEN 'fr' THEN 'Story one' WHEN 'es' THEN ' story ONE' ELSE 'tale ' || lang END AS label, doc_id AS chunk_id FROM documents), tr AS (SELECT DISTINCT theme_id, pass, label, CASE WHEN pass = 'global_similarity' THEN [shelf_id, 'more'] ELSE [shelf_id] END AS shelf_ids FROM tm)"
_DENORM = ", F AS (SELECT DISTINCT l_orderkey AS chunk_id, 'P:' || l_partkey AS term_id FROM lineitem)"


# --- ontology look-ups and filters


@query(" SELECT id, label FROM terms WHERE starts_with(id, 'B:') OR starts_with(id, 'T:')")
def term_prefix_filter(t):
    return ontology.prefix_filter(t.terms, ("B:", "T:")).select("id", "label")


@query(" SELECT id, known FROM (SELECT 'P:' || l_suppkey AS id FROM lineitem UNION SELECT 'X:' || l_linenumber FROM lineitem) q LEFT JOIN (SELECT DISTINCT id AS i, true AS k FROM terms) ON i = id, LATERAL (SELECT k IS NOT NULL AS known)")
def ontology_contains(t):
    line = t.read("lineitem")
    ids = line.select(F.concat(F.lit("P:"), F.col("l_suppkey")).alias("id")).union(line.select(F.concat(F.lit("X:"), F.col("l_linenumber")))).distinct()
    return ontology.membership(ids, t.terms)


@query(" SELECT 'P:' || s_suppkey AS id, label, CASE WHEN synonym IS NULL THEN 0 ELSE 1 END AS n_synonyms, coalesce(synonym, '') AS synonyms FROM supplier LEFT JOIN terms ON id = 'P:' || s_suppkey")
def ontology_names(t):
    ids = t.read("supplier").select(F.concat(F.lit("P:"), F.col("s_suppkey")).alias("id"))
    return ontology.names_of(ids, t.terms).select("id", "label", F.size("synonyms").alias("n_synonyms"), joined("synonyms").alias("synonyms"))


@query(", q AS (SELECT DISTINCT p_name AS query FROM part), nm AS (SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS name FROM terms WHERE NOT obsolete UNION SELECT id, trim(regexp_replace(lower(synonym), '[^a-z0-9]+', ' ', 'g')) FROM terms WHERE NOT obsolete AND synonym IS NOT NULL) SELECT query, id FROM q JOIN nm ON name = trim(regexp_replace(lower(query), '[^a-z0-9]+', ' ', 'g'))")
def name_all_matches(t):
    return ontology.lookup_all(t.read("part").select(F.col("p_name").alias("query")).distinct(), t.terms)


@query(", q AS (SELECT DISTINCT 'P:' || l_partkey AS a, 'B:Brand#' || (10 * l_linenumber + 1) AS b FROM lineitem), r AS (SELECT child AS a, parent AS b FROM is_a UNION SELECT x.child, y.parent FROM is_a x JOIN is_a y ON x.parent = y.child) SELECT q.a, q.b, r.a IS NOT NULL AS near FROM q LEFT JOIN r ON q.a = r.a AND q.b = r.b")
def ancestor_guard(t):
    pairs = t.read("lineitem").select(F.concat(F.lit("P:"), F.col("l_partkey")).alias("a"), F.concat(F.lit("B:Brand#"), 10 * F.col("l_linenumber") + 1).alias("b")).distinct()
    return ontology.within_hops(t.is_a, pairs, 2)


@query(", v AS (SELECT 'T:SMALL' AS id, 'self' AS role WHERE 'T:SMALL' IN (SELECT id FROM terms) UNION ALL SELECT ancestor, 'ancestor' FROM anc WHERE term = 'T:SMALL' UNION ALL (SELECT DISTINCT term, 'descendant' FROM anc WHERE ancestor = 'T:SMALL' ORDER BY term LIMIT 40)) SELECT v.id, label, role FROM v LEFT JOIN terms ON terms.id = v.id")
def ontology_subtree(t):
    return ontology.subtree_view(t.terms, t.anc, "T:SMALL", 40)


@query(", nm AS (SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS name FROM terms WHERE NOT obsolete UNION SELECT id, trim(regexp_replace(lower(synonym), '[^a-z0-9]+', ' ', 'g')) FROM terms WHERE NOT obsolete AND synonym IS NOT NULL), s AS (SELECT term_id, count(DISTINCT chunk_id) AS n FROM links GROUP BY term_id), j AS (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY coalesce(n, 0) DESC, id) AS r, count(*) OVER (PARTITION BY name) AS n_ids FROM nm LEFT JOIN s ON s.term_id = id WHERE length(name) >= 3 AND NOT regexp_matches(name, '^[0-9 ]+$')) SELECT name, n_ids, id AS target FROM j WHERE r = 1 AND n_ids > 1")
def synonym_targets(t):
    s = t.links.groupBy("term_id").agg(F.count_distinct("chunk_id").alias("with_descendants"))
    return ontology.shared_names(t.terms, s)


@query(" SELECT count(DISTINCT id) AS n_terms, sha256(string_agg(id, chr(10) ORDER BY id) || chr(10) || 'encoder-a' || chr(10) || 'ranker-b') AS fingerprint FROM (SELECT DISTINCT id FROM terms WHERE NOT obsolete)")
def index_fingerprint(t):
    return ontology.index_fingerprint(t.terms, "encoder-a", "ranker-b")


@query(" SELECT term_id, direct, with_descendants FROM (SELECT 'P:' || p_partkey AS term_id, CAST(p_size AS BIGINT) AS direct, CAST(p_size * 2 AS BIGINT) AS with_descendants, p_name AS label FROM part) WHERE term_id IN ('P:1', 'P:3') OR (lower(label) NOT IN (SELECT lower(p_name) FROM part WHERE p_partkey <= 5) AND term_id <> 'P:7' AND with_descendants >= 60) UNION ALL SELECT 'B:Brand#11', 0, 0 WHERE 'B:Brand#11' IN (SELECT id FROM terms)")
def prune_lists(t):
    p = t.read("part")
    names = tuple(r[0] for r in p.where("p_partkey <= 5").select("p_name").orderBy("p_partkey").collect())
    s = p.select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("term_id"), F.col("p_size").cast("long").alias("direct"), (F.col("p_size") * 2).cast("long").alias("with_descendants"))
    c = projection.PruneConfig(min_support=60, direct_share_max=0.0, blacklist=(*[n.upper() + " " for n in names], " p:7"), whitelist=("P:1", "P:3", "B:Brand#11", "Z:9"))
    return projection.survivors(s, c, t.terms)


# --- links


@query(" SELECT term_id, count(*) AS n FROM links WHERE term_id IN (SELECT id FROM terms WHERE NOT obsolete) GROUP BY term_id")
def links_in_ontology(t):
    return linking.known_links(t.links, t.terms.where("not obsolete")).groupBy("term_id").agg(F.count("*").alias("n"))


@query(_DENORM + f" SELECT F.chunk_id, F.term_id FROM F ANTI JOIN (SELECT DISTINCT chunk_id, term_id FROM links WHERE confidence >= {TAU}) l ON l.chunk_id = F.chunk_id AND l.term_id = F.term_id")
def unlinked_terms(t):
    return linking.unlinked_terms(t.denorm, t.links.where(F.col("confidence") >= TAU))


@query(_DENORM + ", m(e, f) AS (VALUES ('STANDARD', 'foods'), ('MEDIUM', 'nutrients'), ('PROMO', 'dietary_patterns'), ('LARGE', 'health')), u AS (SELECT f AS facet, chunk_id, term_id FROM links JOIN m ON e = entity_type UNION SELECT 'foods', chunk_id, term_id FROM F) SELECT facet, count(*) AS n, count(DISTINCT term_id) AS n_terms FROM u GROUP BY facet")
def facet_chunk_terms(t):
    from .standin import BY_TYPE

    routed = support.route(t.links, BY_TYPE, {}, "\0", "")
    return linking.facet_terms(routed, t.denorm, "foods").groupBy("facet").agg(F.count("*").alias("n"), F.count_distinct("term_id").alias("n_terms"))


@query(" SELECT e.term_id, CASE WHEN e.term_id LIKE 'P:%' THEN coalesce(label, e.old) ELSE e.old END AS label, CASE WHEN e.term_id LIKE 'P:%' THEN coalesce(synonym, '') ELSE '' END AS synonyms FROM (SELECT 'P:' || s_suppkey AS term_id, s_name AS old FROM supplier UNION ALL SELECT 'B:Brand#' || n_nationkey, n_name FROM nation) e LEFT JOIN terms ON id = e.term_id")
def entity_enrichment(t):
    s = t.read("supplier").select(F.concat(F.lit("P:"), F.col("s_suppkey")).alias("term_id"), F.col("s_name").alias("label"))
    n = t.read("nation").select(F.concat(F.lit("B:Brand#"), F.col("n_nationkey")).alias("term_id"), F.col("n_name").alias("label"))
    return entities.enrich(s.union(n), t.terms, "P").select("term_id", "label", joined("synonyms").alias("synonyms"))


@query("WITH r AS (SELECT doc_id AS chunk_id, text, p AS pos, substr(text, 5 * p + 1, 6) AS surface, CASE WHEN p = 1 THEN 5 * p ELSE -1 END AS s, CASE WHEN p = 1 THEN 5 * p + 6 ELSE 0 END AS e, CASE WHEN p = 2 THEN 'food' ELSE 'thing' END AS label FROM documents, (SELECT unnest([0, 1, 2]) AS p)), f AS (SELECT *, CASE WHEN s < 0 OR e > length(text) THEN instr(text, surface) - 1 ELSE s END AS b, CASE WHEN s < 0 OR e > length(text) THEN length(surface) ELSE e - s END AS w FROM r WHERE trim(surface) <> ''), g AS (SELECT chunk_id, pos, trim(regexp_replace(substr(text, CAST(b + 1 AS BIGINT), CAST(w AS BIGINT)), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS surface, b, w, CASE label WHEN 'food' THEN 'food' ELSE 'other' END AS entity_type FROM f WHERE b >= 0) SELECT chunk_id, surface, CAST(b AS INT) AS start, CAST(b + w AS INT) AS \"end\", entity_type, 1.0 AS score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, lower(surface), b ORDER BY pos) AS n FROM g) WHERE n = 1", False)
def mention_repair(t):
    d = t.chunks.select("chunk_id", "text", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("pos"))
    own = F.col("pos") == 1
    raw = d.select("chunk_id", "text", "pos", F.substring("text", 5 * F.col("pos") + 1, F.lit(6)).alias("surface"), F.when(own, 5 * F.col("pos")).otherwise(-1).alias("start"), F.when(own, 5 * F.col("pos") + 6).otherwise(0).alias("end"), F.when(F.col("pos") == 2, "food").otherwise("thing").alias("label"), F.lit(None).cast("double").alias("score"))
    return linking.repaired_mentions(raw)


@query(" SELECT chunk_id, name, term_id, count(*) AS n FROM (SELECT o_orderkey AS chunk_id, unnest(string_split(trim(regexp_replace(lower(o_orderpriority || ' ' || o_orderstatus), '[^a-z0-9]+', ' ', 'g')), ' ')) AS name FROM orders) JOIN (VALUES ('high', 'T:1'), ('f', 'T:2'), ('urgent', 'T:3'), ('urgent', 'T:4')) d(name, term_id) USING (name) GROUP BY ALL UNION ALL SELECT o_orderkey, 'not specified', 'T:5', 1 FROM orders WHERE o_orderpriority LIKE '%NOT SPECIFIED%'")
def dictionary_mentions(t):
    names = t.spark.createDataFrame([("high", "T:1"), ("f", "T:2"), ("urgent", "T:3"), ("urgent", "T:4"), ("not specified", "T:5")], "name string, term_id string")
    o = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    return linking.dictionary_mentions(o, names, 2)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT 'S' || vec_id AS surface, vec_id, e FROM v WHERE label < 3), n AS (SELECT surface, v.vec_id AS term_no, list_dot_product(q.e, v.e) AS sim, row_number() OVER (PARTITION BY surface ORDER BY round(list_dot_product(q.e, v.e), 12) DESC, v.vec_id) AS r FROM q, v) SELECT s.surface, term_no, round(sim, 9) AS sim FROM (SELECT surface FROM q UNION ALL SELECT lower(surface) || ' ' FROM q) s LEFT JOIN n ON n.surface = upper(trim(s.surface)) AND r = 1 AND sim >= 0.9", False)
def surface_links(t):
    v = t.vectors
    coded = v.where("label < 3").select(F.concat(F.lit("S"), F.col("vec_id")).alias("surface"), "embedding")
    asked = coded.select("surface").union(coded.select(F.concat(F.lower("surface"), F.lit(" "))))
    return linking.link_surfaces(asked, v.select("vec_id", "embedding"), 0.9, coded).withColumn("sim", F.round("sim", 9))


@query(" SELECT (SELECT count(*) FROM orders) AS n_chunks, (SELECT count(*) FROM lineitem) AS n_mentions, count(*) AS n_links, count(*) / (SELECT count(*) FROM lineitem) AS link_rate, count(DISTINCT chunk_id) / (SELECT count(*) FROM orders) AS coverage FROM links WHERE confidence >= " + str(TAU))
def annotate_totals(t):
    return linking.annotate_totals(t.read("lineitem"), t.links.where(F.col("confidence") >= TAU), t.read("orders"))


@query("SELECT count(*) AS n_chunks, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS n_skipped FROM documents", False)
def skipped_rows(t):
    return chunks.skipped_rows(t.chunks)


# --- shelves


@query(f" SELECT parent, count(*) AS n_children, count(*) FILTER (WHERE r > 5) AS n_hidden, CAST(coalesce(sum(n) FILTER (WHERE r > 5), 0) AS BIGINT) AS hidden_chunks FROM (SELECT parent, n, row_number() OVER (PARTITION BY parent ORDER BY n DESC, child) AS r FROM is_a JOIN (SELECT term_id, count(*) AS n FROM D GROUP BY term_id) ON term_id = child) GROUP BY parent")
def fanout_cap_replay(t):
    s = t.direct.groupBy("term_id").agg(F.count("*").alias("with_descendants"))
    return projection.capped_children(t.is_a, s, 5)


@query(" SELECT i.id AS shelf_id, CASE WHEN i.id = 'new:tier' THEN 'ROOT' WHEN i.id LIKE 'B:Brand#1%' THEN 'new:tier' ELSE p END AS parent FROM (SELECT DISTINCT child AS id, 'ROOT' AS p FROM is_a WHERE parent = 'ROOT' UNION ALL SELECT 'new:tier', NULL) i")
def inserted_tier(t):
    s = t.is_a.where("parent = 'ROOT'").select(F.col("child").alias("shelf_id"), "parent")
    tier = t.spark.createDataFrame([("new:tier", "ROOT")], "shelf_id string, parent string")
    moved = s.where("shelf_id like 'B:Brand#1%'").select(F.col("shelf_id").alias("child"), F.lit("new:tier").alias("shelf_id"))
    return projection.insert_tier(s, tier, moved)


def _bt_shelves(t):
    e = t.is_a.where("parent like 'BT:%' or parent like 'B:%'").select(F.col("parent").alias("term_id")).distinct()
    return e.select(F.concat(F.lit("s/"), F.col("term_id")).alias("shelf_id"), "term_id", F.when(F.startswith("term_id", F.lit("BT:")), 2).otherwise(1).alias("depth"))


@query(" , sh AS (SELECT DISTINCT 's/' || parent AS shelf_id, parent AS term_id FROM is_a WHERE parent LIKE 'BT:%' OR parent LIKE 'B:%'), sa AS (SELECT 'P:' || p_partkey AS term_id, CASE WHEN p_size <= 3 THEN 's/BT:' || p_brand || '/' || p_type ELSE 's/B:Brand#11' END AS shelf_id FROM part WHERE p_size <= 6) SELECT 'P:' || p_partkey AS term_id, coalesce(sa.shelf_id, 's/BT:' || p_brand || '/' || p_type) AS home, CASE WHEN sa.shelf_id = 's/B:Brand#11' AND p_brand <> 'Brand#11' THEN 'fabricated' ELSE 'is-a' END AS edge_type FROM part LEFT JOIN sa ON sa.term_id = 'P:' || p_partkey")
def leaf_homes(t):
    p = t.read("part").withColumn("term_id", F.concat(F.lit("P:"), F.col("p_partkey")))
    listed = p.where("p_size <= 6").select("term_id", F.when(F.col("p_size") <= 3, F.concat(F.lit("s/BT:"), "p_brand", F.lit("/"), "p_type")).otherwise("s/B:Brand#11").alias("shelf_id"))
    return projection.leaf_homes(p.select("term_id"), _bt_shelves(t), listed, t.anc)


@query(None)
def backbone_shelves(t):
    s = support.support(t.direct, t.anc)
    return projection.backbone_shelves(t.is_a, s, 30, 5, "ROOT").withColumn("see_also", joined("see_also"))


@query(None)
def single_child_collapse(t):
    tree = t.is_a.where("child not like 'P:%' and parent not like 'T:%'").groupBy("child").agg(F.min("parent").alias("parent"))
    tree = tree.select(F.col("child").alias("term_id"), F.when(F.col("parent") != "ROOT", F.col("parent")).alias("parent"), F.lit(0).alias("depth"))
    return projection.collapsed(tree).withColumn("see_also", F.array_join("see_also", ","))


@query(" SELECT term_id, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT chunk_id, term_id FROM D WHERE term_id IN (SELECT term FROM anc WHERE ancestor = 'B:Brand#11') UNION SELECT chunk_id, a.ancestor FROM D JOIN anc a ON a.term = D.term_id WHERE D.term_id IN (SELECT term FROM anc WHERE ancestor = 'B:Brand#11') AND (a.ancestor = 'B:Brand#11' OR a.ancestor IN (SELECT term FROM anc WHERE ancestor = 'B:Brand#11'))) GROUP BY term_id")
def rolled_up_below(t):
    return evaluation.rolled_up_below("B:Brand#11", t.direct, t.anc)


@query(" SELECT 'BT:' || p_brand || '/' || p_type AS home, count(DISTINCT chunk_id) AS n_chunks FROM D JOIN part ON term_id = 'P:' || p_partkey GROUP BY ALL")
def settled_chunks(t):
    homes = t.is_a.where("child like 'P:%'").select(F.col("child").alias("term_id"), F.col("parent").alias("home"))
    return evaluation.settled(homes, t.direct)


@query("SELECT avg(CAST(l_linenumber AS DOUBLE)) AS mean_distance, CAST(median(l_linenumber) AS DOUBLE) AS median_distance FROM lineitem", False)
def specificity(t):
    return evaluation.specificity(t.read("lineitem").select(F.col("l_linenumber").alias("distance")))


@query("SELECT count(*) FILTER (WHERE l_returnflag = 'A') / n AS is_a, count(*) FILTER (WHERE l_returnflag = 'N') / n AS other_relation, 0.0 AS fabricated FROM lineitem, (SELECT count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N')) GROUP BY n", False)
def faithfulness(t):
    kind = F.when(F.col("l_returnflag") == "A", "is-a").when(F.col("l_returnflag") == "N", "other-relation")
    return evaluation.faithfulness(t.read("lineitem").select(kind.alias("edge_type")))


@query(" SELECT topic, sum(n) FILTER (WHERE r <= 5) / sum(n) AS share FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term_id) AS r FROM (SELECT entity_type AS topic, term_id, count(*) AS n FROM links GROUP BY ALL)) GROUP BY topic")
def entity_concentration(t):
    return evaluation.concentration(t.links.groupBy(F.col("entity_type").alias("topic"), "term_id").agg(F.count("*").alias("n")))


@query("SELECT count(*) AS n_labels, count(*) FILTER (WHERE regexp_matches(p_name, '^[a-z ]+$')) / count(*) AS share FROM part", False)
def nameability(t):
    return evaluation.nameability(t.read("part").select(F.col("p_name").alias("label")), lambda c: c.rlike("^[a-z ]+$"))


@query("SELECT *, CAST(row_number() OVER (PARTITION BY shelf_id ORDER BY n DESC, doc_id) AS INT) AS rank FROM (SELECT source AS shelf_id, lang AS doc_id, count(*) AS n, min(lang) AS source_type, CAST(max(n_chars) AS INT) AS year FROM documents GROUP BY source, lang)", False)
def shelf_documents(t):
    d = t.read("documents")
    docs = d.select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("doc_id"), F.col("lang").alias("source_type"), F.col("n_chars").cast("int").alias("year"))
    return navigation.shelf_facts(d.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("shelf_id")), docs)


@query(" SELECT shelf_id, term_id, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY shelf_id ORDER BY n DESC, term_id) AS r FROM (SELECT o_orderpriority AS shelf_id, term_id, count(DISTINCT chunk_id) AS n FROM links JOIN orders ON chunk_id = o_orderkey GROUP BY ALL)) WHERE r <= 40")
def shelf_entities(t):
    a = t.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderpriority").alias("shelf_id"))
    return navigation.shelf_entities(a, t.links)


@query("SELECT n_name AS shelf_id, r_name AS parent_label, coalesce(kids, '') AS child_labels FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey AS k, string_agg(s_name, ',' ORDER BY s_acctbal DESC, s_name) AS kids FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) AS r FROM supplier) WHERE r <= 5 GROUP BY ALL) ON k = n_nationkey", False)
def alias_context(t):
    n = t.read("nation").join(t.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    shelf = lambda df, i, p, c: df.select(i.alias("shelf_id"), i.alias("label"), p.alias("parent"), c.cast("double").alias("chunk_count"))
    s = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = shelf(t.read("region"), F.col("r_name"), none, F.lit(0)).union(shelf(n, F.col("n_name"), F.col("r_name"), F.lit(0))).union(shelf(s, F.col("s_name"), F.col("n_name"), F.col("s_acctbal")))
    found = navigation.shelf_context(rows).join(t.read("nation").select(F.col("n_name").alias("shelf_id")), "shelf_id", "left_semi")
    return found.select("shelf_id", "parent_label", F.array_join("child_labels", ",").alias("child_labels"))


@query("SELECT s_name AS shelf_id, CASE WHEN s_acctbal > 5000 THEN 'old' ELSE n_name END AS display_label FROM supplier JOIN nation ON s_nationkey = n_nationkey", False)
def alias_pass(t):
    s = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return navigation.with_display_labels(s.select(F.col("s_name").alias("shelf_id"), F.when(F.col("s_acctbal") > 5000, "old").otherwise(" ").alias("display_label")), s.select(F.col("s_name").alias("shelf_id"), F.concat("n_name", F.lit(" ")).alias("name")))


# --- themes


@query(f"WITH {_MEMBERS}, att AS (SELECT doc_id AS chunk_id FROM documents UNION SELECT -doc_id - 1 FROM documents WHERE lang = 'fr'), a AS (SELECT count(*) AS n, count(t.chunk_id) AS m FROM att LEFT JOIN (SELECT DISTINCT chunk_id FROM tm) t USING (chunk_id)), l AS (SELECT coalesce(CAST(sum(k) AS BIGINT), 0) AS n_repeated FROM (SELECT count(*) AS k FROM (SELECT unnest(shelf_ids) AS s, lower(trim(label)) AS l FROM tr) GROUP BY s, l HAVING count(*) > 1)), z AS (SELECT count(*) AS n_tiny FROM (SELECT theme_id FROM tm GROUP BY theme_id HAVING count(DISTINCT chunk_id) < 15)) SELECT count(*) AS n_themes, count(*) FILTER (WHERE pass = 'merged') AS n_merged, count(*) FILTER (WHERE pass = 'global_similarity') AS n_similarity, count(*) FILTER (WHERE pass = 'relatedness') AS n_relatedness, count(*) FILTER (WHERE len(shelf_ids) > 1) AS n_leaking, any_value(m / n) AS coverage, any_value(n - m) AS n_orphans, any_value(n_repeated) AS n_repeated, any_value(n_tiny) AS n_tiny FROM tr, a, l, z", False)
def theme_stats(t):
    d = t.read("documents")
    attached = d.select(F.col("doc_id").alias("chunk_id")).union(d.where("lang = 'fr'").select(-F.col("doc_id") - 1))
    return quality.theme_stats(t.theme_rows, t.theme_members, attached)


@query(f"WITH {_MEMBERS}, dn AS (SELECT DISTINCT chunk_id, CASE WHEN label = 'Story one' AND length(theme_id) > 8 THEN 'lost' ELSE theme_id END AS theme_id FROM tm), g AS (SELECT DISTINCT theme_id, chunk_id FROM tm) SELECT (SELECT count(*) FROM tr) AS n_themes, (SELECT count(*) FROM g JOIN dn USING (theme_id, chunk_id)) / (SELECT count(*) FROM (SELECT theme_id, chunk_id FROM g UNION SELECT theme_id, chunk_id FROM dn)) AS parity, (SELECT count(*) FROM dn WHERE theme_id NOT IN (SELECT theme_id FROM tr)) AS n_dangling, CAST(0 AS BIGINT) AS n_empty, CAST(0 AS BIGINT) AS n_orphan, (SELECT count(*) FILTER (WHERE pass = 'merged') / count(*) FROM tr) AS merged_rate, (SELECT count(*) = 0 FROM dn WHERE theme_id = 'lost') AS passed", False)
def audit_themes(t):
    m = t.theme_members
    moved = (F.col("label") == "Story one") & (F.length("theme_id") > 8)
    return quality.audit_themes(t.theme_rows, m, m.select("chunk_id", F.when(moved, "lost").otherwise(F.col("theme_id")).alias("theme_id")))


@query(f"WITH {_MEMBERS}, x AS (SELECT DISTINCT shelf_id, theme_id, list_distinct(regexp_extract_all(lower(label), '[a-z0-9]+')) AS w FROM tm) SELECT p.shelf_id, p.theme_id AS a, q.theme_id AS b FROM x p JOIN x q ON p.shelf_id = q.shelf_id AND p.theme_id < q.theme_id WHERE len(list_intersect(p.w, q.w)) >= 0.8 * len(list_distinct(list_concat(p.w, q.w)))", False)
def near_labels(t):
    return quality.near_labels(t.theme_members)


@query(f"WITH {_MEMBERS} SELECT theme_id AS key, 'all/' || shelf_id || '/' || CASE label WHEN 'Story one' THEN 'story-one' WHEN ' story ONE' THEN 'story-one' ELSE 'tale-' || split_part(label, ' ', 2) END || '_' || CASE pass WHEN 'relatedness' THEN 'r' WHEN 'merged' THEN 'm' ELSE 'g' END || row_number() OVER (PARTITION BY pass ORDER BY theme_id) AS theme_id FROM (SELECT DISTINCT theme_id, shelf_id, label, pass FROM tm)", False)
def theme_ids(t):
    return themes.theme_ids(t.theme_members.select(F.col("theme_id").alias("key"), F.concat(F.lit("x/"), "shelf_id").alias("shelf_id"), "label", "pass").distinct(), "all").select("key", "theme_id")


@query("WITH m AS (SELECT source AS theme_id, doc_id AS member FROM documents), c AS (SELECT lang || source AS j, lang AS shelf_id, doc_id AS member FROM documents UNION ALL SELECT source, 'whole', doc_id + CASE WHEN n_chars > 20000 THEN 1000000 ELSE 0 END FROM documents), z AS (SELECT j, shelf_id, count(*) AS n FROM c GROUP BY ALL), i AS (SELECT j, shelf_id, theme_id, count(*) AS k FROM c JOIN m USING (member) GROUP BY ALL), f AS (SELECT shelf_id, theme_id FROM i JOIN z USING (j, shelf_id) WHERE k = n) SELECT theme_id, string_agg(DISTINCT shelf_id, ',' ORDER BY shelf_id) AS shelf_ids FROM f GROUP BY theme_id", False)
def theme_origins(t):
    d = t.read("documents")
    c = d.select(F.concat("lang", "source").alias("j"), F.col("lang").alias("shelf_id"), F.col("doc_id").alias("member")).union(d.select("source", F.lit("whole"), F.col("doc_id") + F.when(F.col("n_chars") > 20000, 1000000).otherwise(0)))
    return themes.origin_shelves(d.select(F.col("source").alias("theme_id"), F.col("doc_id").alias("member")), c).withColumn("shelf_ids", joined("shelf_ids"))


@query("SELECT source AS shelf_id, count(*) AS n_chunks, count(*) FILTER (WHERE n_chars > 200) AS n_vectors FROM documents WHERE source <> 'src0' GROUP BY source HAVING count(*) >= 20 AND count(*) FILTER (WHERE n_chars > 200) >= greatest(20, 0.8 * count(*))", False)
def eligible_shelves(t):
    d = t.read("documents")
    return themes.eligible_shelves(d.select(F.col("source").alias("shelf_id"), F.col("doc_id").alias("chunk_id")), 20, "src0", d.where("n_chars > 200").select(F.col("doc_id").alias("chunk_id")))


@query("WITH v AS (SELECT vec_id AS chunk_id, embedding::DOUBLE[] AS e, label AS theme_id, CASE WHEN label < 3 THEN 'global_similarity' WHEN label < 6 THEN 'relatedness' ELSE 'merged' END AS pass FROM embeddings) SELECT theme_id, chunk_id, CASE WHEN pass = 'global_similarity' THEN 'direct' WHEN pass = 'relatedness' THEN 'indirect' WHEN EXISTS (SELECT 1 FROM v w WHERE w.theme_id = v.theme_id AND w.chunk_id <> v.chunk_id AND list_dot_product(w.e, v.e) >= 0.55) THEN 'direct' ELSE 'indirect' END AS badge FROM v", False)
def theme_directness(t):
    kind = F.when(F.col("label") < 3, "global_similarity").when(F.col("label") < 6, "relatedness").otherwise("merged")
    m = t.vectors.select(F.col("label").alias("theme_id"), kind.alias("pass"), F.col("vec_id").alias("chunk_id"))
    return themes.directness(m, t.vectors.select(F.col("vec_id").alias("chunk_id"), "embedding"), 0.55)


@query("SELECT source AS run, count(DISTINCT lang) AS n_communities, CAST(median(n) AS DOUBLE) AS median_size, max(n) AS max_size, max(n) / sum(n) AS max_share, CAST(any_value(e) AS BIGINT) AS n_edges FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT source, count(*) AS e FROM documents GROUP BY ALL) USING (source) GROUP BY source", False)
def community_sizes(t):
    d = t.read("documents")
    return graphs.community_sizes(d.select(F.col("source").alias("run"), F.col("lang").alias("community"), F.col("doc_id").alias("node")), d.select(F.col("source").alias("run"), F.col("doc_id").alias("a"), F.col("doc_id").alias("b")))


@query("SELECT theme_id, CASE WHEN name <> '' THEN name ELSE kw END AS label FROM (SELECT s_suppkey AS theme_id, CASE WHEN s_acctbal > 0 THEN lower(s_name) ELSE '' END AS name, n_name || ' ' || s_nationkey || ' z' AS kw FROM supplier JOIN nation ON s_nationkey = n_nationkey)", False)
def theme_labels(t):
    s = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("theme_id", F.col("s_suppkey"))
    words = s.select("theme_id", F.posexplode(F.array("n_name", F.col("s_nationkey").cast("string"), F.lit("z"), F.lit("more"))).alias("p", "term")).select("theme_id", "term", (F.col("p") + 1).alias("rank"))
    return navigation.labels_or_keywords(s, s.select("theme_id", F.when(F.col("s_acctbal") > 0, F.lower("s_name")).otherwise(" ").alias("name")), words)


# --- audits, search, stores


@query("SELECT c_custkey AS chunk_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) ORDER BY c_custkey LIMIT 10", False)
def first_orphans(t):
    return quality.first_orphans(t.read("customer").select(F.col("c_custkey").alias("chunk_id")), t.read("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("chunk_id")))


@query("SELECT 'documents' AS kind, lang AS \"group\", count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'pages', NULL, count(*) FROM pages", False)
def graph_inventory(t):
    return quality.inventory({"documents": t.read("documents").select("lang"), "pages": t.read("pages").select("url")}, "lang")


@query("SELECT 25 AS n, 25 AS n_distinct, 1.0 AS repeats", False)
def seeded_sample(t):
    rows = t.read("orders").select("o_orderkey")
    a, b = quality.seeded_sample(rows, "o_orderkey", 25, 7), quality.seeded_sample(rows.repartition(5), "o_orderkey", 25, 7)
    n = a.agg(F.count("*").cast("int").alias("n"), F.count_distinct("o_orderkey").cast("int").alias("n_distinct"))
    return n.crossJoin(F.broadcast(evaluation.reproducibility(a.toDF("node"), b.toDF("node")).withColumnRenamed("jaccard", "repeats")))


_CARDS = "SELECT 'card:' || p_partkey AS card_id, p_name AS title, p_brand || ' ' || lower(p_type) AS summary FROM part"


@query(f"SELECT card_id, score, CAST(row_number() OVER (ORDER BY score DESC, card_id) - 1 AS INT) AS rank FROM (SELECT card_id, len(list_intersect(list_distinct(regexp_extract_all(lower(title || ' ' || summary), '[a-z0-9]+')), ['brand', '11', 'promo'])) AS score FROM ({_CARDS})) WHERE score > 0 ORDER BY score DESC, card_id LIMIT 20", False)
def card_search(t):
    c = t.read("part").select(F.concat(F.lit("card:"), F.col("p_partkey")).alias("card_id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", F.lower("p_type")).alias("summary"))
    return retrieval.search_cards(c, ["brand", "11", "promo"], 20).withColumn("score", F.col("score").cast("long"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 3) SELECT vec_id, round(list_dot_product(v.e, q.e), 9) AS score FROM v, q WHERE label <= 4 AND label <> 2 AND vec_id <> 3 ORDER BY score DESC, vec_id LIMIT 15", False)
def knn_within(t):
    v = t.vectors
    found = retrieval.knn_search(v, v.where("vec_id = 3"), 15, candidates=v.where("label <= 4").select("vec_id"), exclude=v.where("label = 2").select("vec_id"))
    return found.select("vec_id", "score")


@query(" SELECT term_id, label, CAST(score AS INT) AS score, CAST(chunk_count AS BIGINT) AS chunk_count FROM (SELECT id AS term_id, label, len(list_intersect(list_distinct(string_split_regex(lower(label || ' ' || coalesce(synonym, '')), '[^a-z0-9]+')), ['promo', 'brand', '11', '12'])) AS score, p_size AS chunk_count FROM terms JOIN part ON id = 'P:' || p_partkey) WHERE score > 0 ORDER BY score DESC, chunk_count DESC, term_id LIMIT 25")
def entity_synonym_search(t):
    p = t.read("part").select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("id"), F.col("p_size").cast("long").alias("chunk_count"))
    e = t.terms.join(p, "id").select(F.col("id").alias("term_id"), "label", "synonyms", "chunk_count")
    return entities.search_entities(e, ["promo", "brand", "11", "12"], 25).select("term_id", "label", "score", "chunk_count")


@query(None)
def hybrid_seed_search(t):
    v = t.vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.hybrid_search(t.chunks.select("chunk_id", "text"), v, ["the", "version"], 10).select("id", "score", "rank")


@query("SELECT doc_id AS chunk_id, '' AS shelf_ids, 0 AS n_edges FROM documents", False)
def cleared_attachments(t):
    c = t.chunks.select("chunk_id", F.array("source_type").alias("shelf_ids"))
    rows, edges = sinks.clear_attachments(c, c.select("chunk_id", F.explode("shelf_ids").alias("shelf_id")))
    n = edges.agg(F.count("*").cast("int").alias("n_edges"))
    return rows.crossJoin(F.broadcast(n)).select("chunk_id", joined("shelf_ids").alias("shelf_ids"), "n_edges")


@query("SELECT doc_id AS chunk_id, string_agg(DISTINCT t, ',' ORDER BY t) AS theme_ids FROM (SELECT doc_id, lang AS t FROM documents UNION ALL SELECT doc_id, source FROM documents WHERE lang <> 'fr' UNION ALL SELECT doc_id, lang FROM documents) GROUP BY doc_id", False)
def theme_attachments(t):
    d = t.read("documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    old, new = d.select("chunk_id", F.col("lang").alias("theme_id")), d.where("lang <> 'fr'").select("chunk_id", F.explode(F.array("source", "lang")).alias("theme_id"))
    return sinks.attach_to_themes(old, new)[1].withColumn("theme_ids", joined("theme_ids"))


@query(" SELECT chunk_id, term_id, max(confidence) AS confidence FROM links GROUP BY ALL")
def entity_attachments(t):
    e = t.links.select("chunk_id", "term_id", "confidence")
    return sinks.attach_to_entities(e.where(F.col("confidence") < FLOOR), e.where(F.col("confidence") >= FLOOR))


@query("SELECT doc_id AS chunk_id, 'A,a,b' AS term_ids FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'x' FROM documents WHERE lang <> 'en'", False)
def merged_annotations(t):
    c = t.chunks.select("chunk_id", F.array(F.lit("x")).alias("term_ids"))
    a = t.chunks.where("source_type = 'en'").select("chunk_id", F.array(F.lit("b"), F.lit("a"), F.lit("b"), F.lit("A")).alias("term_ids"))
    return sinks.merge_annotations(c, a, strict=True).withColumn("term_ids", joined("term_ids"))


@query("SELECT c_custkey AS id, c_mktsegment || ' ' || c_custkey AS name FROM customer WHERE c_custkey IN (5, 17, 99)", False)
def entity_multi_get(t):
    ids = t.spark.createDataFrame([(0, 99), (1, 5), (2, 17), (3, -1)], "pos long, id long")
    e = t.read("customer").select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", "c_custkey").alias("name"))
    return chunks.multi_get(ids, e, "id").select("id", "name")


@query("SELECT s_suppkey AS id, 'facet:' || n_name || '/P:' || s_suppkey AS shelf_id, 'P:' || s_suppkey AS term_id, trim(regexp_replace(s_name, '\\s+food product$', '', 'i')) AS label, s_name || ' | a | b | c | d | e' AS term_text, CASE WHEN s_acctbal > 0 THEN '{\"k\": ' || s_suppkey || '}' END AS reply, CASE WHEN s_acctbal > 5000 THEN 'merged' WHEN s_acctbal > 0 THEN 'similarity_only' ELSE 'other' END AS source, s_acctbal > 0 AND s_acctbal <= 5000 AS real_vector FROM supplier JOIN nation ON s_nationkey = n_nationkey", False)
def scalar_functions(t):
    s = t.read("supplier").join(t.read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    shelf = fx.shelf_id_of(F.col("n_name"), F.concat(F.lit("P:"), k))
    reply = F.when(bal > 0, F.concat(F.lit("Sure:\n```json\n{\"k\": "), k, F.lit("}\n``` done"))).otherwise("no {object here")
    names = F.array(*[F.lit(x) for x in "abcdefg"])
    model = F.when(bal > 5000, "mock-1").when(bal > 0, "encoder").otherwise("hash")
    return s.select(k.alias("id"), shelf.alias("shelf_id"), fx.term_of_shelf(shelf).alias("term_id"), fx.clean_label(F.concat("s_name", F.lit(" food product"))).alias("label"), fx.term_text(F.col("s_name"), names, " | ").alias("term_text"), fx.json_object(reply).alias("reply"), fx.source_of(F.when(bal > 5000, "merged").when(bal > 0, "bertopic").otherwise("?")).alias("source"), fx.is_real_embedding(model).alias("real_vector"))


@query("SELECT doc_id AS chunk_id, CASE WHEN length(text) <= 60 THEN text WHEN regexp_extract(substr(text, 1, 60), '(?s)^(.*)[ \\t\\n]\\S*$', 1) = '' THEN substr(text, 1, 60) ELSE rtrim(regexp_extract(substr(text, 1, 60), '(?s)^(.*)[ \\t\\n]\\S*$', 1), ' ') END AS head FROM documents", False)
def clamped_texts(t):
    return t.chunks.select("chunk_id", fx.clamp_words(F.col("text"), 60).alias("head"))
