"""Queries over the hierarchy, support, projection and attachment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import attach, entities, ontology, projection, quality, support, views
from .standin import BY_PREFIX, BY_TYPE, CAP, FLOOR, ROOT, SQL, Tables

QUERIES, ORACLE = {}, {}


def query(sql: str | None, plain: bool = False):
    """Register a query under its function's name, with its SQL twin over the stand-in views (or over the raw tables)."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[f.__name__] = sql if plain else SQL + sql
        return f

    return add


def joined(column: str):
    return F.array_join(F.array_sort(column), ",")


@query("SELECT term_id, direct, with_descendants FROM support ORDER BY with_descendants DESC, term_id LIMIT 100")
def support_top_terms(t):
    return t.support.orderBy(F.desc("with_descendants"), "term_id").limit(100)


_FACET = f"CASE entity_type WHEN 'STANDARD' THEN 'foods' WHEN 'MEDIUM' THEN 'nutrients' WHEN 'PROMO' THEN 'dietary_patterns' WHEN 'LARGE' THEN 'health' ELSE CASE WHEN term_id LIKE 'P:1%' THEN 'foods' ELSE 'sustainability' END END"


def _routed(t):
    return support.route(t.links, BY_TYPE, BY_PREFIX, "P:1", "foods")


@query(f"SELECT facet, count(*) AS n_links, count(DISTINCT term_id) AS n_terms FROM (SELECT *, {_FACET} AS facet FROM links) GROUP BY facet")
def facet_routing(t):
    return _routed(t).groupBy("facet").agg(F.count("*").alias("n_links"), F.count_distinct("term_id").alias("n_terms"))


@query(f", fd AS (SELECT DISTINCT chunk_id, term_id, {_FACET} AS facet FROM links WHERE confidence >= {FLOOR}), fw AS (SELECT * FROM fd UNION SELECT chunk_id, ancestor, facet FROM fd JOIN anc ON term = term_id) SELECT w.facet, w.term_id, coalesce(d.n, 0) AS direct, w.n AS with_descendants FROM (SELECT facet, term_id, count(*) AS n FROM fw GROUP BY ALL) w LEFT JOIN (SELECT facet, term_id, count(*) AS n FROM fd GROUP BY ALL) d ON w.facet = d.facet AND w.term_id = d.term_id")
def support_by_facet(t):
    d = support.direct_pairs(support.above_floor(_routed(t), FLOOR), "facet")
    return support.support(d, t.anc, "facet").select("facet", "term_id", "direct", "with_descendants")


@query(f"SELECT count(*) AS n_links, count(DISTINCT chunk_id) AS n_chunks FROM links WHERE confidence >= {FLOOR}")
def confidence_floor(t):
    return support.above_floor(t.links, FLOOR).agg(F.count("*").alias("n_links"), F.count_distinct("chunk_id").alias("n_chunks"))


@query("SELECT term_id, count(*) AS n FROM links WHERE NOT (lower(surface) = 'small ring' AND term_id IN (SELECT 'P:' || p_partkey FROM part WHERE p_size > 25)) GROUP BY term_id")
def link_blocklist(t):
    blocked = t.read("part").where("p_size > 25").select(F.lit("Small Ring").alias("surface"), F.concat(F.lit("P:"), F.col("p_partkey")).alias("term_id"))
    return support.not_blocked(t.links, blocked).groupBy("term_id").agg(F.count("*").alias("n"))


@query("SELECT term, ancestor FROM anc")
def ontology_closure(t):
    return t.anc


@query("SELECT term, depth FROM depth")
def ontology_depth(t):
    return t.depth


@query("SELECT parent, count(DISTINCT child) AS n_children, min(child) AS first_child FROM is_a GROUP BY parent")
def ontology_children(t):
    return ontology.children(t.is_a)


@query("SELECT ancestor, count(DISTINCT term) AS n_descendants FROM anc GROUP BY ancestor")
def ontology_descendants(t):
    return ontology.descendant_counts(t.anc)


@query(""", g AS (SELECT p_brand || '+' || CASE WHEN p_size < 25 THEN p_type ELSE 'any' END AS grp, 'P:' || p_partkey AS term FROM part),
r AS (SELECT term, ancestor FROM anc UNION SELECT term, term FROM g), c AS (SELECT grp, ancestor, count(DISTINCT g.term) AS m FROM g JOIN r ON g.term = r.term GROUP BY ALL),
n AS (SELECT grp, count(DISTINCT term) AS n FROM g GROUP BY grp), a AS (SELECT term, count(*) AS above FROM anc GROUP BY term)
SELECT grp AS "group", lca FROM (SELECT c.grp, c.ancestor AS lca, row_number() OVER (PARTITION BY c.grp ORDER BY coalesce(above, 0) DESC, c.ancestor) AS k FROM c JOIN n ON c.grp = n.grp AND c.m = n.n LEFT JOIN a ON a.term = c.ancestor) WHERE k = 1""")
def ontology_lca(t):
    kind = F.when(F.col("p_size") < 25, F.col("p_type")).otherwise("any")
    g = t.read("part").select(F.concat("p_brand", F.lit("+"), kind).alias("group"), F.concat(F.lit("P:"), F.col("p_partkey")).alias("term"))
    return ontology.lowest_common_ancestors(g, t.anc)


@query("""SELECT query, min(id) AS id, count(id) AS n_ids FROM (SELECT DISTINCT q.query, n.id FROM (SELECT DISTINCT upper(p_name) || '!' AS query FROM part UNION SELECT 'no such thing') q
LEFT JOIN (SELECT id, label AS name FROM terms WHERE NOT obsolete UNION SELECT id, synonym FROM terms WHERE NOT obsolete AND synonym IS NOT NULL) n ON trim(regexp_replace(lower(n.name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(q.query), '[^a-z0-9]+', ' ', 'g'))) GROUP BY query""")
def name_lookup(t):
    q = t.read("part").select(F.concat(F.upper("p_name"), F.lit("!")).alias("query")).distinct()
    return ontology.lookup_names(q.union(t.spark.createDataFrame([("no such thing",)], "query string")), t.terms)


@query("SELECT id, label FROM terms WHERE NOT obsolete AND contains(lower(label), 'ring') ORDER BY length(label), id LIMIT 20")
def term_search(t):
    return ontology.search_terms(t.terms, "ring", 20)


@query(""", p AS (SELECT 'P:' || p_partkey AS a, 'T:' || 'SMALL' AS b FROM part) SELECT a, b, EXISTS (SELECT 1 FROM anc WHERE term = a AND ancestor = b) OR a = b AS is_subclass FROM p""")
def subclass_test(t):
    return ontology.subclass_pairs(t.read("part").select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("a"), F.lit("T:SMALL").alias("b")), t.anc)


@query(", l AS (SELECT 'P:' || p_partkey AS term, 'T:' || p_type AS home FROM part) SELECT l.term, l.home, count(u.ancestor) AS distance FROM l LEFT JOIN anc u ON u.term = l.term AND (u.ancestor = l.home OR u.ancestor IN (SELECT d.term FROM anc d WHERE d.ancestor = l.home)) GROUP BY ALL")
def home_distance(t):
    return ontology.is_a_distance(t.read("part").select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("term"), F.concat(F.lit("T:"), "p_type").alias("home")), t.anc)


@query("SELECT term_id, direct, with_descendants FROM support WHERE with_descendants >= 25 AND direct / with_descendants < 0.1 AND (with_descendants - direct) / with_descendants > 0.85")
def umbrella_filter(t):
    return t.support.where(projection.is_umbrella(F.col("direct"), F.col("with_descendants"), projection.PruneConfig()))


@query("SELECT term_id, direct, with_descendants FROM survivors")
def prune_survivors(t):
    return t.survivors


@query("SELECT term_id, parent FROM parents")
def prune_parent(t):
    return projection.nearest_parents(t.survivors, t.anc, t.depth, CAP).select("term_id", "parent")


@query("SELECT term_id, parent, depth FROM tree")
def projection_depth(t):
    return t.tree.select("term_id", "parent", "depth")


@query("SELECT shelf_id, parent, depth, direct, chunk_count FROM shelves")
def synthetic_root(t):
    return t.shelves.select("shelf_id", "parent", "depth", "direct", "chunk_count")


@query("SELECT parent, child, direct, with_descendants, row_number() OVER (PARTITION BY parent ORDER BY with_descendants DESC, child) AS rank FROM is_a JOIN support ON term_id = child WHERE with_descendants >= 30")
def backbone_children(t):
    return projection.supported_children(t.is_a, t.support, 30).select("parent", "child", "direct", "with_descendants", "rank")


@query("SELECT s.term_id, k.child FROM support s JOIN (SELECT parent, count(*) AS n, min(child) AS child FROM is_a JOIN support ON term_id = child WHERE with_descendants >= 38 GROUP BY parent) k ON k.parent = s.term_id WHERE s.direct = 0 AND k.n = 1")
def filing_tier_chains(t):
    return projection.filing_tiers(t.is_a, t.support, 38)


@query("SELECT chunk_id, shelf_id, CASE WHEN bool_or(mode = 'direct') THEN '' ELSE string_agg(DISTINCT term_id, ',' ORDER BY term_id) END AS lifted_from FROM resolved GROUP BY chunk_id, shelf_id")
def attach_edges(t):
    return attach.edges(t.resolved).select("chunk_id", "shelf_id", joined("lifted_from").alias("lifted_from"))


@query("SELECT chunk_id, string_agg(DISTINCT shelf_id, ',' ORDER BY shelf_id) AS shelf_ids FROM resolved GROUP BY chunk_id")
def attach_denorm(t):
    return attach.shelf_ids(t.resolved).select("chunk_id", joined("shelf_ids").alias("shelf_ids"))


@query("SELECT mode, count(*) AS n_chunks FROM (SELECT chunk_id, CASE min(CASE mode WHEN 'direct' THEN 0 WHEN 'collapsed' THEN 1 WHEN 'lifted' THEN 2 ELSE 3 END) WHEN 0 THEN 'direct' WHEN 1 THEN 'collapsed' WHEN 2 THEN 'lifted' ELSE 'orphan' END AS mode FROM resolved GROUP BY chunk_id) GROUP BY mode")
def attach_modes(t):
    return attach.mode_counts(t.resolved)


@query(""", dl AS (SELECT l.*, o_orderdate AS created_at FROM links l JOIN orders ON o_orderkey = chunk_id),
c AS (SELECT term_id, chunk_id, row_number() OVER (PARTITION BY term_id ORDER BY chunk_id) AS k FROM (SELECT DISTINCT term_id, chunk_id FROM dl)),
s AS (SELECT term_id, surface, row_number() OVER (PARTITION BY term_id ORDER BY count(*) DESC, surface) AS k FROM dl GROUP BY term_id, surface),
f AS (SELECT term_id, entity_type, row_number() OVER (PARTITION BY term_id ORDER BY count(*) DESC, entity_type) AS k FROM dl GROUP BY term_id, entity_type)
SELECT dl.term_id, split_part(dl.term_id, ':', 1) AS prefix, any_value(s.surface) AS label, any_value(f.entity_type) AS facet_hint, count(*) AS mention_count, count(DISTINCT chunk_id) AS chunk_count,
 (SELECT string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY chunk_id) FROM c WHERE c.term_id = dl.term_id AND k <= 50) AS chunk_ids, CAST(max(created_at) AS VARCHAR) AS last_seen
FROM dl JOIN s ON s.term_id = dl.term_id AND s.k = 1 JOIN f ON f.term_id = dl.term_id AND f.k = 1 GROUP BY dl.term_id""")
def build_entities(t):
    e = entities.build_entities(t.dated_links)
    return e.withColumn("chunk_ids", F.array_join(F.transform("chunk_ids", lambda x: x.cast("string")), ",")).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss"))


@query("SELECT chunk_id, term_id, max(confidence) AS confidence FROM links GROUP BY ALL")
def entity_edges(t):
    return entities.entity_edges(t.links)


@query("SELECT term_id, surface FROM (SELECT term_id, surface, row_number() OVER (PARTITION BY term_id ORDER BY count(*) DESC, surface) AS k FROM links GROUP BY term_id, surface) WHERE k = 1")
def entity_mode_surface(t):
    return entities.mode_of(t.links, "surface")


_ENTITY = ", e AS (SELECT term_id, min(surface) AS label, count(DISTINCT chunk_id) AS chunk_count FROM links GROUP BY term_id)"


def _small_entities(t):
    return t.links.groupBy("term_id").agg(F.min("surface").alias("label"), F.count_distinct("chunk_id").alias("chunk_count"))


@query(_ENTITY + " SELECT term_id, label, chunk_count, CAST(contains(' ' || label || ' ', ' red ') AS INT) + CAST(contains(' ' || label || ' ', ' ring ') AS INT) AS score FROM e WHERE contains(' ' || label || ' ', ' red ') OR contains(' ' || label || ' ', ' ring ') ORDER BY score DESC, chunk_count DESC, term_id LIMIT 25")
def entity_search(t):
    return entities.search_entities(_small_entities(t), ["red", "ring"], 25)


@query(_ENTITY + " SELECT term_id, label, chunk_count FROM e WHERE split_part(term_id, ':', 1) = 'P' ORDER BY chunk_count DESC, term_id LIMIT 30")
def entity_by_prefix(t):
    return _small_entities(t).where(fx.prefix_of(F.col("term_id")) == "P").orderBy(F.desc("chunk_count"), "term_id").limit(30)


@query("SELECT term_id, count(DISTINCT chunk_id) AS shared FROM links WHERE chunk_id IN (SELECT chunk_id FROM links WHERE term_id = 'P:7') AND term_id <> 'P:7' GROUP BY term_id ORDER BY shared DESC, term_id LIMIT 40")
def entity_neighborhood(t):
    return entities.neighbourhood(t.links, "P:7", 40)


_SA = ", sa(term, ancestor) AS (SELECT shelf_id, parent FROM shelves WHERE parent IS NOT NULL UNION SELECT sa.term, s.parent FROM sa JOIN shelves s ON s.shelf_id = sa.ancestor WHERE s.parent IS NOT NULL) "


def _shelf_closure(t):
    return ontology.closure(t.shelves.where("parent is not null").select(F.col("shelf_id").alias("child"), "parent"))


@query(_SA + "SELECT shelf_id, count(*) AS n_chunks FROM (SELECT chunk_id, shelf_id FROM resolved UNION SELECT chunk_id, sa.ancestor FROM resolved JOIN sa ON sa.term = shelf_id) GROUP BY shelf_id")
def subtree_chunks(t):
    return views.subtree_chunks(_shelf_closure(t), t.resolved.select("chunk_id", "shelf_id").distinct())


@query(_SA + "SELECT s.shelf_id, coalesce(p.path, '') AS path FROM shelves s LEFT JOIN (SELECT sa.term, string_agg(sa.ancestor, '>' ORDER BY a.depth, sa.ancestor) AS path FROM sa JOIN shelves a ON a.shelf_id = sa.ancestor GROUP BY sa.term) p ON p.term = s.shelf_id")
def shelf_ancestors(t):
    return views.ancestor_chain(t.shelves, _shelf_closure(t))


@query("""SELECT start, node FROM (
SELECT DISTINCT a.x AS start, b.y AS node FROM (SELECT shelf_id AS x, parent AS y FROM shelves WHERE parent IS NOT NULL UNION SELECT parent, shelf_id FROM shelves WHERE parent IS NOT NULL) a
JOIN (SELECT shelf_id AS x, parent AS y FROM shelves WHERE parent IS NOT NULL UNION SELECT parent, shelf_id FROM shelves WHERE parent IS NOT NULL UNION SELECT shelf_id, shelf_id FROM shelves) b ON a.y = b.x WHERE a.x LIKE 'BT:%' AND a.x <> b.y)""")
def shelf_neighbors(t):
    from ..operators.graphs import neighbours_within

    s = t.shelves.where("parent is not null")
    return neighbours_within(s.select(F.col("shelf_id").alias("a"), F.col("parent").alias("b")), s.where("shelf_id like 'BT:%'").select(F.col("shelf_id").alias("start")), 2)


@query("SELECT count(*) AS n_bearing, count(DISTINCT r.chunk_id) AS n_attached, count(DISTINCT r.chunk_id) / count(*) AS share FROM (SELECT DISTINCT chunk_id FROM links) c LEFT JOIN (SELECT DISTINCT chunk_id FROM resolved WHERE mode <> 'orphan') r ON c.chunk_id = r.chunk_id")
def audit_coverage(t):
    return quality.coverage(t.pairs, t.resolved.where("mode <> 'orphan'"))


@query(f"""SELECT bucket, count(*) AS n_chunks FROM (SELECT CASE WHEN nd = b AND nm = b THEN 'exact' WHEN nm = b THEN 'denorm_superset' WHEN nd = b THEN 'mentions_superset' ELSE 'partial' END AS bucket
FROM (SELECT coalesce(d.chunk_id, m.chunk_id) AS chunk_id, count(d.term_id) AS nd, count(m.term_id) AS nm, count(*) FILTER (WHERE d.term_id IS NOT NULL AND m.term_id IS NOT NULL) AS b
FROM (SELECT DISTINCT chunk_id, term_id FROM links) d FULL JOIN (SELECT DISTINCT chunk_id, term_id FROM links WHERE confidence >= {FLOOR}) m ON d.chunk_id = m.chunk_id AND d.term_id = m.term_id GROUP BY 1)) GROUP BY bucket""")
def audit_mentions(t):
    return quality.mention_buckets(t.links, support.above_floor(t.links, FLOOR))


@query("SELECT n_a, n_b, n_both, n_both / (n_a + n_b - n_both) AS ratio FROM (SELECT (SELECT count(*) FROM (SELECT DISTINCT chunk_id, shelf_id FROM resolved)) AS n_a, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, shelf_id FROM resolved WHERE mode = 'direct')) AS n_b, (SELECT count(*) FROM (SELECT DISTINCT chunk_id, shelf_id FROM resolved WHERE mode = 'direct')) AS n_both)")
def audit_parity(t):
    r = t.resolved
    return quality.parity(r, r.where("mode = 'direct'"), "chunk_id", "shelf_id")


@query("SELECT s.shelf_id, s.direct, coalesce(e.n, 0) AS actual, coalesce(e.n, 0) - s.direct AS delta FROM shelves s LEFT JOIN (SELECT shelf_id, count(*) AS n FROM (SELECT chunk_id, shelf_id FROM resolved GROUP BY ALL HAVING bool_or(mode = 'direct')) GROUP BY shelf_id) e ON e.shelf_id = s.shelf_id WHERE coalesce(e.n, 0) <> s.direct")
def audit_drift(t):
    return quality.drift(t.shelves, attach.direct_edges(t.resolved))


@query(_SA + "SELECT (SELECT count(*) FROM shelves WHERE parent IS NOT NULL AND parent NOT IN (SELECT shelf_id FROM shelves)) AS dangling, (SELECT count(*) FROM sa WHERE term = ancestor) AS cycles, (SELECT count(*) FROM shelves WHERE parent IS NULL) AS roots")
def audit_structure(t):
    return quality.structure(t.shelves, _shelf_closure(t))


@query("""SELECT shelf_id, rule FROM (SELECT s.shelf_id, CASE WHEN regexp_matches(s.label, '^[0-4]') AND contains(s.label, ' - ') THEN 'coded' WHEN contains(s.label, 'datum') OR regexp_matches(s.label, '\\bdata\\b') THEN 'data' WHEN s.label LIKE '% (raw)' OR s.label LIKE '% (canned)' THEN 'preparation'
WHEN k.n = 1 AND k.only NOT IN (SELECT parent FROM shelves WHERE parent IS NOT NULL) THEN 'single_leaf_child' WHEN s.chunk_count = 0 THEN 'empty' END AS rule
FROM shelves s LEFT JOIN (SELECT parent, count(*) AS n, min(shelf_id) AS only FROM shelves WHERE parent IS NOT NULL GROUP BY parent) k ON k.parent = s.shelf_id) WHERE rule IS NOT NULL""")
def suspicious_shelves(t):
    return quality.suspicious(t.shelves)


@query("""SELECT word, CASE WHEN l.s IS NOT NULL THEN 'label' WHEN x.s IS NOT NULL THEN 'term_shelf' WHEN n.id IS NOT NULL THEN 'term_only' ELSE 'not_found' END AS how, coalesce(l.s, x.s) AS shelf_id
FROM (SELECT DISTINCT p_name AS word FROM part UNION SELECT 'standard' UNION SELECT 'nothing') w
LEFT JOIN (SELECT lower(label) AS w, min(shelf_id) AS s FROM shelves GROUP BY 1) l ON l.w = lower(word) LEFT JOIN (SELECT lower(label) AS w, min(id) AS id FROM terms GROUP BY 1) n ON n.w = lower(word)
LEFT JOIN (SELECT term_id, min(shelf_id) AS s FROM shelves GROUP BY 1) x ON x.term_id = n.id""")
def vocab_check(t):
    words = t.read("part").select(F.col("p_name").alias("word")).distinct().union(t.spark.createDataFrame([("standard",), ("nothing",)], "word string"))
    return quality.vocabulary(words, t.shelves, t.terms)


@query("SELECT (SELECT count(*) FROM shelves) AS n_shelves, max(depth) AS max_depth, median(depth) AS median_depth, count(*) FILTER (WHERE direct = 0) AS n_zero_direct, CAST(sum(direct) AS BIGINT) AS sum_direct, CAST(sum(greatest(chunk_count - direct, 0)) AS BIGINT) AS sum_lifted, min(chunk_count) AS min_chunks, median(chunk_count) AS median_chunks, max(chunk_count) AS max_chunks, (SELECT max(n) FROM (SELECT count(*) AS n FROM shelves WHERE parent IS NOT NULL GROUP BY parent)) AS max_fanout FROM shelves")
def quality_metrics(t):
    return quality.shelf_metrics(t.shelves)


@query("SELECT p.k AS min_support, count(*) AS n_terms, count(*) FILTER (WHERE direct = 0) AS n_zero_direct, max(with_descendants) AS max_chunks FROM support, (SELECT unnest([5, 10, 20, 40, 80]) AS k) p WHERE with_descendants >= p.k GROUP BY p.k")
def threshold_sweep(t):
    ks = F.array(*[F.lit(k) for k in (5, 10, 20, 40, 80)])
    return t.support.withColumn("min_support", F.explode(F.filter(ks, lambda k: k <= F.col("with_descendants")))).groupBy("min_support").agg(F.count("*").alias("n_terms"), F.count_if(F.col("direct") == 0).alias("n_zero_direct"), F.max("with_descendants").alias("max_chunks"))


@query("SELECT l.term_id, count(DISTINCT chunk_id) AS n FROM links l WHERE l.term_id NOT IN (SELECT term_id FROM shelves) GROUP BY l.term_id ORDER BY n DESC, l.term_id LIMIT 50")
def coverage_gaps(t):
    return t.links.join(t.shelves.select("term_id"), "term_id", "left_anti").groupBy("term_id").agg(F.count_distinct("chunk_id").alias("n")).orderBy(F.desc("n"), "term_id").limit(50)


@query("SELECT parent, depth, shelf_id AS child, chunk_count, row_number() OVER (PARTITION BY parent ORDER BY chunk_count DESC, shelf_id) AS rank FROM shelves WHERE parent IS NOT NULL")
def hierarchy_entries(t):
    from pyspark.sql import Window

    s = t.shelves.where("parent is not null")
    return s.select("parent", "depth", F.col("shelf_id").alias("child"), "chunk_count", F.row_number().over(Window.partitionBy("parent").orderBy(F.desc("chunk_count"), "shelf_id")).alias("rank"))


@query("SELECT shelf_id, label, chunk_count FROM shelves ORDER BY chunk_count DESC, shelf_id LIMIT 25")
def top_shelves(t):
    return t.shelves.select("shelf_id", "label", "chunk_count").orderBy(F.desc("chunk_count"), "shelf_id").limit(25)


@query("SELECT term_id, count(*) AS n FROM links GROUP BY term_id ORDER BY n DESC, term_id LIMIT 40")
def entity_histogram(t):
    return t.links.groupBy("term_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term_id").limit(40)


@query(f"SELECT shelf_id, row_number() OVER (ORDER BY depth, lower(label), shelf_id) AS pos FROM shelves")
def shelf_order(t):
    s = t.shelves.orderBy("depth", F.lower("label"), "shelf_id")
    from pyspark.sql import Window

    return s.select("shelf_id", F.row_number().over(Window.orderBy("depth", F.lower("label"), "shelf_id")).alias("pos"))


@query(", a AS (SELECT CASE WHEN n = 0 THEN 'leaf' ELSE 'inner' END AS kind, depth.depth, coalesce(n, 0) AS n, up FROM depth LEFT JOIN (SELECT parent, count(DISTINCT child) AS n FROM is_a GROUP BY parent) k ON k.parent = depth.term LEFT JOIN (SELECT child, count(DISTINCT parent) AS up FROM is_a GROUP BY child) u ON u.child = depth.term) SELECT depth, count(*) AS n_terms, max(n) AS max_children, count(*) FILTER (WHERE n = 1) AS n_single_child, count(*) FILTER (WHERE up > 1) AS n_multi_parent FROM a GROUP BY depth")
def ontology_profile(t):
    e = t.is_a
    kids = e.groupBy(F.col("parent").alias("term")).agg(F.count_distinct("child").alias("n"))
    up = e.groupBy(F.col("child").alias("term")).agg(F.count_distinct("parent").alias("up"))
    j = t.depth.join(kids, "term", "left").join(up, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.groupBy("depth").agg(F.count("*").alias("n_terms"), F.max("n").alias("max_children"), F.count_if(F.col("n") == 1).alias("n_single_child"), F.count_if(F.col("up") > 1).alias("n_multi_parent"))


@query("SELECT id, CASE WHEN regexp_matches(label, '#') THEN 'garbled' WHEN contains(label, 'data') THEN 'data' WHEN regexp_matches(label, '(ing|tion)$') THEN 'process' WHEN contains(label, '/') THEN 'organizational' ELSE 'recognizable' END AS kind FROM terms")
def label_classes(t):
    label = F.col("label")
    kind = F.when(F.contains(label, F.lit("#")), "garbled").when(F.contains(label, F.lit("data")), "data").when(F.rlike(label, F.lit("(ing|tion)$")), "process").when(F.contains(label, F.lit("/")), "organizational").otherwise("recognizable")
    return t.terms.select("id", kind.alias("kind"))
