"""The model's tables as views over the driver's star schema, once in Spark and once as SQL.

Links come from line items and parts, the hierarchy from part, brand and type (every
brand/type node has two parents), chunks from documents, vectors from embeddings.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attach, ontology, projection, support
from ..session import Rounds

FLOOR, TAU, MIN_SUPPORT, CAP = 0.925, 0.955, 30, 5
#: Parts up to this size are see-also entries.
SMALL_PART = 7
ROOT = "facet:all"
BY_TYPE = {"STANDARD": "foods", "MEDIUM": "nutrients", "PROMO": "dietary_patterns", "LARGE": "health"}
BY_PREFIX = {"P": "sustainability"}


class Tables:
    """Stand-in frames of one data directory.

    Scans stay lazy; phases that several later ones read (closure, support, shelves) are
    written once per query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._phases = Rounds(spark, "phases")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def links(self) -> DataFrame:
        part = self.read("part").select("p_partkey", "p_name", "p_type")
        line = self.read("lineitem").select("l_orderkey", "l_partkey", "l_discount")
        j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
        return j.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("P:"), F.col("l_partkey")).alias("term_id"), F.col("p_name").alias("surface"), F.col("p_type").alias("entity_type"), (1 - F.col("l_discount")).alias("confidence"))

    @property
    def dated_links(self) -> DataFrame:
        o = self.read("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("created_at"))
        return self.links.join(o, "chunk_id")

    @property
    def is_a(self) -> DataFrame:
        p = self.read("part")
        leaf, mid = F.concat(F.lit("P:"), F.col("p_partkey")), F.concat(F.lit("BT:"), "p_brand", F.lit("/"), "p_type")
        brand, kind = F.concat(F.lit("B:"), "p_brand"), F.concat(F.lit("T:"), "p_type")
        pairs = F.array(*[F.struct(c.alias("child"), d.alias("parent")) for c, d in ((leaf, mid), (mid, brand), (mid, kind), (brand, F.lit("ROOT")), (kind, F.lit("ROOT")))])
        return p.select(F.explode(pairs).alias("e")).select("e.child", "e.parent").distinct()

    @cached_property
    def anc(self) -> DataFrame:
        return ontology.closure(self.is_a)

    @cached_property
    def depth(self) -> DataFrame:
        return ontology.depths(self.is_a)

    @property
    def terms(self) -> DataFrame:
        """(id, label, synonyms, obsolete): parts by name, inner nodes by the text after the prefix."""
        p = self.read("part").select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("id"), F.col("p_name").alias("label"), F.array(F.concat_ws(" ", "p_name", F.lower("p_type"))).alias("synonyms"), (F.col("p_size") == 1).alias("obsolete"))
        e = self.is_a
        inner = e.select(F.explode(F.array("child", "parent")).alias("id")).where("id not like 'P:%'").distinct()
        return p.unionByName(inner.select("id", F.lower(F.regexp_replace("id", "^[A-Z]+:", "")).alias("label"), F.array().cast("array<string>").alias("synonyms"), F.lit(False).alias("obsolete")))

    @cached_property
    def pairs(self) -> DataFrame:
        """(chunk_id, term_id, confidence) with the best confidence of each pair; line items meet by part and order in one exchange."""
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"))
        best = self.read("lineitem").select("l_orderkey", "l_partkey", "l_discount").join(part, "l_partkey", "left_semi").groupBy("l_orderkey", "l_partkey").agg(F.max(1 - F.col("l_discount")).alias("confidence"))
        return self._phases.write(best.select(F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("P:"), F.col("l_partkey")).alias("term_id"), "confidence"))

    @cached_property
    def direct(self) -> DataFrame:
        return support.above_floor(self.pairs, FLOOR).select("chunk_id", "term_id")

    @cached_property
    def support(self) -> DataFrame:
        return self._phases.write(support.support(self.direct, self.anc))

    @cached_property
    def survivors(self) -> DataFrame:
        c = projection.PruneConfig(min_support=MIN_SUPPORT, direct_share_max=0.0)
        return projection.survivors(self.support, c).where("term_id <> 'ROOT'")

    @cached_property
    def tree(self) -> DataFrame:
        """Survivors with parent and projected depth."""
        return self._phases.write(projection.projected_depths(projection.nearest_parents(self.survivors, self.anc, self.depth, CAP), CAP))

    @cached_property
    def shelves(self) -> DataFrame:
        """(shelf_id, term_id, label, parent, depth, direct, chunk_count) under a synthetic root."""
        s = projection.with_single_root(self.tree, support.one_below(self.direct, self.anc, self.tree.where("parent is null")), ROOT)
        label = F.lower(F.regexp_replace("term_id", "^[A-Za-z]+:", ""))
        return self._phases.write(s.select(F.col("term_id").alias("shelf_id"), "term_id", label.alias("label"), "parent", "depth", "direct", F.col("with_descendants").alias("chunk_count")))

    def see_also(self, shelves: DataFrame) -> DataFrame:
        """Small parts that are no shelf are listed by their brand/type shelf."""
        e = self.read("part").where(f"p_size <= {SMALL_PART}").select(F.concat(F.lit("P:"), F.col("p_partkey")).alias("term_id"), F.concat(F.lit("BT:"), "p_brand", F.lit("/"), "p_type").alias("shelf_id"))
        return e.join(shelves.select("term_id"), "term_id", "left_anti").join(shelves.select("shelf_id"), "shelf_id", "left_semi").select("term_id", "shelf_id")

    @cached_property
    def resolved(self) -> DataFrame:
        s = self.shelves
        return attach.resolve(self.pairs, s.select("shelf_id", "term_id", "depth"), self.see_also(s), self.anc, ROOT)

    @property
    def denorm(self) -> DataFrame:
        """(chunk_id, term_ids): the chunks' own lists, from all line items."""
        return self.read("lineitem").groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("P:"), F.col("l_partkey")))).alias("term_ids"))

    @property
    def theme_members(self) -> DataFrame:
        """(theme_id, pass, shelf_id, label, chunk_id): documents by source and language."""
        kind = F.when(F.col("lang") == "en", "merged").when(F.col("lang") == "de", "global_similarity").otherwise("relatedness")
        label = F.when(F.col("lang") == "fr", "Story one").when(F.col("lang") == "es", " story ONE").otherwise(F.concat(F.lit("tale "), "lang"))
        return self.read("documents").select(F.concat_ws("/", "source", "lang").alias("theme_id"), kind.alias("pass"), F.col("source").alias("shelf_id"), label.alias("label"), F.col("doc_id").alias("chunk_id"))

    @property
    def theme_rows(self) -> DataFrame:
        """(theme_id, pass, label, shelf_ids): themes of German documents lie on two shelves."""
        shelves = F.when(F.col("pass") == "global_similarity", F.array("shelf_id", F.lit("more"))).otherwise(F.array("shelf_id"))
        return self.theme_members.select("theme_id", "pass", "label", shelves.alias("shelf_ids")).distinct()

    @property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select("vec_id", "embedding", "label")

    @property
    def chunks(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_doc_id"), F.col("lang").alias("source_type"))


#: The same views as SQL, to be put before an oracle's SELECT.
SQL = f"""WITH RECURSIVE links AS (SELECT l_orderkey AS chunk_id, 'P:' || l_partkey AS term_id, p_name AS surface, p_type AS entity_type, 1 - l_discount AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey),
is_a AS (SELECT 'P:' || p_partkey AS child, 'BT:' || p_brand || '/' || p_type AS parent FROM part
  UNION SELECT 'BT:' || p_brand || '/' || p_type, 'B:' || p_brand FROM part UNION SELECT 'BT:' || p_brand || '/' || p_type, 'T:' || p_type FROM part
  UNION SELECT 'B:' || p_brand, 'ROOT' FROM part UNION SELECT 'T:' || p_type, 'ROOT' FROM part),
anc(term, ancestor) AS (SELECT child, parent FROM is_a UNION SELECT a.term, e.parent FROM anc a JOIN is_a e ON a.ancestor = e.child),
dep(term, d) AS (SELECT DISTINCT parent, 0 FROM is_a WHERE parent NOT IN (SELECT child FROM is_a) UNION SELECT e.child, dep.d + 1 FROM dep JOIN is_a e ON e.parent = dep.term),
depth AS (SELECT term, min(d) AS depth FROM dep GROUP BY term),
terms AS (SELECT 'P:' || p_partkey AS id, p_name AS label, p_name || ' ' || lower(p_type) AS synonym, p_size = 1 AS obsolete FROM part
  UNION ALL SELECT id, lower(regexp_replace(id, '^[A-Z]+:', '')), NULL, false FROM (SELECT child AS id FROM is_a UNION SELECT parent FROM is_a) WHERE id NOT LIKE 'P:%'),
D AS (SELECT DISTINCT chunk_id, term_id FROM links WHERE confidence >= {FLOOR}),
W AS (SELECT chunk_id, term_id FROM D UNION SELECT chunk_id, ancestor FROM D JOIN anc ON term = term_id),
support AS (SELECT w.term_id, coalesce(d.n, 0) AS direct, w.n AS with_descendants FROM (SELECT term_id, count(*) AS n FROM W GROUP BY term_id) w LEFT JOIN (SELECT term_id, count(*) AS n FROM D GROUP BY term_id) d ON w.term_id = d.term_id),
survivors AS (SELECT * FROM support WHERE with_descendants >= {MIN_SUPPORT} AND term_id <> 'ROOT'),
parents AS (SELECT s.term_id, s.direct, s.with_descendants, (SELECT a.ancestor FROM anc a JOIN survivors p ON p.term_id = a.ancestor JOIN depth q ON q.term = a.ancestor WHERE a.term = s.term_id AND q.depth <= {CAP} ORDER BY q.depth DESC, a.ancestor LIMIT 1) AS parent FROM survivors s),
placed(term_id, d) AS (SELECT term_id, 0 FROM parents WHERE parent IS NULL UNION ALL SELECT p.term_id, placed.d + 1 FROM parents p JOIN placed ON p.parent = placed.term_id),
tree AS (SELECT p.*, least(d, {CAP}) AS depth FROM parents p JOIN placed USING (term_id)),
shelves AS (SELECT term_id AS shelf_id, term_id, lower(regexp_replace(term_id, '^[A-Za-z]+:', '')) AS label, coalesce(parent, '{ROOT}') AS parent, depth + 1 AS depth, direct, with_descendants AS chunk_count FROM tree
  UNION ALL SELECT '{ROOT}', '{ROOT}', 'all', NULL, 0, 0, (SELECT count(DISTINCT chunk_id) FROM W JOIN tree USING (term_id) WHERE parent IS NULL)),
see_also AS (SELECT term_id, shelf_id FROM (SELECT 'P:' || p_partkey AS term_id, 'BT:' || p_brand || '/' || p_type AS shelf_id FROM part WHERE p_size <= {SMALL_PART}) WHERE term_id NOT IN (SELECT term_id FROM shelves) AND shelf_id IN (SELECT shelf_id FROM shelves)),
holder AS (SELECT ancestor, shelf_id, depth FROM (SELECT *, row_number() OVER (PARTITION BY ancestor ORDER BY r, shelf_id) AS k FROM (SELECT term_id AS ancestor, shelf_id, depth, 0 AS r FROM shelves UNION ALL SELECT a.term_id, a.shelf_id, s.depth, 1 FROM see_also a JOIN shelves s ON a.shelf_id = s.shelf_id)) WHERE k = 1),
lifted AS (SELECT term, shelf_id FROM (SELECT a.term, h.shelf_id, row_number() OVER (PARTITION BY a.term ORDER BY h.depth DESC, a.ancestor) AS k FROM anc a JOIN holder h ON a.ancestor = h.ancestor) WHERE k = 1),
resolved AS (SELECT i.chunk_id, i.term_id, coalesce(s.shelf_id, a.shelf_id, l.shelf_id, '{ROOT}') AS shelf_id, CASE WHEN s.shelf_id IS NOT NULL THEN 'direct' WHEN a.shelf_id IS NOT NULL THEN 'collapsed' WHEN l.shelf_id IS NOT NULL THEN 'lifted' ELSE 'orphan' END AS mode
  FROM (SELECT DISTINCT chunk_id, term_id FROM links) i LEFT JOIN shelves s ON s.term_id = i.term_id LEFT JOIN (SELECT term_id, max(shelf_id) AS shelf_id FROM see_also GROUP BY term_id) a ON a.term_id = i.term_id LEFT JOIN lifted l ON l.term = i.term_id)
"""
