"""The phases as one run: annotate, shelves, attach, themes, cards, audits.

``Graph`` holds named frames; every phase writes its tables once under a folder and hands
on scans, so a lost executor repeats one stage, and a later phase can start from disk.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attach, cards, community, graphs, navigation, ontology, projection, quality, support, themes


@dataclass(frozen=True)
class BuildConfig:
    floor: float = 0.70
    prune: projection.PruneConfig = field(default_factory=projection.PruneConfig)
    root_id: str = "facet:all"
    min_chunks: int = 50
    knn_k: int = 15
    edge_threshold: float = 0.55
    tau: float = 0.80
    min_shared: int = 2
    max_df: float = 0.40
    resolution: float = 1.0
    min_community: int = 15
    merge_at: float = 0.70
    #: Facets by entity type and by id prefix; without any there is one facet, that of ``root_id``.
    by_type: dict = field(default_factory=dict)
    by_prefix: dict = field(default_factory=dict)
    home_prefix: str = "\0"
    home_facet: str = ""
    #: Facets built as a backbone below a root term (None: below what has no supported ancestor).
    backbones: dict = field(default_factory=dict)
    collapse: bool = False
    summariser: str = "lexrank"
    sentences: int = 8


def config_hash(config: BuildConfig) -> str:
    """First 16 hex digits of SHA-256 over the configuration as sorted JSON."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True).encode()).hexdigest()[:16]


class Graph:
    """Named tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str, config: BuildConfig | None = None):
        self.spark, self.folder, self.config = spark, folder.rstrip("/"), config or BuildConfig()

    def put(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        return self.table(name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def annotate(self, chunks: DataFrame, linker: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``linker`` maps chunks to links(chunk_id, term_id, surface, entity_type, confidence)."""
        self.put("chunks", chunks)
        return self.put("links", linker(chunks))

    def ontology(self, is_a: DataFrame) -> None:
        self.put("is_a", is_a)
        self.put("anc", ontology.closure(self.table("is_a")))
        self.put("depth", ontology.depths(self.table("is_a")))

    def layer_a(self) -> DataFrame:
        """Support once, then per facet its shelves: a backbone below its root term, or a pruned tree; facets without support give none."""
        c = self.config
        routed = self.put("routed", support.route(self.table("links"), c.by_type, c.by_prefix, c.home_prefix, c.home_facet) if c.by_type or c.by_prefix else self.table("links").withColumn("facet", F.lit(c.root_id.removeprefix("facet:"))))
        out = None
        for row in routed.where("facet is not null").select("facet").distinct().orderBy("facet").collect():  # as many as facets
            part = self._facet(row.facet, routed.where(F.col("facet") == row.facet))
            out = part if out is None else out.unionByName(part)
        empty = self.spark.createDataFrame([], "shelf_id string, term_id string, label string, parent string, depth int, direct long, chunk_count long, see_also array<string>, facet string")
        return self.put("shelves", empty if out is None else empty.unionByName(out))

    def _facet(self, facet: str, links: DataFrame) -> DataFrame:
        c, anc = self.config, self.table("anc")
        root_id = c.root_id if facet == c.root_id.removeprefix("facet:") else f"facet:{facet}"
        direct = self.put(f"direct/{facet}", support.direct_pairs(support.above_floor(links, c.floor)))
        table = self.put(f"support/{facet}", support.support(direct, anc))
        if facet in c.backbones:
            placed = projection.backbone_shelves(self.table("is_a"), table, c.prune.min_support, c.prune.max_depth, c.backbones[facet], c.prune.blacklist)
            tree = table.join(placed, "term_id").select(*table.columns, "parent", "depth", "see_also")
        else:
            kept = projection.survivors(table, c.prune)
            tree = projection.projected_depths(projection.nearest_parents(kept, anc, self.table("depth"), c.prune.max_depth), c.prune.max_depth).withColumn("see_also", F.array().cast("array<string>"))
            if c.collapse:
                flat = projection.collapsed(tree)
                tree = tree.drop("parent", "depth", "see_also").join(flat, "term_id")
        tree = self.put(f"tree/{facet}", tree)
        also = tree.select("term_id", "see_also")
        rooted = projection.with_single_root(tree.drop("see_also"), support.one_below(direct, anc, tree.where("parent is null")), root_id).join(also, "term_id", "left")
        return rooted.select(F.col("term_id").alias("shelf_id"), "term_id", F.col("term_id").alias("label"), "parent", F.col("depth").cast("int").alias("depth"), F.col("direct").cast("long").alias("direct"), F.col("with_descendants").cast("long").alias("chunk_count"), F.coalesce("see_also", F.array().cast("array<string>")).alias("see_also"), F.lit(facet).alias("facet"))

    def attach(self) -> DataFrame:
        shelves = self.table("shelves")
        listed = shelves.select(F.explode("see_also").alias("term_id"), "shelf_id")
        root = self.config.root_id if not shelves.where(F.col("shelf_id") == self.config.root_id).isEmpty() else None
        resolved = attach.resolve(self.table("links"), shelves.select("shelf_id", "term_id", "depth"), listed, self.table("anc"), root)
        return self.put("shelf_edges", attach.edges(resolved))

    def layer_b(self, vectors: DataFrame) -> DataFrame:
        """Themes: communities of the similarity graph and, per shelf with chunks enough, of the co-occurrence graph, merged one to one.

        Both graphs are cut by shelf (similarity edges run within a shelf too), so that a
        community search sees one shelf's graph at a time. Merging weighs chunks and entities.
        """
        c = self.config
        attached = self.table("shelf_edges").select("shelf_id", "chunk_id")
        roots = self.table("shelves").where("parent is null and shelf_id like 'facet:%'").select("shelf_id")
        fit = self.put("eligible", themes.eligible_shelves(attached.join(roots, "shelf_id", "left_anti"), c.min_chunks, c.root_id))
        inside = attached.join(fit.select("shelf_id"), "shelf_id", "left_semi").distinct()
        a, b = inside.select("shelf_id", F.col("chunk_id").cast("long").alias("a")), inside.select("shelf_id", F.col("chunk_id").cast("long").alias("b"))

        def within(edges: DataFrame) -> DataFrame:
            return edges.join(a, "a").join(b, ["shelf_id", "b"]).select("shelf_id", "a", "b", "weight")

        sim = graphs.knn_edges(vectors, c.knn_k, c.edge_threshold).select("a", "b", "weight")
        rel = graphs.cooccurrence_edges(self.table("links"), c.tau, c.min_shared, c.max_df).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "weight")
        name = F.concat("kind", F.lit("|"), "shelf_id")
        both = within(sim).withColumn("kind", F.lit("sim")).unionByName(within(rel).withColumn("kind", F.lit("rel")))
        self.put("edges", both.select(name.alias("shelf_id"), "a", "b", "weight"))
        found = self.put("communities", community.communities(self.table("edges"), c.resolution, min_size=c.min_community))
        key = F.concat("shelf_id", F.lit("#"), F.col("community").cast("string"))
        side = lambda kind, k: found.where(F.startswith("shelf_id", F.lit(f"{kind}|"))).select(key.alias(k), F.substring_index("shelf_id", "|", -1).alias("shelf_id"), F.col("node").alias("member"))
        s, r = side("sim", "i"), side("rel", "j")
        links = self.table("links").where(F.col("confidence") >= c.tau).select(F.col("chunk_id").cast("long").alias("member"), "term_id").distinct()
        terms = lambda df, k: df.join(links, "member").select(k, F.col("term_id").alias("member"))
        decisions = self.put("merge_decisions", themes.merge_scores(themes.overlap(s, r), themes.overlap(terms(s, "i"), terms(r, "j"))))
        pairs = themes.greedy_pairs([(x.i, x.j, x.score) for x in decisions.where(F.col("score") >= c.merge_at).toLocalIterator()], c.merge_at)
        merged = self.spark.createDataFrame([(i, j) for i, j, _ in pairs], "i string, j string")
        from_sim = s.join(merged, "i", "left").select(F.col("i").alias("key"), F.when(F.col("j").isNotNull(), "merged").otherwise("global_similarity").alias("pass"), "shelf_id", F.col("member").alias("chunk_id"))
        from_rel = r.join(merged, "j", "left").select(F.coalesce("i", "j").alias("key"), F.when(F.col("i").isNotNull(), "merged").otherwise("relatedness").alias("pass"), "shelf_id", F.col("member").alias("chunk_id"))
        members = self.put("theme_members_raw", from_sim.unionByName(from_rel).distinct())
        words = themes.keywords(members.join(self.table("chunks").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text"), "chunk_id").select(F.col("key").alias("theme_id"), "text").distinct(), top=3)
        first = members.groupBy("key").agg(F.min("shelf_id").alias("shelf_id"), F.min("pass").alias("pass"), F.array_sort(F.collect_set("shelf_id")).alias("shelf_ids"))
        labels = navigation.labels_or_keywords(first.withColumnRenamed("key", "theme_id"), self.spark.createDataFrame([], "theme_id string, name string"), words).withColumnRenamed("theme_id", "key")
        named = self.put("themes", themes.theme_ids(first.join(labels, "key"), c.root_id.removeprefix("facet:")).select("key", "theme_id", "label", "pass", "shelf_ids"))
        return self.put("theme_members", members.join(named.select("key", "theme_id"), "key").select("theme_id", "pass", "chunk_id").distinct())

    def layer_c(self) -> DataFrame:
        m = self.table("theme_members").join(self.table("chunks").select("chunk_id", "text"), "chunk_id").select("theme_id", "chunk_id", "text")
        words = themes.keywords(m, top=3)
        labels = words.groupBy("theme_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x.term), " ").alias("label"))
        summaries = cards.summaries(m, self.config.summariser, self.config.sentences)
        return self.put("cards", cards.cards(summaries, m, labels))

    def audit(self) -> DataFrame:
        shelves, edges = self.table("shelves"), self.table("shelf_edges")
        anc = ontology.closure(shelves.where("parent is not null").select(F.col("shelf_id").alias("child"), "parent"))
        checks = [
            ("attached", quality.coverage(self.table("links"), edges), F.col("share") >= 0.95, "critical"),
            ("dangling", quality.structure(shelves, anc), F.col("dangling") == 0, "critical"),
            ("cycles", quality.structure(shelves, anc), F.col("cycles") == 0, "critical"),
            ("one_root", shelves.where("parent is null").groupBy("facet").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")), F.col("n") <= 1, "warning"),
            ("themes", quality.audit_themes(self.table("themes"), self.table("theme_members"), self.table("theme_members")), F.col("passed"), "critical"),
        ]
        return self.put("audit", quality.report(checks))

    def build(self, chunks: DataFrame, is_a: DataFrame, linker: Callable[[DataFrame], DataFrame], vectors: DataFrame) -> DataFrame:
        """All phases in order; returns the audit's checks. One row per phase goes to ``artifacts``."""
        steps = [("annotate", lambda: self.annotate(chunks, linker)), ("ontology", lambda: self.ontology(is_a)), ("layer_a", self.layer_a), ("attach", self.attach), ("layer_b", lambda: self.layer_b(vectors)), ("layer_c", self.layer_c), ("audit", self.audit)]
        log = []
        for phase, step in steps:
            out = step()
            log.append((phase, config_hash(self.config), out.count() if out is not None else None))
        self.put("artifacts", self.spark.createDataFrame(log, "phase string, config_hash string, record_count long").withColumn("created_at", F.current_timestamp()))
        return self.table("audit")
