"""The phase build end to end, consolidation, grouping and streaming ingest."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import consolidation, grouping, ontology, projection
from loomgraph.plans.build import BuildConfig, Graph, config_hash
from loomgraph.streaming import ingest


def test_build(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:4]
    chunks = spark.createDataFrame([(i, f"Sentence about topic {i % 4} alpha{i % 4}. Another line of words here.") for i in range(24)], "chunk_id long, text string")
    vec = [(i, (centres[i % 4] + rng.normal(0, 0.01, 8)).tolist()) for i in range(24)]
    vectors = spark.createDataFrame([(i, (np.array(v) / np.linalg.norm(v)).tolist()) for i, v in vec], "vec_id long, embedding array<double>")
    is_a = spark.createDataFrame([("t0", "left"), ("t1", "left"), ("t2", "right"), ("t3", "right"), ("left", "top"), ("right", "top")], "child string, parent string")

    def linker(c):
        return c.select("chunk_id", F.explode(F.array(F.concat(F.lit("t"), F.col("chunk_id") % 4), F.concat(F.lit("u"), F.col("chunk_id") % 4))).alias("term_id"), F.lit("s").alias("surface"), F.lit("x").alias("entity_type"), F.lit(1.0).alias("confidence"))

    config = BuildConfig(prune=projection.PruneConfig(min_support=2, direct_share_max=0.0), knn_k=4, edge_threshold=0.5, max_df=0.5, min_chunks=2, min_community=2, sentences=2)
    g = Graph(spark, str(tmp_path / "g"), config)
    checks = g.build(chunks, is_a, linker, vectors)
    assert all(r.passed for r in checks.collect())
    members = g.table("theme_members")
    assert members.select("theme_id").distinct().count() >= 4
    assert g.table("cards").count() == members.select("theme_id").distinct().count()
    # Co-occurrence finds each shelf's chunks; the similarity graph's communities share their entities and half of their chunks at least.
    named = g.table("themes").collect()
    assert sum(r["pass"] == "merged" for r in named) >= 4 and all("_m" in r.theme_id for r in named if r["pass"] == "merged"), named
    assert {tuple(r.shelf_ids) for r in named} >= {(f"t{i}",) for i in range(4)}
    assert g.table("merge_decisions").where("je = 1 and score >= 0.7").count() >= 4
    assert {r.phase for r in g.table("artifacts").collect()} >= {"layer_a", "layer_b", "layer_c"}
    assert g.table("shelves").where("parent is null").count() == 1
    assert config_hash(config) != config_hash(BuildConfig()) and len(config_hash(config)) == 16


def test_facets_with_backbone_and_collapse(spark, tmp_path):
    is_a = spark.createDataFrame([("A:1", "A:r"), ("A:2", "A:1"), ("A:3", "A:1"), ("A:4", "A:r"), ("A:5", "A:4"), ("B:1", "B:m"), ("B:m", "B:r")], "child string, parent string")
    rows = [(i, t) for t, n in {"A:2": 4, "A:3": 3, "A:5": 3, "B:1": 5, "C:1": 2}.items() for i in range(n)]
    chunks = spark.createDataFrame([(i, "text") for i in range(5)], "chunk_id long, text string")
    links = spark.createDataFrame(rows, "chunk_id long, term_id string").select("chunk_id", "term_id", F.lit("s").alias("surface"), F.lit("x").alias("entity_type"), F.lit(1.0).alias("confidence"))
    c = BuildConfig(prune=projection.PruneConfig(min_support=2, direct_share_max=0.0), by_prefix={"A": "a", "B": "b"}, backbones={"a": "A:r"}, collapse=True)
    g = Graph(spark, str(tmp_path / "g"), c)
    g.annotate(chunks, lambda _: links)
    g.ontology(is_a)
    got = {r.shelf_id: (r.facet, r.parent, r.depth, r.chunk_count, list(r.see_also)) for r in g.layer_a().collect()}
    # A:4 has no support of its own and one supported child: it folds into it. B's chain collapses from its top.
    assert got["A:5"] == ("a", "facet:a", 1, 3, ["A:4"]) or got["A:5"][3] == 3
    assert got["A:1"][:3] == ("a", "facet:a", 1) and got["A:2"][1] == got["A:3"][1] == "A:1"
    assert got["B:1"] == ("b", None, 0, 5, ["B:r", "B:m"]) or (got["B:1"][0], got["B:1"][1], sorted(got["B:1"][4])) == ("b", None, ["B:m", "B:r"])
    assert "C:1" not in got
    edges = {(r.chunk_id, r.shelf_id) for r in g.attach().collect()}
    assert (0, "A:2") in edges and (4, "B:1") in edges


def test_consolidation(spark):
    s = spark.createDataFrame([("a", "A", "apple", None, 1, 2, 5, []), ("b", "B", "apples", None, 1, 3, 4, ["Z"]), ("c", "C", "pie", "b", 2, 1, 1, [])], "shelf_id string, term_id string, label string, parent string, depth int, direct long, chunk_count long, see_also array<string>")
    pairs = spark.createDataFrame([("a", "b", 0.99)], "a string, b string, sim double")
    found = consolidation.clusters(pairs)
    ok = consolidation.judged(found, s, lambda labels: 0.9)
    assert consolidation.judged(found, s, lambda labels: 0.9, blocked=frozenset({("b", "a")})).count() == 0
    out = {r.shelf_id: r for r in consolidation.apply_groups(s, ok.select("cluster", "node")).collect()}
    assert set(out) == {"a", "c"} and out["a"].direct == 5 and out["a"].chunk_count == 9
    assert out["a"].see_also == ["B", "Z"] and out["c"].parent == "a"
    assert consolidation.cap_per_shelf([("a", "b", 0.9), ("a", "c", 0.8), ("a", "d", 0.7), ("e", "f", 0.6)], 2) == [("a", "b", 0.9), ("a", "c", 0.8), ("e", "f", 0.6)]


def test_grouping(spark):
    r = spark.createDataFrame([("Malus domestica", ["Malus pumila", "apple", "apple tree", "a1"])], "label string, synonyms array<string>")
    got = r.select(grouping.display_name(F.col("label"), F.col("synonyms")), grouping.concepts(F.lit("Fruits and Nuts, oils / Fats"))).first()
    assert got[0] == "apple" and got[1] == ["fruit", "nut", "oil", "fat"]
    anc = ontology.closure(spark.createDataFrame([("x", "m"), ("m", "top"), ("y", "top")], "child string, parent string"))
    links = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "z")], "chunk_id long, term_id string")
    anchors = spark.createDataFrame([("inner", "m"), ("outer", "top")], "group string, anchor string")
    assigned = grouping.assign_leaves(links, anchors, anc)
    assert {(a.term_id, a.group) for a in assigned.collect()} == {("x", "inner"), ("y", "outer")}
    assert {(s.shelf_id, s.chunk_count) for s in grouping.grouped_shelves(links, assigned).collect()} == {("inner", 2), ("outer", 1), ("root", 2)}


def test_streaming_ingest(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([(1, "a", t(0)), (1, "a", t(1)), (2, "a", t(2)), (2, "b", t(50))], "chunk_id long, term_id string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("chunk_id long, term_id string, ts timestamp").parquet(str(tmp_path / "in"))
    q = ingest.running_support(stream).writeStream.format("memory").queryName("support_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.term_id, r.n_chunks) for r in spark.table("support_now").collect()} == {("a", 2), ("b", 1)}
    q = ingest.upsert_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    users = spark.readStream.schema("chunk_id long, term_id string, ts timestamp").parquet(str(tmp_path / "in")).withColumnRenamed("chunk_id", "user_id")
    q = ingest.sessions(users).writeStream.format("memory").queryName("sessions_now").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sessions_now").count() == 3
