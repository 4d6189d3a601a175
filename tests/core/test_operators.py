"""Operators against hand-made fixtures and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as fx
from loomgraph.operators import attach, cards, community, evaluation, graphs, ontology, projection, quality, retrieval, support, themes, views
from loomgraph.sources import chunks, nel, obo, sinks

TREE = [("plant", "product"), ("animal", "product"), ("fruit", "plant"), ("vegetable", "plant"), ("nut", "plant"), ("apple", "fruit"), ("olive", "fruit"), ("oil", "olive"), ("dairy", "animal")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(TREE, "child string, parent string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_closure_and_depths(edges):
    up = {c: p for c, p in TREE}
    expect = []
    for t in up:
        x = t
        while x in up:
            x = up[x]
            expect.append((t, x))
    assert rows(ontology.closure(edges)) == sorted(expect)
    assert dict(rows(ontology.depths(edges)))["oil"] == 4


def test_closure_ends_on_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert rows(ontology.closure(e)) == [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")]


def test_support_counts_each_chunk_once(spark, edges):
    links = spark.createDataFrame([(1, "apple"), (1, "apple"), (2, "apple"), (1, "oil"), (3, "oil"), (4, "oil")], "chunk_id long, term_id string")
    s = {r[0]: r[1:] for r in rows(support.support(support.direct_pairs(links), ontology.closure(edges)))}
    assert s["apple"] == (2, 2) and s["olive"] == (0, 3) and s["fruit"] == (0, 4) and s["product"] == (0, 4)


def test_backbone_folds_filing_tiers():
    kids = {}
    for c, p in TREE:
        kids.setdefault(p, []).append(c)
    direct, wide = {"apple": 2, "oil": 3}, {"apple": 2, "oil": 3, "olive": 3, "fruit": 5, "plant": 5, "product": 5}
    got = {r["term_id"]: r for r in projection.backbone(kids, direct, wide, 1, 5, root="product")}
    assert set(got) == {"plant", "fruit", "apple", "oil"}
    assert got["oil"]["parent"] == "fruit" and got["oil"]["see_also"] == ["olive"] and got["oil"]["status"] == "folded"
    assert got["fruit"]["depth"] == 1


def test_single_child_collapse():
    got = projection.collapse_single_children([{"term_id": "a", "parent": None, "depth": 0}, {"term_id": "b", "parent": "a", "depth": 1}, {"term_id": "c", "parent": "b", "depth": 2}, {"term_id": "d", "parent": "b", "depth": 2}])
    assert [(r["term_id"], r["parent"], r["depth"]) for r in got] == [("b", None, 0), ("c", "b", 2), ("d", "b", 2)]
    assert got[0]["see_also"] == ["a"]


def test_rehome(spark):
    s = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "c")], "term_id string, parent string")
    doomed = spark.createDataFrame([("b",), ("c",)], "term_id string")
    assert rows(projection.merge_tiers(s, doomed).where("parent is not null")) == [("d", "a")]


def test_attach_cascade(spark, edges):
    ids = spark.createDataFrame([(1, "apple"), (1, "olive"), (2, "oil"), (3, "dairy"), (4, "nut")], "chunk_id long, term_id string")
    shelves = spark.createDataFrame([("s:apple", "apple", 2), ("s:plant", "plant", 1)], "shelf_id string, term_id string, depth int")
    see = spark.createDataFrame([("olive", "s:apple")], "term_id string, shelf_id string")
    got = {(r.chunk_id, r.term_id): (r.shelf_id, r.mode) for r in attach.resolve(ids, shelves, see, ontology.closure(edges), "root").collect()}
    assert got == {(1, "apple"): ("s:apple", "direct"), (1, "olive"): ("s:apple", "collapsed"), (2, "oil"): ("s:apple", "lifted"), (3, "dairy"): ("root", "orphan"), (4, "nut"): ("s:plant", "lifted")}


def test_cooccurrence(spark):
    links = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("c", "1"), ("c", "3")], "chunk_id string, term_id string").withColumn("confidence", F.lit(1.0))
    got = graphs.cooccurrence_edges(links, 0.5, 2, 1.0).collect()
    assert [(r.a, r.b, r.shared) for r in got] == [("a", "b", 2)]
    assert got[0].weight == pytest.approx(1 / np.log(4) + 1 / np.log(3))


def test_components_and_caps(spark):
    rng = random.Random(1)
    es = {(a, b) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(45))}
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in es:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    nodes = {x for e in es for x in e}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in es], "a long, b long, weight double")
    assert rows(graphs.components(df)) == sorted((x, find(x)) for x in nodes)
    assert all(len(c) <= 4 for c in graphs.split_to_cap([(a, b, rng.random()) for a, b in es], 4))


def test_leiden_beats_trivial_partitions():
    es = []
    for k in range(4):
        es += [(10 * k + i, 10 * k + j, 1.0) for i, j in itertools.combinations(range(8), 2)]
    es += [(10 * k, 10 * ((k + 1) % 4), 0.5) for k in range(4)]
    found = community.leiden(es)
    assert len({found[x] for x in found}) == 4
    assert all(len({found[10 * k + i] for i in range(8)}) == 1 for k in range(4))
    assert community.leiden([]) == {}
    assert community.modularity(es, found) > 0.6


def test_merge():
    sim = {"s": ({1, 2, 3, 4}, set())}
    rel = {"x": ({1, 2}, {"e"}), "y": ({1, 2, 3}, {"e"})}
    kinds = [(t["pass"], len(t["chunks"])) for t in themes.merge_candidates(sim, rel, threshold=0.4)]
    assert kinds == [("merged", 4), ("relatedness", 2)]


def test_summarisers_and_cards(spark):
    lines = ["Olive oil is pressed from olives.", "Apples grow on trees in the orchard.", "Olive oil keeps well.", "It rains."]
    for name, score in cards.SUMMARISERS.items():
        s = score(lines)
        assert len(s) == 4 and np.isfinite(s).all(), name
        assert cards.pick(lines, s, 9) == " ".join(lines)
    m = spark.createDataFrame([("t", 1, " ".join(lines)), ("t", 2, " ".join(lines[:2])), ("u", 3, "One sentence.")], "theme_id string, chunk_id long, text string")
    got = {r.theme_id: r for r in cards.summaries(m, "textrank", n=2, limit=3, budget=60).collect()}
    assert got["t"].strategy == "map_reduce" and got["u"].summary == "One sentence."
    made = cards.cards(cards.summaries(m, n=2), m, m.select("theme_id", F.col("theme_id").alias("label")).distinct()).collect()
    assert sorted(r.card_id for r in made) == ["card:theme:t", "card:theme:u"]


def test_findability_nearest_rank(spark):
    d = [1, 1, 2, 3, 3, 5, None, 9]
    got = evaluation.findability(spark.createDataFrame([(i, x) for i, x in enumerate(d)], "query long, depth int")).first()
    known = sorted(x for x in d if x is not None)
    assert got.p90_clicks == known[round(0.9 * (len(known) - 1))]
    assert got.share_reachable == 7 / 8


def test_lsh_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16))
    x = x[:100].repeat(2, 0) + 0.05 * rng.standard_normal((200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    near = {(r.query_id, r.neighbour_id) for r in graphs.knn(v, v, 1).collect()}
    found = {(r.query_id, r.neighbour_id) for r in graphs.lsh_knn(v, 1).collect()}
    assert len(near & found) / len(near) > 0.9


def test_empty_tables(spark, edges):
    none = edges.limit(0)
    assert ontology.closure(none).count() == 0 and ontology.depths(none).count() == 0
    links = spark.createDataFrame([], "chunk_id long, term_id string, confidence double")
    assert graphs.cooccurrence_edges(links, 0.5, 1, 1.0).count() == 0
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert graphs.knn(v, v, 3).count() == 0
    assert quality.parity(links, links, "chunk_id").first().ratio == 1.0


def test_csv_corpus(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('chunk_id,chunk_text,type,chunk_metadata\nx1,"two\nlines, ""quoted""",Abstract,"{\'DOI\': \'10/1\', \'year\': 2011}"\nx2,text,guide,"{\'file\': \'f.pdf\', \'year\': \'2016\'}"\nx3,text,textbook,"{broken"\n')
    got = {r.chunk_id: r for r in chunks.read_chunks(spark, str(p), strict=False).collect()}
    assert set(got) == {"x1", "x2"}
    assert got["x1"].text == 'two\nlines, "quoted"' and got["x1"].source_doc_id == "10/1" and got["x1"].year == 2011
    assert got["x2"].section_type == "guideline" and got["x2"].source_doc_id == "f.pdf" and got["x2"].year == 2016
    with pytest.raises(Exception, match="x3"):
        chunks.read_chunks(spark, str(p)).collect()
    with pytest.raises(FileNotFoundError):
        chunks.read_chunks(spark, str(tmp_path / "none.csv"))
    assert chunks.read_chunks(spark, str(tmp_path), strict=False).count() == 2


def test_nel_alignment(spark, tmp_path):
    (tmp_path / "a.csv").write_text("chunk_id,chunk_entities_ner,chunk_uri_nel\nc1,old,u\nc2,a; ;b,http://purl.obolibrary.org/obo/FOODON_1;x\n")
    (tmp_path / "b.csv").write_text("chunk_id,chunk_entities_ner,chunk_uri_nel\nc1,apple;pear,;http://purl.obolibrary.org/obo/NCBITaxon_7\n")
    (tmp_path / "c.csv").write_text("id,other\n1,2\n")
    got = rows(nel.mentions(nel.read_dir(spark, str(tmp_path))).select("chunk_id", "surface", F.coalesce("term_id", F.lit("-"))))
    assert got == [("c1", "apple", "-"), ("c1", "pear", "http://purl.obolibrary.org/obo/NCBITaxon_7"), ("c2", "a", "FOODON:1")]


def test_obo(spark, tmp_path):
    p = tmp_path / "x.obo"
    p.write_text('format-version: 1.2\n\n[Term]\nid: M:1\nname: product\n\n[Term]\nid: M:2\nname: plant product\nsynonym: "herb" EXACT []\nsynonym: "weed" RELATED []\nis_a: M:1 ! product\nrelationship: RO:1 N:9 ! other\n\n[Term]\nid: M:3\nname: gone\nis_obsolete: true\n\n[Typedef]\nid: RO:1\nname: derives\n')
    t = {r.id: r for r in obo.terms(spark, str(p)).collect()}
    assert set(t) == {"M:1", "M:2", "M:3"} and t["M:2"].synonyms == ["herb"] and t["M:2"].related_synonyms == ["weed"] and t["M:3"].obsolete
    assert rows(obo.is_a(obo.terms(spark, str(p)))) == [("M:2", "M:1")]
    assert rows(obo.relations(spark, str(p), "M", ("N",))) == [("M:2", "RO:1", "N:9")]


def test_sinks(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id long, v string, n int")
    assert rows(sinks.upsert(base, new, "id", "n")) == [(1, "a"), (2, "y"), (3, "z")]
    chunks_ = base.select(F.col("id").alias("chunk_id"), "v")
    with pytest.raises(KeyError):
        sinks.merge_annotations(chunks_, spark.createDataFrame([(9, "q")], "chunk_id long, v string"), strict=True)


def test_scalars(spark):
    df = spark.createDataFrame([("Abc  d-E", "http://purl.obolibrary.org/obo/FOODON_0012")], "a string, u string")
    r = df.select(fx.normalise(F.col("a")), fx.shorten_uri(F.col("u")), fx.slug(F.lit("!!")), fx.snippet(F.lit("a  b c d e"), 5), fx.hash_embedding(F.lit("x"), 40)).first()
    assert r[0] == "abc d e" and r[1] == "FOODON:0012" and r[2] == "unlabeled" and r[3] == "a b…" and r[4][0] == r[4][32]


def test_graphml(spark, tmp_path):
    s = spark.createDataFrame([("a", None, "A & B"), ("b", "a", "b")], "shelf_id string, parent string, label string")
    th = spark.createDataFrame([("t", "T", ["b"])], "theme_id string, label string, shelf_ids array<string>")
    cd = spark.createDataFrame([("c", "t", "C")], "card_id string, target_id string, title string")
    views.graphml(views.nodes(s, th, cd), views.edges(s, th, cd), str(tmp_path / "g.xml"))
    import xml.etree.ElementTree as ET

    root = ET.parse(tmp_path / "g.xml").getroot()
    assert len(root.findall(".//{*}node")) == 4 and len(root.findall(".//{*}edge")) == 3


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0), (2, 1)], "id long, rank int")
    b = spark.createDataFrame([(2, 0), (3, 1)], "id long, rank int")
    assert [r.id for r in retrieval.rrf([a, b], 3).orderBy("rank").collect()] == [2, 1, 3]


def test_hierarchies_of_any_depth_and_size(spark, monkeypatch):
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i - 1:03}") for i in range(1, 90)] + [("x", "y"), ("y", "x"), (None, "n000")], "child string, parent string")
    some = spark.createDataFrame([("a", "b"), ("b", "r"), ("a", "r"), ("x", "y"), ("y", "x")], "child string, parent string")
    for small in (ontology.SMALL, 0):
        monkeypatch.setattr(ontology, "SMALL", small)
        assert {(r.term, r.ancestor) for r in ontology.closure(some).collect()} == {("a", "b"), ("a", "r"), ("b", "r"), ("x", "y"), ("x", "x"), ("y", "x"), ("y", "y")}
        assert {r.term: r.depth for r in ontology.depths(some).collect()} == {"r": 0, "b": 1, "a": 1}
        assert ontology.closure(some.limit(0)).count() == 0 and ontology.depths(some.limit(0)).count() == 0
    monkeypatch.setattr(ontology, "SMALL", 10**6)
    assert {r.term: r.depth for r in ontology.depths(chain).collect()} == {f"n{i:03}": i for i in range(90)}


def test_missing_vectors_are_skipped(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, None), (4, [])], "vec_id long, embedding array<double>")
    assert {(r.query_id, r.neighbour_id) for r in graphs.knn(v, v, 2).collect()} == {(1, 2), (2, 1)}
    assert graphs.lsh_knn(v.limit(0), 2).count() == 0 and graphs.knn(v.limit(0), v, 2).count() == 0


def test_hybrid_search_by_seed_and_vector(spark):
    c = spark.createDataFrame([(1, "red fox"), (2, "red red fox"), (3, "blue"), (4, None)], "chunk_id long, text string")
    v = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.9, 0.1])], "chunk_id long, embedding array<double>")
    assert [r.id for r in retrieval.hybrid_search(c, v, ["red"], 3).collect()] == [2, 1, 3]
    assert {r.id for r in retrieval.hybrid_search(c, v, ["blue"], 2, [0.0, 1.0]).collect()} == {3, 1}
    assert retrieval.hybrid_search(c, v, ["none"], 3).count() == 0


def test_macro_topics():
    assert evaluation.macro_topics(["b", "a", "d", "c"], [[1, 0], [1, 0.1], [0, 1], [0.1, 1]], 2) == {"a": 0, "b": 0, "c": 1, "d": 1}
    assert evaluation.macro_topics([], [], 2) == {}


def test_stores(spark, tmp_path):
    t = spark.range(5).toDF("chunk_id")
    assert [len(b) for b in chunks.scan(t, 2)] == [2, 2, 1]
    with pytest.raises(ValueError):
        chunks.scan(t, 0)
    shelf = spark.createDataFrame([(1, "s", ["x"])], "chunk_id long, shelf_id string, lifted_from array<string>")
    theme = spark.createDataFrame([(1, "t")], "chunk_id long, theme_id string")
    a, b = sinks.attach(shelf, theme, t.where("chunk_id < 2"), shelf="s")
    assert {(r.chunk_id, len(r.lifted_from)) for r in a.collect()} == {(0, 0), (1, 0)} and b.count() == 1
    assert sinks.attach(shelf, theme, t.where("chunk_id < 2"), theme="t")[1].count() == 2
    with pytest.raises(ValueError):
        sinks.attach(shelf, theme, t, shelf="s", theme="t")
    source = tmp_path / "terms.txt"
    source.write_text("a")
    made = []

    def build(path):
        made.append(path)
        return spark.createDataFrame([(source.read_text(),)], "x string")

    for text in ("a", "a", "bb"):
        source.write_text(text) if source.read_text() != text else None
        assert chunks.cached(spark, f"file://{source}", f"file://{tmp_path}/cache", build).first().x == text
    assert len(made) == 2
    with pytest.raises(FileNotFoundError):
        chunks.read_chunks(spark, str(tmp_path / "no.parquet"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        chunks.read_chunks(spark, str(tmp_path / "empty"))
    sinks.write_report(t, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").count() == 5


def test_embeddings_are_filled_where_missing(spark):
    c = spark.createDataFrame([(1, "a", [1.0]), (2, "b", None), (3, "c", [])], "chunk_id long, text string, embedding array<double>")
    code = F.array(F.length("text").cast("double") + 6)
    assert [r.embedding for r in chunks.embed(c, code).orderBy("chunk_id").collect()] == [[1.0], [7.0], [7.0]]
    assert [r.embedding for r in chunks.embed(c, code, only_missing=False).orderBy("chunk_id").collect()] == [[7.0]] * 3


def test_capped_clusters_against_brute_force(spark):
    rng = random.Random(6)
    for _ in range(3):
        edges = [(a, b, round(rng.random(), 3)) for a in range(14) for b in range(a) if rng.random() < 0.2]
        cap, todo, want = 4, [sorted(edges, key=lambda e: (e[2], e[0], e[1]))], []
        while todo:
            es = todo.pop()
            near = {}
            for a, b, _ in es:
                near.setdefault(a, set()).add(b)
                near.setdefault(b, set()).add(a)
            left = set(near)
            while left:
                group, front = set(), [min(left)]
                while front:
                    x = front.pop()
                    if x not in group:
                        group.add(x)
                        front += near[x]
                left -= group
                mine = [e for e in es if e[0] in group]
                want.append(sorted(group)) if len(group) <= cap else todo.append(mine[1:])
        df = spark.createDataFrame(edges, "a long, b long, weight double")
        got = {}
        for r in graphs.capped_clusters(df, cap).collect():
            got.setdefault(r.cluster, []).append(r.node)
        assert sorted(sorted(x) for x in got.values()) == sorted(want)
