"""Queries against their SQL twins, over the smallest driver tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from loomgraph import catalog
from loomgraph.plans import detail_queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="driver tables are absent")
SOME = ["facet_routing", "link_blocklist", "ontology_depth", "name_lookup", "prune_survivors", "prune_parent", "attach_modes", "build_entities", "cooccurrence_edges", "mutual_knn_edges", "centroid_primary", "theme_keywords", "npmi_coherence", "bm25_search", "tri_hybrid_rrf", "freq_summary", "char_budget_groups", "upsert_last_wins", "nel_zip_align", "findability", "sweep_score", *sorted(detail_queries.ORACLE)]


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return str(v) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_matches_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    expect = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=repr)
    assert got == expect


def test_every_twin_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)
