"""The pipeline's stages against their operators' definitions, on a small table."""

import pytest

import corpus_pipeline
from loomgraph.llm import jaccard, lines

from .test_operators import SCHEMA, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, corpus()[30][1])], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES, strict=True)
    assert len(names) == 5
    kept = functions[0](spark, docs, folder)
    assert kept.columns == docs.columns
    texts = {r.text for r in kept.collect()}
    assert None not in texts and "" not in texts and "One" in texts
    shorter = functions[1](spark, kept, folder)
    assert shorter.columns == docs.columns and shorter.count() == kept.count()
    assert shorter.exceptAll(lines.without_common_lines(kept)).count() == 0
    one = functions[2](spark, shorter, folder)
    groups = jaccard.similar_groups(shorter)
    assert one.columns == docs.columns
    assert one.select("doc_id").distinct().exceptAll(groups.select("component_id").distinct()).count() == 0
    clean = functions[3](spark, one, folder)
    assert clean.columns == docs.columns and 0 < clean.count() < one.count()
    assert clean.where("doc_id = 30").count() == 0
    mix = functions[4](spark, clean, folder)
    assert mix.count() == clean.count()


def test_run_is_repeatable(spark, folder):
    a, b = corpus_pipeline.run(spark, folder), corpus_pipeline.run(spark, folder)
    assert a.count() > 0 and a.exceptAll(b).count() == 0
