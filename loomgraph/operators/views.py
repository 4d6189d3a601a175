"""Graph views as node and edge frames, and GraphML."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(shelves: DataFrame, themes: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, kind, label) of shelves, themes and cards."""
    s = shelves.select(F.col("shelf_id").cast("string").alias("id"), F.lit("shelf").alias("kind"), "label")
    t = themes.select(F.col("theme_id").cast("string").alias("id"), F.lit("theme").alias("kind"), "label")
    c = cards.select(F.col("card_id").alias("id"), F.lit("card").alias("kind"), F.col("title").alias("label"))
    return s.unionByName(t).unionByName(c)


def edges(shelves: DataFrame, themes: DataFrame, cards: DataFrame) -> DataFrame:
    """(source, target, kind): parent_of, has_theme, has_card."""
    p = shelves.where("parent is not null").select(F.col("parent").alias("source"), F.col("shelf_id").alias("target"), F.lit("parent_of").alias("kind"))
    t = themes.select(F.explode("shelf_ids").alias("source"), F.col("theme_id").cast("string").alias("target"), F.lit("has_theme").alias("kind"))
    c = cards.select(F.col("target_id").cast("string").alias("source"), F.col("card_id").alias("target"), F.lit("has_card").alias("kind"))
    return p.unionByName(t).unionByName(c)


def graphml(node_rows: DataFrame, edge_rows: DataFrame, path: str) -> None:
    """Write a graph that people look at (shelves, themes, cards; never chunks) as one GraphML file, row by row."""
    with open(path, "w", encoding="utf-8") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="kind" for="all" attr.name="kind" attr.type="string"/>\n<key id="label" for="node" attr.name="label" attr.type="string"/>\n<graph edgedefault="directed">\n')
        for r in node_rows.orderBy("kind", "id").toLocalIterator():
            out.write(f'<node id={quoteattr(r["id"])}><data key="kind">{escape(r["kind"])}</data><data key="label">{escape(r["label"] or "")}</data></node>\n')
        for r in edge_rows.orderBy("kind", "source", "target").toLocalIterator():
            out.write(f'<edge source={quoteattr(r["source"])} target={quoteattr(r["target"])}><data key="kind">{escape(r["kind"])}</data></edge>\n')
        out.write("</graph>\n</graphml>\n")


def ancestor_chain(shelves: DataFrame, anc: DataFrame) -> DataFrame:
    """Path of each shelf from the root, as one string: ``shelves(shelf_id, depth)``, closure over shelf ids."""
    a = anc.join(shelves.select(F.col("shelf_id").alias("ancestor"), "depth"), "ancestor")
    path = a.groupBy(F.col("term").alias("shelf_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "ancestor"))), lambda x: x.ancestor), ">").alias("path"))
    return shelves.select("shelf_id").join(path, "shelf_id", "left").select("shelf_id", F.coalesce("path", F.lit("")).alias("path"))


def subtree_chunks(anc: DataFrame, shelf_edges: DataFrame) -> DataFrame:
    """Distinct chunks at a shelf or below it: counts per shelf."""
    up = shelf_edges.join(anc, F.col("shelf_id") == F.col("term")).select("chunk_id", F.col("ancestor").alias("shelf_id"))
    return shelf_edges.select("chunk_id", "shelf_id").union(up).distinct().groupBy("shelf_id").agg(F.count("*").alias("n_chunks"))
