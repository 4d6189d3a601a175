"""Keyed writes as snapshots: upserts, field updates, clears, Parquet and JSON sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, updates: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """Rows of ``updates`` replace those of equal key; of several updates the highest version wins."""
    new = updates
    if version is not None:
        rest = [c for c in updates.columns if c not in (key, version)]
        new = updates.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("x")).select(key, *[F.col(f"x.{c}").alias(c) for c in rest])
    return base.join(new.select(key), key, "left_anti").unionByName(new.select(*base.columns))


def update_fields(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace the fields ``updates`` has; keys it doesn't name, and null values, leave a row as it is."""
    fields = [c for c in updates.columns if c != key]
    u = updates.select(key, *[F.col(c).alias(f"__{c}") for c in fields])
    return base.join(u, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns])


def merge_annotations(chunks: DataFrame, annotations: DataFrame, strict: bool = False) -> DataFrame:
    """Replace annotation fields by chunk_id; strict: unknown ids raise KeyError."""
    if strict:
        unknown = annotations.join(chunks.select("chunk_id"), "chunk_id", "left_anti").limit(1).collect()
        if unknown:
            raise KeyError(unknown[0]["chunk_id"])
    ids = [F.array_sort(F.array_distinct(c)).alias(c) if c == "term_ids" else F.col(c) for c in annotations.columns]
    return update_fields(chunks, annotations.select(*ids), "chunk_id")


def clear_layer_a(shelves: DataFrame, edges: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """No shelves, no shelf edges, and cards without those of shelves."""
    return shelves.limit(0), edges.limit(0), cards.where("target_type <> 'shelf'")


def clear_themes(themes: DataFrame, edges: DataFrame, cards: DataFrame, facet: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop a facet's themes (or all) with their edges and cards."""
    doomed = (themes if facet is None else themes.where(F.col("facet") == facet)).select("theme_id")
    kept = cards.join(doomed.withColumnRenamed("theme_id", "target_id").withColumn("target_type", F.lit("theme")), ["target_id", "target_type"], "left_anti")
    return themes.join(doomed, "theme_id", "left_anti"), edges.join(doomed, "theme_id", "left_anti"), kept.select(*cards.columns)


def attach_chunks(shelf_edges: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert (chunk, shelf, lifted_from); returns the edges and each chunk's shelf ids, which always agree."""
    new = added.dropDuplicates(["chunk_id", "shelf_id"])
    edges = shelf_edges.join(new.select("chunk_id", "shelf_id"), ["chunk_id", "shelf_id"], "left_anti").select(*shelf_edges.columns).unionByName(new.select(*shelf_edges.columns))
    return edges, edges.groupBy("chunk_id").agg(F.array_sort(F.collect_set("shelf_id")).alias("shelf_ids"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def cache_misses(wanted: DataFrame, cache: DataFrame, schema_version: str) -> DataFrame:
    """Rows of ``wanted(key, ...)`` without a cached entry of this schema version."""
    return wanted.join(cache.where(F.col("schema_version") == schema_version).select("key"), "key", "left_anti")


def clear_attachments(chunks: DataFrame, shelf_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """No shelf edges, and chunks without shelf and theme ids; theme edges are not touched."""
    fields = [F.array().cast(f.dataType).alias(f.name) if f.name in ("shelf_ids", "theme_ids") else F.col(f.name) for f in chunks.schema]
    return chunks.select(*fields), shelf_edges.limit(0)


def attach_to_themes(theme_edges: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set union of (chunk, theme); further columns of ``added`` replace those of equal pairs. Returns edges and each chunk's theme ids."""
    new = added.dropDuplicates(["chunk_id", "theme_id"])
    edges = theme_edges.join(new.select("chunk_id", "theme_id"), ["chunk_id", "theme_id"], "left_anti").select(*theme_edges.columns).unionByName(new.select(*theme_edges.columns))
    return edges, edges.groupBy("chunk_id").agg(F.array_sort(F.collect_set("theme_id")).alias("theme_ids"))


def attach_to_entities(entity_edges: DataFrame, added: DataFrame) -> DataFrame:
    """(chunk, term, confidence): the stronger link of a pair stays."""
    both = entity_edges.unionByName(added.select(*entity_edges.columns))
    return both.groupBy("chunk_id", "term_id").agg(F.max("confidence").alias("confidence")).select(*entity_edges.columns)


def attach(shelf_edges: DataFrame, theme_edges: DataFrame, chunk_ids: DataFrame, shelf: str | None = None, theme: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Attach chunks by hand to exactly one shelf or theme; returns both edge tables."""
    if (shelf is None) == (theme is None):
        raise ValueError("name exactly one of shelf and theme")
    if shelf is not None:
        added = chunk_ids.select("chunk_id", F.lit(shelf).alias("shelf_id"), F.array().cast("array<string>").alias("lifted_from"))
        return attach_chunks(shelf_edges, added)[0], theme_edges
    added = chunk_ids.select("chunk_id", F.lit(theme).alias("theme_id"))
    return shelf_edges, attach_to_themes(theme_edges, added.select(*theme_edges.columns))[0]


def write_report(report: DataFrame, path: str) -> None:
    """A benchmark or audit as JSON lines."""
    report.write.mode("overwrite").json(path)
