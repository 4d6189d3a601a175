"""Edge builders and graph operators: co-occurrence, kNN, centroids, components, neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dot
from ..session import Rounds


def document_frequency(pairs: DataFrame) -> DataFrame:
    """Distinct chunks per term."""
    return pairs.select("chunk_id", "term_id").distinct().groupBy("term_id").agg(F.count("*").alias("df"))


def cooccurrence_edges(links: DataFrame, tau: float, min_shared: int, max_df_share: float, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that share at least ``min_shared`` entities; weight is the sum of 1 / ln(1 + df).

    Entities above the document-frequency ceiling are dropped before the self-join, so
    that what joins is bounded; pairs are weighted and counted in one aggregation.
    """
    pairs = links.where(F.col("confidence") >= tau).select("chunk_id", "term_id").distinct()
    n = pairs.agg(F.count_distinct("chunk_id").alias("n_chunks"))
    df = document_frequency(pairs)
    kept = df.crossJoin(F.broadcast(n)).where(F.col("df") / F.col("n_chunks") <= max_df_share)
    if exclude:
        kept = kept.where(~F.col("term_id").isin(*exclude))
    p = pairs.join(kept.select("term_id", "df"), "term_id")
    a, b = p.select("term_id", "df", F.col("chunk_id").alias("a")), p.select("term_id", F.col("chunk_id").alias("b"))
    return a.join(b, "term_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(1 / F.log(1 + F.col("df"))).alias("weight")).where(F.col("shared") >= min_shared)


#: Blocks that a table of vectors is cut into (fewer where they would hold less than LEAST rows). Their number is fixed, so
#: that copies grow with the rows alone; only beyond MOST rows to a block there are more blocks.
BLOCKS, LEAST, MOST = 24, 256, 131_072
#: Rows of either side that meet in one matrix product.
SLICE = 1024


def _blocks(n: int) -> int:
    return max(1, min(BLOCKS, -(-n // LEAST)), -(-n // MOST))


def _clean(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id is not null and embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))


def _block_of(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _matrix(v: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _slack(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, type]:
    """How much less a product in single precision may be, by row of x, and the precision to use: double for huge values."""
    far, wide = np.sqrt((x * x).sum(1)), float(np.sqrt((y * y).sum(1).max(initial=0.0)))
    if not max(far.max(initial=0.0), wide) < 1e15:
        return np.zeros(len(x)), np.float64
    return (x.shape[1] + 8) * 2.0**-22 * far * wide + 1e-36, np.float32


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Dot products of the rows i of x and j of y in double precision."""
    out = np.empty(len(i))
    for s in range(0, len(i), 65_536):
        out[s : s + 65_536] = np.einsum("ij,ij->i", x[i[s : s + 65_536]], y[j[s : s + 65_536]])
    return out


class _Nearest:
    """The k nearest of each query so far, by similarity rounded to 12 digits, then id.

    Products are taken in single precision; what may reach a query's k is taken again in double.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.sim, self.name = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, names: np.ndarray, y: np.ndarray) -> None:
        slack, kind = _slack(self.x, y)
        y1 = y.astype(kind).T
        for s in range(0, len(self.ids), SLICE):
            at = slice(s, s + SLICE)
            sim = self.x[at].astype(kind) @ y1
            least = self.sim[at, -1] - slack[at]
            if np.isneginf(least).any():  # not k yet: the k best of this product will do
                sim[self.ids[at, None] == names[None, :]] = -np.inf
                if sim.shape[1] > self.k:
                    least = np.maximum(least, np.partition(sim, -self.k, axis=1)[:, -self.k] - 2 * slack[at])
            rows = np.flatnonzero(sim.max(axis=1) >= least)
            i, j = np.divmod(np.flatnonzero(sim[rows] >= least[rows, None]), sim.shape[1])
            i = rows[i] + s
            other = self.ids[i] != names[j]
            self._add(i[other], names[j[other]], _exact(self.x, y, i[other], j[other]))

    def _add(self, i: np.ndarray, name: np.ndarray, sim: np.ndarray) -> None:
        if not len(i):
            return
        rows = np.unique(i)
        at = np.concatenate([np.repeat(rows, self.k), i])
        name, sim = np.concatenate([self.name[rows].ravel(), name]), np.concatenate([self.sim[rows].ravel(), sim])
        order = np.lexsort((name, -np.round(sim, 12), at))
        at, name, sim = at[order], name[order], sim[order]
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        keep = nth < self.k
        self.name[at[keep], nth[keep]], self.sim[at[keep], nth[keep]] = name[keep], sim[keep]

    def found(self) -> pa.RecordBatch:
        """Ranked by query id: rows that share an id share its k."""
        ids, name, sim = np.repeat(self.ids, self.k), self.name.ravel(), self.sim.ravel()
        full = np.isfinite(sim)
        ids, name, sim = ids[full], name[full], sim[full]
        order = np.lexsort((name, -np.round(sim, 12), ids))
        ids, name, sim = ids[order], name[order], sim[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
        rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.r_[first, len(ids)])) + 1
        keep = rank <= self.k
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(name[keep]), pa.array(sim[keep]), pa.array(rank[keep].astype(np.int32))], names=["query_id", "neighbour_id", "sim", "rank"])


_NEAR = "query_id long, neighbour_id long, sim double, rank int"


def knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Exact k nearest by dot product of unit vectors, self left out; ties by id. (query_id, neighbour_id, sim, rank).

    Queries are cut into blocks; a task holds one block with its k nearest so far, while
    all vectors (or a part of them, where there are few queries) stream past it. Copies
    grow with the rows, products with both sides; for much larger tables use ``lsh_knn``.
    Null and empty vectors are left out.
    """
    q, d = _clean(queries), _clean(vectors)
    nq = _blocks(q.count())
    nd = max(1, min(BLOCKS // nq, _blocks(d.count())))
    task = lambda qb, db: (qb * nd + db).cast("int")
    one = q.select(F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("db"), "id", "v").select(task(_block_of(nq), F.col("db")).alias("task"), F.lit(0).alias("side"), "id", "v")
    two = d.select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"), "id", "v").select(task(F.col("qb"), _block_of(nd)).alias("task"), F.lit(1).alias("side"), "id", "v")

    def finite(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _matrix(b.column("v"), b.num_rows)
        ok = np.isfinite(x).all(1)
        return b.column("id").to_numpy(zero_copy_only=False)[ok], x[ok]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, xs, near = [], [], None
        for b in batches:
            side = b.column("side").to_numpy(zero_copy_only=False)
            cut = int(np.searchsorted(side, 1))
            own, rest = b.slice(0, cut), b.slice(cut)
            if cut:
                i, x = finite(own)
                ids.append(i)
                xs.append(x)
            if near is None and rest.num_rows:
                if not ids:
                    return
                near = _Nearest(np.concatenate(ids), np.concatenate(xs), k)
            for s in range(0, rest.num_rows, 2 * SLICE):
                names, y = finite(rest.slice(s, 2 * SLICE))
                if len(names):
                    near.meet(names, y)
        if near is not None:
            found = near.found()
            for s in range(0, found.num_rows, 100_000):
                yield found.slice(s, 100_000)

    near = one.union(two).repartitionById(nq * nd, F.col("task")).sortWithinPartitions("side").select("side", "id", "v").mapInArrow(run, _NEAR)
    if nd == 1:
        return near
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("sim", 12)), "neighbour_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def _above(x: np.ndarray, y: np.ndarray, threshold: float, strict: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sim) of all rows of x and y whose dot product is above (or at) the threshold, slice by slice."""
    slack, kind = _slack(x, y)
    y1, least = y.astype(kind), threshold - slack[:, None]
    for s in range(0, len(x), SLICE):
        for t in range(0, len(y), 2 * SLICE):
            near = x[s : s + SLICE].astype(kind) @ y1[t : t + 2 * SLICE].T >= least[s : s + SLICE]
            i, j = np.divmod(np.flatnonzero(near), near.shape[1])
            sim = _exact(x, y, i + s, j + t)
            keep = sim > threshold if strict else sim >= threshold
            yield i[keep] + s, j[keep] + t, sim[keep]


def _in_pairs(rows: DataFrame, n: Column) -> DataFrame:
    """``rows(id, v, ...)`` cut into ``n`` blocks, each row copied to the n pairs of blocks (one <= two) that its block is in."""
    cut = rows.withColumn("own", F.pmod(F.xxhash64("id"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))
    return cut.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other")


def pairs_above(vectors: DataFrame, threshold: float) -> DataFrame:
    """All pairs (a < b) with a dot product above the threshold; only those leave the product of their two blocks.

    Either block is in one task's memory, its products are slices; each pair of blocks is met once.
    """
    v = _clean(vectors)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own, ids, x = t.column("own").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("v"), t.num_rows)
        left, right = own == t.column("one")[0].as_py(), own == t.column("two")[0].as_py()
        a, b, same = ids[left], ids[right], bool((left & right).any())
        for i, j, sim in _above(x[left], x[right], threshold):
            p, q = a[i], b[j]
            keep = p < q if same else p != q
            p, q, sim = p[keep], q[keep], sim[keep]
            if len(p):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sim)], names=["a", "b", "sim"])

    return _in_pairs(v, F.lit(_blocks(v.count()))).groupBy("one", "two").applyInArrow(near, "a long, b long, sim double")


def with_near(members: DataFrame, threshold: float) -> DataFrame:
    """Distinct (theme_id, id) of ``members(theme_id, id, v)`` that have another id of their theme with a dot product at or above the threshold.

    Themes are cut into blocks by their size; each pair of a theme's blocks is met once.
    """
    n = members.groupBy("theme_id").agg(F.count("*").alias("n"))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / (4 * SLICE)), F.lit(BLOCKS)), F.ceil(F.col("n") / MOST)).cast("int")
    rows = members.where("theme_id is not null and id is not null").join(n.select("theme_id", blocks.alias("blocks")), "theme_id")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        own, ids, x = t.column("own").to_numpy(), t.column("id").to_numpy(), _matrix(t.column("v"), t.num_rows)
        left, right = own == t.column("one")[0].as_py(), own == t.column("two")[0].as_py()
        a, b, hits = ids[left], ids[right], [ids[:0]]
        for i, j, _ in _above(x[left], x[right], threshold, strict=False):
            other = a[i] != b[j]
            hits.append(np.unique(np.concatenate([a[i[other]], b[j[other]]])))
        found = pa.array(np.unique(np.concatenate(hits)))
        yield pa.RecordBatch.from_arrays([pa.array([t.column("theme_id")[0].as_py()] * len(found), t.schema.field("theme_id").type), found], names=["theme_id", "id"])

    kind = {c: members.schema[c].dataType.simpleString() for c in ("theme_id", "id")}
    met = _in_pairs(rows, F.col("blocks")).select("theme_id", "id", "v", "own", "one", "two").groupBy("theme_id", "one", "two")
    return met.applyInArrow(near, f"theme_id {kind['theme_id']}, id {kind['id']}").distinct()


def knn_edges(vectors: DataFrame, k: int, threshold: float, mutual: bool = True) -> DataFrame:
    """Edges a < b with similarity >= threshold where both (or either) rank the other among their k nearest."""
    near = knn(vectors, vectors, k).where(F.col("sim") >= threshold).select(F.least("query_id", "neighbour_id").alias("a"), F.greatest("query_id", "neighbour_id").alias("b"), "sim")
    return near.groupBy("a", "b").agg(F.max("sim").alias("weight"), F.count("*").alias("n")).where(F.col("n") >= (2 if mutual else 1)).select("a", "b", "weight")


def centroids(members: DataFrame) -> DataFrame:
    """``members(theme_id, embedding)``: mean vector per theme, scaled to length one, as (theme_id, dim, value)."""
    mean = members.select("theme_id", F.posexplode("embedding").alias("dim", "x")).groupBy("theme_id", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = mean.groupBy("theme_id").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))
    return mean.join(norm, "theme_id").select("theme_id", "dim", F.when(F.col("norm") > 0, F.col("m") / F.col("norm")).otherwise(0.0).alias("value"))


def centroid_vectors(members: DataFrame) -> DataFrame:
    c = centroids(members)
    return c.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x.value).alias("centroid"))


def centroid_primary(members: DataFrame) -> DataFrame:
    """Per theme the member nearest to the centroid; ties by smallest id. ``members(theme_id, vec_id, embedding)``."""
    scored = members.join(centroid_vectors(members), "theme_id").withColumn("score", F.round(dot(F.col("embedding"), F.col("centroid")), 9))
    best = scored.groupBy("theme_id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("primary_id"))).alias("x"))
    return best.select("theme_id", F.col("x.primary_id").alias("primary_id"))


def degree_primary(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per theme the member with the largest sum of edge weights inside the theme; ties by smallest id."""
    both = edges.select("a", "b", "weight").union(edges.select(F.col("b"), F.col("a"), F.col("weight")))
    m1, m2 = members.select("theme_id", F.col("chunk_id").alias("a")), members.select(F.col("theme_id").alias("t2"), F.col("chunk_id").alias("b"))
    inside = both.join(m1, "a").join(m2, "b").where("theme_id = t2").groupBy("theme_id", "a").agg(F.sum("weight").alias("w"))
    scored = members.join(inside.withColumnRenamed("a", "chunk_id"), ["theme_id", "chunk_id"], "left").withColumn("w", F.round(F.coalesce("w", F.lit(0.0)), 9))
    best = scored.groupBy("theme_id").agg(F.min(F.struct((-F.col("w")).alias("s"), "chunk_id")).alias("x"))
    return best.select("theme_id", F.col("x.chunk_id").alias("primary_id"), (-F.col("x.s")).alias("score"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): smallest reachable id, by alternating large and small stars; rounds are written tables."""
    spark = edges.sparkSession
    rounds = Rounds(spark, "components")
    pairs = rounds.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        pairs = rounds.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())


def split_to_cap(edges: list[tuple], cap: int) -> list[list]:
    """Components of one weighted graph; while one exceeds ``cap`` its weakest edge goes. Singletons are dropped.

    Taking the weakest edges away undoes, in reverse, joining nodes by the strongest edges
    first. What is left are the largest joined groups within the cap, so that one pass over
    the sorted edges finds them: a group is done when it would join to more than ``cap``.
    """
    parent: dict = {}
    members: dict = {}  # of groups that have an edge and are within the cap
    done = []

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    size: dict = {}
    for a, b, _ in sorted(edges, key=lambda e: (e[2], e[0], e[1]), reverse=True):
        x, y = find(a), find(b)
        if x == y:
            if x not in members and size.get(x, 1) == 1 <= cap:  # an edge of a node to itself
                members[x] = [x]
            continue
        if size.get(x, 1) < size.get(y, 1):
            x, y = y, x
        parent[y] = x
        size[x] = size.get(x, 1) + size.get(y, 1)
        if size[x] <= cap:
            members[x] = members.pop(x, [x]) + members.pop(y, [y])
        else:
            done += [sorted(members.pop(g)) for g in (x, y) if g in members]
    return sorted(done + [sorted(m) for m in members.values()])


def capped_clusters(edges: DataFrame, cap: int) -> DataFrame:
    """Connected clusters of at most ``cap`` nodes, cut component by component: (cluster, node). The edges are written once, as they are read twice."""
    edges = Rounds(edges.sparkSession, "clusters").write(edges.select("a", "b", "weight"))
    comp = components(edges).select(F.col("node").alias("a"), "component")

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(f"{nodes[0]}", x) for nodes in split_to_cap(list(pdf[["a", "b", "weight"]].itertuples(index=False, name=None)), cap) for x in nodes]
        return pd.DataFrame(rows, columns=["cluster", "node"])

    return edges.join(comp, "a").groupBy("component").applyInPandas(cut, f"cluster string, node {edges.schema['a'].dataType.simpleString()}")


def neighbours_within(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node) within ``hops`` undirected steps, the start itself left out. ``edges(a, b)``, ``starts(start)``."""
    rounds = Rounds(edges.sparkSession, "hops")
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = rounds.write(starts.select("start", F.col("start").alias("node")))
    for _ in range(hops):
        seen = rounds.write(seen.union(seen.join(both, F.col("node") == F.col("a")).select("start", F.col("b").alias("node"))).distinct())
    return seen.where("start <> node")


def lsh_knn(vectors: DataFrame, k: int, tables: int = 8, bits: int = 12, seed: int = 7) -> DataFrame:
    """Approximate kNN for large tables (extension): random hyperplanes; candidates share a bucket in some table."""
    vectors = vectors.where("embedding is not null and size(embedding) > 0")
    size = len((vectors.select("embedding").first() or [[0.0]])[0])
    planes = np.random.default_rng(seed).standard_normal((tables * bits, size))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = (np.stack(b["embedding"]) @ planes.T > 0).reshape(len(b), tables, bits) @ (1 << np.arange(bits))
            yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), tables), "t": np.tile(np.arange(tables), len(b)), "key": x.ravel()})

    keys = vectors.select("vec_id", "embedding").mapInPandas(sign, "vec_id long, t int, key long")
    a, b = keys.toDF("query_id", "t", "key"), keys.toDF("neighbour_id", "t", "key")
    pairs = a.join(b, ["t", "key"]).where("query_id <> neighbour_id").select("query_id", "neighbour_id").distinct()
    one, two = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("x")), vectors.select(F.col("vec_id").alias("neighbour_id"), F.col("embedding").alias("y"))
    sims = pairs.join(one, "query_id").join(two, "neighbour_id").select("query_id", "neighbour_id", dot(F.col("x"), F.col("y")).alias("sim"))
    return sims.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "neighbour_id"))).where(F.col("rank") <= k)


def community_sizes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Per run: number of communities, median and largest size, the largest one's share, edges. ``members(run, community, node)``, ``edges(run, a, b)``."""
    sizes = members.groupBy("run", "community").agg(F.count_distinct("node").alias("n"))
    g = sizes.groupBy("run").agg(F.count("*").alias("n_communities"), F.median("n").alias("median_size"), F.max("n").alias("max_size"), F.sum("n").alias("n_nodes"))
    e = edges.groupBy("run").agg(F.count("*").alias("n_edges"))
    return g.join(e, "run", "left").select("run", "n_communities", "median_size", "max_size", (F.col("max_size") / F.col("n_nodes")).alias("max_share"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))
