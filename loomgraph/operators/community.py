"""Communities: Leiden per group (modularity with resolution), k-means topics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leiden(edges: list[tuple], resolution: float = 1.0, iterations: int = 10, seed: int = 42) -> dict:
    """Communities of one weighted graph after Traag, Waltman and van Eck: move, refine, aggregate, repeat.

    Quality is modularity with a resolution factor. Nodes are visited in an order drawn
    from ``seed``; the result depends on the graph and the seed alone.
    """
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    if not names:
        return {}
    index = {x: i for i, x in enumerate(names)}
    rng = np.random.default_rng(seed)
    n = len(names)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        i, j = index[a], index[b]
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    loops = [0.0] * n
    total = sum(sum(d.values()) for d in near) or 1.0
    where = np.arange(n)  # node of the first level -> node of this level

    def degree(g, own):
        return [sum(d.values()) + own[i] for i, d in enumerate(g)]

    def move(g, deg, label, allowed=None):
        weight: dict[int, float] = {}
        for i, c in enumerate(label):
            weight[c] = weight.get(c, 0.0) + deg[i]
        queue, waiting = rng.permutation(len(g)).tolist(), set(range(len(g)))
        changed, at = False, 0
        while at < len(queue):
            i = queue[at]
            at += 1
            waiting.discard(i)
            old = label[i]
            weight[old] -= deg[i]
            gain: dict[int, float] = {old: 0.0}
            for j, w in g[i].items():
                if allowed is None or allowed[j] == allowed[i]:
                    gain[label[j]] = gain.get(label[j], 0.0) + w
            # The best gain, rounded to 12 digits; of equal ones the old community, else the smallest.
            share = resolution * deg[i]
            best, most = old, gain[old] - share * weight.get(old, 0.0) / total
            for c, w in gain.items():
                value = w - share * weight.get(c, 0.0) / total
                if value > most - 2e-12 and c != best:
                    x, y = round(value, 12), round(most, 12)
                    if x > y or (x == y and best != old and (c == old or c < best)):
                        best, most = c, value
            weight[best] = weight.get(best, 0.0) + deg[i]
            if best != old:
                label[i] = best
                changed = True
                for j in g[i]:
                    if label[j] != best and j not in waiting:
                        waiting.add(j)
                        queue.append(j)
        return changed

    label = list(range(n))
    g, own = near, loops
    for _ in range(iterations):
        deg = degree(g, own)
        changed = move(g, deg, label)
        fine = list(range(len(g)))
        move(g, deg, fine, allowed=label)
        parts = {c: k for k, c in enumerate(dict.fromkeys(fine))}
        if len(parts) == len(g) and not changed:
            break
        to = [parts[c] for c in fine]
        wide: list[dict[int, float]] = [{} for _ in parts]
        extra = [0.0] * len(parts)
        for i, d in enumerate(g):
            extra[to[i]] += own[i]
            for j, w in d.items():
                if to[i] == to[j]:
                    extra[to[i]] += w
                else:
                    wide[to[i]][to[j]] = wide[to[i]].get(to[j], 0.0) + w
        coarse = [0] * len(parts)
        for i, k in enumerate(to):
            coarse[k] = label[i]
        where = np.array([to[k] for k in where])
        g, own = wide, extra
        first = {c: k for k, c in enumerate(dict.fromkeys(coarse))}
        label = [first[c] for c in coarse]
    return {x: label[where[i]] for i, x in enumerate(names)}


def modularity(edges: list[tuple], label: dict, resolution: float = 1.0) -> float:
    total = sum(w for _, _, w in edges)
    if not total:
        return 0.0
    inside, degree = 0.0, {}
    for a, b, w in edges:
        inside += w if label[a] == label[b] else 0.0
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0.0) + w
    return inside / total - resolution * sum((d / (2 * total)) ** 2 for d in degree.values())


def communities(edges: DataFrame, resolution: float = 1.0, iterations: int = 10, seed: int = 42, min_size: int = 2) -> DataFrame:
    """``edges(shelf_id, a, b, weight)`` to (shelf_id, node, community) per shelf; small communities are dropped.

    Shelves are independent; one shelf's graph is bounded by the kNN degree and the
    document-frequency ceiling of its edge builders.
    """
    kind = edges.schema["a"].dataType.simpleString()
    shelf = edges.schema["shelf_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = leiden(list(pdf[["a", "b", "weight"]].itertuples(index=False, name=None)), resolution, iterations, seed)
        groups: dict[int, list] = {}
        for node, c in found.items():
            groups.setdefault(c, []).append(node)
        kept = sorted((sorted(m) for m in groups.values() if len(m) >= min_size), key=lambda m: (-len(m), m[0]))
        rows = [(pdf["shelf_id"].iloc[0], node, k) for k, m in enumerate(kept) for node in m]
        return pd.DataFrame(rows, columns=["shelf_id", "node", "community"])

    return edges.groupBy("shelf_id").applyInPandas(run, f"shelf_id {shelf}, node {kind}, community int")


def auto_k(n: int) -> int:
    return int(min(12, max(2, round(math.sqrt(n / 2)))))


def kmeans_topics(vectors: DataFrame, k: int | None = None, seed: int = 42, min_size: int = 1) -> DataFrame:
    """k-means over vectors (``pyspark.ml``): (vec_id, topic); topics below ``min_size`` become -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k or auto_k(rows.count()), seed=seed).fit(rows)
    found = model.transform(rows).select("vec_id", F.col("prediction").alias("topic"))
    sizes = found.groupBy("topic").agg(F.count("*").alias("n"))
    return found.join(sizes, "topic").select("vec_id", F.when(F.col("n") >= min_size, F.col("topic")).otherwise(-1).alias("topic"))
