"""Clustering and its evaluation on vectors.

Exact neighbour work runs over pairs of blocks of rows: a task holds two blocks and reduces them with matrix products,
so pairs of rows are never emitted. That is quadratic by nature; the training-data subpackage has approximate means.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import vectors as vx
from postloom.storage import cut

#: Rows of a block, blocks up to which all pairs of them meet, and pivots of cells at most.
BLOCK, MOST_PLAIN, MOST_PIVOTS = 4096, 8, 2048
#: Steps of the histogram from which quantiles are read.
STEPS = 100_000
#: Rows up to which the driver makes the spanning tree of a hierarchy; beyond that it is made over pairs of blocks.
HIERARCHY_ROWS = 5000
#: Rows of a block at most and of a tile when a spanning tree is made, and the grid its vectors are rounded to.
TREE_BLOCK, TREE_TILE, GRID = 16384, 256, 2**25
NOISE = -1


def _stack(c: pd.Series) -> np.ndarray:
    return np.stack(c.to_numpy()).astype(np.float64) if len(c) else np.zeros((0, 1))


def _distance(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        return 1 - (a @ b.T) / np.maximum(na[:, None] * nb[None], 1e-12)
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def block_pairs(vectors: DataFrame, extra: list[str] | None = None, block: int = BLOCK, reach: float | None = None, metric: str = "cosine") -> tuple[DataFrame, DataFrame]:
    """Rows (id, emb, extra...) placed for pairs (row block p, column block q): left by p, right by q.

    Without ``reach`` all pairs of blocks meet. With it, blocks are cells around pivots, and only those meet that can hold
    rows within that distance: by the triangle inequality two cells farther apart than their radii and the reach hold
    none, so no pair is lost. Cells that are too large are cut, and all their parts meet."""
    blocks = max(1, -(-vectors.count() // block))
    rows = vectors.select("id", "emb", *(extra or []))
    if reach is None or blocks < MOST_PLAIN:
        rows = rows.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        every = F.sequence(F.lit(0), F.lit(blocks - 1))
        return rows.select("*", F.explode(every).alias("_q")).withColumnRenamed("_b", "_p"), rows.select("*", F.explode(every).alias("_p")).withColumnRenamed("_b", "_q")
    sc = vectors.sparkSession.sparkContext
    pivots = _flat(_stack(vectors.select("emb").orderBy(F.xxhash64("id")).limit(min(4 * blocks, MOST_PIVOTS)).toPandas()["emb"]), metric)
    far = math.sqrt(2 * reach) if metric == "cosine" else reach
    held = sc.broadcast(pivots)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distance(_flat(_stack(pdf["emb"]), metric), held.value, "euclidean")
                yield pd.DataFrame({"id": pdf["id"], "_c": d.argmin(1).astype(np.int32), "_d": d.min(1)})

    cells = cut(rows.select("id", "emb").mapInPandas(measured, "id long, _c int, _d double"), "cells")
    size = {r["_c"]: (r["n"], r["far"]) for r in cells.groupBy("_c").agg(F.count("*").alias("n"), F.max("_d").alias("far")).collect()}  # at most MOST_PIVOTS rows
    parts, first = {}, 0
    for c in sorted(size):
        parts[c] = (first, -(-size[c][0] // block))
        first += parts[c][1]
    between = _distance(pivots, pivots, "euclidean")
    meets = {c: [b for o in sorted(size) if between[c, o] - size[c][1] - size[o][1] <= far + 1e-6 for b in range(parts[o][0], sum(parts[o]))] for c in sorted(size)}
    known = vectors.sparkSession.createDataFrame([(c, parts[c][0], parts[c][1], meets[c]) for c in sorted(size)], "_c int, _first int, _n int, _meets array<int>")
    placed = rows.join(cells.select("id", "_c"), "id").join(F.broadcast(known), "_c").withColumn("_b", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_n"))).cast("int"))
    placed = cut(placed, "placed")
    keep = [F.col(c).alias(c) for c in ("id", "emb", *(extra or []))]
    left, right = (placed.select(*keep, F.col("_b").alias(a), F.explode("_meets").alias(b)) for a, b in (("_p", "_q"), ("_q", "_p")))
    return left, right


def _flat(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors whose distances along the straight line order as the metric does."""
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) if metric == "cosine" else x


def neighbour_distances(vectors: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(id, rank, distance): distances to the k nearest other rows, exact. Fewer rows give fewer ranks."""
    left, right = block_pairs(vectors)

    def near(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["id", "d"])
        d = _distance(_stack(a["emb"]), _stack(b["emb"]), metric)
        d[a["id"].to_numpy()[:, None] == b["id"].to_numpy()[None]] = np.inf
        return pd.DataFrame({"id": a["id"], "d": [[float(v) for v in row if np.isfinite(v)] for row in np.sort(d, axis=1)[:, :k]]})

    part = left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInPandas(near, "id long, d array<double>")
    best = part.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))
    return best.select("id", F.posexplode("d").alias("rank", "distance")).withColumn("rank", F.col("rank") + 1)


def quantiles(values: DataFrame, column: str, n: int) -> DataFrame:
    """(i, q) for i = 0 .. n - 1: the value of rank floor(i / (n - 1) * (rows - 1)), rounded down to one of STEPS steps up to
    the maximum. Values are counted by step, so no task holds more than the steps, however many rows there are."""
    whole = values.filter(F.col(column).isNotNull()).agg(F.max(column).alias("top"), F.count("*").alias("rows")).first()
    if not whole["rows"]:
        return values.sparkSession.createDataFrame([], "i int, q double")
    width = F.lit((whole["top"] or 0.0) / STEPS or 1.0)
    counts = values.filter(F.col(column).isNotNull()).groupBy(F.floor(F.col(column) / width).alias("step")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("step"))  # STEPS + 1 rows at most
    ranks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i / F.lit(max(n - 1, 1)) * F.lit(whole["rows"] - 1)))
    inside = counts.withColumn("upto", upto).select("step", "upto", "n", F.posexplode(ranks).alias("i", "rank")).filter((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
    return inside.select(F.col("i").cast("int").alias("i"), (F.col("step") * width).alias("q"))


def knee(distances: DataFrame, k: int) -> DataFrame:
    """(eps): the k-th neighbour distance at the greatest second difference of the sorted curve, over 256 quantiles."""
    curve = quantiles(distances.filter(F.col("rank") == k), "distance", 256).withColumnRenamed("q", "d")
    w = Window.orderBy("i")  # 256 rows
    second = curve.withColumn("bend", F.round(F.lead("d").over(w) - 2 * F.col("d") + F.lag("d").over(w), 9))
    return second.filter(F.col("bend").isNotNull()).orderBy(F.desc("bend"), "i").limit(1).select(F.col("d").alias("eps"))


def automatic_eps(vectors: DataFrame, metric: str = "cosine", k: int = 2, share: float = 0.85, default: float = 0.25) -> float:
    """A share of the median distance to the k-th nearest other row (the third, if a row counts itself); the default where
    that is not above 0."""
    middle = quantiles(neighbour_distances(vectors, k, metric).filter(F.col("rank") == k), "distance", 3).filter("i = 1").first()
    return share * middle["q"] if middle and middle["q"] > 0 else default


def improved_clusters(vectors: DataFrame, wide: int = 100, variance: float = 0.95, k: int = 2, noise: float = 0.5, shrink: float = 0.8) -> DataFrame:
    """(id, label): unit vectors, standardised, with more than ``wide`` dimensions reduced to the components that keep
    ``variance``, then density clusters at the knee of the k-th neighbour distances, of at least one row in a hundred (two at
    least); once more with a smaller radius where more than ``noise`` of the rows are in none."""
    n, dim = vectors.count(), len(vectors.select("emb").first()["emb"]) if vectors.limit(1).count() else 0
    if n < 3:
        return vectors.select("id", F.lit(NOISE).cast("bigint").alias("label"))
    rows = vectors.select("id", vx.unit("emb").alias("emb"))
    rows = cut(reduce_dimensions(rows, None if dim > wide else dim, variance, True), "reduced")
    found = knee(neighbour_distances(rows, k), k).first()
    eps, least = found["eps"] if found and found["eps"] > 0 else 0.3, max(2, n // 100)
    out = dbscan(rows, eps, least)
    return dbscan(rows, eps * shrink, least) if evaluate(out).first()["noise_share"] > noise else out


def dbscan(vectors: DataFrame, eps: float | None, least: int, metric: str = "cosine") -> DataFrame:
    """(id, label): density clusters; labels are the smallest core id of a cluster, noise is -1. A row counts itself.

    Without ``eps`` it is that of automatic_eps(). Counting neighbours and passing on the smallest label are reductions
    over pairs of blocks that can hold neighbours; labels also jump to the label of their label, so few rounds are needed."""
    eps = automatic_eps(vectors, metric) if eps is None else eps
    left, right = block_pairs(vectors, None, BLOCK, eps, metric)

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["id", "n"])
        return pd.DataFrame({"id": a["id"], "n": (_distance(_stack(a["emb"]), _stack(b["emb"]), metric) <= eps).sum(1)})

    counts = left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    state = cut(vectors.select("id", "emb").join(counts, "id").select("id", "emb", (F.col("n") >= least).alias("core"), F.when(F.col("n") >= least, F.col("id")).alias("label")), "density")

    def spread(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b[b["core"]] if len(b) else b
        if not len(a) or not len(b):
            return pd.DataFrame(columns=["id", "low"])
        near = _distance(_stack(a["emb"]), _stack(b["emb"]), metric) <= eps
        low = np.where(near, b["label"].to_numpy(float)[None], np.inf).min(1)
        keep = np.isfinite(low)
        return pd.DataFrame({"id": a["id"].to_numpy()[keep], "low": low[keep].astype(np.int64)})

    while True:  # labels only fall, so this ends
        left, right = block_pairs(state, ["core", "label"], BLOCK, eps, metric)
        low = left.groupBy("_p", "_q").cogroup(right.groupBy("_p", "_q")).applyInPandas(spread, "id long, low long").groupBy("id").agg(F.min("low").alias("low"))
        new = state.join(low, "id", "left").withColumn("low", F.least("low", "label"))
        jump = new.filter("core").select(F.col("id").alias("low"), F.col("low").alias("further"))
        new = new.join(jump, "low", "left").select("id", "emb", "core", F.least("low", "further").alias("new"), "label")
        new = cut(new, "density")
        if not new.filter(F.col("core") & ~F.col("new").eqNullSafe(F.col("label"))).limit(1).count():
            return new.select("id", F.coalesce("new", F.lit(NOISE)).alias("label"))
        state = new.select("id", "emb", "core", F.col("new").alias("label"))


def _grid(c: pd.Series) -> np.ndarray:
    """Unit vectors on a grid of 2 ** -25, as integers: squared distances on it are exact sums, so equal ones are equal
    in every order of summation and every block."""
    x = _stack(c)
    return np.rint(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-8) * GRID).astype("<i4")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def prim_tree(x: np.ndarray) -> list[tuple[float, int, int]]:
    """The minimum spanning tree of the rows as (squared distance, smaller, greater position); of equally long edges
    those of smaller positions."""
    n = len(x)
    inside, dist, near = np.zeros(n, bool), np.full(n, np.inf), np.full(n, n)
    edges, cur = [], 0
    for _ in range(n - 1):
        inside[cur] = True
        d = _squares(x, x[cur : cur + 1])[:, 0]
        closer = ~inside & ((d < dist) | (d == dist) & (cur < near))
        dist[closer], near[closer] = d[closer], cur
        far = np.where(inside, np.inf, dist)
        tied = np.flatnonzero(far == far.min())
        nxt = int(tied[np.lexsort((np.maximum(tied, near[tied]), np.minimum(tied, near[tied])))[0]])
        edges.append((float(dist[nxt]), min(nxt, int(near[nxt])), max(nxt, int(near[nxt]))))
        cur = nxt
    return edges


def boruvka_tree(vectors: DataFrame, ids: np.ndarray, block: int = TREE_BLOCK) -> list[tuple[float, int, int]]:
    """The tree of prim_tree() over all rows of ``vectors``, positions being those in the sorted ``ids``.

    Pairs of blocks are laid down once. In each round a task gives the nearest row of another component for the rows of
    its two blocks that need it: a row whose last nearest row is still in another component keeps it, and one that was
    farther than what its component has already cannot matter. The driver keeps a few numbers a row, never vectors.
    """
    spark, n = vectors.sparkSession, len(ids)
    size = -(-n // max(-(-n // block), min(8, -(-n // 256))))
    blocks = -(-n // size)
    known = spark.sparkContext.broadcast(ids)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                at = np.searchsorted(known.value, pdf["id"].to_numpy())
                yield pd.DataFrame({"b": (at // size).astype(np.int32), "at": at, "vec": [v.tobytes() for v in _grid(pdf["emb"])]})

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        p, q = int(pdf["p"].iloc[0]), int(pdf["q"].iloc[0])
        return pd.DataFrame({"p": [p], "q": [q], "left": [b"".join(pdf["vec"][pdf["b"] == p])], "right": [b"".join(pdf["vec"][pdf["b"] == q])]})

    rows = vectors.select("id", "emb").mapInPandas(placed, "b int, at long, vec binary").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "at", "vec")
    pairs = cut(rows.groupBy("p", "q").applyInPandas(packed, "p int, q int, left binary, right binary").repartition(blocks * (blocks + 1) // 2, "p", "q"), "pairs")

    def search(held):
        def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            comp, active = held.value
            for pdf in batches:
                for p, q, a, b in zip(pdf["p"], pdf["q"], pdf["left"], pdf["right"], strict=True):
                    for s, t, x, y in ((p, q, a, b), (q, p, b, a))[: 1 if p == q else 2]:
                        own, other = comp[s * size : (s + 1) * size], comp[t * size : (t + 1) * size]
                        wanted = np.flatnonzero(active[s * size : (s + 1) * size])
                        x, y = (np.frombuffer(v, "<i4").reshape(len(c), -1) / GRID for v, c in ((x, own), (y, other)))
                        for lo in range(0, len(wanted), TREE_TILE):
                            k = wanted[lo : lo + TREE_TILE]
                            d = _squares(x[k], y)
                            d[own[k][:, None] == other[None]] = np.inf
                            j = d.argmin(1)
                            d = d[np.arange(len(k)), j]
                            keep = np.isfinite(d)
                            yield pd.DataFrame({"at": s * size + k[keep], "d": d[keep], "other": t * size + j[keep]})

        return searched

    comp, best, dist = np.arange(n), np.full(n, -1), np.zeros(n)
    edges: list[tuple[float, int, int]] = []
    while len(edges) < n - 1:
        out = (best >= 0) & (comp[best] != comp)
        least = np.full(n, np.inf)
        np.minimum.at(least, comp[out], dist[out])
        active = ~out & (dist <= least[comp])
        if active.any():
            held = spark.sparkContext.broadcast((comp, active))
            found = pairs.mapInPandas(search(held), "at long, d double, other long").groupBy("at").agg(F.min(F.struct("d", "other")).alias("r")).select("at", "r.*").toPandas()
            held.unpersist()
            at = found["at"].to_numpy()
            dist[at], best[at], out[at] = found["d"], found["other"], True
        at = np.flatnonzero(out)
        low, high = np.minimum(at, best[at]), np.maximum(at, best[at])
        order = np.lexsort((high, low, dist[at]))
        first = order[np.sort(np.unique(comp[at][order], return_index=True)[1])]  # the shortest edge of each component
        parent = list(range(n))
        for d, a, b in zip(dist[at][first].tolist(), low[first].tolist(), high[first].tolist(), strict=True):
            i, j = _root(parent, int(comp[a])), _root(parent, int(comp[b]))
            if i != j:
                parent[max(i, j)] = min(i, j)
                edges.append((d, a, b))
        comp = np.array([_root(parent, i) for i in range(n)])[comp]
    return edges


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def condensed_labels(x: np.ndarray, least: int = 4, epsilon: float = 0.01) -> np.ndarray:
    """Labels by tree_labels() of few rows."""
    return tree_labels(len(x), prim_tree(x), least, epsilon)


def tree_labels(n: int, edges: list[tuple[float, int, int]], least: int = 4, epsilon: float = 0.01) -> np.ndarray:
    """Leaves of the condensed single-linkage tree (minimum cluster size ``least``) made of the ``edges`` (squared length,
    position, position) of a minimum spanning tree; clusters born below ``epsilon`` are merged into their parents; noise
    is -1. Ties are broken by position."""
    if n < 2:
        return np.full(n, NOISE)
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}
    for k, (d, a, b) in enumerate(sorted(edges)):
        a, b = _root(parent, a), _root(parent, b)
        kids[n + k] = (a, b, d**0.5)
        parent[a] = parent[b] = n + k
        size[n + k] = size[a] + size[b]
    label = np.full(n, NOISE)

    def points(i: int) -> list[int]:
        out, todo = [], [i]
        while todo:
            j = todo.pop()
            if j < n:
                out.append(j)
            else:
                todo += kids[j][:2]
        return out

    leaves: set[int] = set()
    todo = [(2 * n - 2, 2 * n - 2)]  # (node, cluster it belongs to)
    while todo:
        i, own = todo.pop()
        if i < n:
            continue
        a, b, d = kids[i]
        if size[a] >= least and size[b] >= least and d >= epsilon:
            leaves.discard(own)
            leaves |= {a, b}
            todo += [(a, a), (b, b)]
        else:
            todo += [(c, own) for c in (a, b) if size[c] >= least]
    for k, members in enumerate(sorted((points(i) for i in leaves), key=min)):
        label[members] = k
    return label


def hierarchy(vectors: DataFrame, least: int = 4, epsilon: float = 0.01, most: int = HIERARCHY_ROWS) -> DataFrame:
    """(id, label) by the tree over all rows; ``vectors`` has one row an id. Up to ``most`` rows the driver makes the
    tree, beyond that rounds over pairs of blocks do, with the same result."""
    vectors = cut(vectors.select("id", "emb"), "vectors")
    if vectors.count() <= most:
        pdf = vectors.toPandas().sort_values("id")
        ids = pdf["id"].to_numpy()
        edges = prim_tree(_grid(pdf["emb"]) / GRID)
    else:
        ids = np.sort(vectors.select("id").toPandas()["id"].to_numpy())
        edges = boruvka_tree(vectors, ids)
    held = vectors.sparkSession.sparkContext.broadcast((ids, tree_labels(len(ids), edges, least, epsilon)))

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, label = held.value
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "label": label[np.searchsorted(ids, pdf["id"].to_numpy())].astype(np.int32)})

    return vectors.select("id").mapInPandas(labelled, "id long, label int")


def kmeans(vectors: DataFrame, k: int, seeds: Sequence[int] = range(42, 52)) -> DataFrame:
    """(id, label): the best of several starts by cost."""
    rows = cut(vectors.select("id", array_to_vector("emb").alias("features")), "features")
    models = [KMeans(k=k, seed=s, maxIter=20).fit(rows) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(rows).select("id", F.col("prediction").alias("label"))


def reduce_dimensions(vectors: DataFrame, dim: int | None = None, variance: float = 0.95, standardise: bool = False) -> DataFrame:
    """(id, emb): principal components, ``dim`` of them or as many as keep ``variance``."""
    rows = vectors.select("id", array_to_vector("emb").alias("features"))
    if standardise:
        rows = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(rows).transform(rows).select("id", F.col("scaled").alias("features"))
    width = vectors.select(F.size("emb")).first()[0]
    model = PCA(k=dim or width, inputCol="features", outputCol="out").fit(rows)
    keep = dim or int(np.searchsorted(np.cumsum(model.explainedVariance.toArray()), variance) + 1)
    return model.transform(rows).select("id", F.slice(vector_to_array("out"), 1, keep).alias("emb"))


def evaluate(labels: DataFrame) -> DataFrame:
    """(clusters, noise, rows, noise_share) of a clustering."""
    return labels.agg(F.count_distinct(F.when(F.col("label") != NOISE, F.col("label"))).alias("clusters"), F.count_if(F.col("label") == NOISE).alias("noise"), F.count("*").alias("rows")).withColumn("noise_share", F.col("noise") / F.nullif(F.col("rows"), F.lit(0)))


def eps_grid(vectors: DataFrame, grid: list[float], metrics: tuple[str, ...] = ("cosine", "euclidean"), least: int = 5) -> DataFrame:
    """(metric, eps, clusters, noise, best): one row a run; the best has least noise, then most clusters."""
    out = None
    for metric in metrics:
        for eps in grid:
            part = evaluate(dbscan(vectors, eps, least, metric)).select(F.lit(metric).alias("metric"), F.lit(eps).alias("eps"), "clusters", "noise")
            out = part if out is None else out.unionByName(part)
    rank = F.row_number().over(Window.orderBy("noise", F.desc("clusters"), "metric", "eps"))  # one row a run
    return out.withColumn("best", rank == 1)
