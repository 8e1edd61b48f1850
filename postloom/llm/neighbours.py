"""Most similar vectors for every vector: inverted lists with an adaptive dimension scan.

Vectors are brought to unit length and rotated by one random orthogonal matrix, so that every block of columns is a fair
sample of the whole distance. Lists are the cells of k-means centroids fitted on a bounded sample; every vector is
indexed. Inside a probed list, distances grow block by block, and a hypothesis test drops a candidate as soon as its
partial distance cannot belong to a vector within the radius any more.

For a threshold the lists to probe follow from geometry: if x lies in the cell of c and |x - q| <= r, then q is no
farther than r from the border between c and the centroid nearest to q, and most likely much nearer. So only vectors near a
border visit other lists. A list with more rows than one should hold is divided by centroids of its own, so lists stay
small however many vectors there are; what cannot be divided, such as many copies of one vector, is cut into blocks that
are all compared. Vectors travel as 16-bit numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.storage import cut

#: Rows of the samples on which the first centroids and those inside of lists are fitted.
SAMPLE_ROWS, INNER_ROWS = 20_000, 40_000
#: Rows a list should hold, and rows beyond which it is divided.
LIST_ROWS, BLOCK_ROWS = 6_000, 8_192
#: Rows of a list for searches, rows beyond which one is divided, and lists a query probes for its first radius.
SEARCH_ROWS, SEARCH_BLOCK, PROBES = 600, 2_400, 24
#: Standard deviations of a displacement across a border up to which the list behind it is visited.
SIGMAS = 4.0
#: Fixed-point scale of shipped vectors (16 bits a value), and what that may cost a squared distance.
SCALE, SLACK = 32_767, 4e-5
#: Lists of the first level at most, which bounds what every task compares each vector with.
MOST_LISTS = 1_024
#: Distances to centroids that are held at once.
TILE = 2_000_000
#: Columns of a block of the scan, and the width of the test in standard deviations; infinite makes the scan exact.
STEP, EPSILON = 16, 2.1
#: Seed of the rotation and of the centroids.
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float32) if len(column) else np.zeros((0, 1), np.float32)


def prepare(vectors: DataFrame, name: str, emb: str) -> DataFrame:
    """(name, emb) with one unit vector a name. NULL, empty and zero vectors, vectors with NULL, NaN or infinite parts
    and NULL names are left out; of several rows of a name the least by value stands for all. Vectors of another length
    than the most common one raise an error on use."""
    whole = F.col(emb).isNotNull() & (F.size(emb) > 0) & F.exists(emb, lambda x: x != 0) & ~F.exists(emb, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.filter(whole & F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(F.col(emb).cast("array<float>")).alias("emb"))

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = stack(pdf["emb"])
                yield pd.DataFrame({"name": pdf["name"], "emb": list(v / np.linalg.norm(v, axis=1, keepdims=True))})

    return rows.mapInPandas(unit, rows.schema)


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its squared distance, less the square of the row. Rows are taken in tiles, so the
    distances to all centroids are never held for all rows."""
    own, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.result_type(x, c))
    cc = (c * c).sum(1)
    tile = max(1, TILE // len(c))
    for lo in range(0, len(x), tile):
        d = cc - 2 * x[lo : lo + tile] @ c.T
        own[lo : lo + tile], far[lo : lo + tile] = d.argmin(1), d.min(1)
    return own, far


def fit_centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means on a sample; empty cells restart at the points farthest from their centroids."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(sample)))
    c = sample[rng.choice(len(sample), k, replace=False)].copy()
    for _ in range(rounds):
        own, far = closest(sample, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(n == 0)
        c = sums / np.maximum(n, 1)[:, None]
        if len(empty):
            c[empty] = sample[np.argsort(far)[::-1][: len(empty)]]
    return c.astype(np.float32)


def sample_of(vectors: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, int]:
    """A hash sample of about ``rows`` vectors, in the order of names, and the number of all vectors."""
    n = vectors.count()
    part = vectors if n <= rows else vectors.filter(F.pmod(F.xxhash64("name"), F.lit(1_000_003)) < int(1_000_003 * rows / n))
    pdf = part.toPandas().sort_values("name")
    return (stack(pdf["emb"]) if len(pdf) else np.zeros((0, 1), np.float32)), n


def scan(q: np.ndarray, x: np.ndarray, radius2: float, upper: bool = False, step: int = STEP, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rotated unit vectors within squared distance ``radius2``; ``upper``: of one set, each pair once.

    The first block of columns is one matrix product; each later block only touches the candidates that are left.
    """
    dim = q.shape[1]
    limit = lambda done: min(radius2, radius2 * done / dim * (1 + epsilon / math.sqrt(done)) ** 2) + 1e-6
    out_i, out_j = [], []
    tile = max(1, 4_000_000 // max(len(x), 1))
    x0 = x[:, :step]
    xx = (x0 * x0).sum(1)
    for lo in range(0, len(q), tile):
        q0 = q[lo : lo + tile, :step]
        start = lo if upper else 0
        part = (q0 * q0).sum(1)[:, None] + xx[None, start:] - 2 * (q0 @ x0[start:].T)
        i, j = np.nonzero(part <= limit(min(step, dim)))
        d = part[i, j]
        i, j = i + lo, j + start
        if upper:
            keep = i < j
            i, j, d = i[keep], j[keep], d[keep]
        for at in range(step, dim, step):
            end = min(at + step, dim)
            diff = q[i, at:end] - x[j, at:end]
            d = d + (diff * diff).sum(1)
            keep = d <= limit(end)
            i, j, d = i[keep], j[keep], d[keep]
        out_i.append(i)
        out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int), np.zeros(0, int))


def borders(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and how far the vector is from the border of every other one's cell."""
    d = (c * c).sum(1)[None] - 2 * v @ c.T
    own = d.argmin(1)
    between = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * c @ c.T, 1e-12))
    return own, (d - d[np.arange(len(v)), own][:, None]) / (2 * between[own])


class Lists:
    """Centroids in two levels: those of the first, and for each of them its inner ones (itself, if it is not divided).

    Lists are numbered through all inner centroids; ``blocks`` tells into how many blocks each is cut."""

    def __init__(self, first: np.ndarray, inner: list[np.ndarray], blocks: np.ndarray):
        self.first, self.inner, self.blocks = first, inner, blocks
        self.base = np.cumsum([0] + [len(x) for x in inner])

    @classmethod
    def fit(cls, vectors: DataFrame, sample: np.ndarray, n: int, turn: np.ndarray, list_rows: int, most_rows: int, seed: int = SEED) -> Lists:
        """``sample`` are rotated vectors; where it has too few rows of a list that must be divided, a larger one is drawn. Every
        vector is indexed."""
        c = fit_centroids(sample, min(MOST_LISTS, -(-n // list_rows)), seed=seed)
        inner = [c[k : k + 1] for k in range(len(c))]
        own = closest(sample, c)[0]
        share = np.bincount(own, minlength=len(c)) * (n / len(sample))
        if (share > most_rows).any():
            few = np.bincount(own, minlength=len(c)) < 4 * np.ceil(share / list_rows)  # too few rows to divide a list by
            if n > len(sample) and (few & (share > most_rows)).any():
                sample = sample_of(vectors, INNER_ROWS)[0] @ turn
                own = closest(sample, c)[0]
                share = np.bincount(own, minlength=len(c)) * (n / len(sample))
            for k in np.flatnonzero(share > most_rows):
                rows = sample[own == k]
                inner[k] = np.unique(fit_centroids(rows, min(-(-int(share[k]) // list_rows), max(1, len(rows) // 4)), seed=seed), axis=0)
        made = cls(c, inner, np.ones(sum(map(len, inner)), int))
        counts = np.bincount(made.own(sample), minlength=len(made.blocks)) * (n / len(sample))
        made.blocks = np.maximum(1, np.ceil(counts / most_rows)).astype(int)
        return made

    def _inside(self, of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The divided lists of the first level among ``of``, and where they stand in it."""
        order = np.argsort(of, kind="stable")
        for k in np.unique(of):
            if len(self.inner[k]) > 1:
                lo, hi = np.searchsorted(of[order], [k, k + 1])
                yield int(k), order[lo:hi]

    def own(self, v: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        top = closest(v, self.first)[0]
        out = self.base[top].copy()
        for k, at in self._inside(top):
            out[at] += closest(v[at], self.inner[k])[0]
        return out

    def visits(self, v: np.ndarray, reach: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The own list of each vector, and (row, list) of the other lists whose border is within ``reach`` of it; only
        those numbered higher if ``later``, so that of two vectors one visits the other."""
        top, far = borders(v, self.first)
        own = self.base[top].copy()
        near = far <= reach[:, None]
        if later:
            near &= np.arange(len(self.first))[None] > top[:, None]
        else:
            near[np.arange(len(v)), top] = False
        row, to = np.nonzero(near)
        single = np.array([len(x) == 1 for x in self.inner])[to]
        rows, lists = [row[single]], [self.base[to[single]]]
        for k, at in self._inside(top):
            mine, far = borders(v[at], self.inner[k])
            own[at] += mine
            near = (far <= reach[at][:, None]) & (np.arange(far.shape[1])[None] > mine[:, None] if later else np.arange(far.shape[1])[None] != mine[:, None])
            i, j = np.nonzero(near)
            rows.append(at[i])
            lists.append(self.base[k] + j)
        for k, at in self._inside(to):
            i, j = np.nonzero(borders(v[row[at]], self.inner[k])[1] <= reach[row[at]][:, None])
            rows.append(row[at][i])
            lists.append(self.base[k] + j)
        return own, np.concatenate(rows), np.concatenate(lists)

    def nearest(self, v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the ``count`` lists nearest to each vector among those of its ``count`` nearest first ones."""
        d = (self.first * self.first).sum(1)[None] - 2 * v @ self.first.T
        near = _least(d, count)
        row, to = np.repeat(np.arange(len(v)), near.shape[1]), near.ravel()
        single = np.array([len(x) == 1 for x in self.inner])[to]
        rows, lists, far = [row[single]], [self.base[to[single]]], [d[row[single], to[single]]]
        for k, at in self._inside(to):
            c = self.inner[k]
            rows.append(np.repeat(row[at], len(c)))
            lists.append(np.tile(self.base[k] + np.arange(len(c)), len(at)))
            far.append(((c * c).sum(1)[None] - 2 * v[row[at]] @ c.T).ravel())
        row, to, far = np.concatenate(rows), np.concatenate(lists), np.concatenate(far)
        order = np.lexsort((to, far, row))
        row, to = row[order], to[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < count
        return row[keep], to[keep]


def _least(d: np.ndarray, count: int) -> np.ndarray:
    """The columns of the ``count`` least values of each row, in their order; a few are found without sorting the row."""
    count = min(count, d.shape[1])
    if count > 8:
        return np.argsort(d, axis=1, kind="stable")[:, :count]
    d, out, rows = d.copy(), np.empty((len(d), count), np.int64), np.arange(len(d))
    for k in range(count):
        out[:, k] = d.argmin(1)
        d[rows, out[:, k]] = np.inf
    return out


def packed(v: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.clip(np.rint(v * SCALE), -SCALE, SCALE).astype("<i2")]


def unpacked(column: pd.Series) -> np.ndarray:
    v = np.frombuffer(b"".join(column), "<i2").reshape(len(column), -1).astype(np.float32)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _block_of(names: pd.Series, blocks: np.ndarray) -> np.ndarray:
    return (pd.util.hash_pandas_object(names, index=False).to_numpy() % blocks.astype(np.uint64)).astype(np.int64)


def _every(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each of ``n``, one after another."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def similar_pairs(
    vectors: DataFrame, cosine: float, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, block_rows: int = BLOCK_ROWS, sigmas: float = SIGMAS, epsilon: float = EPSILON
) -> DataFrame:
    """(vec_a, vec_b): all pairs of different names whose vectors have a cosine of at least ``cosine``, smaller name first.

    ``vectors`` as from prepare(). An empty table gives no pairs. Exact copies under several names are pairs like others.
    A displacement of length r has a standard deviation of r / sqrt(dimensions) along any one direction, so a vector
    visits the lists whose border is within ``sigmas`` of these. With sqrt(dimensions) sigmas no visit can be missed, and
    with an infinite ``epsilon`` the scan drops no pair: then the result is exact, but for pairs whose cosine is less than
    SLACK below ``cosine``, which the 16-bit numbers may let through.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    sample, n = sample_of(vectors, sample_rows)
    if n < 2:
        return spark.createDataFrame([], "vec_a string, vec_b string")
    dim = sample.shape[1]
    turn = rotation(dim)
    radius2 = 2 - 2 * cosine
    reach = math.sqrt(radius2) * min(1.0, sigmas / math.sqrt(dim)) + 1e-5
    held = spark.sparkContext.broadcast((Lists.fit(vectors, sample @ turn, n, turn, list_rows, block_rows), turn))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, turn = held.value
        for pdf in batches:
            if not len(pdf):
                continue
            v = stack(pdf["emb"]) @ turn
            own, row, visit = lists.visits(v, np.full(len(v), reach, np.float32), True)
            block = _block_of(pdf["name"], lists.blocks[own])
            rest = lists.blocks[own] - block - 1  # the later blocks of the own list
            each = lists.blocks[visit]
            at = np.concatenate([np.arange(len(v)), np.repeat(np.arange(len(v)), rest), np.repeat(row, each)])
            payload = packed(v)
            yield pd.DataFrame({
                "cell": np.concatenate([own, np.repeat(own, rest), np.repeat(visit, each)]).astype(np.int32),
                "part": np.concatenate([block, np.repeat(block + 1, rest) + _every(rest), _every(each)]).astype(np.int32),
                "guest": np.arange(len(at)) >= len(v),
                "name": pdf["name"].to_numpy()[at],
                "vec": [payload[i] for i in at],
            })

    cells = vectors.mapInPandas(placed, "cell int, part int, guest boolean, name string, vec binary")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        home, guest = pdf[~pdf["guest"]], pdf[pdf["guest"]]
        hn, gn = home["name"].to_numpy(), guest["name"].to_numpy()
        pairs = []
        if len(home):
            h = unpacked(home["vec"])
            for left, names in ((h, hn), (unpacked(guest["vec"]), gn)) if len(guest) else ((h, hn),):
                i, j = scan(left, h, radius2 + SLACK, upper=left is h, epsilon=epsilon)
                keep = (left[i] * h[j]).sum(1, dtype=np.float64) >= cosine - SLACK / 2
                pairs += zip(names[i[keep]], hn[j[keep]], strict=True)
        return pd.DataFrame([(a, b) if a < b else (b, a) for a, b in pairs], columns=["vec_a", "vec_b"])

    return cells.groupBy("cell", "part").applyInPandas(joined, "vec_a string, vec_b string")


def best_of(q: np.ndarray, x: np.ndarray, q_names: np.ndarray, x_names: np.ndarray, k: int, radius2: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the k most similar other rows of each query by the adaptive scan, ties by name.

    The rows best on the first block of columns give a radius, if it is not ``radius2`` that is smaller; the others must
    pass the test after every block."""
    dim = x.shape[1]
    d = (q[:, :STEP] ** 2).sum(1)[:, None] + (x[:, :STEP] ** 2).sum(1)[None] - 2 * q[:, :STEP] @ x[:, :STEP].T
    d[q_names[:, None] == x_names[None]] = np.inf
    few = min(len(x), 4 * k)
    first = np.argpartition(d, few - 1, axis=1)[:, :few]
    exact = 2 - 2 * np.einsum("qd,qnd->qn", q, x[first])
    exact[np.isinf(np.take_along_axis(d, first, 1))] = np.inf
    bound = np.sort(exact, axis=1)[:, min(k, few) - 1] if few >= k else np.full(len(q), np.inf)
    bound = np.minimum(np.where(np.isfinite(bound), bound, 4.0), radius2) + 1e-6
    wide = lambda done: (done / dim * (1 + epsilon / math.sqrt(done)) ** 2 if done < dim and math.isfinite(epsilon) else 1.0)
    i, j = np.nonzero(d <= (bound * wide(min(STEP, dim)))[:, None])
    d = d[i, j]
    for lo in range(STEP, dim, STEP):
        hi = min(lo + STEP, dim)
        d = d + ((q[i, lo:hi] - x[j, lo:hi]) ** 2).sum(1)
        keep = d <= bound[i] * wide(hi) + 1e-6
        i, j, d = i[keep], j[keep], d[keep]
    cos = (q[i] * x[j]).sum(1, dtype=np.float64)
    order = np.lexsort((x_names[j].astype(str), -cos, i))
    i, j, cos = i[order], j[order], cos[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < k], j[rank < k], cos[rank < k]


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int, probes: int = PROBES, sample_rows: int = SAMPLE_ROWS, list_rows: int = SEARCH_ROWS, block_rows: int = SEARCH_BLOCK, sigmas: float = SIGMAS, epsilon: float = EPSILON
) -> DataFrame:
    """(name, neighbour, cosine, rank): for every row of ``queries`` its ``k`` most similar other vectors, ties by name.

    Both as from prepare(). The ``probes`` nearest lists are searched first; inside a list the k-th best so far is the
    radius of the scan. What they found gives each query a radius within which all its neighbours lie, and then it visits
    every other list whose border is within ``sigmas`` standard deviations of it, as in similar_pairs(), however many
    lists there are; sqrt(dimensions) sigmas and an infinite ``epsilon`` make the result exact. A list beyond
    ``block_rows`` is divided, and blocks of one that cannot be are searched one by one. Fewer vectors give fewer rows.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    sample, n = sample_of(vectors, sample_rows)
    schema = "name string, neighbour string, cosine double"
    if n < 2:
        return spark.createDataFrame([], schema + ", rank int")
    dim = sample.shape[1]
    turn = rotation(dim)
    held = spark.sparkContext.broadcast((Lists.fit(vectors, sample @ turn, n, turn, list_rows, block_rows), turn))
    share = min(1.0, sigmas / math.sqrt(dim))

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists, turn = held.value
        for pdf in batches:
            if len(pdf):
                v = stack(pdf["emb"]) @ turn
                own = lists.own(v)
                yield pd.DataFrame({"cell": own.astype(np.int32), "part": _block_of(pdf["name"], lists.blocks[own]).astype(np.int32), "name": pdf["name"], "vec": packed(v)})

    def guests(again: bool):
        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lists, turn = held.value
            for pdf in batches:
                if not len(pdf):
                    continue
                v = stack(pdf["emb"]) @ turn
                radius2 = 2 - 2 * pdf["least"].to_numpy() + SLACK
                row, to = lists.nearest(v, probes)
                if again:
                    own, more, visit = lists.visits(v, (np.sqrt(radius2) * share + 1e-5).astype(np.float32), False)
                    known = np.unique(row * len(lists.blocks) + to)
                    key = np.concatenate([more, np.arange(len(v))]) * len(lists.blocks) + np.concatenate([visit, own])
                    key = np.setdiff1d(key, known)
                    row, to = key // len(lists.blocks), key % len(lists.blocks)
                each = lists.blocks[to]
                at, payload = np.repeat(row, each), packed(v)
                yield pd.DataFrame({"cell": np.repeat(to, each).astype(np.int32), "part": _every(each).astype(np.int32), "name": pdf["name"].to_numpy()[at], "vec": [payload[i] for i in at], "radius2": radius2[at]})

        return placed

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            names, x = left["name"].to_numpy(), unpacked(left["vec"])
            asked, q, radius2 = right["name"].to_numpy(), unpacked(right["vec"]), right["radius2"].to_numpy()
            for lo in range(0, len(q), 256):
                rows = slice(lo, lo + 256)
                i, j, cos = best_of(q[rows], x, asked[rows], names, k, radius2[rows], epsilon)
                if len(i):
                    parts.append(pd.DataFrame({"name": asked[rows][i], "neighbour": names[j], "cosine": cos}))
        return pd.concat(parts) if parts else pd.DataFrame([], columns=["name", "neighbour", "cosine"])

    home = vectors.mapInPandas(at_home, "cell int, part int, name string, vec binary").groupBy("cell", "part")
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour"))), 1, k)

    def found(asked: DataFrame, again: bool) -> DataFrame:
        out = asked.mapInPandas(guests(again), "cell int, part int, name string, vec binary, radius2 double")
        return home.cogroup(out.groupBy("cell", "part")).applyInPandas(searched, schema)

    queries = cut(queries.select("name", "emb"), "queries")
    first = cut(found(queries.withColumn("least", F.lit(-1.0)), False).groupBy("name").agg(ranked.alias("best")), "first")
    radius = first.filter(F.size("best") == k).select("name", (-F.element_at("best", -1)["far"]).alias("least"))
    asked = queries.join(radius, "name", "left").withColumn("least", F.coalesce("least", F.lit(-1.0)))
    seen = first.select("name", F.explode("best").alias("b")).select("name", "b.neighbour", (-F.col("b.far")).alias("cosine"))
    best = seen.unionByName(found(asked, True)).groupBy("name").agg(ranked.alias("best"))
    return best.select("name", F.posexplode("best").alias("rank", "b")).select("name", F.col("b.neighbour").alias("neighbour"), (-F.col("b.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
