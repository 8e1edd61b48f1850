"""Groups of mutually similar records: neighbour descent, modularity, and a check against the group's mean direction.

Vectors are routed to blocks of similar ones (cells of k-means centroids, divided by centroids of their own where they are
large), each to its own block and to others. In a block, neighbour descent builds an approximate nearest-neighbour graph,
and local moves that raise modularity turn it into communities. A vector that sits in several blocks links their
communities: these links form the contracted graph, whose communities are merged, by joins over all blocks, as long as
that raises modularity. Last, the definition is checked: communities of one mean direction are united, every vector goes
to the group whose mean is nearest, and only groups and members that meet the definition are kept. What was left over
goes through the same steps twice more with other cells. Groups are described by the members of highest internal weighted
degree: the sum of the weights of a member's links to other members of the final group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.neighbours import SAMPLE_ROWS, SEED, Lists, fit_centroids, packed, sample_of, stack, unpacked
from postloom.storage import BROADCAST_ROWS, cut, fits_broadcast, stored, written

#: Neighbours of a vector, candidates per round of descent, rounds at most.
NEIGHBOURS, CANDIDATES, ROUNDS = 10, 48, 8
#: Hash tables for the start of the descent, and vectors of the same bucket tried in each.
TABLES, BUCKET = 6, 20
#: Rows a block should hold, rows beyond which a cell is divided.
BLOCK_ROWS, PART_ROWS = 2_500, 5_000
#: Copies of one vector from which one stands for all of them in the graph.
COPIES = 64
#: Degree within which links are compared with chance: modularity with a resolution that grows with the graph, so that
#: communities do not depend on how much else there is. Parts of a large group are united by mean.
RESOLUTION = 1_000.0
#: The same for the contracted graph, whose links are single vectors, and links that tie a vector to its community.
CONTRACTED, TIES = 200.0, 2
#: Links of the contracted graph up to which one task merges it; more are merged by joins, with the same result.
FEW_LINKS = 2_000_000
#: Cells of a vector in each pass; what is left over is scattered, so it sits in more cells.
SEATS = (2, 4)
#: Cosine between mean directions from which communities are one group.
SAME = 0.8
#: Means up to which their comparison is one small matrix; more are compared in blocks, with the same result.
FEW_MEANS = 8_192
#: Means that a task may hold; more are held in several blocks, one after another.
MOST_MEANS = 524_288
#: Means whose lists are put in order at once.
INDEXED = 32_768
#: Means up to which every vector is compared with all of them. Beyond it means stand in lists, of some MEANS_A_LIST and of
#: no more than MEAN_LISTS: each mean in the STANDS lists next to it; a vector looks into the LOOKS next to it.
ALL_MEANS, MEANS_A_LIST, MEAN_LISTS, STANDS, LOOKS = 4_096, 16, 4_096, 16, 8
#: Cosine from which a vector keeps the best mean of the lists that it looks into; others are compared with all means.
FIRM = 0.72
#: Vectors that a task holds against the means at once.
TOGETHER = 65_536


def descend(x: np.ndarray, k: int = NEIGHBOURS, rounds: int = ROUNDS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour descent over unit vectors: (neighbours, similarities), best first, -1 where there are too few.

    It starts from vectors on the same side of random hyperplanes, so that small groups far from all others are not
    missed. Each round compares a vector with neighbours of its neighbours
    and of those that hold it for theirs, and ends when hardly any list changes."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return np.full((n, 1), -1), np.full((n, 1), -1.0, np.float32)
    rng = np.random.default_rng(seed)
    start = []
    bits = max(1, int(np.log2(max(n / 32, 2))))
    for _ in range(TABLES):
        code = (x @ rng.normal(size=(x.shape[1], bits)).astype(np.float32) > 0) @ (1 << np.arange(bits))
        order = np.lexsort((rng.random(n), code))
        _, first, size = np.unique(code[order], return_index=True, return_counts=True)
        first, size = np.repeat(first, size), np.repeat(size, size)
        found = np.empty((n, BUCKET), int)
        found[order] = order[first[:, None] + (np.arange(n)[:, None] - first[:, None] + 1 + np.arange(BUCKET)) % size[:, None]]
        start.append(found)
    nb, sim = _best(x, np.full((n, 0), -1), np.zeros((n, 0), np.float32), np.concatenate(start, 1), k)
    for _ in range(rounds):
        back = np.full((n, 4), -1)
        src = np.repeat(np.arange(n), nb.shape[1])
        order = rng.permutation(len(src))
        back[nb.ravel()[order], order % 4] = src[order]
        back = np.where((back < 0), nb[:, :1], back)
        via = np.concatenate([nb[:, : k // 2], back], 1)
        via = via.ravel().take(np.arange(n)[:, None] * via.shape[1] + rng.integers(0, via.shape[1], (n, CANDIDATES - 4)))
        cand = np.concatenate([nb.ravel().take(via * nb.shape[1] + rng.integers(0, nb.shape[1], via.shape), mode="wrap"), back], 1)
        old = nb
        nb, sim = _best(x, nb, sim, cand, k)
        if (nb != old).mean() < 0.01:
            break
    return nb, sim


def _best(x: np.ndarray, nb: np.ndarray, sim: np.ndarray, cand: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar of the present and the candidate neighbours."""
    n, wide = len(x), nb.shape[1] + cand.shape[1]
    bits, place = wide.bit_length(), np.arange(wide)
    out_nb, out_sim = np.empty((n, k), int), np.empty((n, k), np.float32)
    for lo in range(0, n, 256):
        c = cand[lo : lo + 256]
        s = np.einsum("nd,ncd->nc", x[lo : lo + 256], x.take(c.ravel(), axis=0).reshape(*c.shape, -1))
        ids, sims = np.concatenate([nb[lo : lo + 256], c], 1), np.concatenate([sim[lo : lo + 256], s], 1)
        sims[ids == np.arange(lo, lo + len(c))[:, None]] = -2
        start = np.arange(len(c))[:, None] * wide
        key = np.sort(ids << bits | place, axis=1)  # by id, then place: numbers are sorted much faster than an order is found
        ids = key >> bits
        sims = sims.ravel().take((key & ((1 << bits) - 1)) + start)
        sims[:, 1:][ids[:, 1:] == ids[:, :-1]] = -2
        low = (-sims).view(np.int32).astype(np.int64)  # as whole numbers in the order of -sims
        low = np.where(low < 0, -0x80000000 - low, low) << bits | place
        top = np.sort(np.partition(low, k - 1, axis=1)[:, :k], axis=1) & ((1 << bits) - 1)
        out_nb[lo : lo + 256], out_sim[lo : lo + 256] = ids.ravel().take(top + start), sims.ravel().take(top + start)
    return out_nb, out_sim


def edges_of(nb: np.ndarray, sim: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Undirected edges (a < b, weight) with at least this similarity, each once."""
    a, b, w = np.repeat(np.arange(len(nb)), nb.shape[1]), nb.ravel(), sim.ravel()
    keep = (b >= 0) & (w >= least)
    a, b, w = np.minimum(a, b)[keep], np.maximum(a, b)[keep], w[keep]
    _, first = np.unique(a * len(nb) + b, return_index=True)
    return a[first], b[first], w[first]


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, rounds: int = 24, levels: int = 4, seed: int = SEED, scale: float = RESOLUTION) -> np.ndarray:
    """Labels by modularity of resolution 2m / ``scale``: local moves of half of the nodes a round, then the same on the
    contracted graph."""
    rng = np.random.default_rng(seed)
    label = np.arange(n)
    node, m = np.arange(n), float(w.sum())
    if m <= 0:
        return label
    self_w = np.zeros(n)
    for _ in range(levels):
        size = int(node.max()) + 1
        deg = np.bincount(a, w, size) + np.bincount(b, w, size) + 2 * self_w
        own = np.arange(size)
        src, dst, ww = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        moved_any = False
        for _ in range(rounds):
            total = np.bincount(own, deg, size)
            key, inv = np.unique(src * size + own[dst], return_inverse=True)
            s, c = key // size, key % size
            gain = np.bincount(inv, ww) - deg[s] * (total[c] - np.where(own[s] == c, deg[s], 0)) / scale
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else s  # keys are in the order of s, c
            most = np.maximum.reduceat(gain, first) if len(s) else gain
            at = np.flatnonzero((gain > 1e-9) & (gain == np.repeat(most, np.diff(np.append(first, len(s))))))
            best = own.copy()
            best[s[at[::-1]]] = c[at[::-1]]  # of equal gains the smallest label
            move = (best != own) & (rng.random(size) < 0.5)
            if not (best != own).any():
                break
            moved_any = True
            own = np.where(move, best, own)
        _, own = np.unique(own, return_inverse=True)
        node = own[node]
        if not moved_any:
            break
        k = int(own.max()) + 1
        inner = own[a] == own[b]
        self_w = np.bincount(own, self_w, k) + np.bincount(own[a[inner]], w[inner], k)
        lo, hi = np.minimum(own[a], own[b])[~inner], np.maximum(own[a], own[b])[~inner]
        key, inv = np.unique(lo * k + hi, return_inverse=True)
        w = np.bincount(inv, w[~inner]) if len(key) else np.zeros(0)
        a, b = key // k, key % k
    return node


def _propose(vectors: DataFrame, least: float, seed: int, seats: int, edges: bool) -> tuple[DataFrame, DataFrame | None] | None:
    """Communities over all blocks: (label, n, total), and with ``edges`` the links of each vector in its blocks as
    (name, near, weights). ``vectors`` are (name, emb, copies)."""
    spark = vectors.sparkSession
    sample, n = sample_of(vectors, SAMPLE_ROWS)
    if n < 2:
        return None
    dim = sample.shape[1]
    held = spark.sparkContext.broadcast(Lists.fit(vectors, sample, n, np.eye(dim, dtype=np.float32), BLOCK_ROWS, PART_ROWS, seed))

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = stack(pdf["emb"])
                row, to = held.value.nearest(v, seats)
                payload = packed(v)
                yield pd.DataFrame({"cell": to.astype(np.int32), "name": pdf["name"].to_numpy()[row], "copies": pdf["copies"].to_numpy()[row], "vec": [payload[i] for i in row]})

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        x, copies = unpacked(pdf["vec"]), pdf["copies"].to_numpy()
        nb, sim = descend(x, seed=seed)
        a, b, w = edges_of(nb, sim, least)
        label = communities(len(x), a, b, w)
        inner = label[a] == label[b]
        ties = np.bincount(a[inner], minlength=len(x)) + np.bincount(b[inner], minlength=len(x))
        used = (ties >= TIES) | (copies > 1)
        columns = ["name", "label", "n", "total", "near", "weights"]
        parts = []
        names = pdf["name"].to_numpy()
        tag = f"{int(pdf['cell'].iloc[0])}." if len(pdf) else ""
        if used.any():
            parts.append(pd.DataFrame({"name": names[used], "label": [tag + str(k) for k in label[used]], "n": None, "total": None, "near": None, "weights": None}))
            ks, inv = np.unique(label[used], return_inverse=True)
            total = np.zeros((len(ks), dim), np.float64)
            np.add.at(total, inv, x[used] * copies[used, None])
            parts.append(pd.DataFrame({"name": None, "label": [tag + str(k) for k in ks], "n": np.bincount(inv, copies[used], len(ks)).astype(int), "total": list(total), "near": None, "weights": None}))
        if edges and len(x):
            at = [np.flatnonzero(g) for g in (nb >= 0) & (sim >= least)]
            parts.append(pd.DataFrame({"name": names, "label": None, "n": None, "total": None, "near": [names[r[k]] for r, k in zip(nb, at, strict=True)], "weights": [r[k].astype(float) for r, k in zip(sim, at, strict=True)]}))
        return pd.concat([p.astype(object) for p in parts]) if parts else pd.DataFrame([], columns=columns)

    out = vectors.mapInPandas(placed, "cell int, name string, copies long, vec binary").groupBy("cell")
    rows = cut(out.applyInPandas(grouped, "name string, label string, n long, total array<double>, near array<string>, weights array<double>"), "blocks")
    sums = rows.filter(F.col("total").isNotNull()).select("label", "n", "total")
    nodes = rows.filter(F.col("name").isNotNull() & F.col("label").isNotNull()).select("name", "label")
    held_in = nodes.groupBy("name").agg(F.array_sort(F.collect_set("label")).alias("seats")).filter(F.size("seats") > 1)  # as many as a vector has seats
    pair = F.flatten(F.transform("seats", lambda x: F.transform(F.filter("seats", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    links = cut(held_in.select(F.explode(pair).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").cast("double").alias("w")), "links")
    merged = merge_contracted(sums.select("label"), links)
    found = sums.join(merged, "label").select(F.col("group").alias("label"), "n", "total")
    return found, rows.filter(F.col("near").isNotNull()).select("name", "near", "weights") if edges else None


def merge_contracted(nodes: DataFrame, links: DataFrame, scale: float = CONTRACTED, few: int = FEW_LINKS) -> DataFrame:
    """(label, group): nodes of a contracted graph, merged as long as that raises modularity of resolution 2m / ``scale``.

    In each round every group chooses the partner with which it gains most. Pairs that choose each other merge, and those
    that chose one of the pair join it if they gain even when all others join too; so every round raises modularity, and
    the rounds end, when no merger does so any more. The rounds are joins; up to ``few`` links one task does the same."""
    groups = nodes.distinct().select("label", F.col("label").alias("group"))
    if links.count() <= few:
        moved = links.repartition(1).mapInPandas(lambda batches: _merged(batches, scale), "label string, into string")
        return groups.join(moved, "label", "left").select("label", F.coalesce("into", "group").alias("group"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    k = both.groupBy("a").agg(F.sum("w").alias("k"))
    both = cut(both.join(k, "a").join(k.select(F.col("a").alias("b"), F.col("k").alias("kb")), "b"), "links")
    while True:
        gains = both.withColumn("gain", F.col("w") - F.col("k") * F.col("kb") / scale).filter("gain > 0")
        order = F.struct("gain", F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y"))
        best = gains.groupBy("a").agg(F.max_by(F.struct("b", "w", "k", "kb"), order).alias("c")).select("a", "c.*")
        back = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        pairs = best.join(back, "b").filter((F.col("back") == F.col("a")) & (F.col("a") < F.col("b"))).select(F.col("a").alias("centre"), F.col("b").alias("partner"))
        chosen = best.join(pairs.withColumnRenamed("centre", "b"), "b")
        load = chosen.groupBy("b").agg(F.sum("k").alias("load"))
        joins = chosen.join(load, "b").filter((F.col("a") == F.col("partner")) | (F.col("w") - F.col("k") * (F.col("kb") + F.col("load") - F.col("k")) / scale > 0))
        step = cut(joins.select(F.col("a").alias("gone"), F.col("b").alias("into"), "k", "kb"), "merged")
        if not step.limit(1).count():
            return groups
        total = step.groupBy("into").agg((F.max("kb") + F.sum("k")).alias("grown"))
        moved = step.select(F.col("gone").alias("node"), "into").unionByName(total.select(F.col("into").alias("node"), "into")).join(total, "into")

        def renamed(df: DataFrame, column: str, degree: str, moved: DataFrame = moved) -> DataFrame:
            to = df.join(moved.withColumnRenamed("node", column), column, "left")
            return to.withColumn(column, F.coalesce("into", column)).withColumn(degree, F.coalesce("grown", degree)).drop("into", "grown")

        both = cut(renamed(renamed(both, "a", "k"), "b", "kb").filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("kb").alias("kb")), "links")
        groups = cut(groups.join(step.select(F.col("gone").alias("group"), "into"), "group", "left").select("label", F.coalesce("into", "group").alias("group")), "named")


def _merged(batches: Iterator[pd.DataFrame], scale: float) -> Iterator[pd.DataFrame]:
    """The rounds of merge_contracted() over links that one task holds: (label, into) of the nodes that have links."""
    pdf = pd.concat(list(batches) or [pd.DataFrame({"a": [], "b": [], "w": []})])
    code, names = pd.factorize(np.concatenate([pdf["a"].to_numpy(object), pdf["b"].to_numpy(object)]), sort=True)
    if not len(names):
        return
    half = len(pdf)
    a, b, w = code, np.concatenate([code[half:], code[:half]]), np.tile(pdf["w"].to_numpy(float), 2)
    k, group = np.bincount(a, w, len(names)), np.arange(len(names))
    while True:
        gain = w - k[a] * k[b] / scale
        at = np.flatnonzero(gain > 0)
        order = at[np.lexsort((np.minimum(a, b)[at], np.maximum(a, b)[at], gain[at], a[at]))]
        last = order[np.concatenate([a[order][1:] != a[order][:-1], [True]])] if len(order) else order  # the best of each a
        best = np.full(len(names), -1)
        best[a[last]] = b[last]
        one = np.flatnonzero(best >= 0)
        mutual = one[best[best[one]] == one]
        centre = np.zeros(len(names), bool)
        centre[np.minimum(mutual, best[mutual])] = True
        into = last[centre[b[last]]]
        load = np.bincount(b[into], k[a[into]], len(names))
        joins = into[(best[b[into]] == a[into]) | (w[into] - k[a[into]] * (k[b[into]] + load[b[into]] - k[a[into]]) / scale > 0)]
        if not len(joins):
            break
        to = np.arange(len(names))
        to[a[joins]] = b[joins]
        k, group = np.bincount(to, k, len(names)), to[group]
        a, b = to[a], to[b]
        key, inv = np.unique(a * len(names) + b, return_inverse=True)
        w = np.bincount(inv, w)
        a, b = key // len(names), key % len(names)
        keep = a != b
        a, b, w = a[keep], b[keep], w[keep]
    yield pd.DataFrame({"label": names, "into": names[group]})


def total_of(parts: DataFrame) -> DataFrame:
    """(label, n, total) summed by label; parts of a label are added up before the shuffle."""

    def add(batches: Iterator[pd.DataFrame], first: bool) -> Iterator[pd.DataFrame]:
        held: tuple = ()
        for pdf in batches:
            if len(pdf):
                total = np.stack(pdf["total"].to_numpy()).astype(float) if first else np.frombuffer(b"".join(pdf["total"]), np.float32).reshape(len(pdf), -1)
                new = pdf["label"].to_numpy(), pdf["n"].to_numpy(), total
                held = _added(*(np.concatenate(x) for x in zip(held, new, strict=True))) if held else _added(*new)
        if held:
            yield pd.DataFrame({"label": held[0], "n": held[1], "total": [x.tobytes() for x in held[2].astype(np.float32)] if first else list(held[2])})

    parted = parts.select("label", "n", "total").mapInPandas(lambda batches: add(batches, True), "label string, n long, total binary").repartition("label")
    return parted.mapInPandas(lambda batches: add(batches, False), "label string, n long, total array<double>")


def _added(label: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each label once, with the sums of its numbers and totals."""
    code, names = pd.factorize(label)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(names)))
    return names, np.add.reduceat(n[order].astype(np.int64), first), np.add.reduceat(total[order].astype(float), first, axis=0)


def _means(sums: DataFrame) -> DataFrame:
    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                total = np.stack(pdf["total"].to_numpy()).astype(float)
                norm = np.sqrt((total * total).sum(1))
                some = norm > 0
                yield pd.DataFrame({"name": pdf["label"].to_numpy()[some], "emb": list((total[some] / norm[some, None]).astype(np.float32))})

    return sums.select("label", "total").mapInPandas(unit, "name string, emb array<float>")


def united(sums: DataFrame, same: float = SAME) -> DataFrame:
    """Sums with the labels of communities of one mean direction made equal (smallest label, by repeated joins)."""
    sums = cut(sums, "sums")
    means = _means(sums)
    if means.count() <= FEW_MEANS:
        pdf = means.toPandas().sort_values("name")
        names, m = pdf["name"].to_numpy(), stack(pdf["emb"])
        low = np.arange(len(m))
        for lo in range(0, len(m), 256):
            row, to = np.nonzero(m[lo : lo + 256] @ m.T >= same)
            bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else row
            for k, end in zip(bounds[:-1], bounds[1:], strict=True):
                _join(low, np.append(to[k:end], lo + row[k]))
        while (low[low] != low).any():
            low = low[low]
        groups = sums.sparkSession.createDataFrame([(str(a), str(names[k])) for a, k in zip(names, low, strict=True)], "label string, group string")
        return total_of(sums.join(F.broadcast(groups), "label").select(F.col("group").alias("label"), "n", "total"))
    means = cut(means, "means")

    def alike(batches: Iterator[pd.DataFrame], names: np.ndarray, m: np.ndarray) -> Iterator[pd.DataFrame]:
        """Pairs that join what all alike pairs join; their number grows with the means, not with the pairs."""
        root = np.arange(len(names))
        for pdf in batches:
            x, mine = stack(pdf["emb"]), np.full(len(pdf), -1)
            for lo in range(0, len(x), 1024):
                for at in range(0, len(m), 4096):
                    row, to = np.nonzero(x[lo : lo + 1024] @ m[at : at + 4096].T >= same)
                    bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else row
                    for k, end in zip(bounds[:-1], bounds[1:], strict=True):
                        r, near = lo + row[k], to[k:end] + at
                        near = near if mine[r] < 0 else np.append(near, mine[r])
                        mine[r] = _join(root, near) if len(near) > 1 else near[0]
            some = mine >= 0
            yield pd.DataFrame({"vec_a": pdf["name"].to_numpy()[some], "vec_b": names[mine[some]]})
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield pd.DataFrame({"vec_a": names[moved], "vec_b": names[root[moved]]})

    pairs = _held_against(means, means, alike, "vec_a string, vec_b string").filter("vec_a <> vec_b")
    both = cut(pairs.unionByName(pairs.select(F.col("vec_b").alias("vec_a"), F.col("vec_a").alias("vec_b"))).distinct(), "pairs")
    groups = sums.select("label", F.col("label").alias("group"))
    before = None
    while True:
        low = both.join(groups.select(F.col("label").alias("vec_b"), "group"), "vec_b").groupBy(F.col("vec_a").alias("label")).agg(F.min("group").alias("low"))
        groups = cut(groups.join(low, "label", "left").select("label", F.least("group", F.coalesce("low", "group")).alias("group")), "united")
        check = groups.agg(F.sum(F.xxhash64("label", "group").cast("decimal(38,0)"))).first()[0]
        if check == before:
            break
        before = check
    return total_of(sums.join(groups, "label").select(F.col("group").alias("label"), "n", "total"))


def _join(root: np.ndarray, nodes: np.ndarray) -> int:
    """Make the sets of these nodes one. ``root`` leads from each node to smaller ones, to the smallest of its set."""
    top = root[nodes]
    while (root[top] != top).any():
        top = root[top]
    low = top.min()
    root[top] = root[nodes] = low
    return low


def _held_against(vectors: DataFrame, means: DataFrame, use: Callable[[Iterator[pd.DataFrame], np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``use`` makes of all vectors and each block of about MOST_MEANS means (names and directions), in turn."""
    blocks = max(1, -(-means.count() // MOST_MEANS))
    out = None
    for k in range(blocks):
        path = written(means.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k), "held")
        part = vectors.mapInPandas(lambda batches, path=path: use(batches, *_kept((path,), _directions)), schema)
        out = part if out is None else out.unionByName(part)
    return out


#: What this process has built last from tables of the shared folder; the next tasks of a worker use it again.
_last: dict[tuple[str, ...], object] = {}


def _kept(paths: tuple[str, ...], build: Callable[..., object]) -> object:
    """``build(*paths)``, once as long as nothing else is asked for in this process."""
    if paths not in _last:
        _last.clear()
        _last[paths] = build(*paths)
    return _last[paths]


def _directions(path: str, *more: str) -> tuple[np.ndarray, ...]:
    """Names and directions in the order of names, and more columns of numbers, read from where they were written."""
    parts = [(b.column("name").to_numpy(zero_copy_only=False), *(b.column(c).flatten().to_numpy().reshape(b.num_rows, -1) for c in ("emb", *more))) for b in stored(path, "name", "emb", *more) if b.num_rows]
    if not parts:
        return np.zeros(0, object), *(np.zeros((0, 1), kind) for kind in (np.float32, *(np.int32 for _ in more)))
    columns = list(zip(*parts, strict=True))
    del parts
    names = np.concatenate(columns[0]).astype(object)
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    out = []
    for k in range(1, len(columns)):
        whole, at = np.empty((len(names), columns[k][0].shape[1]), columns[k][0].dtype), 0
        for rows in columns[k]:
            whole[rank[at : at + len(rows)]] = rows
            at += len(rows)
        columns[k] = ()
        out.append(whole)
    return names[order], *out


class Beside:
    """Means of which a vector is given the most similar one. Many of them stand in lists, by centroids ``c``; ``near`` are
    the lists of each mean."""

    def __init__(self, names: np.ndarray, m: np.ndarray, c: np.ndarray | None = None, near: np.ndarray | None = None):
        self.names, self.m, self.c = names, m, c
        if c is not None:
            parts = range(0, len(near), INDEXED)
            sizes = sum((np.bincount(near[lo : lo + INDEXED].ravel(), minlength=len(c)) for lo in parts), np.zeros(len(c), np.int64))
            self.at, self.start = np.empty(near.size, np.int32), np.concatenate([[0], np.cumsum(sizes)])
            free = self.start[:-1].copy()
            for lo in parts:
                flat = near[lo : lo + INDEXED].ravel()
                order = np.argsort(flat, kind="stable")
                first = np.searchsorted(flat[order], np.arange(len(c) + 1))
                self.at[(free - first[:-1])[flat[order]] + np.arange(len(order))] = lo + order // near.shape[1]
                free += np.diff(first)

    def best(self, x: np.ndarray, least: float, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The most similar mean of each row, as far as one was found, and its cosine. With ``whole`` rows whose best in the
        lists is below FIRM or ``least`` are compared with all means."""
        k, s = np.zeros(len(x), np.int64), np.full(len(x), -2, np.float32)
        if not len(self.m):
            return k, s
        rest = np.arange(len(x))
        if self.c is not None:
            row, to = np.repeat(rest, LOOKS), _next(x, self.c, LOOKS).ravel()
            order = np.argsort(to, kind="stable")
            bounds = np.searchsorted(to[order], np.arange(len(self.c) + 1))
            for i in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(self.start) > 0)):
                at = self.at[self.start[i] : self.start[i + 1]]
                m, rows = self.m[at], row[order[bounds[i] : bounds[i + 1]]]
                self._take(k, s, rows, x[rows], m, at)
            rest = np.flatnonzero(s < max(FIRM, least)) if whole else rest[:0]
        for lo in range(0, len(rest), 1024):
            rows = rest[lo : lo + 1024]
            part = x[rows]
            for j in range(0, len(self.m), 4096):
                self._take(k, s, rows, part, self.m[j : j + 4096], np.arange(j, min(j + 4096, len(self.m))))
        return k, s

    @staticmethod
    def _take(k: np.ndarray, s: np.ndarray, rows: np.ndarray, x: np.ndarray, m: np.ndarray, at: np.ndarray) -> None:
        """Give the rows the best of the means ``m``, numbered ``at``, where it is better than what they have."""
        p = x @ m.T
        j = p.argmax(1)
        p, j = p[np.arange(len(rows)), j], at[j]
        good = (p > s[rows]) | ((p == s[rows]) & (j < k[rows]))
        k[rows[good]], s[rows[good]] = j[good], p[good]


def _next(x: np.ndarray, c: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` centroids most similar to each row."""
    count = min(count, len(c))
    return np.concatenate([np.argpartition(x[lo : lo + 1024] @ -c.T, count - 1, axis=1)[:, :count].astype(np.int32) for lo in range(0, len(x), 1024)])


def _beside(vectors: DataFrame, means: DataFrame, use: Callable[[Iterator[pd.DataFrame], Beside], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``use`` makes of all vectors and each block of about MOST_MEANS means, in turn. Tasks read the means from where
    they were written; only the centroids of the lists are broadcast."""
    sc, n = vectors.sparkSession.sparkContext, means.count()
    blocks = max(1, -(-n // MOST_MEANS))
    spread = None
    if n // blocks > ALL_MEANS:
        c = fit_centroids(sample_of(means, SAMPLE_ROWS)[0], min(MEAN_LISTS, n // blocks // MEANS_A_LIST), rounds=4)
        spread = sc.broadcast(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9))

        def stand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(near=list(_next(stack(pdf["emb"]), spread.value, STANDS)))

        means = means.repartition(sc.defaultParallelism).mapInPandas(stand, "name string, emb array<float>, near array<int>")
        means = cut(means, "stands") if blocks > 1 else means

    def built(path: str) -> Beside:
        names, m, *near = _directions(path, *(["near"] if spread else []))
        return Beside(names, m, spread.value if spread else None, *near)

    out = None
    for b in range(blocks):
        path = written(means.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b) if blocks > 1 else means, "held")
        part = vectors.mapInPandas(lambda batches, path=path: use(_together(batches), _kept((path,), built)), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches, joined to some TOGETHER rows each."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        held.append(pdf)
        if sum(map(len, held)) >= TOGETHER:
            yield pd.concat(held)
            held = []
    if sum(map(len, held)):
        yield pd.concat(held)


def assigned(vectors: DataFrame, sums: DataFrame, cosine: float, whole: bool = True) -> DataFrame:
    """(name, label): each vector with the most similar mean, where the cosine is at least ``cosine``.

    Among many means a vector looks into some lists first. It keeps what it finds there from a cosine of FIRM on, where
    hardly any other mean is nearer; all others, and so all that seem to be in no group, are compared with every mean.
    Without ``whole`` those are left out that the lists do not hold; while groups are formed, they come round again."""
    means = cut(_means(sums), "means")

    def closest(batches: Iterator[pd.DataFrame], beside: Beside) -> Iterator[pd.DataFrame]:
        for part in batches:
            k, s = beside.best(stack(part["emb"]), cosine, whole)
            keep = s >= cosine
            if keep.any():
                yield pd.DataFrame({"name": part["name"].to_numpy()[keep], "label": beside.names[k[keep]], "near": s[keep]})

    found = _beside(vectors.select("name", "emb"), means, closest, "name string, label string, near float")
    if means.count() > MOST_MEANS:  # the best of all blocks
        return found.groupBy("name").agg(F.min(F.struct((-F.col("near")).alias("far"), "label")).alias("b")).select("name", F.col("b.label").alias("label"))
    return found.drop("near")


def drawn(vectors: DataFrame, sums: DataFrame, cosine: float) -> DataFrame:
    """(label, n, total): the sums of what assigned() gives to each mean, as far as its lists hold it, without moving
    vectors while a task holds all means."""
    means = cut(_means(sums), "means")
    if means.count() > MOST_MEANS:
        return _sums_of(assigned(vectors, sums, cosine, False).join(vectors, "name"))

    def closest(batches: Iterator[pd.DataFrame], beside: Beside) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = stack(part["emb"])
            k, s = beside.best(x, cosine, False)
            keep = s >= cosine
            if keep.any():
                copies = part["copies"].to_numpy()[keep]
                at, n, total = _added(k[keep], copies, x[keep].astype(float) * copies[:, None])
                yield pd.DataFrame({"label": beside.names[at], "n": n, "total": list(total)})

    return total_of(_beside(vectors, means, closest, "label string, n long, total array<double>"))


def _sums_of(members: DataFrame) -> DataFrame:
    return total_of(members.select("label", F.col("copies").alias("n"), F.transform("emb", lambda x: x.cast("double") * F.col("copies")).alias("total")))


def lasting(members: DataFrame, cosine: float) -> DataFrame:
    """(name, label, cosine): members (name, label, emb) without those that their own group's mean does not hold, which
    moves the mean, until all that are left are held. A member must have passed all earlier means."""
    members = cut(members, "members")
    sums = cut(_sums_of(members.withColumn("copies", F.lit(1).cast("bigint"))), "sums")
    blocks = max(1, -(-sums.count() // MOST_MEANS))
    history: list[tuple[str, ...]] = [()] * blocks

    def hold(sums: DataFrame) -> None:
        for b in range(blocks):
            history[b] += (written(_means(sums).filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == b), "held"),)

    def built(*paths: str) -> tuple:
        names, first = _directions(paths[0])
        later = []
        for moved, m in map(_directions, paths[1:]):
            row = np.full(len(names), -1, np.int32)
            row[np.searchsorted(names, moved)] = np.arange(len(moved))
            later.append((row, m))
        return names, first, later, {x: i for i, x in enumerate(names)}

    def checked(final: bool) -> DataFrame:
        out = None
        for b in range(blocks):

            def check(batches: Iterator[pd.DataFrame], paths=history[b]) -> Iterator[pd.DataFrame]:
                names, first, later, at_of = _kept(paths, built)
                total, n = np.zeros(first.shape), np.zeros(len(names), np.int64)
                for pdf in batches:
                    k = np.array([at_of.get(x, -1) for x in pdf["label"]], int)
                    pdf, k = pdf[k >= 0], k[k >= 0]
                    if not len(pdf):
                        continue
                    x = stack(pdf["emb"])
                    near = np.einsum("nd,nd->n", x, first[k])
                    good = near >= cosine
                    for row, m in later:
                        at = np.flatnonzero(row[k] >= 0)
                        near[at] = np.einsum("nd,nd->n", x[at], m[row[k[at]]])
                        good &= near >= cosine
                    if final:
                        yield pd.DataFrame({"name": pdf["name"].to_numpy()[good], "label": pdf["label"].to_numpy()[good], "cosine": near[good].astype(float)})
                    else:
                        np.add.at(total, k[good], x[good])
                        np.add.at(n, k[good], 1)
                at = np.flatnonzero(n)
                if not final and len(at):
                    yield pd.DataFrame({"label": names[at], "n": n[at], "total": list(total[at])})

            part = members.mapInPandas(check, "name string, label string, cosine double" if final else "label string, n long, total array<double>")
            out = part if out is None else out.unionByName(part)
        return out

    hold(sums)
    before = sums.agg(F.sum("n")).first()[0]
    while before:
        now = cut(total_of(checked(False)), "sums")
        after = now.agg(F.sum("n")).first()[0]
        if after == before:
            break
        hold(now.join(sums.select("label", F.col("n").alias("was")), "label").filter("n <> was"))  # the other means have not moved
        before, sums = after, now
    return checked(True)


def with_copies(vectors: DataFrame) -> DataFrame:
    """(name, emb, copies): where many vectors are equal, one with their number, so that they do not fill a block."""
    key = F.xxhash64("emb")
    many = vectors.groupBy(key.alias("_h")).agg(F.count("*").alias("_n"), F.min("name").alias("_first")).filter(F.col("_n") >= COPIES)
    if not many.limit(1).count():
        return vectors.select("name", "emb", F.lit(1).cast("bigint").alias("copies"))
    many = F.broadcast(many) if fits_broadcast(many, BROADCAST_ROWS) else many
    rows = vectors.withColumn("_h", key).join(many, "_h", "left").filter(F.col("_first").isNull() | (F.col("_first") == F.col("name")))
    return cut(rows.select("name", "emb", F.coalesce("_n", F.lit(1)).cast("bigint").alias("copies")), "single")


def similarity_groups(vectors: DataFrame, cosine: float = 0.65, least: int = 5, passes: int = 3, degrees: bool = True) -> DataFrame:
    """(name, label, degree, cosine): the members of every group.

    A group has at least ``least`` vectors, each with a cosine of at least ``cosine`` to the mean direction of the group.
    ``label`` is the smallest member's name. ``degree`` is the sum of the similarities of the member's links, in the
    neighbour graph, to members of its group; 0 without ``degrees``, and for copies that another vector stands for.
    ``vectors`` as from neighbours.prepare(); an empty table gives no rows. Links are kept from a similarity of cosine
    squared on, which members at the border of a group have on average.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors, "vectors")
    rest = single = with_copies(vectors)
    sums, linked = None, None
    for k in range(passes):
        made = _propose(rest, cosine * cosine, SEED + k, SEATS[min(k, len(SEATS) - 1)], degrees)
        if made is None:
            break
        parts, edges = made
        linked = edges if linked is None or edges is None else linked.unionByName(edges)
        found = total_of(parts).filter(F.col("n") >= (least if k == 0 else least - 2)).withColumn("label", F.concat(F.lit(f"{k}/"), "label"))
        for few in (2, least):  # parts of one group draw together before small ones are dropped
            found = cut(drawn(rest, united(found), cosine).filter(F.col("n") >= few), "groups")
        sums = found if sums is None else sums.unionByName(found)
        if k + 1 < passes:
            rest = cut(rest.join(assigned(rest, found, cosine, False).select("name"), "name", "left_anti"), "rest")
    if sums is None:
        return spark.createDataFrame([], "name string, label string, degree double, cosine double")
    final = assigned(vectors, united(sums), cosine)
    kept = cut(lasting(final.join(vectors, "name").select("name", "label", "emb"), cosine), "kept")
    sizes = kept.groupBy("label").agg(F.count("*").alias("n"), F.min("name").alias("first")).filter(F.col("n") >= least)
    members = kept.join(sizes, "label").select("name", F.col("first").alias("label"), "cosine")
    if not degrees:
        return members.select("name", "label", F.lit(0.0).alias("degree"), "cosine")
    return members.join(inner_degrees(members, linked), "name", "left").select("name", "label", F.coalesce("degree", F.lit(0.0)).alias("degree"), "cosine")


def inner_degrees(members: DataFrame, linked: DataFrame) -> DataFrame:
    """(name, degree): the weights of each member's links, in either direction, to members of the same group."""
    out = linked.select("name", F.explode(F.arrays_zip("near", "weights")).alias("e")).select("name", F.col("e.near").alias("other"), F.round("e.weights", 4).alias("w"))
    links = out.unionByName(out.select(F.col("other").alias("name"), F.col("name").alias("other"), "w")).groupBy("name", "other").agg(F.max("w").alias("w"))
    labels = members.select("name", "label")
    same = links.join(labels, "name").join(labels.select(F.col("name").alias("other"), F.col("label").alias("beside")), "other").filter("label = beside")
    return same.groupBy("name").agg(F.sum("w").alias("degree"))
