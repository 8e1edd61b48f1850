"""Top-N, similar vectors, term scores and groups against brute force, with the awkward cases."""

import math
import pickle
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from postloom.llm import communities, neighbours, terms, topn
from tests.conftest import rows


def brute_top(data, n):
    best = defaultdict(dict)
    for g, c, t, s in data:
        if s is not None and not math.isnan(s) and t is not None:
            best[g, c][t] = max(s, best[g, c].get(t, -math.inf))
    return sorted(((g, c, t) for (g, c), d in best.items() for t, _ in sorted(d.items(), key=lambda x: (-x[1], x[0]))[:n]), key=repr)


@pytest.mark.parametrize("salt", [256, 1])
def test_top_n_against_brute_force(spark, salt):
    r = random.Random(3)
    data = [(r.choice(["", "a", None, "b"]), r.choice([0, 0, 0, 1, None]), r.randrange(60), r.choice([None, float("nan"), *[k / 4 for k in range(8)]])) for _ in range(900)]
    data += data[:100] + [("a", 1, None, 9.0)]
    df = spark.createDataFrame([(*x, "x", 1) for x in data], "g string, c int, t long, s double, n string, score long").repartition(7)
    got = topn.top_n(df, ["g", "c"], "s", "t", 5, salt_above=salt).select("g", "c", "t")
    assert rows(got) == brute_top(data, 5)


def test_top_n_of_an_empty_table_and_of_a_bad_n(spark):
    df = spark.createDataFrame([], "g string, t long, s double")
    assert topn.top_n(df, ["g"], "s", "t", 3).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(df, ["g"], "s", "t", 0)


def test_loser_tree_merges_any_number_of_runs():
    r = random.Random(5)
    for k in (0, 1, 2, 3, 7, 33):
        data = [[("g" + str(r.randrange(4)), 0, r.randrange(20), r.random()) for _ in range(r.randrange(30))] for _ in range(k)]
        runs = [topn.Run.of(pd.DataFrame(x, columns=["g", "c", "t", "s"]), ["g"], "s", "t", 4) for x in data]
        out = topn.merge(runs, 4)
        want = brute_top([(g, 0, t, s) for x in data for g, _, t, s in x], 4)
        assert sorted(((g[1], 0, t) for g, t in zip(out.groups, out.ties, strict=True)), key=repr) == want
        assert all(a <= b for a, b in zip(zip(out.groups, out.scores, strict=True), list(zip(out.groups, out.scores, strict=True))[1:], strict=False))


def clumps(n=400, groups=12, dim=32, noise=0.05, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    own = rng.integers(0, groups, n)
    x = c[own] + rng.normal(size=(n, dim)) * noise
    return x, own


def frame(spark, x, names=None):
    return spark.createDataFrame([(names[i] if names else f"v{i:04d}", [float(a) for a in v], "extra") for i, v in enumerate(x)], "name string, emb array<float>, cell string")


@pytest.mark.parametrize("list_rows,block_rows", [(6000, 8192), (40, 8192), (40, 16)])
def test_similar_pairs_against_brute_force(spark, list_rows, block_rows):
    x, _ = clumps()
    x[7] = x[3] * 2.5
    v = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.95, 1)), strict=True)}
    got = rows(neighbours.similar_pairs(neighbours.prepare(frame(spark, x), "name", "emb"), 0.95, list_rows=list_rows, block_rows=block_rows, sigmas=math.sqrt(32)))
    assert len(got) == len(set(got)) and len(set(got) ^ want) <= len(want) * 0.005 and len(want) > 500
    exact = rows(neighbours.similar_pairs(neighbours.prepare(frame(spark, x), "name", "emb"), 0.95, list_rows=list_rows, block_rows=block_rows, sigmas=math.sqrt(32), epsilon=math.inf))
    assert want <= set(exact) and len(exact) == len(set(exact)) and all(v[int(a[1:])] @ v[int(b[1:])] >= 0.95 - neighbours.SLACK for a, b in exact)
    quick = rows(neighbours.similar_pairs(neighbours.prepare(frame(spark, x), "name", "emb"), 0.95, list_rows=list_rows, block_rows=block_rows))
    assert len(set(quick) & want) >= 0.99 * len(want)


def test_divided_lists_lose_no_visit():
    x, _ = clumps(600, 9, dim=16, noise=0.2, seed=3)
    v = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = neighbours.fit_centroids(v, 5)
    own = ((c * c).sum(1) - 2 * v @ c.T).argmin(1)
    lists = neighbours.Lists(c, [neighbours.fit_centroids(v[own == k], 1 + 3 * k) for k in range(5)], np.ones(35, int))
    near = {(i, j) for i, j in zip(*np.nonzero(np.triu(v @ v.T >= 0.9, 1)), strict=True)}
    for later in (True, False):
        home, row, to = lists.visits(v, np.full(len(v), math.sqrt(0.2), np.float32), later)
        assert (home == lists.own(v)).all() and len(set(home)) > 20
        seen = set(zip(row.tolist(), to.tolist(), strict=True))
        assert len(seen) == len(row) and not any(home[i] == t for i, t in seen)
        assert all(home[i] == home[j] or ((i, home[j]) in seen) + ((j, home[i]) in seen) == (1 if later else 2) for i, j in near)
    row, to = lists.nearest(v, 3)
    assert len(row) == 3 * len(v) and (to.reshape(-1, 3) == home[:, None]).any(1).mean() > 0.99


def test_vectors_without_direction_are_left_out(spark):
    data = [("a", [1.0, 0.0]), ("a", [1.0, 1e-7]), ("b", [0.0, 0.0]), ("c", None), ("d", []), (None, [1.0, 0.0]), ("e", [2.0, 0.0]), ("f", [float("nan"), 1.0]), ("g", [None, 1.0])]
    v = neighbours.prepare(spark.createDataFrame(data, "name string, emb array<float>"), "name", "emb")
    assert [r["name"] for r in v.orderBy("name").collect()] == ["a", "e"]
    assert rows(neighbours.similar_pairs(v, 0.95)) == [("a", "e")]
    assert neighbours.similar_pairs(v.limit(0), 0.95).count() == 0 and neighbours.nearest(v.limit(0), v, 3).count() == 0


@pytest.mark.parametrize("block_rows", [2_400, 30, 8])
def test_nearest_finds_neighbours_in_lists_that_were_not_probed(spark, monkeypatch, block_rows):
    monkeypatch.setattr(neighbours, "MOST_LISTS", 6)  # so all lists are divided
    x, _ = clumps(900, 25, noise=0.3, seed=14)
    v = x / np.linalg.norm(x, axis=1, keepdims=True)
    all_ = neighbours.prepare(frame(spark, x), "name", "emb")
    got = defaultdict(list)
    for name, other, _, rank in sorted(rows(neighbours.nearest(all_, all_.filter("name like '%20' or name = 'v0001'"), 10, probes=1, list_rows=20, block_rows=block_rows, sigmas=math.sqrt(32), epsilon=math.inf)), key=lambda r: (r[0], r[3])):
        got[name].append(other)
        assert rank == len(got[name])
    assert len(got) == 10
    for name, near in got.items():
        s = v @ v[int(name[1:])]
        s[int(name[1:])] = -2
        assert near == [f"v{j:04d}" for j in np.argsort(-s)[:10]]


def test_nearest_reaches_the_recall(spark):
    x, _ = clumps(1500, 25, noise=0.2, seed=4)
    v = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    all_ = neighbours.prepare(frame(spark, x), "name", "emb")
    got = defaultdict(list)
    for name, other, *_ in rows(neighbours.nearest(all_, all_.filter("name like '%00'"), 10, probes=12, list_rows=60)):
        got[name].append(other)
    hit = 0
    for name, near in got.items():
        assert len(near) == 10 and name not in near
        s = v @ v[int(name[1:])]
        s[int(name[1:])] = -2
        hit += len({f"v{j:04d}" for j in np.argsort(-s)[:10]} & set(near))
    assert len(got) == 15 and hit >= 0.9 * 150


def test_terms_against_brute_force(spark):
    r = random.Random(2)
    words = ["ёж", "кот", "dog", "house", "дом-2", "сад", "tree", "rare", "x1abc"]
    texts = [(i, " ".join(r.choice(words).upper() if r.random() < 0.2 else r.choice(words) for _ in range(r.randrange(12)))) for i in range(60)] + [(60, None), (61, ""), (5, None), (None, "кот")]
    df = spark.createDataFrame([(*t, "z") for t in texts], "id long, text string, term string").union(spark.createDataFrame([(3, texts[3][1], "z")], "id long, text string, term string"))
    import re

    bags = {}
    for i, t in texts:
        if i is not None and (i not in bags or t):
            bags[i] = Counter(re.findall("[a-zа-яё]{3,}", (t or "").lower()))
    n = 62
    df_of = Counter(w for b in bags.values() for w in b)
    cf = Counter()
    for b in bags.values():
        cf.update(b)
    mean = sum(cf.values()) / n
    for limit in (2_000_000, 0):
        scored = terms.score_terms(terms.text_terms(df, "id", "text"), n, broadcast_rows=limit)
        got = {(x["rec_key"], x["term"]): (x["tf"], x["df"], x["dfr"]) for x in scored.collect()}
        assert set(got) == {(str(i), w) for i, b in bags.items() for w in b}
        for (i, w), (tf, d, dfr) in got.items():
            length = sum(bags[int(i)].values())
            tfn, m = tf * math.log2(1 + mean / length), cf[w] / n
            assert (tf, d) == (bags[int(i)][w], df_of[w])
            assert dfr == pytest.approx((math.log2(1 + m) + tfn * math.log2((1 + m) / m)) / (tfn + 1))
    lead = {tuple(x) for x in terms.leading_terms(scored, n, 40, 2).select("rec_key", "term").collect()}
    want = set()
    for i, b in bags.items():
        s = {w: f * math.log(n / df_of[w]) for w, f in b.items() if df_of[w] > 1}
        want |= {(str(i), w) for w, x in s.items() if x >= max(s.values()) - 1e-9 and df_of[w] <= 40 and b[w] >= 2}
    assert lead == want
    assert terms.score_terms(terms.text_terms(df.limit(0), "id", "text"), 0).count() == 0


def test_values_of_arrays_count_once(spark):
    df = spark.createDataFrame([("s", 1, ["a", "b", None, "a"], ["a"]), ("s", 1, ["a"], None), ("s", 2, None, None)], "section string, c int, x array<string>, y array<string>")
    assert rows(terms.value_terms(df, df["section"], "x", "y")) == [("s", "a", 1), ("s", "b", 1)]


def test_descent_finds_small_far_groups():
    x, own = clumps(600, 60, dim=32, noise=0.1, seed=6)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    nb, sim = communities.descend(x)
    exact = np.sort(x @ x.T - 3 * np.eye(len(x)), 1)[:, ::-1][:, : nb.shape[1]]
    assert (sim >= exact[:, -1:] - 1e-5).mean() > 0.85
    label = communities.communities(len(x), *communities.edges_of(nb, sim, 0.42))
    pure = sum(Counter(own[label == k]).most_common(1)[0][1] for k in set(label)) / len(x)
    assert pure > 0.9


def test_groups_meet_their_definition(spark):
    x, own = clumps(900, 30, dim=64, noise=0.09, seed=8)
    x = np.concatenate([x, np.random.default_rng(1).normal(size=(120, 64)), np.zeros((2, 64))])
    df = neighbours.prepare(frame(spark, x), "name", "emb")
    communities.BLOCK_ROWS, old = 200, communities.BLOCK_ROWS
    try:
        got = communities.similarity_groups(df).collect()
    finally:
        communities.BLOCK_ROWS = old
    groups = defaultdict(list)
    for r in got:
        groups[r["label"]].append(int(r["name"][1:]))
        assert r["cosine"] >= 0.65
    assert len({r["name"] for r in got}) == len(got)
    for first, members in groups.items():
        assert len(members) >= 5 and min(members) == int(first[1:])
    want = Counter(own)
    assert sorted(len(m) for m in groups.values()) == sorted(n for n in want.values() if n >= 5)
    assert communities.similarity_groups(df.limit(0)).count() == 0


def test_many_means_give_the_groups_of_few(spark, monkeypatch):
    rng = np.random.default_rng(12)
    chain = np.zeros((30, 64))  # from axis to axis in steps of which only neighbours are alike
    for k, t in enumerate(np.arange(30) * 0.9 * np.arccos(communities.SAME)):
        axis, turn = divmod(t, np.pi / 2)
        chain[k, int(axis)], chain[k, int(axis) + 1] = np.cos(turn), np.sin(turn)
    m = np.concatenate([chain, rng.normal(size=(150, 64))])
    sums = spark.createDataFrame([(f"m{i:04d}", 1, [float(x) for x in v]) for i, v in enumerate(m)], "label string, n long, total array<double>")
    x = np.concatenate([m, m]) / np.linalg.norm(np.concatenate([m, m]), axis=1, keepdims=True) + rng.normal(size=(2 * len(m), 64)) * 0.06
    v = neighbours.prepare(frame(spark, x), "name", "emb")
    got = []
    for few, most in ((8192, 65536), (10, 40)):
        monkeypatch.setattr(communities, "FEW_MEANS", few)
        monkeypatch.setattr(communities, "MOST_MEANS", most)
        got.append((rows(communities.united(sums).select("label", "n")), rows(communities.assigned(v, sums, 0.65).select("name", "label"))))
    assert got[0] == got[1] and len(got[0][0]) == 151 and ("m0000", len(chain)) in got[0][0]


def test_alike_means_are_joined_without_all_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(3, 64))
    m = np.concatenate([c[k] + rng.normal(size=(n, 64)) * 0.2 for k, n in enumerate((300, 40, 1))])
    sums = spark.createDataFrame([(f"m{i:04d}", 1, [float(x) for x in v]) for i, v in enumerate(m)], "label string, n long, total array<double>")
    laid, cut = {}, communities.cut

    def counted(df, label="step"):
        out = cut(df, label)
        laid[label] = max(laid.get(label, 0), out.count())
        return out

    monkeypatch.setattr(communities, "cut", counted)
    monkeypatch.setattr(communities, "FEW_MEANS", 10)
    for most in (10**6, 90):
        monkeypatch.setattr(communities, "MOST_MEANS", most)
        laid.clear()
        assert rows(communities.united(sums).select("label", "n")) == [("m0000", 300), ("m0300", 40), ("m0340", 1)]
        assert laid["pairs"] < 40 * len(m)  # of 91,601 alike pairs


def traced(f):
    """What ``f`` gives, and the MB of this process that it took at most."""
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_driver_holds_no_matrix_of_all_sampled_rows_or_means(spark):
    x = np.random.default_rng(5).normal(size=(20_000, 64)).astype(np.float32)
    c, most = traced(lambda: neighbours.fit_centroids(x, communities.MEAN_LISTS, rounds=2))
    assert c.shape == (communities.MEAN_LISTS, 64) and most < 100
    own, far = neighbours.closest(x[:300], c)
    d = ((x[:300, None].astype(float) - c[None]) ** 2).sum(2)
    assert (own == d.argmin(1)).all() and np.allclose(far + (x[:300] ** 2).sum(1), d.min(1), atol=1e-3)
    m = np.random.default_rng(6).normal(size=(1, 64)) + np.random.default_rng(7).normal(size=(3000, 64)) * 0.2
    sums = communities.cut(spark.createDataFrame([(f"m{i:04d}", 1, [float(a) for a in v]) for i, v in enumerate(m)], "label string, n long, total array<double>"))
    got, most = traced(lambda: rows(communities.united(sums).select("label", "n")))
    assert got == [("m0000", 3000)] and most < 50  # of 9 million alike pairs


def test_lists_of_means_and_their_slices_are_those_of_one(spark, monkeypatch):
    rng = np.random.default_rng(8)
    near = np.argsort(rng.random((500, 30)), axis=1)[:, :4].astype(np.int32)
    m = rng.normal(size=(500, 8)).astype(np.float32)
    means = spark.createDataFrame([(f"m{i:04d}", m[i].tolist(), near[i].tolist()) for i in rng.permutation(500)], "name string, emb array<float>, near array<int>")
    for most in (10**6, 37, 500, 499):
        monkeypatch.setattr(communities, "INDEXED", most)
        names, got, lists = communities._directions(communities.written(means.repartition(3)), "near")
        assert list(names) == [f"m{i:04d}" for i in range(500)] and (got == m).all() and (lists == near).all()
        beside = communities.Beside(names, got, m[:30], lists)
        for k in range(30):
            assert list(beside.at[beside.start[k] : beside.start[k + 1]]) == list(np.flatnonzero((near == k).any(1)))
    assert [len(x) for x in communities._directions(communities.written(means.limit(0)), "near")] == [0, 0, 0]


def test_means_do_not_pass_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(11)
    m = rng.normal(size=(300, 64))
    v = neighbours.prepare(frame(spark, np.concatenate([m, m + rng.normal(size=m.shape) * 0.1])), "name", "emb")
    sums = spark.createDataFrame([(f"m{i:04d}", 1, [float(a) for a in y]) for i, y in enumerate(m)], "label string, n long, total array<double>")
    sent, broadcast = [], spark.sparkContext.broadcast

    def counted(value):
        sent.append(len(pickle.dumps(value)))
        return broadcast(value)

    monkeypatch.setattr(spark.sparkContext, "broadcast", counted)
    monkeypatch.setattr(communities, "FEW_MEANS", 10)
    whole = rows(communities.assigned(v, sums, 0.65))
    united = rows(communities.united(sums).select("label", "n"))
    kept = communities.lasting(v.join(communities.assigned(v, sums, 0.65), "name"), 0.65).count()
    assert len(whole) == kept == 600 and len(united) == 300 and not sent
    monkeypatch.setattr(communities, "ALL_MEANS", 100)
    assert rows(communities.assigned(v, sums, 0.65)) == whole and max(sent) < 300 * 64 * 4 / 4  # centroids of lists


@pytest.mark.parametrize("most", [10**6, 7])
def test_members_last_that_all_means_hold_and_only_moved_means_are_held_again(spark, monkeypatch, most):
    rng = np.random.default_rng(10)
    c = rng.normal(size=(20, 64))
    spread = np.where(np.arange(20) < 4, 1.25, 0.4)
    g = np.repeat(np.arange(20), 40)
    x = c[g] + rng.normal(size=(800, 64)) * spread[g, None]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    held, written = [], communities.written

    def counted(df, label="step"):
        held.append(df.count() if label == "held" else 0)
        return written(df, label)

    monkeypatch.setattr(communities, "written", counted)
    monkeypatch.setattr(communities, "MOST_MEANS", most)
    df = spark.createDataFrame([(f"v{i:04d}", f"g{k:02d}", v.tolist()) for i, (k, v) in enumerate(zip(g, x, strict=True))], "name string, label string, emb array<float>")
    got = {r["name"]: r["cosine"] for r in communities.lasting(df, 0.65).collect()}
    want, rounds = {}, 0
    for k in range(20):
        at, last = np.flatnonzero(g == k), None
        for n in range(99):
            mean = x[at].sum(0) / np.linalg.norm(x[at].sum(0))
            keep = at[x[at] @ mean >= 0.65]
            if len(keep) == len(at):
                break
            at, rounds = keep, max(rounds, n + 1)
        want |= {f"v{i:04d}": float(x[i] @ mean) for i in at}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert rounds >= 2 and len(got) < 800 and 20 < sum(held) <= 20 + 4 * rounds


def test_lists_of_means_leave_no_vector_out(spark, monkeypatch):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(700, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    side = rng.normal(size=(2500, 64))
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = m[rng.integers(0, 700, 2500)] + side * rng.uniform(0.5, 1.4, (2500, 1))
    v = neighbours.prepare(frame(spark, x), "name", "emb")
    sums = spark.createDataFrame([(f"m{i:04d}", 1, [float(a) for a in y]) for i, y in enumerate(m)], "label string, n long, total array<double>")
    whole = rows(communities.assigned(v, sums, 0.65))
    single = communities.with_copies(v)
    monkeypatch.setattr(communities, "ALL_MEANS", 100)
    monkeypatch.setattr(communities, "STANDS", 2)
    monkeypatch.setattr(communities, "LOOKS", 1)
    assert 1000 < len(whole) < 2400 and rows(communities.assigned(v, sums, 0.65)) == whole
    some = communities.assigned(v, sums, 0.65, False)
    assert 0 < some.count() < len(whole) and set(rows(some)) <= set(whole)
    drawn = dict(rows(communities.drawn(single, sums, 0.65).select("label", "n")))
    assert drawn == dict(Counter(label for _, label in rows(some)))


def test_hot_cell_is_cut_and_put_together_again(spark):
    rng = np.random.default_rng(9)
    c = rng.normal(size=(2, 64))
    x = np.concatenate([c[:1] + rng.normal(size=(700, 64)) * 0.6, c[1:] + rng.normal(size=(20, 64)) * 0.6])
    communities.PART_ROWS, old = 150, communities.PART_ROWS
    try:
        got = communities.similarity_groups(neighbours.prepare(frame(spark, x), "name", "emb")).collect()
    finally:
        communities.PART_ROWS = old
    assert sorted(Counter(r["label"] for r in got).values()) == [20, 700]


def quality(links, group, scale):
    """Sum of what each group gains over chance."""
    k, inner, total = Counter(), Counter(), Counter()
    for a, b, w in links:
        k[a] += w
        k[b] += w
        inner[group[a]] += w * (group[a] == group[b])
    for x, d in k.items():
        total[group[x]] += d
    own = Counter()
    for x, d in k.items():
        own[group[x]] += d * d
    return sum(inner.values()) - sum(total[g] ** 2 - own[g] for g in total) / 2 / scale


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_contracted_graph_is_merged_alike_in_one_task_and_by_joins(spark, seed):
    r = random.Random(seed)
    pairs = Counter()
    for _ in range(400):
        a, b = r.sample(range(60), 2)
        if a // 6 == b // 6 or r.random() < 0.04:
            pairs[f"n{min(a, b):02d}", f"n{max(a, b):02d}"] += r.randrange(1, 5)
    links = spark.createDataFrame([(a, b, float(w)) for (a, b), w in pairs.items()], "a string, b string, w double")
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(60)] + [("alone",)], "label string")
    one, many = (dict(rows(communities.merge_contracted(nodes, links, 200.0, few))) for few in (10**6, 0))
    assert one == many and len(one) == 61 and one["alone"] == "alone"
    flat = [(a, b, w) for (a, b), w in pairs.items()]
    best = quality(flat, one, 200.0)
    assert best > quality(flat, {x: x for x in one}, 200.0)
    names = sorted(set(one.values()) - {"alone"})
    for i, x in enumerate(names):  # no merger is left that would gain
        for y in names[:i]:
            assert quality(flat, {n: y if g == x else g for n, g in one.items()}, 200.0) <= best + 1e-9
    assert communities.merge_contracted(nodes, links.limit(0)).filter("label <> group").count() == 0


@pytest.mark.parametrize("parts", [10, 50])
def test_small_groups_beside_a_hot_one_are_found(spark, monkeypatch, parts):
    rng = np.random.default_rng(parts)
    hot = rng.normal(size=(1, 64))
    hot /= np.linalg.norm(hot)
    side = hot * 0.45 + rng.normal(size=(24, 64)) / 8 * 0.89  # directions of small groups in the cells of the hot one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    sizes = [5 + k % 4 for k in range(24)]
    x = np.concatenate([hot + rng.normal(size=(1500, 64)) * 0.08, *(c + rng.normal(size=(n, 64)) * 0.05 for c, n in zip(side, sizes, strict=True))])
    monkeypatch.setattr(communities, "BLOCK_ROWS", 1500 // parts)
    monkeypatch.setattr(communities, "PART_ROWS", 3000 // parts)
    got = communities.similarity_groups(neighbours.prepare(frame(spark, x), "name", "emb"), degrees=False).collect()
    label = {int(r["name"][1:]): r["label"] for r in got}
    bounds = np.cumsum([1500, *sizes])
    assert len({label[k] for k in range(1500)}) == 1
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):  # two of them may be one group by the definition, none is torn
        assert len({label[k] for k in range(lo, hi)}) == 1 and label[lo] != label[0]


def test_copies_of_one_vector_count_and_fill_no_block(spark):
    x, own = clumps(300, 6, dim=64, noise=0.05, seed=5)
    x = np.concatenate([x, np.repeat(x[:1], 200, 0)])
    v = neighbours.prepare(frame(spark, x), "name", "emb")
    single = communities.with_copies(v)
    assert sorted(r["copies"] for r in single.collect()) == [1] * 299 + [201]
    got = communities.similarity_groups(v).collect()
    assert sorted(Counter(r["label"] for r in got).values()) == sorted(n + 200 * (k == own[0]) for k, n in Counter(own).items())


def test_degree_counts_links_inside_the_final_group(spark):
    linked = spark.createDataFrame([("a", ["b", "c"], [0.9, 0.8]), ("b", ["a"], [0.9]), ("c", ["d"], [0.7]), ("d", [], []), ("e", ["a"], [0.6])], "name string, near array<string>, weights array<double>")
    members = spark.createDataFrame([("a", "a"), ("b", "a"), ("d", "a"), ("e", "a"), ("c", "c")], "name string, label string")
    assert {n: round(d, 4) for n, d in rows(communities.inner_degrees(members, linked))} == {"a": 1.5, "b": 0.9, "e": 0.6}
