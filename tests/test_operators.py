import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.operators import clustering, moderation, retrieval, style, trends
from tests.conftest import rows


def test_recency_and_trend(spark):
    m = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("a", 2, 3)], "section string, cluster_id int, topic_id long")
    t = spark.sql("select 1L id, timestamp'2024-01-24 00:00:00' created_at union all select 2L, timestamp'2024-01-23 23:59:59' union all select 3L, timestamp'2020-01-01 00:00:00'")
    rec = trends.recency(m, t, "2024-01-31 00:00:00")
    assert rows(rec) == [("a", 1, 1, 2), ("a", 2, 0, 0)]
    pop = spark.createDataFrame([("a", 1, 99), ("b", 7, None)], "section string, cluster_id int, total_count_30d long")
    got = {(r["section"], r["cluster_id"]): r["trend_score"] for r in trends.trend(pop, rec).collect()}
    assert set(got) == {("a", 1), ("b", 7)} and got["b", 7] == 0
    assert got["a", 1] == pytest.approx(0.2 * 0.7 + np.log10(2) * 0.2 + np.log10(3) * 0.1)


def posts(spark):
    data = [("s", 1, 1, "red hat", [1.0, 0.0]), ("s", 1, 2, "blue", [0.9, 0.1]), ("s", 2, 3, "red", [0.0, 1.0]), ("u", 3, 4, None, [0.8, 0.0])]
    return spark.createDataFrame(data, "section string, cluster_id int, post_id long, text string, emb array<double>")


def test_rerank_limits_before_it_restricts(spark):
    got = {r["cluster_id"]: r for r in retrieval.rerank(posts(spark), [1.0, 0.0], [2], 2, "red", 1.5).collect()}
    assert got == {}  # both places of the limit go to other clusters
    got = {r["cluster_id"]: r for r in retrieval.rerank(posts(spark), [1.0, 0.0], [1, 2], 2, "red", 1.85).collect()}
    assert got[1]["cluster_size"] == 2 and got[1]["post_hits_at_tau"] == 2 and got[1]["lex_hits_count"] == 1 and got[1]["lex_dens"] == 0.5
    none = retrieval.rerank(posts(spark), [1.0, 0.0], [1], 2, None, 1.85).first()
    assert none["post_hits_at_tau"] is None and none["lex_hits_count"] == 0


def test_discover_leaves_out_known_clusters(spark):
    got = retrieval.discover(posts(spark), [1.0, 0.0], [1], None, None).collect()
    assert [r["cluster_id"] for r in got] == [3, 2] and got[0]["sem_hits_in_top"] is None


def test_cluster_in_two_sections_fans_out_and_the_filter_comes_last(spark):
    view = spark.createDataFrame([("a", 1, "t", [1.0, 0.0], None, 0.5), ("b", 1, "t", [1.0, 0.0], [1.0, 0.0], 0.1), ("a", 2, "t", [0.5, 0.0], None, 0.0)], "section string, cluster_id int, topic string, centroid array<double>, title_emb array<double>, trend_score double")
    assert retrieval.nearest_clusters(view, [1.0, 0.0], 2).count() == 4
    assert retrieval.nearest_clusters(view, [1.0, 0.0], 1, "b").count() == 1
    first = retrieval.nearest_clusters(view, [1.0, 0.0], 8, limit=1).first()
    assert first["section"] == "b" and first["final_score"] == pytest.approx(0.55 * 2 + 0.25 * 2 + 0.02)


def test_rank_order_is_total_and_puts_nulls_last(spark):
    cols = ", ".join(f"{k} double" for k in retrieval.RANK_KEYS)
    data = [(0, *[None] * 8), (1, *[1.0] * 8), (2, *[1.0] * 8), (3, 2.0, *[0.0] * 7), (4, *[0.0] * 8)]
    got = spark.createDataFrame(data, f"position int, {cols}").orderBy(*retrieval.rank_order()).collect()
    assert [r["position"] for r in got] == [3, 1, 2, 4, 0]


def test_policy_precedence(spark):
    def verdict(hits, scores):
        df = spark.createDataFrame([(hits, scores)], "h map<string,array<string>>, s map<string,double>")
        return tuple(df.select(moderation.decide(F.col("h"), F.col("s")).alias("v")).first()["v"])

    assert verdict({"illegal_content": ["x"], "profanity": ["y"]}, {}) == ("block", "illegal_content")
    assert verdict({"extremism_support": ["x"]}, {"illegal_content": 0.8}) == ("block", "illegal_content")
    assert verdict({}, {"extremism_support": 0.8}) == ("block", "extremism_support")
    assert verdict({"profanity": ["y"]}, {"illegal_content": 0.7}) == ("redact", "profanity")
    assert verdict({}, {"profanity": 0.65}) == ("redact", "profanity")
    assert verdict({}, {"illegal_content": 0.5}) == ("review", "uncertain_high_risk")
    assert verdict({}, {"illegal_content": 0.4999}) == ("allow", "clean") and verdict(None, None) == ("allow", "clean")


def test_moderation_matches_hidden_spellings_and_redacts(spark):
    terms = spark.createDataFrame([("profanity", "гром", "грома"), ("profanity", "гром", "гром"), ("illegal_content", "тихий омут", "тихий омут")], "category string, lemma string, form string")
    docs = spark.createDataFrame([(1, "вот г-р о*м тут"), (2, "Тихий  омут"), (3, "ясно"), (4, None), (5, "ГРОМА")], "id long, text string")
    got = {r["id"]: r for r in moderation.moderate(docs, terms, "id", "text").collect()}
    assert got[1]["decision"] == "redact" and got[1]["text"] == "вот [REDACTED] тут"
    assert got[2]["decision"] == "block" and got[2]["text"] is None
    assert got[3]["decision"] == "allow" and got[3]["text"] == "ясно" and got[4]["text"] is None
    assert got[5]["hits"] == {"profanity": ["гром"]}


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.15, (25, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-6, 6, (12, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    near = d <= 0.5
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(x)), 10**6)
    for _ in range(len(x)):
        label = np.where(core, np.minimum(label, np.where(near & core[None], label[None], 10**6).min(1)), label)
    want = np.where(core, label, np.where(near & core[None], label[None], 10**6).min(1))
    want = np.where(want == 10**6, -1, want)
    for block in (4096, 20):
        clustering.BLOCK, old = block, clustering.BLOCK
        left = dict(rows(clustering.dbscan(df, 0.5, 5, "euclidean")))
        clustering.BLOCK = old
        assert [left[i] for i in range(len(x))] == want.tolist()


def test_neighbour_distances_with_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [3.0, 4.0])], "id long, emb array<double>")
    assert rows(clustering.neighbour_distances(df, 3, "euclidean")) == [(1, 1, 5.0), (2, 1, 5.0)]
    assert clustering.neighbour_distances(df.limit(0), 3).count() == 0


def test_hierarchy_of_many_rows_is_that_of_all_rows(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(90, 12))
    x = np.vstack([centres[k] + r.normal(size=(5, 12)) * 0.05 for k in range(90)] + [r.normal(size=(150, 12)), centres[:20], centres[:20]])  # small groups, noise, copies
    df = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>").repartition(5)
    few, many = (rows(clustering.hierarchy(df, most=most)) for most in (5000, 60))
    assert few == many and len({label for _, label in many}) > 80
    ids = np.arange(len(x)) * 3
    tree = clustering.boruvka_tree(df, ids, 100)
    assert sorted(tree) == sorted(clustering.prim_tree(clustering._grid(df.toPandas().sort_values("id")["emb"]) / clustering.GRID))


def test_hierarchy_finds_leaves(spark):
    x = np.concatenate([np.random.default_rng(1).normal(c, 0.02, (8, 2)) for c in ((1, 0), (0, 1), (-1, 0))])
    label = clustering.condensed_labels(x, 4, 0.01)
    assert len(set(label) - {-1}) == 3 and all(len(set(label[i : i + 8]) - {-1}) == 1 for i in (0, 8, 16))
    assert clustering.condensed_labels(np.zeros((1, 2))).tolist() == [-1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, emb array<double>")
    assert clustering.hierarchy(df, most=12).count() == 24


def test_terms_run_on_across_posts_and_buckets(spark):
    style.BUCKET_BITS, old = 1, style.BUCKET_BITS
    try:
        texts = [(1, "alpha beta"), (2, "gamma"), (4, "delta epsilon"), (9, ""), (20, "zeta")]
        df = spark.createDataFrame([("s", 1, i, t) for i, t in texts] + [("s", 2, 5, "alpha omega")], "section string, cluster_id int, post_id long, text string")
        got = {r["term"] for r in style.term_counts(df).filter("cluster_id = 1").collect()}
    finally:
        style.BUCKET_BITS = old
    words = "alpha beta gamma delta epsilon zeta".split()
    assert got == {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def test_single_cluster_section_has_no_single_words(spark):
    df = spark.createDataFrame([("s", 1, 1, "alpha beta")], "section string, cluster_id int, post_id long, text string")
    out = style.key_phrases(style.exclusive_terms(style.term_counts(df))).first()
    assert out["top_ngrams"] == ["alpha beta"] and out["slang_ngrams"] == []


@pytest.mark.parametrize("metric,eps", [("cosine", 0.05), ("euclidean", 0.4)])
def test_density_clusters_over_cells_are_those_over_all_pairs(spark, monkeypatch, metric, eps):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(12, 8))
    x = np.concatenate([c[rng.integers(0, 12, 400)] + rng.normal(size=(400, 8)) * 0.12, rng.normal(size=(60, 8)), np.repeat(c[:1], 90, 0)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, emb array<double>")
    want = dict(map(tuple, clustering.dbscan(df, eps, 5, metric).collect()))
    monkeypatch.setattr(clustering, "BLOCK", 16)
    left, _ = clustering.block_pairs(df, None, 16, eps, metric)
    every, _ = clustering.block_pairs(df, None, 16)
    monkeypatch.setattr(clustering, "MOST_PLAIN", 0)
    assert left.count() < every.count() * 0.9
    assert dict(map(tuple, clustering.dbscan(df, eps, 5, metric).collect())) == want and len(set(want.values())) > 5


def test_quantiles_by_histogram(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.random(500), [0.5] * 300, [2.0]])
    df = spark.createDataFrame([(float(a),) for a in v] + [(None,)], "d double")
    got = [q for _, q in rows(clustering.quantiles(df, "d", 11), "i")]
    want = np.sort(v)[np.floor(np.arange(11) / 10 * 800).astype(int)]
    assert np.allclose(got, want, atol=3e-5) and clustering.quantiles(df.limit(0), "d", 5).count() == 0


def test_batch_search_in_blocks_gives_what_one_gives(spark, monkeypatch):
    view = spark.createDataFrame([("s", k, [float(k % 5), float(k % 3), 1.0]) for k in range(20)], "section string, cluster_id int, centroid array<double>")
    asked = spark.createDataFrame([(f"r{k}", [1.0, float(k), 0.5]) for k in range(9)], "request_id string, emb array<double>")
    one = rows(retrieval.nearest_clusters_batch(view, asked, 3))
    monkeypatch.setattr(retrieval, "MATRIX_ROWS", 4)
    assert rows(retrieval.nearest_clusters_batch(view, asked, 3)) == one and len(one) == 27
    assert rows(retrieval.nearest_clusters_batch(view, asked.unionByName(asked.selectExpr("concat(request_id, 'x') AS request_id", "emb")).unionByName(asked.selectExpr("concat(request_id, 'y') AS request_id", "emb")), 3).filter("length(request_id) = 2")) == one


@pytest.mark.parametrize("clusters, requests", [(70, 90), (90, 70)])
def test_batch_search_in_tiles_against_brute_force(spark, monkeypatch, clusters, requests):
    rng = np.random.default_rng(1)
    c, q = rng.integers(-1, 2, (clusters, 3)).astype(float), rng.integers(-1, 2, (requests, 3)).astype(float)  # many ties
    keys = [(f"s{k % 7}" if k % 11 else None, int(k)) for k in rng.permutation(clusters)]
    view = spark.createDataFrame([(*key, v.tolist()) for key, v in zip(keys, c, strict=True)], "section string, cluster_id int, centroid array<double>").repartition(3)
    asked = spark.createDataFrame([(f"r{k:03d}", v.tolist()) for k, v in enumerate(q)], "request_id string, emb array<double>")
    want = []
    for k, v in enumerate(q):
        best = sorted((-(1 + v @ x), s or "", i) for (s, i), x in zip(keys, c, strict=True))[:8]
        want += [(f"r{k:03d}", s or None, i, -d, n + 1) for n, (d, s, i) in enumerate(best)]
    for tile, most in ((1024, 100_000), (5, 100_000), (16, 20)):
        monkeypatch.setattr(retrieval, "TILE", tile)
        monkeypatch.setattr(retrieval, "MATRIX_ROWS", most)
        assert rows(retrieval.nearest_clusters_batch(view, asked, 8)) == sorted(want, key=repr)
    assert retrieval.nearest_clusters_batch(view.limit(0), asked).count() == 0 == retrieval.nearest_clusters_batch(view, asked.limit(0)).count()


@pytest.mark.parametrize("clusters, requests", [(40_000, 40_001), (40_001, 40_000)])
def test_batch_search_holds_no_matrix_of_all_clusters(spark, monkeypatch, clusters, requests):
    taken = []

    def inside(df, f, schema):  # in this process, to see what a task takes
        def traced(batches):
            tracemalloc.start()
            try:
                yield from f(batches)
            finally:
                taken.append(tracemalloc.get_traced_memory()[1] / 1e6)
                tracemalloc.stop()

        pdf = df.limit(3000).toPandas()
        return spark.createDataFrame(pd.concat([x.head(5) for x in traced(iter([pdf]))]), schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", inside)
    vectors = [F.array(*(F.rand(k) - 0.5 for k in range(16)))]
    view = spark.range(clusters).select(F.lit("s").alias("section"), F.col("id").cast("int").alias("cluster_id"), *[v.alias("centroid") for v in vectors])
    asked = spark.range(requests).select(F.col("id").cast("string").alias("request_id"), *[v.alias("emb") for v in vectors])
    retrieval.nearest_clusters_batch(view, asked, 3)
    assert taken and max(taken) < 150  # MB; all similarities of 1,024 rows would be 328


def test_improved_clusters_and_automatic_eps(spark):
    rng = np.random.default_rng(2)
    c = np.eye(6) * 3
    x = c[np.arange(240) % 6] + rng.normal(size=(240, 6)) * 0.05
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, emb array<double>")
    assert 0 < clustering.automatic_eps(df) < 0.01
    got = dict(map(tuple, clustering.dbscan(df, None, 5).collect()))
    assert len({got[i] for i in range(240) if got[i] >= 0}) >= 6 and all(got[i] == -1 or got[i] % 6 == i % 6 for i in got)
    better = dict(map(tuple, clustering.improved_clusters(df).collect()))
    assert all(better[i] == -1 or better[i] % 6 == i % 6 for i in better) and len(better) == 240
    assert rows(clustering.improved_clusters(df.limit(2)).select("label")) == [(-1,), (-1,)]
