"""Ranking clusters and posts for a query by vector, lexical and trend evidence.

A query vector is a parameter of the plan. Every stage is lazy; limits come before the joins that fetch attributes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.functions import vectors as vx
from postloom.sources.tables import NOISE
from postloom.storage import cut, spread, stored, written

#: Fan-out of the stages.
TOPK, POSTS_TOPK, DISCOVERED_POSTS, NEW_CLUSTERS, FINAL = 8, 50, 120, 5, 3
#: Rows of a matrix that every task may hold.
MATRIX_ROWS = 100_000
#: Requests, and clusters, whose similarities are held at once.
TILE = 1024
#: What a missing rank key counts as.
LOWEST = -1e12


def centroids(assignments: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(cluster_id, centroid, size): means of the posts of each cluster, not made unit length; noise is left out."""
    rows = assignments.filter(F.col("cluster_id") != NOISE).select("cluster_id", F.col("topic_id").alias("post_id")).distinct().join(vectors, "post_id")
    return rows.groupBy("cluster_id").agg(vx.mean("emb", dim).alias("centroid"), F.count("*").cast("int").alias("size"))


def post_search(assignments: DataFrame, topics: DataFrame, vectors: DataFrame) -> DataFrame:
    """(section, cluster_id, post_id, text, emb): clustered posts with text and vector."""
    rows = assignments.filter(F.col("cluster_id") != NOISE).select("section", "cluster_id", F.col("topic_id").alias("post_id"))
    return rows.join(topics.select(F.col("id").alias("post_id"), "text"), "post_id").join(vectors, "post_id").select("section", "cluster_id", "post_id", "text", "emb")


def cluster_view(topics: DataFrame, centroids: DataFrame, styles: DataFrame, popularity: DataFrame, trends: DataFrame) -> DataFrame:
    """One wide row for each (section, cluster_id) that has a topic and a centroid; a missing trend counts as 0."""
    key = ["section", "cluster_id"]
    out = topics.join(centroids.select("cluster_id", "centroid"), "cluster_id")
    out = out.join(styles.select(*key, "avg_len_tokens", "p95_len_tokens", "emoji_rate", "exclam_rate", "question_rate", "top_ngrams", "slang_ngrams"), key, "left")
    out = out.join(popularity.drop("topic"), key, "left").join(trends.select(*key, "trend_score"), key, "left")
    return out.withColumn("trend_score", F.coalesce("trend_score", F.lit(0.0)))


def _scored(view: DataFrame, query: list[float], text: str | None) -> DataFrame:
    q = vx.literal(query)
    lex = F.lit(None).cast("boolean") if text is None else tx.holds_all(tx.words(F.concat_ws(" ", "section", "topic")), tx.words(F.lit(text)))
    near = F.lit(None).cast("double") if text is None else tx.trigram_similarity(F.col("section"), F.lit(text))
    out = view.withColumn("sim_centroid", vx.similarity("centroid", q)).withColumn("sim_title", vx.similarity("title_emb", q))
    out = out.withColumn("section_lex_hit", lex).withColumn("section_trgm_sim", near)
    out = out.withColumn("section_match_score", F.coalesce(F.col("section_lex_hit").cast("int"), F.lit(0)) * 0.7 + F.coalesce("section_trgm_sim", F.lit(0.0)) * 0.3)
    return out.withColumn("final_score", F.col("sim_centroid") * 0.55 + F.coalesce("sim_title", F.lit(0.0)) * 0.25 + F.col("trend_score") * 0.2)


def nearest_clusters(view: DataFrame, query: list[float], topk: int = TOPK, section: str | None = None, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Stage 1: the ``topk`` rows nearest by centroid, all rows of their clusters, the section filter only then, scores,
    and the best ``limit``. Ties go by section and cluster."""
    near = view.select("section", "cluster_id", vx.dot("centroid", vx.literal(query)).alias("_ip")).orderBy(F.desc("_ip"), "section", "cluster_id").limit(topk)
    rows = near.select("cluster_id").join(view, "cluster_id")  # a cluster in several sections fans out
    rows = rows.filter(F.col("section") == section) if section is not None else rows
    out = _scored(rows, query, text)
    return out.orderBy(F.desc("final_score"), "section", "cluster_id").limit(limit) if limit else out


def nearest_posts(posts: DataFrame, query: list[float], k: int, section: str | None = None, cluster_id: int | None = None) -> DataFrame:
    """The k posts most similar to the query, ties by post and cluster, optionally within a cluster and section."""
    rows = posts if section is None else posts.filter(F.col("section") == section)
    rows = rows if cluster_id is None else rows.filter(F.col("cluster_id") == cluster_id)
    return rows.withColumn("sim", vx.similarity("emb", vx.literal(query))).orderBy(F.desc("sim"), "post_id", "section", "cluster_id").limit(k)


def discover(posts: DataFrame, query: list[float], known: Sequence[int] = (), text: str | None = None, tau: float | None = None, section: str | None = None, posts_limit: int = DISCOVERED_POSTS, most: int = NEW_CLUSTERS) -> DataFrame:
    """Clusters behind the nearest posts that are not ``known``: hits, mean similarity, lexical and semantic hits."""
    near = nearest_posts(posts, query, posts_limit, section)
    lex, sem = _hits(text, tau)
    out = near.groupBy("section", "cluster_id").agg(F.count("*").alias("hits_in_top"), F.avg("sim").alias("mean_sim"), F.coalesce(F.sum(lex), F.lit(0)).alias("lex_hits_in_top"), F.sum(sem).alias("sem_hits_in_top"))
    out = out.filter(~F.col("cluster_id").isin(list(known))) if known else out
    return out.orderBy(F.desc("lex_hits_in_top"), F.desc_nulls_last("sem_hits_in_top"), F.desc("hits_in_top"), F.desc(F.round("mean_sim", 9)), "section", "cluster_id").limit(most)


def _hits(text: str | None, tau: float | None) -> tuple[Column, Column]:
    lex = F.lit(0) if text is None else tx.holds_all(tx.words("text"), tx.words(F.lit(text))).cast("int")
    sem = F.lit(None).cast("int") if text is None or tau is None else (F.col("sim") >= tau).cast("int")
    return lex, sem


def rerank(posts: DataFrame, query: list[float], clusters: Sequence[int], topk: int = POSTS_TOPK, text: str | None = None, tau: float | None = None, section: str | None = None) -> DataFrame:
    """Evidence of posts for candidate clusters. Ranks and sizes are those of the whole cluster, taken before the limit;
    the limit is over all posts, before the restriction to candidates, so a candidate may have no row left.

    Sizes are counted with map-side sums; of a cluster only its best rows that can be under the limit are ranked, with a
    filter on the rank below the shuffle; only key and similarity travel, and texts join the few rows that are left."""
    rows = posts if section is None else posts.filter(F.col("section") == section)
    most = topk * max(len(clusters), 1)
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    by = Window.partitionBy("cluster_id").orderBy(F.desc("sim"), "post_id", "section")
    ranked = rows.select("cluster_id", "section", "post_id", vx.similarity("emb", vx.literal(query)).alias("sim")).withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= most)
    top = ranked.orderBy(F.desc("sim"), "post_id", "section", "cluster_id").limit(most).filter(F.col("cluster_id").isin(list(clusters)))
    top = top.join(rows.select("cluster_id", "section", "post_id", "text"), ["cluster_id", "section", "post_id"]) if text is not None else top.withColumn("text", F.lit(None).cast("string"))
    top = top.join(sizes, "cluster_id")
    lex, sem = _hits(text, tau)
    size = F.nullif(F.col("cluster_size"), F.lit(0))
    out = top.groupBy("cluster_id").agg(F.max("cluster_size").alias("cluster_size"), F.avg(F.when(F.col("rn") <= topk, F.col("sim"))).alias("post_topk_mean_sim"), F.sum(sem).alias("post_hits_at_tau"), F.sum(lex).alias("lex_hits_count"))
    return out.withColumn("post_dens_at_tau", F.col("post_hits_at_tau") / size).withColumn("lex_dens", F.col("lex_hits_count") / size)


RANK_KEYS = ("lex_hits_count", "section_lex_hit", "section_match_score", "post_hits_at_tau", "lex_dens", "post_dens_at_tau", "post_topk_mean_sim", "final_score")


def rank_order(position: str = "position") -> list[Column]:
    """Descending by eight keys, a NULL below everything, then the position at which a row came."""
    return [F.coalesce(F.round(F.col(k).cast("double"), 9), F.lit(LOWEST)).desc() for k in RANK_KEYS] + [F.col(position).asc()]


def select_clusters(view: DataFrame, posts: DataFrame, query: list[float], topk: int = TOPK, section: str | None = None, text: str | None = None, tau: float | None = None, final: int = FINAL, discovery: bool = True) -> DataFrame:
    """All stages: nearest clusters, lock on the first row's section, clusters found through posts, evidence of posts,
    and the order by eight keys. Candidates are at most ``final`` + NEW_CLUSTERS clusters, so they pass the driver."""
    first = nearest_clusters(view, query, topk, section, text, final).select("section", "cluster_id", "final_score").orderBy(F.desc("final_score"), "section", "cluster_id").collect()
    locked = section if section is not None else first[0]["section"] if first else None
    ids = list(dict.fromkeys(r["cluster_id"] for r in first))
    order = {(r["section"], r["cluster_id"]): k for k, r in reversed(list(enumerate(first)))}
    if discovery and locked is not None:
        for k, r in enumerate(discover(posts, query, ids, text, tau, locked).collect()):
            ids.append(r["cluster_id"])
            order.setdefault((locked, r["cluster_id"]), len(first) + k)
    spark = view.sparkSession
    listed = spark.createDataFrame([(s, c, k) for (s, c), k in order.items()], "section string, cluster_id int, position int")
    rows = _scored(view.join(F.broadcast(listed), ["section", "cluster_id"]), query, text)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("position"))).filter("_n = 1").drop("_n")
    evidence = rerank(posts, query, ids, POSTS_TOPK, text, tau, locked)
    out = rows.join(F.broadcast(evidence), "cluster_id", "left")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*rank_order()))).filter(F.col("rank") <= final)


def nearest_clusters_batch(view: DataFrame, requests: DataFrame, topk: int = TOPK) -> DataFrame:
    """(request_id, section, cluster_id, sim_centroid, rank) for many requests (request_id, emb) in one job.

    The smaller side is a matrix in every task: the clusters, with the requests staying where they are, or the requests,
    with each partition of clusters giving its best ``topk`` a request before anything is shuffled. A side beyond
    MATRIX_ROWS is taken in several blocks; tasks read it from the shared folder and hold the similarities of TILE requests
    and clusters at a time. Ties go by section and cluster."""
    order = ["section", "cluster_id"]
    key = cut(view.select(*order, "centroid").filter(F.col("centroid").isNotNull()), "clusters")
    asked = cut(requests.select("request_id", "emb").filter(F.col("emb").isNotNull()), "requests")
    schema = "request_id string, section string, cluster_id int, sim_centroid double"

    def found(ids: np.ndarray, clusters: pd.DataFrame, top: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        for lo in range(0, len(ids), 8 * TILE):
            i, k = np.nonzero(at[lo : lo + 8 * TILE] >= 0)
            j = at[i + lo, k]
            yield pd.DataFrame({"request_id": ids[i + lo], "section": clusters["section"].to_numpy()[j], "cluster_id": clusters["cluster_id"].to_numpy()[j], "sim_centroid": top[i + lo, k]})

    def for_requests(path: str):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            clusters, m = _held(path, "centroid", *order)
            places = clusters.sort_values(order, na_position="first", kind="stable").index.to_numpy()
            clusters, m = clusters.iloc[places], m[places]
            for pdf in batches:
                for lo in range(0, len(pdf) if len(m) else 0, TILE):
                    part = pdf.iloc[lo : lo + TILE]
                    q = np.stack(part["emb"].to_numpy()).astype(float)
                    top, at = np.full((len(q), topk), -np.inf), np.full((len(q), topk), -1)
                    for c in range(0, len(m), TILE):
                        _better(top, at, 1 + q @ m[c : c + TILE].T, c)
                    yield from found(part["request_id"].to_numpy(), clusters, top, at)

        return each

    def for_clusters(path: str):  # which come in their order
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asking, q = _held(path, "emb", "request_id")
            top, at = np.full((len(q), topk), -np.inf), np.full((len(q), topk), -1)
            seen, n = [], 0
            for pdf in batches:
                for c in range(0, len(pdf) if len(q) else 0, TILE):
                    m = np.stack(pdf["centroid"].iloc[c : c + TILE].to_numpy()).astype(float)
                    for lo in range(0, len(q), TILE):
                        _better(top[lo : lo + TILE], at[lo : lo + TILE], 1 + q[lo : lo + TILE] @ m.T, n + c)
                seen.append(pdf[order])
                n += len(pdf)
            if n and len(q):
                yield from found(asking["request_id"].to_numpy(), pd.concat(seen), top, at)

        return each

    clusters, requested = key.count(), asked.count()
    small, large, of_requests = (key, spread(asked), False) if clusters <= requested else (asked, spread(key).sortWithinPartitions(*order), True)
    blocks = max(1, -(-min(clusters, requested) // MATRIX_ROWS))
    out = None
    for b in range(blocks):
        names = ["request_id"] if of_requests else order
        path = written(small.filter(F.pmod(F.xxhash64(*names), F.lit(blocks)) == b), "held")
        part = large.mapInPandas((for_clusters if of_requests else for_requests)(path), schema)
        out = part if out is None else out.unionByName(part)
    by = Window.partitionBy("request_id").orderBy(F.desc(F.round("sim_centroid", 12)), "section", "cluster_id")
    return out.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= topk)


def _held(path: str, vector: str, *names: str) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a table at written(): their names, and their vectors as a matrix."""
    ids, parts = [], []
    for batch in stored(path, *names, vector):
        if batch.num_rows:
            ids.append(batch.select(list(names)).to_pandas())
            parts.append(np.stack(batch.column(vector).to_numpy(zero_copy_only=False)).astype(float))
    return (pd.concat(ids, ignore_index=True), np.concatenate(parts)) if ids else (pd.DataFrame(columns=list(names)), np.zeros((0, 1)))


def _better(top: np.ndarray, at: np.ndarray, sim: np.ndarray, base: int) -> None:
    """Put the best of ``sim``, whose columns are clusters from number ``base`` on, into the best so far of each row: ``top``
    and their numbers ``at``. Of equal ones (to 12 digits) the lower number is better; NaN is none."""
    most = top.shape[1]
    floor = np.round(top[:, -1], 12) + 4e-13
    free = np.flatnonzero(at[:, -1] < 0)
    if len(free):
        few = min(most, sim.shape[1])
        floor[free] = -np.partition(-sim[free], few - 1, axis=1)[:, few - 1] - 2e-12
        floor[np.isnan(floor)] = -np.inf
    i, j = np.nonzero(sim > floor[:, None])
    if not len(i):
        return
    rows = np.unique(i)
    row, number, value = np.concatenate([i, np.repeat(rows, most)]), np.concatenate([j + base, at[rows].ravel()]), np.concatenate([sim[i, j], top[rows].ravel()])
    order = np.lexsort((number, -np.round(value, 12), row))
    first = np.searchsorted(row[order], rows)
    chosen = order[first[:, None] + np.arange(most)]  # each row has at least those it had
    top[rows], at[rows] = value[chosen], number[chosen]


def exemplar_posts(topics: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """(section, cluster_id, position, post_id, text): the first k exemplars of each cluster, in the order of the array."""
    listed = topics.select("section", "cluster_id", F.posexplode(F.slice("exemplars", 1, k)).alias("position", "post_id"))
    return listed.join(posts.select(F.col("id").alias("post_id"), "text"), "post_id")


def cosine_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    q = vx.literal(query)
    return vectors.withColumn("cos", vx.cosine("emb", q)).filter(F.col("cos").isNotNull()).orderBy(F.desc("cos"), "post_id").limit(k)


def style_and_topic(view: DataFrame, section: str, cluster_id: int) -> DataFrame:
    """The style profile and the topic of one cluster; no row for an unknown one."""
    return view.filter((F.col("section") == section) & (F.col("cluster_id") == cluster_id)).select("section", "cluster_id", "topic", "avg_len_tokens", "p95_len_tokens", "emoji_rate", "exclam_rate", "question_rate", "top_ngrams", "slang_ngrams")


def similar_to_text(vectors: DataFrame, posts: DataFrame, text: str, k: int) -> DataFrame:
    """(post_id, cos): the k posts most similar to the last post of exactly this text; none if there is no such post."""
    anchor = posts.filter(F.col("text") == text).join(vectors.select(F.col("post_id").alias("id"), "emb"), "id").orderBy(F.desc("id")).limit(1).first()
    if anchor is None:
        return vectors.select("post_id", F.lit(0.0).alias("cos")).limit(0)
    return cosine_top(vectors.filter(F.col("post_id") != anchor["id"]), [float(x) for x in anchor["emb"]], k).select("post_id", "cos")
