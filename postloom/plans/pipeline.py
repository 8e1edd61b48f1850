"""The batch pipeline: embeddings, clusters, topics, title vectors, style, popularity, trends; each a snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.operators import clustering, prompts, retrieval, store, style, trends
from postloom.sources import external
from postloom.sources import tables as tb
from postloom.storage import release

KEY = ["section", "cluster_id"]


def run(spark: SparkSession, posts: DataFrame, target: str, as_of: str, embedder: external.Embedder | None = None, cluster: Callable[[DataFrame], DataFrame] | None = None, ask: Callable[[str], dict] | None = None, chat: external.Chat | None = None) -> store.Snapshots:
    """All stages over ``posts`` (the schema of topics, one row an id), written under ``target`` in order.

    Without a popularity service that stage gives an empty table, and trends are empty as popularity drives them. A stage
    reads only snapshots of earlier ones, so a broken run can begin again at any of them."""
    embedder = embedder or external.HashEmbedder()
    cluster = cluster or clustering.hierarchy
    out = store.Snapshots(spark, target)
    texts = posts.select("id", F.coalesce("text_clean", "text").alias("text"), F.coalesce("section", F.lit("")).alias("section"), "created_at").filter("text IS NOT NULL")

    out.write("post_embeddings", external.embed(texts, "id", "text", embedder).withColumnRenamed("id", "post_id"), ["post_id"])
    vectors = out.read("post_embeddings")
    labels = cluster(vectors.select(F.col("post_id").alias("id"), F.col("emb").cast("array<double>").alias("emb")))
    out.write("message_clusters", labels.select(F.col("id").alias("topic_id"), F.col("label").cast("int").alias("cluster_id")).join(texts.select(F.col("id").alias("topic_id"), "section"), "topic_id"), ["topic_id"])
    assigned = out.read("message_clusters")
    out.write("cluster_centroids", retrieval.centroids(assigned, vectors, embedder.dim), ["cluster_id"])

    clustered = assigned.filter(F.col("cluster_id") != tb.NOISE).join(texts.select(F.col("id").alias("topic_id"), "text"), "topic_id").withColumnRenamed("topic_id", "post_id")
    phrases = style.key_phrases(style.exclusive_terms(style.term_counts(clustered)))
    groups = style.topic_groups(clustered)
    if chat:  # the lead phrase stands for a topic that no answer gives
        answers = external.ask_chat(groups.select(F.concat_ws("\x1f", *(F.col(k).cast("string") for k in KEY)).alias("k"), prompts.topic_prompt(F.col("examples")).alias("p")), "k", "p", chat)
        groups = groups.withColumn("k", F.concat_ws("\x1f", *(F.col(k).cast("string") for k in KEY))).join(answers, "k", "left").drop("k")
    else:
        groups = groups.withColumn("answer", F.lit(None).cast("string"))
    groups = groups.join(phrases.select(*KEY, F.get("top_ngrams", F.lit(0)).alias("lead")), KEY, "left")
    titled = groups.select(*KEY, "size_raw", F.col("size_raw").alias("size_kept"), F.lit(0.0).alias("cohesion_raw"), F.lit(0.0).alias("cohesion_kept"), tx.clean_title(F.coalesce(F.nullif(F.trim("answer"), F.lit("")), "lead", F.concat(F.lit("topic "), F.col("cluster_id").cast("string")))).alias("topic"), "exemplars")
    named = external.embed(titled.select(F.concat_ws("\x1f", *(F.col(k).cast("string") for k in KEY)).alias("k"), "topic"), "k", "topic", embedder).withColumnRenamed("emb", "title_emb")
    out.write("cluster_topics_by_section", titled.withColumn("k", F.concat_ws("\x1f", *(F.col(k).cast("string") for k in KEY))).join(named, "k", "left").drop("k"), KEY)

    typical = style.typical_posts(clustered.join(vectors, "post_id"), embedder.dim).groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "post_id"))), lambda x: x["post_id"]).alias("exemplar_post_ids"))
    profile = style.lengths_and_rates(clustered).join(phrases, KEY, "left").join(typical, KEY, "left")
    out.merge("cluster_style", profile, KEY, "updated_at", as_of)

    wanted = out.read("cluster_topics_by_section").select(*KEY, tx.request_phrase("topic").alias("phrase")).filter("phrase <> ''")
    found = external.fetch_popularity(wanted if ask else wanted.limit(0), ask or (lambda _: {}))
    out.merge("topic_popularity", found, KEY, "requested_at", as_of)
    out.write("cluster_recency", trends.recency(assigned, texts, as_of), KEY)
    out.write("cluster_trend_score", trends.trend(out.read("topic_popularity"), out.read("cluster_recency")), KEY)
    release(spark)  # all stages are written
    return out
