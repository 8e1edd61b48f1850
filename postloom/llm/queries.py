"""Queries of the training-data operators, by name; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import abuse, communities, leakage, markup, neighbours, packing, pii, residue, terms, topn
from postloom.storage import cut, read_table

EXEMPLARS = 5


def personal(spark: SparkSession, d: str) -> DataFrame:
    topics = pii.mask_personal(read_table(spark, d, "topics", "id", "text"), "id", "text").withColumn("rec_table", F.lit("topics"))
    clusters = pii.mask_personal(read_table(spark, d, "message_clusters", "topic_id", "text"), "topic_id", "text").withColumn("rec_table", F.lit("message_clusters"))
    return topics.unionByName(clusters)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return personal(spark, d).select("rec_table", "rec_id", F.explode("info_types").alias("info_type")).distinct()


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    return personal(spark, d).select("rec_table", "rec_id", "masked").distinct()


def abuse_scores(spark: SparkSession, d: str, *more: str) -> DataFrame:
    out = None
    for table, key, text in (("topics", "id", "text"), ("post_responses", "request_id", "post_text"), ("moderation_requests", "request_id", "text")):
        part = abuse.score_abuse(read_table(spark, d, table, key, text), key, text).withColumn("rec_table", F.lit(table))
        if more:
            part = part.join(read_table(spark, d, table, key, *more).select(F.col(key).alias("rec_id"), *more).dropDuplicates(["rec_id"]), "rec_id")
        out = part if out is None else out.unionByName(part)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse_scores(spark, d).filter(F.col("score") >= abuse.THRESHOLD).select("rec_table", "rec_id").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Records of each source and the share of them with abuse; repeated rows count once."""
    each = abuse_scores(spark, d, "source").groupBy("rec_table", "rec_id", "source").agg(F.max("score").alias("score"))
    return each.groupBy("rec_table", "source").agg(F.count("*").alias("records"), F.count_if(F.col("score") >= abuse.THRESHOLD).alias("bad")).withColumn("rate", F.round(F.col("bad") / F.col("records"), 6))


def grouped_posts(spark: SparkSession, d: str, degrees: bool) -> DataFrame:
    posts = read_table(spark, d, "post_embeddings", "post_id", "emb").select(F.format_string("%020d", "post_id").alias("name"), "emb")
    groups = communities.similarity_groups(neighbours.prepare(posts, "name", "emb"), degrees=degrees)
    return groups.select(F.col("label").cast("long").alias("first_id"), F.col("name").cast("long").alias("post_id"), "degree")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return grouped_posts(spark, d, False).filter("post_id <> first_id").select("first_id", "post_id")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each group with its size and its most typical posts, those of highest internal weighted degree."""
    posts = cut(grouped_posts(spark, d, True), "grouped")
    best = topn.top_n(posts, ["first_id"], "degree", "post_id", EXEMPLARS)
    listed = best.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("degree")).alias("d"), "post_id"))), lambda x: x["post_id"]).alias("exemplars"))
    return posts.groupBy("first_id").agg(F.count("*").alias("size")).join(listed, "first_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "message_clusters", "section", "cluster_id", "topic_id", "score").filter("cluster_id <> -1")
    return topn.top_n(rows, ["section", "cluster_id"], "score", "topic_id", EXEMPLARS).drop("score")


def named_vectors(spark: SparkSession, d: str) -> DataFrame:
    posts = read_table(spark, d, "post_embeddings", "post_id", "emb").select(F.concat(F.lit("post/"), "post_id").alias("name"), "emb")
    titles = read_table(spark, d, "cluster_topics_by_section", "section", "cluster_id", "title_emb").select(F.concat_ws("/", F.lit("title"), F.coalesce("section", F.lit("")), F.col("cluster_id").cast("string")).alias("name"), F.col("title_emb").alias("emb"))
    return neighbours.prepare(posts.unionByName(titles), "name", "emb")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(named_vectors(spark, d), 0.95)


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    vectors = named_vectors(spark, d)
    chosen = F.col("name").startswith("post/") & (F.regexp_extract("name", r"(\d+)$", 1).cast("long") % 100 == 0)
    return neighbours.nearest(vectors, vectors.filter(chosen), 10)


def topic_terms(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    topics = read_table(spark, d, "topics", "id", "text_clean")
    return terms.text_terms(topics, "id", "text_clean"), topics.select("id").distinct().count()


def style_terms(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    styles = read_table(spark, d, "cluster_style", "section", "cluster_id", "top_ngrams", "slang_ngrams")
    key = F.concat_ws("/", F.coalesce("section", F.lit("")), F.col("cluster_id").cast("string"))
    return terms.value_terms(styles, key, "top_ngrams", "slang_ngrams"), styles.select("section", "cluster_id").distinct().count()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = []
    for kind, (counted, n), least in (("topic", topic_terms(spark, d), 2), ("style", style_terms(spark, d), 1)):
        lead = terms.leading_terms(terms.score_terms(counted, n), n, 5, least)
        out.append(lead.select(F.lit(kind).alias("rec_type"), "rec_key", "term"))
    return out[0].unionByName(out[1])


def p6_style_scores(spark: SparkSession, d: str) -> DataFrame:
    counted, n = style_terms(spark, d)
    return terms.score_terms(counted, n).select("rec_key", "term", F.round("dfr", 6).alias("dfr"))


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """The divergence from randomness of every term of every record of both types, over the whole tables."""
    out = []
    for kind, (counted, n) in (("topic", topic_terms(spark, d)), ("style", style_terms(spark, d))):
        out.append(terms.score_terms(counted, n).select(F.lit(kind).alias("rec_type"), "rec_key", "term", F.round("dfr", 6).alias("dfr")))
    return out[0].unionByName(out[1])


def cleaned_topics(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_markup(read_table(spark, d, "topics", "id", "source", "text", "text_clean"), "id", "source", ["text", "text_clean"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cleaned_topics(spark, d).select(F.col("rec_id").alias("topic_id"), "rec_field", F.explode("markup_types").alias("markup_type")).distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return cleaned_topics(spark, d).select(F.col("rec_id").alias("topic_id"), "rec_field", "clean")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.count_tokens(read_table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, d, "documents", "doc_id", "text"), read_table(spark, d, "eval_items", "item_id", "passage"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(read_table(spark, d, "documents", "doc_id", "source", "text"))


QUERIES = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_nearest": p5_nearest,
    "p6_found": p6_found,
    "p6_style_scores": p6_style_scores,
    "p6_scores": p6_scores,
    "p7_found": p7_found,
    "p7_clean": p7_clean,
    "p8_packed": p8_packed,
    "p9_found": p9_found,
    "p10_found": p10_found,
}
