"""The model's tables: schemas, reading, and the current state of tables with repeated or outdated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.storage import read_table

# Schemas of the model.
SCHEMAS = {
    "topics": "id long, source string, text string, hash string, created_at timestamp, updated_at timestamp, section string, text_clean string",
    "post_embeddings": "post_id long, emb array<float>, created_at timestamp",
    "message_clusters": "topic_id long, cluster_id int, section string",
    "cluster_topics_by_section": "section string, cluster_id int, size_raw int, size_kept int, cohesion_raw double, cohesion_kept double, topic string, title_emb array<float>, exemplars array<long>",
    "cluster_centroids": "cluster_id int, centroid array<double>, size int, updated_at timestamp",
    "cluster_style": "section string, cluster_id int, avg_len_tokens int, p95_len_tokens int, emoji_rate float, exclam_rate float, question_rate float, markdown_rate float, top_ngrams array<string>, slang_ngrams array<string>, exemplar_post_ids array<long>, updated_at timestamp",
    "topic_popularity": "section string, cluster_id int, topic string, request_phrase string, total_count_30d long, top_max_phrase string, top_max_count long, top_requests array<struct<phrase:string,count:long>>, associations array<struct<phrase:string,count:long>>, regions_used array<int>, devices_used array<string>, requested_at timestamp",
}
KEYS = {"topics": ["id"], "post_embeddings": ["post_id"], "message_clusters": ["topic_id"], "cluster_topics_by_section": ["section", "cluster_id"], "cluster_centroids": ["cluster_id"], "cluster_style": ["section", "cluster_id"], "topic_popularity": ["section", "cluster_id"]}
NOISE = -1


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first by ``order``. A NULL key is a key; the filter on the rank is pushed below the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def current_topics(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The latest version of every post (rows without a time last)."""
    need = list(dict.fromkeys([*columns, "id", "updated_at", "hash", "created_at"]))
    df = keep_first(read_table(spark, d, "topics", *need), ["id"], F.col("updated_at").desc_nulls_last(), F.col("hash").asc(), F.col("created_at").asc())
    return df.select(*columns) if columns else df


def assignments(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "message_clusters", "section", "cluster_id", "topic_id").distinct()


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(post_id, emb): one vector a post, the smaller of several by value."""
    return read_table(spark, d, "post_embeddings", "post_id", "emb").filter("emb IS NOT NULL").groupBy("post_id").agg(F.min("emb").alias("emb"))


def cluster_topics(spark: SparkSession, d: str) -> DataFrame:
    cols = ["section", "cluster_id", "size_raw", "size_kept", "cohesion_raw", "topic", "title_emb", "exemplars"]
    order = [F.col("size_raw").desc_nulls_last(), F.col("size_kept").desc_nulls_last(), F.col("cohesion_raw").desc_nulls_last(), F.col("topic").asc_nulls_last()]
    return keep_first(read_table(spark, d, "cluster_topics_by_section", *cols), ["section", "cluster_id"], *order)


def styles(spark: SparkSession, d: str) -> DataFrame:
    return keep_first(read_table(spark, d, "cluster_style"), ["section", "cluster_id"], F.col("updated_at").desc_nulls_last(), F.col("avg_len_tokens").desc_nulls_last())


def check_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break uniqueness or are NULL, with their counts; empty when the constraint holds."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | null)


def check_dimension(df: DataFrame, column: str, dim: int) -> DataFrame:
    """``df`` with a guard: a vector of another length raises an error when it is read."""
    return df.withColumn(column, F.when(F.assert_true(F.col(column).isNull() | (F.size(column) == dim), F.lit(f"{column}: not {dim} values")).isNull(), F.col(column)))


def read_posts_csv(spark: SparkSession, path: str) -> DataFrame:
    """Posts from CSV with a header, quotes doubled inside quotes, and line breaks inside values."""
    return spark.read.csv(path, schema=SCHEMAS["topics"], header=True, quote='"', escape='"', multiLine=True, mode="FAILFAST")


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """(term): the lines of text files, without blanks and lines that begin with #."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("term")).filter((F.col("term") != "") & ~F.col("term").startswith("#"))
