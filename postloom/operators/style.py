"""Style profiles of clusters: lengths, rates, typical posts and key phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.functions import vectors as vx

#: Candidates, phrases and single words kept for a cluster; overlap from which a phrase repeats another.
CANDIDATES, PHRASES, SLANG, OVERLAP = 60, 20, 12, 0.66
#: Posts of a section that one window task orders at most (ids that fall into one bucket).
BUCKET_BITS = 16


def lengths_and_rates(posts: DataFrame) -> DataFrame:
    """Per (section, cluster_id): mean and 95th percentile of tokens as whole numbers, mean rates of signs."""
    tokens = tx.token_count("text")
    return posts.groupBy("section", "cluster_id").agg(
        F.avg(tokens).cast("int").alias("avg_len_tokens"), F.percentile(tokens, 0.95).cast("int").alias("p95_len_tokens"), F.avg(tx.emoji_rate("text")).alias("emoji_rate"),
        F.avg(tx.char_rate("text", "!")).alias("exclam_rate"), F.avg(tx.char_rate("text", "?")).alias("question_rate"), F.lit(0.0).alias("markdown_rate"),
    )


def typical_posts(posts: DataFrame, dim: int, k: int = 5) -> DataFrame:
    """(section, cluster_id, post_id, cos, rank): the k posts nearest to the mean of the cluster's unit vectors."""
    key = ["section", "cluster_id"]
    units = posts.select(*key, "post_id", vx.unit("emb").alias("u"))
    means = units.groupBy(*key).agg(vx.mean("u", dim).alias("mean"))
    cos = units.join(means, key).select(*key, "post_id", F.round(vx.dot("u", vx.unit("mean")), 9).alias("cos"))
    return cos.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("cos"), "post_id"))).filter(F.col("rank") <= k)


def _grams(tokens: Column, head: Column, n: int) -> Column:
    """n-grams that begin in ``tokens`` and may end in ``head``, the first words of what follows."""
    both = F.concat(tokens, F.slice(head, 1, n - 1)) if n > 1 else tokens
    last = F.least(F.size(tokens), F.size(both) - (n - 1))
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(both, i, n), " "))).otherwise(F.array().cast("array<string>"))


def term_counts(posts: DataFrame, most: int = 3) -> DataFrame:
    """(section, cluster_id, term, n) of 1- to 3-grams over the posts of a cluster, joined in the order of ids.

    n-grams run on across posts. Each post gets the first words of the next ones; ids are cut into buckets, so no task
    orders a whole hot cluster, and the heads of buckets are stitched together afterwards."""
    key = ["section", "cluster_id"]
    normal = F.array_join(tx.phrase_tokens("text"), " ")
    rows = posts.select(*key, "post_id", F.regexp_extract_all(normal, F.lit(r"(?U)\w{2,}"), F.lit(0)).alias("tokens")).filter(F.size("tokens") > 0)
    rows = rows.withColumn("bucket", F.shiftright(F.col("post_id"), BUCKET_BITS))
    by = Window.partitionBy(*key, "bucket").orderBy("post_id")
    following = F.flatten(F.collect_list(F.slice("tokens", 1, most - 1)).over(by.rowsBetween(1, most - 1)))
    rows = rows.withColumn("head", F.slice(following, 1, most - 1)).withColumn("left", F.count("*").over(by.rowsBetween(1, most - 1)))
    heads = rows.groupBy(*key, "bucket").agg(F.min_by("tokens", "post_id").alias("t"), F.min_by("head", "post_id").alias("h"))
    heads = heads.select(*key, "bucket", F.slice(F.concat("t", "h"), 1, most - 1).alias("opening"))
    nexts = heads.select(*key, "bucket", F.slice(F.flatten(F.collect_list("opening").over(Window.partitionBy(*key).orderBy("bucket").rowsBetween(1, most - 1))), 1, most - 1).alias("next"))
    rows = rows.join(nexts, [*key, "bucket"]).withColumn("head", F.when(F.col("left") < most - 1, F.slice(F.concat("head", "next"), 1, most - 1)).otherwise(F.col("head")))
    terms = F.concat(*(_grams(F.col("tokens"), F.col("head"), n) for n in range(1, most + 1)))
    return rows.select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))


def exclusive_terms(counts: DataFrame) -> DataFrame:
    """Terms that occur in one cluster of their section only, scored by their share of the cluster's such terms. A
    section of a single cluster has no background; there only phrases count."""
    section = counts.groupBy("section", "term").agg(F.count("*").alias("clusters"))
    sole = counts.groupBy("section").agg(F.count_distinct("cluster_id").alias("of"))
    rows = counts.join(section, ["section", "term"]).join(F.broadcast(sole), "section").filter("clusters = 1").filter((F.col("of") > 1) | F.col("term").contains(" "))
    total = F.sum("n").over(Window.partitionBy("section", "cluster_id"))
    return rows.withColumn("score", F.col("n") / total * (F.log(F.lit(1.5)) + 1)).select("section", "cluster_id", "term", "n", "score")


def key_phrases(scored: DataFrame) -> DataFrame:
    """(section, cluster_id, top_ngrams, slang_ngrams): phrases that do not repeat each other, then single words that no
    phrase uses; ties by term."""
    key = ["section", "cluster_id"]
    by = Window.partitionBy(*key, "phrase").orderBy(F.desc("score"), "term")
    best = scored.withColumn("phrase", F.col("term").contains(" ")).withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= CANDIDATES + PHRASES * 3)
    listed = best.groupBy(*key).agg(F.array_sort(F.collect_list(F.when(F.col("phrase") & (F.col("rn") <= CANDIDATES), F.struct("rn", "term")))).alias("p"), F.array_sort(F.collect_list(F.when(~F.col("phrase"), F.struct("rn", "term")))).alias("w"))
    phrases = distinct_phrases(F.transform("p", lambda x: x["term"]))
    listed = listed.withColumn("top_ngrams", phrases)
    used = F.array_distinct(F.flatten(F.transform("top_ngrams", lambda x: F.split(x, " "))))
    return listed.select(*key, "top_ngrams", F.slice(F.filter(F.transform("w", lambda x: x["term"]), lambda t: ~F.array_contains(used, t)), 1, SLANG).alias("slang_ngrams"))


def distinct_phrases(items: Column, overlap: float = OVERLAP, most: int = PHRASES) -> Column:
    """Greedy: a phrase stays unless it shares at least ``overlap`` of the smaller word set with one that stayed."""

    def near(x: Column, y: Column) -> Column:
        a, b = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
        return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)) >= overlap

    return F.aggregate(items, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) >= most) | F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def topic_groups(posts: DataFrame, examples: int = 12, exemplars: int = 3) -> DataFrame:
    """(section, cluster_id, size_raw, exemplars, examples): size, the first ids and the first texts of each cluster."""
    key = ["section", "cluster_id"]
    first = posts.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy("post_id"))).filter(F.col("rn") <= max(examples, exemplars))
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rn", "post_id", "text"))).alias("l"))
    sizes = posts.groupBy(*key).agg(F.count("*").alias("size_raw"))
    return sizes.join(listed, key).select(*key, "size_raw", F.transform(F.slice("l", 1, exemplars), lambda x: x["post_id"]).alias("exemplars"), F.transform(F.slice("l", 1, examples), lambda x: x["text"]).alias("examples"))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): tf times smoothed idf, unit length per document; words of two or more letters or digits."""
    one = docs.filter(F.col(text).isNotNull()).groupBy(key).agg(F.max(text).alias("_t"))
    tf = one.select(key, F.explode(F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = one.count()
    raw = tf.join(df, "term").withColumn("w", F.col("tf") * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    return raw.withColumn("weight", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).select(key, "term", "weight")
