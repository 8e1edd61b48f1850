"""How distinctive a term is for a record: divergence from randomness.

With cf occurrences of a term over n records, a geometric model with mean cf / n gives the information content of tf
occurrences in one record; the Laplace after-effect 1 / (tf + 1) turns it into a gain. tf is first normalised by the
record's length (second normalisation): tfn = tf * log2(1 + c * average length / length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.storage import BROADCAST_ROWS, fits_broadcast

#: Terms as maximal runs of letters.
WORD = "[a-zа-яё]{3,}"
#: Length normalisation: the greater, the less long records are discounted.
LENGTH_C = 1.0
#: A term counts as heavy when at least one of so many (record, term) pairs is its: there are at most so many of those.
HEAVY_SHARE = 1000


def geometric_gain(tf: Column, cf: Column, n: Column, length: Column, mean_length: Column, c: float = LENGTH_C) -> Column:
    """Information content under the geometric model times the Laplace after-effect gain."""
    tfn = tf * F.log2(1 + F.lit(c) * mean_length / length)
    mean = cf / n
    information = F.log2(1 + mean) + tfn * F.log2((1 + mean) / mean)
    return information / (tfn + 1)


def score_terms(counted: DataFrame, n: int, c: float = LENGTH_C, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Scores for ``counted`` (rec_key, term, tf), one row a pair; ``n`` is the number of records, with or without terms.

    Adds df (records holding the term), cf (its occurrences), length of the record, and ``dfr``. Statistics cover all
    records. The statistics of terms are broadcast while they have at most ``broadcast_rows`` rows. Beyond that, only the
    heavy terms are (at most HEAVY_SHARE of them, whatever the data), and the others, which have no hot key left, are
    joined by shuffle. No records give no rows.
    """
    stats = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    size = stats.agg(F.sum("df").alias("pairs"), F.sum("cf").alias("tokens"), F.count("*").alias("terms")).first()
    lengths = Window.partitionBy("rec_key")
    rows = counted.withColumn("length", F.sum("tf").over(lengths))
    if (size["terms"] or 0) <= broadcast_rows:
        joined = rows.join(F.broadcast(stats), "term")
    else:
        heavy = stats.filter(F.col("df") * HEAVY_SHARE >= size["pairs"])
        names = F.broadcast(heavy.select("term"))
        light = stats.join(names, "term", "left_anti")
        joined = rows.join(F.broadcast(heavy), "term").unionByName(rows.join(names, "term", "left_anti").join(light, "term"))
    mean_length = F.lit((size["tokens"] or 0) / max(n, 1))
    return joined.withColumn("dfr", geometric_gain(F.col("tf").cast("double"), F.col("cf").cast("double"), F.lit(float(max(n, 1))), F.col("length").cast("double"), mean_length, c))


def text_terms(records: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_key, term, tf) of ``text``, and nothing for NULL or termless texts.

    Records are told apart by ``key``; repeated rows count once (of differing texts the greatest). NULL keys are left
    out. Terms are the maximal runs of three or more letters, in lower case. Grouping by record and term keeps the
    partitioning by record, so terms are counted without another shuffle.
    """
    one = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("rec_key")).agg(F.max(text).alias("text"))
    words = one.select("rec_key", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("term"))
    return words.groupBy("rec_key", "term").agg(F.count("*").alias("tf"))


def value_terms(records: DataFrame, key: Column, *arrays: str) -> DataFrame:
    """(rec_key, term, tf = 1): the distinct non-NULL values of all ``arrays`` of all rows of a key."""
    values = F.concat(*(F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays))
    rows = records.select(key.alias("rec_key"), F.explode(values).alias("term"))
    return rows.filter(F.col("term").isNotNull() & F.col("rec_key").isNotNull()).groupBy("rec_key", "term").agg(F.lit(1).cast("bigint").alias("tf"))


def leading_terms(scored: DataFrame, n: int, most_records: int = 5, least_tf: int = 1) -> DataFrame:
    """Of scored rows those whose tf * ln(n / df) is the highest of their record (ties within 1e-9) over terms of at
    least two records, with df <= ``most_records`` and tf >= ``least_tf``."""
    weighed = scored.filter(F.col("df") > 1).withColumn("tfidf", F.col("tf") * F.log(F.lit(float(max(n, 1))) / F.col("df")))
    best = F.max("tfidf").over(Window.partitionBy("rec_key"))
    return weighed.withColumn("best", best).filter((F.col("tfidf") >= F.col("best") - 1e-9) & (F.col("df") <= most_records) & (F.col("tf") >= least_tf)).drop("best")


__all__ = ["fits_broadcast", "geometric_gain", "leading_terms", "score_terms", "text_terms", "value_terms"]
