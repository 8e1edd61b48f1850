import pytest
from pyspark.sql import functions as F

from postloom.operators import clustering
from postloom.plans import pipeline
from postloom.sources import external
from postloom.sources import tables as tb
from tests.conftest import rows


def test_all_stages(spark, small, tmp_path):
    posts = tb.current_topics(spark, small, "id", "text", "text_clean", "section", "created_at").withColumn("section", F.lower(F.trim("section")))
    out = pipeline.run(spark, posts, f"file://{tmp_path}", "2025-07-01 00:00:00", cluster=lambda v: clustering.kmeans(v, 6, (42,)), ask=lambda phrase: {"totalCount": len(phrase), "topRequests": [{"phrase": phrase, "count": 3}]})
    assert out.read("message_clusters").count() == posts.filter("coalesce(text_clean, text) IS NOT NULL").count()
    topics = out.read("cluster_topics_by_section")
    assert topics.count() == out.read("cluster_style").count() == out.read("cluster_trend_score").count() > 0
    assert topics.filter("title_emb IS NULL OR size(title_emb) <> 64 OR topic = ''").count() == 0
    assert out.read("topic_popularity").filter("total_count_30d <> length(request_phrase)").count() == 0
    assert out.read("cluster_centroids").count() == 6


def test_popularity_retries_and_gives_up(spark):
    calls = []

    def ask(phrase):
        if phrase == "bad":
            raise OSError("down")
        return {"totalCount": 7, "topRequests": None, "associations": [{"phrase": "x", "count": None}]}

    wanted = spark.createDataFrame([("s", 1, "good"), ("s", 2, "bad")], "section string, cluster_id int, phrase string")
    got = {r["cluster_id"]: r for r in external.fetch_popularity(wanted, ask, tries=3, pause=0.0).collect()}
    assert got[1]["total_count_30d"] == 7 and got[1]["associations"][0]["count"] == 0 and got[2]["total_count_30d"] is None
    assert external.probe(lambda _: {"totalCount": 1})["ok"] and not external.probe(lambda _: {})["ok"] and "refused" in external.probe(lambda _: (_ for _ in ()).throw(OSError("refused")))["reason"] and calls == []


def test_embedder_and_parsers(spark, tmp_path):
    e = external.backend("hash")
    v = e(["кот и пёс", "", "кот и пёс"])
    assert (v[0] == v[2]).all() and abs((v[0] ** 2).sum() - 1) < 1e-5 and (v[1] == 0).all()
    with pytest.raises(ValueError):
        external.backend("other")
    assert external.embed(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), "k", "t", e).count() == 1
    assert external.numbers("1, x,-3,") == [1, -3] and external.strings(None) == [] and external.strings(" a,,b ") == ["a", "b"]
    (tmp_path / "c.yaml").write_text("limits:\n  low: 2\nnew: 1\n")
    assert external.settings(str(tmp_path / "c.yaml"), {"limits": {"low": 1, "high": 3}}) == {"limits": {"low": 2, "high": 3}, "new": 1}
    spark.range(2).write.mode("overwrite").saveAsTable("some_rows")
    assert external.has_table(spark, "some_rows") and not external.has_table(spark, "no_rows")
    spark.sql("DROP TABLE some_rows")


def test_rows_helper(spark):
    assert rows(spark.range(2)) == [(0,), (1,)]
