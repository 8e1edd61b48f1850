"""Interfaces for models and services, with stand-ins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.operators import moderation, prompts, store
from postloom.plans import catalogue
from postloom.sources import external
from tests.conftest import rows


class Model:
    def encode(self, texts):
        return [[len(t), 1.0] for t in texts]


class Wide:
    def encode(self, texts):
        return [[1.0, 2.0, 3.0] for _ in texts]


def test_model_backends():
    e = external.backend("multi", Model, 2)
    v = e(["abc", ""])
    assert np.allclose(v[0], np.array([3, 1]) / 10**0.5) and np.allclose(v[1], [0, 1]) and e.__getstate__()["model"] is None
    with pytest.raises(ValueError):
        external.backend("ru", Wide, 2)(["x"])
    t = external.backend("tfidf", 256)(["кот пёс кот", "пёс кот", ""])
    assert 0.9 < float(t[0] @ t[1]) < 1 and not t[2].any()


def test_service_is_asked_again(spark):
    calls = []

    def ask(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise OSError("down")
        return [[3.0, 4.0] for _ in texts]

    waits = []
    assert np.allclose(external.backend("llm", ask, 2, sleep=waits.append)(["a", "b"]), [[0.6, 0.8]] * 2) and waits == [1.2, 1.2]
    with pytest.raises(OSError):
        external.repeated(lambda: (_ for _ in ()).throw(OSError("no")), 2, 0, waits.append)


def test_each_text_is_embedded_once(spark):
    data = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "c")], "k int, t string")
    empty = spark.createDataFrame([], "text_hash string, emb array<float>")
    first, new = external.embed_cached(data.filter("k < 4"), "k", "t", external.HashEmbedder(8), empty)
    assert sorted(r["k"] for r in first.collect()) == [1, 2, 3] and new.count() == 2
    second, more = external.embed_cached(data, "k", "t", external.HashEmbedder(8), new)
    assert sorted(r["k"] for r in second.collect()) == [1, 2, 3, 5] and more.count() == 1


def test_chat_answers_retries_and_falls_back(spark):
    def chat(messages):
        if "bad" in messages[-1]["content"]:
            raise OSError("down")
        return "" if "blank" in messages[-1]["content"] else f"{len(messages)}: {messages[-1]['content']}"

    data = spark.createDataFrame([(1, "x"), (2, "bad"), (3, "blank"), (4, None), (5, " ")], "k int, p string")
    got = dict(rows(external.ask_chat(data, "k", "p", chat, system="s", pause=0.0, fallback="none")))
    assert got == {1: "2: x", 2: "none", 3: "none", 4: "none", 5: "none"}
    assert external.TemplateChat(2)([{"role": "user", "content": "розы и розы, тюльпаны"}]).startswith("Розы тюльпаны\n\n") and external.TemplateChat()([]) == ""


def test_posts_of_answers(spark):
    df = spark.createDataFrame([(1, "# A title\n\nText\nmore # text"), (2, "Only a title"), (3, None), (4, "  ")], "k int, a string")
    got = {r["k"]: (r["p"]["post_title"], r["p"]["post_text"]) for r in df.select("k", prompts.post_of(F.col("a")).alias("p")).collect()}
    assert got == {1: ("A title", "Text more text"), 2: ("Only a title", prompts.FAILED), 3: (prompts.FAILED, prompts.FAILED), 4: (prompts.FAILED, prompts.FAILED)}


def test_every_request_gets_a_post(spark, small):
    got = catalogue.get_post(spark, small)
    assert got.count() == catalogue.responses(spark, small).select("request_id").distinct().count()
    assert got.filter("post_title IS NULL OR post_text IS NULL OR post_title = ''").count() == 0


def test_requests_from_json(spark):
    df = spark.createDataFrame([('[{"phrase":"a","count":2}]',), ("no json",), (None,)], "j string")
    assert [[tuple(x) for x in r[0]] for r in df.select(prompts.requests_from_json(F.col("j"))).collect()] == [[("a", 2)], [], []]


def test_topic_prompt_cuts_and_limits(spark):
    long = "x" * 900
    text = spark.createDataFrame([([None, " ", long, *["Старый Город в " + str(i) for i in range(20)]],), ([],), (None,)], "t array<string>").select(prompts.topic_prompt(F.col("t"))).collect()
    assert text[0][0].count("\n- ") == 12 and "x" * 700 in text[0][0] and "x" * 701 not in text[0][0] and "Старый Город" in text[0][0].split("Names in them: ")[1]
    assert text[1][0].endswith("Texts:\n-\n\nNames in them: -")


def test_snapshots_merge_by_key(spark, tmp_path):
    out = store.Snapshots(spark, f"file://{tmp_path}")
    assert not out.exists("t")
    out.merge("t", spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"], "at", "2025-01-01 00:00:00")
    out.merge("t", spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"], "at", "2025-02-01 00:00:00")
    assert out.exists("t") and [(k, v, str(at)[:7]) for k, v, at in rows(out.read("t").select("k", "v", "at"))] == [(1, "a", "2025-01"), (2, "c", "2025-02"), (3, "d", "2025-02")]


def test_dictionary_in_blocks_gives_what_one_gives(spark, monkeypatch):
    terms = spark.createDataFrame([("profanity", f"l{k}", f"сло{'абвгд'[k % 5]}{k}") for k in range(40)] + [("profanity", "a", "слоа0"), ("x", "p", "два слова"), ("x", "n", None), ("x", "e", "")], "category string, lemma string, form string")
    docs = spark.createDataFrame([(1, "тут слоа0 и с л о б 1"), (2, None), (3, "два   слова"), (4, "слов2" * 3), (1, "слог3")], "id long, text string")
    one = rows(moderation.dictionary_hits(docs, terms, "id", "text").select("id", F.map_entries("hits")))
    plain = rows(moderation.plain_hits(docs, terms, "id", "text"))
    monkeypatch.setattr(moderation, "BLOCK_FORMS", 7)
    assert rows(moderation.dictionary_hits(docs, terms, "id", "text").select("id", F.map_entries("hits"))) == one and rows(moderation.plain_hits(docs, terms, "id", "text")) == plain
    assert len(one) == 5 and (1, "profanity", "a") in plain and (1, "profanity", "l0") in plain


def test_verdict_and_scores(spark):
    df = spark.createDataFrame([(1, "block", "illegal_content", {"b": ["x"], "a": ["y"]}), (2, "allow", "clean", {})], "k int, decision string, reason string, hits map<string,array<string>>")
    assert rows(moderation.verdicts(df, "k")) == [(1, False, ["a", "b"], ["illegal_content"]), (2, True, [], [])]
    s = spark.range(1).select(moderation.combine_scores({"t": F.lit(0.3)}, {"i": F.lit(0.59)}, {"e": F.lit(0.7)}).alias("s")).first()["s"]
    assert s == {"profanity": 0.3, "extremism_support": 0.7, "illegal_content": 0.7}


def test_capabilities(spark):
    assert external.capabilities(spark, ["no_rows"]) == {"no_rows": False, "trigrams": True}
