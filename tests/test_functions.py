import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.functions import vectors as vx
from postloom.operators import prompts, style


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'array<double>' if isinstance(v, list) and (not v or isinstance(v[0], float)) else 'array<string>'}" for k, v in cols.items())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def test_rates_and_counts(spark):
    assert one(spark, tx.token_count("t"), t="a b\tc d ") == 4
    assert one(spark, tx.token_count("t"), t=None) == 0
    assert one(spark, tx.emoji_rate("t"), t="a\U0001f525b\U0001f525") == 0.5
    assert one(spark, tx.char_rate("t", "!"), t="!a!") == pytest.approx(2 / 3)
    assert one(spark, tx.char_rate("t", "!"), t="") == 0 and one(spark, tx.char_rate("t", "?"), t=None) == 0


def test_vectors(spark):
    assert one(spark, vx.similarity("a", "b"), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0
    assert one(spark, vx.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) is None
    assert one(spark, vx.unit("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, vx.unit("a"), a=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, vx.from_text(vx.to_text("a")), a=[0.5, -2.0]) == [0.5, -2.0]
    assert one(spark, vx.from_text("t"), t="nonsense") is None


def test_titles_and_phrases(spark):
    assert one(spark, tx.clean_title("t"), t=" «щётки: вопросы». ") == "Щётки: вопросы"
    long = one(spark, tx.clean_title("t"), t="word " * 40)
    assert len(long) <= 120 and long.endswith("word")
    assert one(spark, tx.request_phrase("t"), t="see https://a.b/c  «x» y!") == "see «x» y!"
    assert one(spark, tx.plain_phrase("t"), t="see HTTPS://a.b/c  «x» y!") == "see x y" and one(spark, tx.request_phrase("t"), t="a/b; c+d [e] №5") == "a b c+d [e] 5"
    assert [one(spark, tx.clamped("t", 5, 9, 7), t=t) for t in ("1", "8", "99", "x", None)] == [5, 8, 9, 7, 7]
    assert one(spark, tx.capital_phrases("t"), t="Вот Анна Петрова и John Smith. one Two") == ["Вот Анна Петрова", "John Smith"]
    assert one(spark, tx.distinct_fold(F.col("a")), a=["b", "B ", "", "c", "C"]) == ["b", "c"]
    assert one(spark, tx.thousands(F.lit(1234567))) == "1 234 567"


def test_lexical(spark):
    assert one(spark, tx.holds_all(tx.words("t"), tx.words(F.lit("b a"))), t="A, b c") is True
    assert one(spark, tx.holds_all(tx.words("t"), tx.words(F.lit(" "))), t="a") is False
    assert one(spark, tx.trigram_similarity(F.col("t"), F.lit("cat")), t="cat") == 1.0
    assert one(spark, tx.trigram_similarity(F.col("t"), F.lit("")), t=None) == 0.0


def model(s, joiner):
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).lower())
    s = "".join(c for c in s if not unicodedata.combining(c)).translate(str.maketrans(tx.LEET_FROM, tx.LEET_TO))
    s = re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"[\s.,\-_*|+=~\\/]+", joiner, s)).translate(str.maketrans(tx.LATIN, tx.CYRILLIC))
    s = re.sub(r"[^\wЀ-ӿ\s]+", "", s)
    return re.sub(r"\s+", " ", s).strip().replace("ё", "е") if joiner else s.replace("ё", "е")


def test_normal_forms_against_a_model(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("абвёйabcxyz @4$!|+-_*./\\?,0137ÀéХхх ") for _ in range(r.randint(0, 30))) for _ in range(200)] + ["", "д-у_р*а.к", "h e l l o"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", "t", tx.surface("t").alias("s"), tx.compact("t").alias("c")).collect()
    for row in got:
        assert row["s"] == model(row["t"], " "), row
        assert row["c"] == model(row["t"], ""), row


def test_prompts_round_trip(spark):
    p = prompts.build(F.col("b"), F.col("p"), F.col("u"))
    assert one(spark, p, b="be kind", p=None, u="write\ntwo lines") == "[BOT]\nbe kind\n\n[USER]\nwrite\ntwo lines"
    assert tuple(one(spark, prompts.parse(p), b="be kind", p=" ", u="write\n\ntwo lines")) == ("be kind", "", "write\n\ntwo lines")
    assert tuple(one(spark, prompts.parse(F.col("t")), t="plain\n[bot] x\n[BOT]\ny")) == ("x\n\ny", "", "plain")
    assert one(spark, prompts.title(F.col("t")), t="\n# A\n title\n\nbody # one\n\n two") == "A title"
    assert one(spark, prompts.body(F.col("t")), t="\n# A\n title\n\nbody # one\n\n two") == "body one two"
    assert one(spark, prompts.body(F.col("t")), t=None) == ""


def test_top_request_takes_the_first_of_a_tie(spark):
    df = spark.sql("select array(named_struct('phrase','a','count',1L), named_struct('phrase','b','count',3L), named_struct('phrase','c','count',3L)) q union all select array() union all select null")
    got = [r[0] and r[0]["phrase"] for r in df.select(prompts.top_request(F.col("q"))).collect()]
    assert got == ["b", None, None]


def greedy(items):
    out = []
    for x in items:
        a = set(x.split())
        if len(out) < style.PHRASES and not any(len(a & set(y.split())) / min(len(a), len(set(y.split()))) >= style.OVERLAP for y in out):
            out.append(x)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=2, max_size=3).map(" ".join), min_size=1, max_size=30))
def test_distinct_phrases_against_a_model(spark, items):
    assert one(spark, style.distinct_phrases(F.col("a")), a=items) == greedy(items)
