"""Dictionary matching, decisions and redaction. Dictionaries and thresholds are data; models are pluggable columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postloom.functions import text as tx
from postloom.storage import fits_broadcast

# Thresholds of the policy and the placeholder.
THRESHOLDS = {"illegal_content": 0.80, "extremism_support": 0.80, "profanity": 0.65, "review_low": 0.50, "review_high": 0.80}
PLACEHOLDER = "[REDACTED]"
#: Forms of one automaton.
BLOCK_FORMS = 500_000
#: Score from which a label of a zero-shot model counts.
LABEL_THRESHOLD = 0.60


def plain_hits(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, category, lemma): lemmas of which a form occurs in the lower-cased text, each once a key."""
    listed = terms.filter(F.col("form").isNotNull() & (F.col("form") != "")).select(F.lit(0).alias("kind"), F.lower("form").alias("form"), "category", "lemma").distinct()
    found = _matched(docs.select(key, F.lower(text).alias("_t0"), F.lit("").alias("_t1")), listed, key)
    pairs = found.select(key, F.explode("hits").alias("category", "_lemmas"))
    return pairs.select(key, "category", F.explode("_lemmas").alias("lemma")).distinct()


def dictionary_hits(docs: DataFrame, terms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hits map<category, sorted lemmas>): matches without word borders on both normal forms, spaced and compact.

    The first lemma by name wins a form. Compact matching is for single words only. NULL texts have no hits; a row comes
    out for each that comes in."""
    kept = terms.filter("form IS NOT NULL AND form <> ''").select("category", "lemma", F.contains(F.trim("form"), F.lit(" ")).alias("phrase"), tx.surface("form").alias("spaced"), tx.compact("form").alias("compact"))
    both = kept.select(F.lit(0).alias("kind"), F.col("spaced").alias("form"), "category", "lemma").unionByName(kept.filter("NOT phrase").select(F.lit(1).alias("kind"), F.col("compact").alias("form"), "category", "lemma"))
    listed = both.filter("form <> ''").groupBy("kind", "form", "category").agg(F.min("lemma").alias("lemma"))
    return _matched(docs.select(F.col(key), tx.surface(text).alias("_t0"), tx.compact(text).alias("_t1")), listed, key)


def _matched(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, hits) of ``rows`` (key, _t0, _t1) against forms (kind, form, category, lemma), kind k in text _tk. An automaton
    a task holds BLOCK_FORMS forms at most; with more, the rows go through several, one after another, and gather hits."""
    kind = dict(rows.dtypes)[key]
    blocks = max(1, -(-listed.count() // BLOCK_FORMS))
    out = rows.withColumn("hits", F.create_map().cast("map<string,array<string>>"))
    for b in range(blocks):
        tables: tuple[dict, dict] = ({}, {})
        for r in listed.filter(F.pmod(F.xxhash64("form"), F.lit(blocks)) == b).collect():
            tables[r["kind"]].setdefault(r["form"], set()).add((r["category"], r["lemma"]))
        held = rows.sparkSession.sparkContext.broadcast(tables)

        def find(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            scans = [_matcher(t) for t in held.value]
            for pdf in batches:
                out = []
                for texts in zip(pdf["_t0"], pdf["_t1"], pdf["hits"], strict=True):
                    hits = {k: set(v) for k, v in dict(texts[2]).items()}
                    for scan, x in zip(scans, texts[:2], strict=True):
                        for category, lemma in scan(x or ""):
                            hits.setdefault(category, set()).add(lemma)
                    out.append({k: sorted(v) for k, v in sorted(hits.items())})
                yield pdf.assign(hits=out)

        out = out.mapInPandas(find, f"`{key}` {kind}, _t0 string, _t1 string, hits map<string,array<string>>")
    return out.select(key, "hits")


def _matcher(table: dict[str, set]) -> Callable[[str], set]:
    if not table:
        return lambda text: set()
    import ahocorasick

    auto = ahocorasick.Automaton()
    for form, payload in table.items():
        auto.add_word(form, payload)
    auto.make_automaton()
    return lambda text: {p for _, payload in auto.iter(text) for p in payload}


def expand_forms(lemmas: DataFrame, forms: DataFrame) -> DataFrame:
    """(category, lemma, form): each lemma with its inflected ``forms`` (lemma, form), and itself; phrases stay whole."""
    own = lemmas.select("category", "lemma", F.col("lemma").alias("form"))
    words = lemmas.filter(~F.contains(F.trim("lemma"), F.lit(" ")))
    return own.unionByName(words.join(forms.select("lemma", "form"), "lemma").select("category", "lemma", "form")).filter("form IS NOT NULL").distinct()


def lemmatised(docs: DataFrame, forms: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text): the spaced normal form with each word replaced by its lemma in ``forms`` (lemma, form), the smallest of
    several; words without one stay. NULL texts give empty ones; rows of a key count once.

    Words travel, not texts: a row is taken apart, its distinct words are looked up, and it is put together again."""
    known = forms.select(tx.surface("form").alias("_w"), tx.surface("lemma").alias("_l")).groupBy("_w").agg(F.min("_l").alias("_l"))
    rows = docs.select(key, tx.surface(text).alias("_t")).groupBy(key).agg(F.max("_t").alias("_t"))
    words = rows.select(key, F.posexplode(F.split("_t", " ")).alias("_pos", "_w"))
    known = F.broadcast(known) if fits_broadcast(known) else known
    named = words.join(known, "_w", "left").select(key, "_pos", F.coalesce("_l", "_w").alias("_w"))
    return named.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_w"))), lambda x: x["_w"]), " ").alias("text"))


def combine_scores(toxic: dict[str, Column], illegal: dict[str, Column], extremism: dict[str, Column]) -> Column:
    """Scores of a model as map: profanity is the highest toxic label; the others are the highest label from
    LABEL_THRESHOLD on, 0 below; illegal content is at least extremism."""
    top = lambda d: F.array_max(F.array(*d.values())) if d else F.lit(0.0)
    gate = lambda c: F.when(c >= LABEL_THRESHOLD, c).otherwise(F.lit(0.0))
    ex, il = gate(top(extremism)), gate(top(illegal))
    return F.create_map(F.lit("profanity"), top(toxic), F.lit("extremism_support"), ex, F.lit("illegal_content"), F.greatest(il, ex))


def decide(hits: Column, scores: Column, limits: dict[str, float] = THRESHOLDS) -> Column:
    """struct(decision, reason): illegal content, then extremism block; profanity redacts; a doubtful score asks for a
    review; all else is clean. A missing hit map or score counts as none."""
    hit = lambda k: F.coalesce(F.map_contains_key(hits, k), F.lit(False))
    score = lambda k: F.coalesce(scores[k], F.lit(0.0))
    doubt = lambda k: (score(k) >= limits["review_low"]) & (score(k) < limits["review_high"])
    out = lambda d, r: F.struct(F.lit(d).alias("decision"), F.lit(r).alias("reason"))
    return (
        F.when(hit("illegal_content") | (score("illegal_content") >= limits["illegal_content"]), out("block", "illegal_content"))
        .when(hit("extremism_support") | (score("extremism_support") >= limits["extremism_support"]), out("block", "extremism_support"))
        .when(hit("profanity") | (score("profanity") >= limits["profanity"]), out("redact", "profanity"))
        .when(doubt("illegal_content") | doubt("extremism_support"), out("review", "uncertain_high_risk"))
        .otherwise(out("allow", "clean"))
    )


def term_pattern(term: str) -> re.Pattern:
    """The letters of a term with any non-word signs between them."""
    return re.compile(r"\W*".join(re.escape(c) for c in term), re.IGNORECASE)


def redact(text: str, terms: list[str], placeholder: str = PLACEHOLDER) -> str:
    """All terms replaced, longer ones first, then by name."""
    for t in sorted({t for t in terms if t}, key=lambda t: (-len(t), t)):
        text = term_pattern(t).sub(lambda m: placeholder, text)
    return text


def moderate(docs: DataFrame, terms: DataFrame, key: str, text: str, scores: Column | None = None) -> DataFrame:
    """(key, decision, reason, hits, scores, text): a blocked text is NULL, a redacted one has its lemmas replaced."""
    found = dictionary_hits(docs, terms, key, text)
    scored = docs.select(key, F.col(text).alias("_t"), (scores if scores is not None else F.create_map().cast("map<string,double>")).alias("scores"))
    rows = scored.join(found, key).withColumn("_d", decide(F.col("hits"), F.col("scores")))

    @F.pandas_udf(StringType())
    def redacted(t: pd.Series, lemmas: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else redact(x, list(ls)) for x, ls in zip(t, lemmas, strict=True)])

    lemmas = F.array_distinct(F.flatten(F.map_values("hits")))
    out = F.when(F.col("_d.decision") == "block", F.lit(None)).when(F.col("_d.decision") == "redact", redacted("_t", lemmas)).otherwise(F.col("_t"))
    return rows.select(key, "_d.decision", "_d.reason", "hits", "scores", out.alias("text"))


def verdicts(moderated: DataFrame, key: str) -> DataFrame:
    """(key, ok, labels, reasons): the answer of a moderation service. Only blocked texts are not ok; labels are the
    categories hit, and an allowed text has no reason."""
    reasons = F.when(F.col("decision") == "allow", F.array().cast("array<string>")).otherwise(F.array("reason"))
    return moderated.select(key, (F.col("decision") != "block").alias("ok"), F.array_sort(F.map_keys("hits")).alias("labels"), reasons.alias("reasons"))
