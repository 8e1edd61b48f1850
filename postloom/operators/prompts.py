"""Building and taking apart prompts and posts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom.functions import text as tx

#: Examples of a topic prompt, their longest length, and hints from names.
EXAMPLES, EXAMPLE_CHARS, HINTS = 12, 700, 12
# What stands for a title or a text that could not be made.
FAILED = "Не удалось сгенерировать"
# Tags of prompt blocks.
TAGS = ("BOT", "PROFILE", "USER")


def build(bot: Column, profile: Column, user: Column) -> Column:
    """The tagged prompt; blank parts are left out."""
    part = lambda tag, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"[{tag}]\n"), F.trim(c)))
    return F.concat_ws("\n\n", part("BOT", bot), part("PROFILE", profile), part("USER", user))


def parse(prompt: Column) -> Column:
    """struct(bot, profile, user): lines after a tag belong to it, lines before any tag to the user."""
    start = F.struct(F.lit("USER").alias("tag"), *(F.lit("").alias(t.lower()) for t in TAGS))

    def step(acc: Column, line: Column) -> Column:
        found = F.upper(F.regexp_extract(F.trim(line), r"(?i)^\[(BOT|PROFILE|USER)\]", 1))
        rest = F.when(found != "", F.trim(F.regexp_replace(line, r"(?i)^\s*\[(BOT|PROFILE|USER)\]", ""))).otherwise(line)
        tag = F.when(found != "", found).otherwise(acc["tag"])
        add = lambda t: F.when(tag == t, F.concat(acc[t.lower()], rest, F.lit("\n"))).otherwise(acc[t.lower()])
        return F.struct(tag.alias("tag"), *(add(t).alias(t.lower()) for t in TAGS))

    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.aggregate(F.split(F.coalesce(prompt, F.lit("")), "\n"), start, step, lambda acc: F.struct(*(trim(acc[t.lower()]).alias(t.lower()) for t in TAGS)))


def _paragraphs(post: Column) -> Column:
    trimmed = F.regexp_replace(F.coalesce(post, F.lit("")), r"^\s+|\s+$", "")
    return F.split(trimmed, r"\n\s*\n")


def title(post: Column) -> Column:
    """The first paragraph on one line, without #."""
    return F.trim(F.regexp_replace(F.regexp_replace(_paragraphs(post)[0], "#", ""), r"\s+", " "))


def body(post: Column) -> Column:
    """All paragraphs but the first on one line, without #."""
    rest = F.array_join(F.slice(_paragraphs(post), 2, 1_000_000), " ")
    return F.trim(F.regexp_replace(F.regexp_replace(rest, "#", ""), r"\s+", " "))


def top_request(requests: Column) -> Column:
    """The entry of the highest count of array<struct<phrase,count>>, the first one on a tie; NULL for none."""
    best = F.array_max(F.transform(requests, lambda x: F.coalesce(x["count"], F.lit(0))))
    return F.get(F.filter(requests, lambda x: F.coalesce(x["count"], F.lit(0)) == best), 0)


def phrases(requests: Column, k: int) -> Column:
    """The first k non-blank phrases."""
    return F.slice(F.filter(F.transform(requests, lambda x: F.trim(x["phrase"])), lambda p: p.isNotNull() & (p != "")), 1, k)


def keywords(top: Column, requests: Column, associations: Column, grams: Column, slang: Column, most: int = 6) -> Column:
    """Up to ``most`` keywords of a context row, by source, without repeats and without phrases of stop words only."""
    empty = F.array().cast("array<string>")
    merged = F.concat(F.filter(F.array(top), lambda x: x.isNotNull()), *(F.coalesce(c, empty) for c in (phrases(requests, 5), phrases(associations, 3), F.slice(grams, 1, 10), F.slice(slang, 1, 8))))
    clean = F.transform(merged, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "[\"'«»“”„]", ""), r"\s+", " ")))
    useful = F.filter(clean, lambda x: F.exists(F.split(F.lower(x), " "), lambda w: (w != "") & ~w.isin(tx.STOP)))
    return F.slice(tx.distinct_fold(useful), 1, most)


def context_prompt(topic: Column, words: Column, demand: Column, examples: Column, snippets: Column, profile: Column) -> Column:
    """Instructions for a generator from a context row: topic, keywords, demand, two examples and four short snippets."""
    short = lambda c, n: F.left(F.regexp_replace(c, r"\s*\n\s*", " "), F.lit(n))
    bullets = lambda xs, n, k: F.array_join(F.transform(F.slice(F.coalesce(xs, F.array().cast("array<string>")), 1, k), lambda x: F.concat(F.lit("- "), short(x, n))), "\n")
    return F.concat_ws(
        "\n", F.concat(F.lit("Topic: "), F.coalesce(topic, F.lit("any"))), F.concat(F.lit("Keywords: "), F.array_join(words, ", ")), F.concat(F.lit("Requests a month: "), tx.thousands(demand)),
        F.concat(F.lit("Author: "), F.coalesce(profile, F.lit("anyone"))), F.lit("Examples:"), bullets(examples, 300, 2), F.lit("Also written:"), bullets(snippets, 200, 4),
    )


def example_block(texts: Column, most: int = EXAMPLES, chars: int = EXAMPLE_CHARS) -> Column:
    """The first non-blank texts, trimmed and cut, as a list; "-" for none."""
    kept = F.slice(F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")), 1, most)
    return F.when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda x: F.concat(F.lit("- "), F.left(x, F.lit(chars)))), "\n")).otherwise(F.lit("-"))


def topic_prompt(texts: Column) -> Column:
    """Instructions to name the topic of texts, with the names in them as hints."""
    kept = F.slice(F.filter(texts, lambda x: x.isNotNull() & (F.trim(x) != "")), 1, EXAMPLES)
    hints = F.slice(F.flatten(F.transform(kept, tx.capital_phrases)), 1, HINTS)
    return F.concat(F.lit("Name one simple topic of these texts in three to ten words, without quotes.\n\nTexts:\n"), example_block(texts), F.lit("\n\nNames in them: "), F.when(F.size(hints) > 0, F.array_join(hints, ", ")).otherwise(F.lit("-")))


def post_of(answer: Column) -> Column:
    """struct(post_title, post_text) of a generator's answer; what is missing reads FAILED."""
    whole = F.when(F.trim(F.coalesce(answer, F.lit(""))) != "", answer).otherwise(F.lit(FAILED + "\n\n" + FAILED))
    filled = lambda c: F.when(F.trim(c) != "", c).otherwise(F.lit(FAILED))
    return F.struct(filled(title(whole)).alias("post_title"), filled(body(whole)).alias("post_text"))


def requests_from_json(c: Column) -> Column:
    """array<struct<phrase,count>> of a JSON text; an empty array for NULL and for what is no such text."""
    kind = "array<struct<phrase:string,count:bigint>>"
    return F.coalesce(F.from_json(c, kind), F.array().cast(kind))
