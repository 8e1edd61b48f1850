"""Text expressions as Columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Stop words, tokens and limits of key phrases; allowed signs of request phrases.
STOP = "и в во на но а как о об от до за из по при к с у же ли или что это то так там тут для без про над под между не ни да ну the a an to of in on at for and or but is are be by with as from".split()
PHRASE_TOKEN = r"[A-Za-zА-Яа-яЁё0-9][A-Za-zА-Яа-яЁё0-9\-]+"
LINK = r"(?i)https?://\S+|www\.\S+"
REQUEST_SIGNS = r"A-Za-zА-Яа-яЁё0-9\s+\-|!\[\]()\"«»"
PLAIN_SIGNS = r"A-Za-zА-Яа-яЁё0-9\s"
CAPITALS = r"(?:[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){1,3})|(?:[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
TITLE_EDGES = r"^[\"'«»“”„`\s]+|[\"'«»“”„`.\s]+$"
EMOJI = r"[\x{1F300}-\x{1FAFF}]"
# Look-alike signs.
LEET_FROM, LEET_TO = "@4€31!|05$7+", "aaeeiiiosstt"
LATIN, CYRILLIC = "aeopcxykmtih", "аеорсхукмтіһ"
SEPARATORS = r"[\s\.\,\-\_\*\|\+\=\~\\/]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(c: Column | str) -> Column:
    """Tokens between any white space; 0 for NULL."""
    return F.coalesce(F.size(F.filter(F.split(_col(c), r"(?U)\s+"), lambda x: x != "")), F.lit(0))


def char_rate(c: Column | str, ch: str) -> Column:
    s = _col(c)
    return F.coalesce((F.length(s) - F.length(F.replace(s, F.lit(ch), F.lit("")))) / F.greatest(F.length(s), F.lit(1)), F.lit(0.0))


def emoji_rate(c: Column | str) -> Column:
    s = _col(c)
    return F.coalesce(F.regexp_count(s, F.lit(EMOJI)) / F.greatest(F.length(s), F.lit(1)), F.lit(0.0))


def words(c: Column | str) -> Column:
    """Distinct sorted lower-case words: the lexical form of a text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def holds_all(tokens: Column, query: Column) -> Column:
    """Whether all query words are among the tokens; an empty query never matches, a NULL one gives NULL."""
    return (F.size(query) > 0) & (F.size(F.array_except(query, tokens)) == 0)


def trigrams(c: Column | str) -> Column:
    """Distinct trigrams of the words, each padded by two blanks before and one after."""
    padded = F.transform(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 where there are none."""
    x, y = trigrams(F.coalesce(a, F.lit(""))), trigrams(F.coalesce(b, F.lit("")))
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def phrase_tokens(c: Column | str) -> Column:
    """Tokens for key phrases: lower case, without stop words, short words and plain numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(PHRASE_TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP) & (F.length(w) > 2) & ~w.rlike(r"^[0-9]+$"))


def clean_title(c: Column | str, most: int = 120) -> Column:
    """A title without quotes and closing dots, cut before the last word that does not fit, first letter large."""
    s = F.regexp_replace(F.trim(_col(c)), TITLE_EDGES, "")
    cut = F.when(F.length(s) > most, F.regexp_replace(F.left(s, F.lit(most)), r"\s+\S*$", "")).otherwise(s)
    return F.concat(F.upper(F.left(cut, F.lit(1))), F.substr(cut, F.lit(2)))


def _sanitised(c: Column, allowed: str, most: int) -> Column:
    s = F.regexp_replace(F.coalesce(c, F.lit("")), LINK, " ")
    return F.left(F.trim(F.regexp_replace(F.regexp_replace(s, f"[^{allowed}]", " "), r"\s+", " ")), F.lit(most))


def request_phrase(c: Column | str, most: int = 256) -> Column:
    """A phrase for a popularity request: no links, only allowed signs, squeezed and cut."""
    return _sanitised(_col(c), REQUEST_SIGNS, most)


def plain_phrase(c: Column | str, most: int = 256) -> Column:
    """The simpler phrase that is asked for when the first one is refused: letters, digits and blanks only."""
    return _sanitised(_col(c), PLAIN_SIGNS, most)


def capital_phrases(c: Column | str) -> Column:
    """Runs of two to four capitalised words of one script."""
    return F.regexp_extract_all(_col(c), F.lit(CAPITALS), F.lit(0))


def distinct_fold(items: Column) -> Column:
    """Order-keeping removal of repeats that differ in case only."""
    return F.aggregate(
        F.filter(items, lambda x: x.isNotNull() & (F.trim(x) != "")), F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(F.trim(x))), acc).otherwise(F.concat(acc, F.array(F.trim(x)))),
    )


def thousands(c: Column | str) -> Column:
    """A whole number with blanks between thousands; "0" for NULL."""
    return F.replace(F.format_number(F.coalesce(_col(c).cast("long"), F.lit(0)), 0), F.lit(","), F.lit(" "))


def clamped(c: Column | str, low: int, high: int, default: int | None = None) -> Column:
    """A whole number brought between two bounds; the default, or else the lower bound, for NULL and for what is no number."""
    return F.least(F.greatest(F.coalesce(_col(c).try_cast("long"), F.lit(low if default is None else default)), F.lit(low)), F.lit(high)).cast("long")


@F.pandas_udf(StringType())
def _decomposed(s: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        if x is None:
            return None
        low = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", x).lower())
        return "".join(ch for ch in low if not unicodedata.combining(ch))

    return s.map(one, na_action="ignore")


def _folded(c: Column, joiner: str) -> Column:
    s = F.translate(_decomposed(F.coalesce(c, F.lit(""))), LEET_FROM, LEET_TO)
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)" + SEPARATORS, joiner), r"(.)\1{2,}", "$1$1")
    s = F.translate(s, LATIN, CYRILLIC)
    return F.regexp_replace(s, r"(?U)[^\w\x{0400}-\x{04FF}\s]+", "")


def surface(c: Column | str) -> Column:
    """Comparable spelling with single blanks: decomposed, look-alikes folded, separators to blanks, long runs cut to two."""
    return F.replace(F.trim(F.regexp_replace(_folded(_col(c), " "), r"(?U)\s+", " ")), F.lit("ё"), F.lit("е"))


def compact(c: Column | str) -> Column:
    """The same without any separators."""
    return F.replace(_folded(_col(c), ""), F.lit("ё"), F.lit("е"))
