"""Markup residue in text: find it by type, drop boilerplate of the host, and keep what the markup meant.

The pages of a host are token streams, with markup as tokens of their own. They are concatenated, and a suffix array
(prefix doubling) brings equal substrings together: suffixes that agree on their first ``LONG`` tokens form a class, and
a class that spans ``PAGES`` distinct texts is boilerplate. Covered tokens are removed; the unique runs are kept and
their markup becomes plain text in which headings, lists, code and formulas can still be told apart. The types of markup
of a field are those of its unique runs and of its boilerplate, which is looked at once for all pages that share it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a substring that counts as long, a power of two, and distinct texts it must occur in.
LONG, PAGES = 32, 3
#: Tokens of the shorter windows of which the least by hash stands for a long one.
SHORT = 8
#: Characters of a host's texts in one block; a larger host is cut into blocks that exchange what they found.
BLOCK_CHARS = 24_000_000

# Signs of markup by type.
SIGNS = {
    "html": r"</?[a-zA-Z][a-zA-Z0-9]{0,14}(?:\s+[a-zA-Z_:][\w:-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>|<!--|-->|<!DOCTYPE|&(?:[a-zA-Z]{2,8}\d{0,2}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});",
    "markdown": r"^[ ]{0,3}\#{1,6}[ ]+\S|\*\*[^\s*](?:[^*\n]*[^\s*])?\*\*|(?<![\w_])__[^\s_](?:[^\n]*?[^\s_])?__(?![\w_])|!?\[[^\]\n]*\]\([^()\s]+(?:\s+\"[^\"]*\")?\)|^[ ]{0,3}(?:```|~~~)|`[^`\n]+`"
    r"|^\s*[-*+][ ]\[[ xX]\][ ]|^[ ]{0,3}>[ ]?\S|^[ ]{0,3}\|(?:[ ]?:?-{3,}:?[ ]?\|)+\s*$|~~[^\s~](?:[^~\n]*[^\s~])?~~",
    "wiki": r"^\s*(?P<eq>={2,6})[^=\n]+(?P=eq)\s*$|'''?[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|\{\{[^{}\n]*\}\}|^\s*\{\|[^\n]*$|^\s*\|\}|^\s*\|-(?!-*\|)-*[^|\n]*$",
    "latex": r"\\(?:begin|end|emph|textbf|textit|texttt|underline|cite|ref|label|section|subsection|chapter|paragraph|item|frac|sqrt|sum|int|prod|leq|geq|neq|cdot|times|alpha|beta|gamma|footnote|url|href|left|right|infty)(?![a-zA-Z])|\\\[|\\\]|\\\(|\\\)"
    r"|\$\$[^$]+\$\$|\$[^$\n]*[\\^_{}][^$\n]*\$",
}
# Commands whose argument is a heading, and block tags that end a line.
HEADINGS = "section|subsection|subsubsection|chapter|paragraph|title"
BLOCKS = "p|div|table|tr|ul|ol|blockquote|section|article|header|footer|br|hr"

_SIGNS = {k: re.compile(v, re.M) for k, v in SIGNS.items()}
# Each kind needs one of these characters, so most texts are cleared at once.
_NEEDS = {"html": re.compile(r"<|-->|&\w|&#"), "markdown": re.compile(r"[#*_\]`>|~]|\[[ xX]\]"), "wiki": re.compile(r"==|''|\[\[|\{\{|\{\||\|"), "latex": re.compile(r"[\\$]")}
# Signs that run over the end of a line: a text with one of them is looked at as a whole.
_OVER_LINES = re.compile(r"<[a-zA-Z/!][^<>]*\n|\$\$|\]\([^()\s]+\s*\n")
_TOKEN = re.compile(r"</?[a-zA-Z][^<>\n]*>|<!--|-->|&\w+;|\\[a-zA-Z]+|```|\{\{|\}\}|\[\[|\]\]|\w+|[^\w\s]|\n")


def markup_types(text: str | None) -> list[str]:
    """Types of markup in a text, sorted; none for NULL and empty texts."""
    if not text:
        return []
    return [k for k in ("html", "latex", "markdown", "wiki") if _NEEDS[k].search(text) and _SIGNS[k].search(text)]


def _formula(body: str) -> str:
    body = re.sub(r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"\1/\2", body)
    body = re.sub(r"\\sqrt\{([^{}]*)\}", r"√(\1)", body)
    for name, sign in (("leq", "≤"), ("geq", "≥"), ("neq", "≠"), ("cdot", "·"), ("times", "×"), ("alpha", "α"), ("beta", "β"), ("gamma", "γ"), ("sum", "∑"), ("infty", "∞")):
        body = re.sub(rf"\\{name}(?![a-zA-Z])", sign, body)
    return "⟦" + re.sub(r"[{}]", "", body).strip() + "⟧"


def _code(body: str) -> str:
    return "\n" + "\n".join("    " + x for x in body.strip("\n").split("\n")) + "\n"


def to_plain(text: str, types: list[str]) -> str:
    """Plain text for markup of ``types``: headings begin with "§ ", list items with "• ", code lines with four blanks,
    table cells are parted by " · ", and formulas stand in ⟦ ⟧. Text without markup comes back as it is."""
    if not types:
        return text
    kept: list[str] = []

    def keep(body: str) -> str:
        kept.append(body)
        return f"\x00{len(kept) - 1}\x00"

    t = text
    if "html" in types:
        t = re.sub(r"(?is)<pre[^<>]*>(.*?)(?:</pre>|\Z)", lambda m: keep(_code(html.unescape(re.sub(r"<[^<>]+>", "", m[1])))), t)
    if "markdown" in types:
        t = re.sub(r"(?ms)^[ ]{0,3}(```|~~~)[^\n]*\n(.*?)(?:^[ ]{0,3}\1[^\n]*$|\Z)", lambda m: keep(_code(m[2])), t)
        t = re.sub(r"`([^`\n]+)`", lambda m: keep(m[1]), t)
    if "latex" in types:
        t = re.sub(r"(?s)\\begin\{(?:verbatim|lstlisting)\}(.*?)\\end\{(?:verbatim|lstlisting)\}", lambda m: keep(_code(m[1])), t)
        t = re.sub(r"(?s)\$\$([^$]+)\$\$|\\\[(.*?)\\\]|\\\((.*?)\\\)|\$([^$\n]*[\\^_{}][^$\n]*)\$", lambda m: keep(_formula(m[1] or m[2] or m[3] or m[4] or "")), t)
        t = re.sub(rf"\\(?:{HEADINGS})\*?\{{([^{{}}]*)\}}", r"\n§ \1\n", t)
        t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
        t = re.sub(r"\\item(?![a-zA-Z])\s*(?:\[([^\]]*)\])?", r"\n• \1", t)
        t = re.sub(r"~?\\(?:cite|ref|label)\{[^{}]*\}", "", t)
        t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
        for _ in range(3):
            t = re.sub(r"\\(?:emph|textbf|textit|texttt|underline|footnote|url)\{([^{}]*)\}", r"\1", t)
    if "html" in types:
        t = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", t)
        t = re.sub(r"(?is)<h[1-6][^<>]*>(.*?)</h[1-6]\s*>", r"\n§ \1\n", t)
        t = re.sub(r"(?i)<li[^<>]*>", "\n• ", t)
        t = re.sub(r"(?i)</t[dh]\s*>\s*<t[dh][^<>]*>", " · ", t)
        t = re.sub(rf"(?i)</?(?:{BLOCKS})(?:\s[^<>]*)?/?>", "\n", t)
        t = re.sub(r"</?[a-zA-Z][a-zA-Z0-9]{0,14}(?:\s[^<>]*)?/?>|<!--|-->", "", t)
        t = html.unescape(t)
    if "wiki" in types:
        t = re.sub(r"(?m)^\s*(={2,6})\s*([^=\n]+?)\s*\1\s*$", r"§ \2", t)
        t = re.sub(r"(?m)^\s*(?:\{\|[^\n]*|\|\}|\|-+[^|\n]*)$\n?", "", t)
        t = re.sub(r"(?m)^\s*[!|]\s*", "", t)
        t = re.sub(r"\s*(?:\|\||!!)\s*", " · ", t)
        t = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]\n]+)\]\]", r"\1", t)
        t = re.sub(r"\{\{(?:[^{}|\n]*\|)?([^{}\n]*)\}\}", r"\1", t)
        t = re.sub(r"'''?", "", t)
    if "markdown" in types:
        t = re.sub(r"(?m)^[ ]{0,3}#{1,6}[ ]+(.*?)[ ]*#*$", r"§ \1", t)
        t = re.sub(r"(?m)^[ ]{0,3}\|(?:[ ]?:?-{3,}:?[ ]?\|)+\s*$\n?", "", t)
        t = re.sub(r"(?m)^[ ]{0,3}\|(.*)\|\s*$", lambda m: " · ".join(x.strip() for x in m[1].split("|")), t)
        t = re.sub(r"(?m)^\s*[-*+][ ](?:\[[ xX]\][ ])?", "• ", t)
        t = re.sub(r"(?m)^[ ]{0,3}>[ ]?", "", t)
        t = re.sub(r"!?\[([^\]\n]*)\]\([^()\n]*\)", r"\1", t)
        t = re.sub(r"\*\*([^\s*](?:[^*\n]*[^\s*])?)\*\*|(?<![\w_])__([^\s_](?:[^\n]*?[^\s_])?)__(?![\w_])|~~([^~\n]+)~~", lambda m: m[1] or m[2] or m[3], t)
    for _ in range(2):
        t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", t)).strip("\n")


def suffix_classes(ids: np.ndarray, long: int = LONG) -> np.ndarray:
    """The rank of every suffix by its first ``long`` tokens (prefix doubling); suffixes that agree on them share it."""
    _, rank = np.unique(ids, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    width = 1
    while width < long and len(rank):
        ahead = np.zeros_like(rank)
        ahead[:-width] = rank[width:] if width < len(rank) else 0
        _, rank = np.unique(rank * (rank.max() + 1) + ahead, return_inverse=True)
        rank = rank.astype(np.int64) + 1
        width *= 2
    return rank


class Stream:
    """The concatenated token streams of distinct texts; every text ends with a token that occurs nowhere else."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        known: dict[str, int] = {}
        ids, starts, ends, page, bounds = [], [], [], [], [0]
        for k, text in enumerate(texts):
            for m in _TOKEN.finditer(text):
                ids.append(known.setdefault(m[0], len(known)))
                starts.append(m.start())
                ends.append(m.end())
            ids.append(-k - 1)
            starts.append(len(text))
            ends.append(len(text))
            page.append(len(ids) - bounds[-1])
            bounds.append(len(ids))
        self.ids, self.starts, self.ends = np.array(ids, np.int64), np.array(starts), np.array(ends)
        self.page, self.bounds = np.repeat(np.arange(len(texts)), page), np.array(bounds)
        self.words = list(known)

    def windows(self, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of suffixes in suffix order, and the number of distinct pages of each suffix's class."""
        rank = suffix_classes(self.ids, long)
        order = np.lexsort((self.page, rank))
        r, p = rank[order], self.page[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
        pages = np.bincount(r[first], minlength=int(r.max()) + 1 if len(r) else 1)
        return rank, pages[rank]

    def whole(self, long: int) -> np.ndarray:
        """Positions whose window ends before the end of its text; a window that reaches the end is shared with no text."""
        last = self.bounds[self.page + 1] - 1 if len(self.ids) else np.zeros(0, np.int64)
        return np.flatnonzero(np.arange(len(self.ids)) + long <= last)

    def _hashes(self, width: int) -> np.ndarray:
        """A content hash of the ``width`` tokens from each position on, equal in every block."""
        own = np.array([xxhash.xxh64_intdigest(w) for w in self.words] + [0], np.uint64)[np.maximum(self.ids, -1)]
        out, n = np.zeros(len(own), np.uint64), len(own)
        with np.errstate(over="ignore"):
            for k in range(width):
                out[: max(n - k, 0)] = (out[: max(n - k, 0)] ^ own[k:]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
        return out

    def keys(self, at: np.ndarray, long: int) -> np.ndarray:
        """A content hash of the window at each position out of whole(), equal in every block."""
        return self._hashes(long)[at].view(np.int64)

    def minimisers(self, at: np.ndarray, long: int) -> np.ndarray:
        """For the window at each position out of whole(), the least hash of the shorter windows inside it: equal windows
        have the same one, and neighbouring windows mostly share it."""
        inner = self._hashes(min(SHORT, long))
        out = inner[at].copy()
        for k in range(1, long - min(SHORT, long) + 1):
            np.minimum(out, inner[at + k], out=out)
        return out.view(np.int64)

    def covered(self, heads: np.ndarray, long: int) -> dict[int, list[tuple[int, int]]]:
        """By page, the stretches of its text that windows beginning at ``heads`` cover, as positions of characters."""
        cover = np.zeros(len(self.ids) + 1, np.int64)
        np.add.at(cover, heads, 1)
        np.add.at(cover, np.minimum(heads + long, len(self.ids)), -1)
        hit = np.cumsum(cover)[:-1] > 0
        out = {}
        for k in np.unique(self.page[hit]) if hit.any() else []:
            lo, hi = self.bounds[k], self.bounds[k + 1] - 1
            edges = np.flatnonzero(np.diff(np.concatenate([[False], hit[lo:hi], [False]]).astype(np.int8))).reshape(-1, 2)
            out[int(k)] = [(int(self.starts[lo + s]), int(self.ends[lo + e - 1])) for s, e in edges]
        return out


def unique_runs(text: str, covered: list[tuple[int, int]]) -> str:
    """What is left of a text without its covered stretches."""
    parts, at = [], 0
    for s, e in covered:
        parts.append(text[at:s])
        at = e
    return "".join([*parts, text[at:]])


def types_of_runs(text: str, covered: list[tuple[int, int]], known: dict[str, list[str]]) -> list[str]:
    """Types of markup of a text from its unique runs and its covered ones, sorted; the same as those of the whole text.

    Signs stand on one line, so the lines with a unique run are looked at, and the lines inside covered stretches only
    once, kept in ``known``. Texts with signs over several lines are looked at as a whole."""
    if not covered or _OVER_LINES.search(text):
        return markup_types(text)
    own, shared, at, k = [], [], 0, 0
    for line in text.split("\n"):
        while k < len(covered) and covered[k][1] < at + len(line):
            k += 1
        (shared if k < len(covered) and covered[k][0] <= at else own).append(line)
        at += len(line) + 1
    block = "\n".join(shared)
    if block not in known:
        known[block] = markup_types(block)
    return sorted({*markup_types("\n".join(own)), *known[block]})


def clean_markup(records: DataFrame, key: str, host: str, fields: list[str], long: int = LONG, pages: int = PAGES, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(rec_id, rec_field, markup_types, clean): per record and non-NULL field its types of markup and its clean text.

    Repeated rows of a key count once (the first by host and then by text, a text before NULL); NULL keys are left out; a
    NULL host is a host of its own. Types are those of the whole field; ``clean`` is made of the runs that are no
    boilerplate of the host. Equal texts count as one page, so copies of a post do not make it boilerplate. A host beyond
    ``block_chars`` is cut into blocks by text, a field at a time. Its blocks first compare minimisers, a small part of
    their windows, and then add up how often the windows occur that they may share, so no task holds a hot host, little is
    moved and the result is the same.
    """
    names = [f"_f{i}" for i in range(len(fields))]
    rows = records.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec_id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"), *(F.col(f).alias(n) for f, n in zip(fields, names, strict=True)))
    first = F.min(F.struct("_host", *(x for n in names for x in (F.col(n).isNull().alias(n + "_none"), F.col(n)))))
    rows = rows.groupBy("rec_id").agg(first.alias("r")).select("rec_id", "r._host", *(F.col(f"r.{n}") for n in names))
    chars = sum((F.coalesce(F.length(n), F.lit(0)) for n in names), F.lit(0))
    least = records.select(F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("_host"), sum((F.coalesce(F.length(f), F.lit(0)) for f in fields), F.lit(0)).alias("_c"))  # at least as many as without repeats
    large = least.groupBy("_host").agg(F.sum("_c").alias("_chars")).filter(F.col("_chars") > block_chars)
    sizes = {r["_host"]: -(-r["_chars"] // block_chars) for r in large.collect()}  # at most (all characters) / block_chars hosts
    count = F.coalesce(F.create_map(*(x for h, n in sizes.items() for x in (F.lit(h), F.lit(int(n)))))[F.col("_host")], F.lit(1)) if sizes else F.lit(1)
    if sizes:  # each field of a large host has blocks of its own, so equal texts of any field meet in one
        part = lambda i: F.struct(*(F.col(n) if j == i else F.lit(None).cast("string").alias(n) for j, n in enumerate(names)), (count * i + F.pmod(F.xxhash64(names[i]), count)).cast("int").alias("_block"))
        all_fields = F.struct(*names, F.lit(0).alias("_block"))
        placed = rows.select("rec_id", "_host", F.explode(F.when(count > 1, F.array(*(part(i) for i in range(len(names))))).otherwise(F.array(all_fields))).alias("r")).select("rec_id", "_host", "r.*")
    else:
        placed = rows.withColumn("_block", F.lit(0))

    def streams(pdf: pd.DataFrame) -> tuple[list[list[str]], list[Stream]]:
        texts = [sorted({t for t in pdf[n] if isinstance(t, str) and t}) for n in names]
        made: list[Stream] = []
        for k, ts in enumerate(texts):
            made.append(made[0] if k and ts == texts[0] else Stream(ts))
        return texts, made

    extra = None
    if sizes:
        def listed(pdf: pd.DataFrame, k: int, key: np.ndarray, n: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"_host": pdf["_host"].iloc[0], "_block": pdf["_block"].iloc[0], "_field": k, "_key": key, "_n": n})

        columns = ["_host", "_block", "_field", "_key", "_n"]

        def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
            """Minimisers and the number of pages that hold them."""
            out = []
            for k, s in enumerate(streams(pdf)[1]):
                at = s.whole(long)
                pairs = np.unique(np.stack([s.minimisers(at, long), s.page[at]], 1), axis=0)
                key, n = np.unique(pairs[:, 0], return_counts=True)
                out.append(listed(pdf, k, key, n))
            return pd.concat(out) if out else pd.DataFrame(columns=columns)

        def shared(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """Windows whose minimiser other blocks hold too, each once, with the number of their pages."""
            out = []
            held = known_of(right)
            for k, s in enumerate(streams(left)[1] if held else []):
                at = s.whole(long)
                at = at[np.isin(s.minimisers(at, long), held.get(k, np.zeros(0, np.int64)))]
                if len(at):
                    rank, n = s.windows(long)
                    _, first = np.unique(rank[at], return_index=True)
                    out.append(listed(left, k, s.keys(at[first], long), n[at[first]]))
            return pd.concat(out) if out else pd.DataFrame(columns=columns)

        def known_of(right: pd.DataFrame) -> dict[int, np.ndarray]:
            each = [(x["_field"], x["_key"]) for r in right["_known"] for x in r]
            return {k: np.array([key for f, key in each if f == k], np.int64) for k in {f for f, _ in each}}

        def to_blocks(counts: DataFrame) -> DataFrame:
            """What several blocks hold on enough pages together, to each block only what it has itself."""
            known = counts.groupBy("_host", "_field", "_key").agg(F.sum("_n").alias("_n"), F.collect_set("_block").alias("_blocks")).filter((F.col("_n") >= pages) & (F.size("_blocks") > 1))
            slots = known.select("_host", F.explode("_blocks").alias("_block"), "_field", "_key")
            return slots.groupBy("_host", "_block").agg(F.collect_list(F.struct("_field", "_key")).alias("_known"))

        schema = "_host string, _block int, _field int, _key long, _n long"
        large_rows = placed.filter(F.col("_host").isin(list(sizes)))
        likely = to_blocks(large_rows.groupBy("_host", "_block").applyInPandas(candidates, schema))
        extra = to_blocks(large_rows.groupBy("_host", "_block").cogroup(likely.groupBy("_host", "_block")).applyInPandas(shared, schema))

    def cleaned_with(known: dict[int, np.ndarray], pdf: pd.DataFrame) -> pd.DataFrame:
        texts, made = streams(pdf)
        boilerplate: dict[str, list[str]] = {}
        out = []
        done: dict[int, dict[str, tuple[list[str], str]]] = {}
        for k, (ts, s) in enumerate(zip(texts, made, strict=True)):
            if k and s is made[0] and not known:
                done[k] = done[0]
            else:
                rank, n = s.windows(long)
                heads = n >= pages
                if k in known:
                    at = s.whole(long)
                    at = at[~heads[at]]
                    heads[at[np.isin(s.keys(at, long), known[k])]] = True
                covered = s.covered(np.flatnonzero(heads), long)
                done[k] = {t: (types := types_of_runs(t, covered.get(i, []), boilerplate), to_plain(unique_runs(t, covered.get(i, [])), types)) for i, t in enumerate(ts)}
            for i, t in zip(pdf["rec_id"], pdf[names[k]], strict=True):
                if isinstance(t, str):
                    types, plain = done[k].get(t, ([], t))
                    out.append((i, fields[k], types, plain))
        return pd.DataFrame(out, columns=["rec_id", "rec_field", "markup_types", "clean"])

    schema = "rec_id long, rec_field string, markup_types array<string>, clean string"
    if extra is None:
        return placed.groupBy("_host", "_block").applyInPandas(lambda pdf: cleaned_with({}, pdf), schema)
    def with_known(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return cleaned_with(known_of(right), left)

    return placed.groupBy("_host", "_block").cogroup(extra.groupBy("_host", "_block")).applyInPandas(with_known, schema)
