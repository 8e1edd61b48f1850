"""Evaluation texts leaking into training text.

Passages are cut into word n-grams. Of every few consecutive ones the rarest over all documents becomes a seed, so that
any run of ``SEED_N + SPREAD - 1`` words copied without change holds a seed. Documents that hold a seed are aligned with
the item by Smith-Waterman over words, around the places of the seeds, best alignment first and then those that use other
cells, and an alignment counts when part of it covers ``LEAST`` consecutive words of the passage with at most one word in
ten changed, dropped or added, the first and the last word being equal.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.storage import cut, spread

#: Words of a seed, and consecutive n-grams of which the rarest is one.
SEED_N, SPREAD = 3, 3
#: Words of the passage that a leak covers at least, and the share of them that may be edited.
LEAST, EDITS = 16, 0.1
#: Words between two seeds of one copy, and by how much edits may shift them, at most.
APART, DRIFT = 40, 4
#: n-grams that a copy shares at least within so many places.
SHARED, WITHIN = 10, 22
#: Scores of the alignment. A part that counts and begins or ends with one word, an edit and then a clean run still gains
#: by that word, so the alignment does not drop it.
MATCH, EDIT = 2, -1
#: The score of the poorest part that counts; alignments below it are not looked for.
POOREST = MATCH * (LEAST - int(EDITS * LEAST)) + EDIT * int(EDITS * LEAST)
#: n-grams of items that one broadcast holds; more items are taken in several blocks.
BLOCK_GRAMS = 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower().replace("ё", "е"))


_word_id = lru_cache(1 << 18)(xxhash.xxh64_intdigest)


def word_ids(tokens: Iterable[str], n: int = -1) -> np.ndarray:
    """A 64-bit number for each word."""
    return np.fromiter(map(_word_id, tokens), np.uint64, n)


def gram_ids(ids: np.ndarray, n: int = SEED_N) -> np.ndarray:
    """A 64-bit number for each n-gram."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - n + 1 + k]
            out ^= out >> np.uint64(29)
    return out


def pick_seeds(grams: np.ndarray, rarity: np.ndarray, spread: int = SPREAD) -> np.ndarray:
    """Positions of seeds: the rarest of every ``spread`` consecutive n-grams, the first on a tie."""
    if len(grams) <= spread:
        return np.unique([int(rarity.argmin())]) if len(grams) else np.zeros(0, int)
    windows = np.lib.stride_tricks.sliding_window_view(rarity, spread)
    return np.unique(windows.argmin(1) + np.arange(len(windows)))


def align(a: np.ndarray, b: np.ndarray, equal: np.ndarray | None = None) -> tuple[list[tuple[bool, bool, bool]], list[tuple[int, int]], int]:
    """The best local alignment of passage ``a`` with ``b``: for each step, whether it takes a word of a, of b, and is
    equal; its equal cells; and its score. ``equal`` tells which words count as equal, by default those that are."""
    n, m = len(a), len(b)
    equal = a[:, None] == b[None] if equal is None else equal
    h = np.zeros((n + 1, m + 1), np.int32)
    step = -EDIT * np.arange(m + 1, dtype=np.int32)
    for i in range(1, n + 1):
        row = np.maximum(h[i - 1, 1:] + EDIT, h[i - 1, :-1] + np.where(equal[i - 1], MATCH, EDIT))
        np.maximum(row, 0, out=row)
        h[i, 1:] = np.maximum(row, np.maximum.accumulate(row + step[1:]) - step[1:])
    i, j = (int(x) for x in np.unravel_index(int(h.argmax()), h.shape))
    score = int(h[i, j])
    path, cells = [], []
    while i > 0 and j > 0 and h[i, j] > 0:
        same = bool(equal[i - 1, j - 1])
        if h[i, j] == h[i - 1, j - 1] + (MATCH if same else EDIT):
            path.append((True, True, same))
            i, j = i - 1, j - 1
            if same:
                cells.append((i, j))
        elif h[i, j] == h[i - 1, j] + EDIT:
            path.append((True, False, False))
            i -= 1
        else:
            path.append((False, True, False))
            j -= 1
    return path[::-1], cells, score


def covers(path: list[tuple[bool, bool, bool]], least: int = LEAST, edits: float = EDITS) -> bool:
    """Whether some part of an alignment takes ``least`` or more words of the passage with few enough edits."""
    if sum(p[0] for p in path) < least:
        return False
    of_a = np.cumsum([0] + [p[0] for p in path])
    wrong = np.cumsum([0] + [not p[2] for p in path])
    room = edits * of_a - wrong  # a part from s to e is fine when its room does not fall
    lowest, s = np.inf, 0
    for e in range(1, len(room)):
        while of_a[e] - of_a[s] >= least:
            lowest = min(lowest, room[s] if path[s][2] else np.inf)
            s += 1
        if path[e - 1][2] and room[e] >= lowest - 1e-9:
            return True
    return False


def clustered(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The seeds that have another one near by on nearly the same diagonal.

    LEAST words with one edit in ten leave clean runs in which at least two seeds lie, so no leak is lost by this."""
    places = sorted(places)
    keep = set()
    for k, (d, p) in enumerate(places):
        for e, q in places[k + 1 :]:
            if e - d > APART:
                break
            if q > p and abs((e - q) - (d - p)) <= DRIFT:
                keep |= {(d, p), (e, q)}
    return sorted(keep)


class Grams:
    """The n-grams of a block of passages, sorted, and the passages that hold each."""

    def __init__(self, passages: list[np.ndarray]):
        per = [np.unique(gram_ids(p)) for p in passages]
        every, owner = np.concatenate(per), np.repeat(np.arange(len(per)), [len(x) for x in per])
        order = np.argsort(every, kind="stable")
        self.grams, self.owner = np.unique(every), owner[order]
        self.first = np.searchsorted(every[order], self.grams)
        self.holders = np.diff(np.concatenate([self.first, [len(every)]]))

    def hits(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``g`` that hold one of the n-grams, and its number."""
        at = np.searchsorted(self.grams, g)
        at[at == len(self.grams)] = 0
        pos = np.flatnonzero(self.grams[at] == g)
        return pos, at[pos]

    def dense(self, pos: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The passages of which some ``WITHIN`` places hold ``SHARED`` n-grams.

        n words with e edits share at least n - 2 - 3e n-grams of three words: 11 for LEAST words and one edit, more for
        longer copies, so no leak is lost by this."""
        n = self.holders[at]
        where = np.repeat(pos, n)
        item = self.owner[np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.lexsort((where, item))
        where, item = where[order], item[order]
        k = SHARED - 1
        close = (item[k:] == item[:-k]) & (where[k:] - where[:-k] < WITHIN) if len(item) > k else np.zeros(0, bool)
        return np.unique(item[k:][close])


def leaked(doc: np.ndarray, passage: np.ndarray, places: list[tuple[int, int]]) -> bool:
    """Whether a document leaks a passage; ``places`` are (position in the document, in the passage) of common seeds.

    Around each place the best alignment is looked at, then the best one that uses none of its equal cells, and so on
    until none can hold a part that counts: a poor copy does not hide a good one behind it."""
    done = -1
    for start in sorted({max(0, d - p) for d, p in clustered(places)}):
        if start < done:
            continue
        part = doc[max(0, start - len(passage) // 2) : start + 2 * len(passage)]
        equal = passage[:, None] == part[None]
        while True:
            path, cells, score = align(passage, part, equal)
            if score < POOREST:
                break
            if covers(path):
                return True
            equal[tuple(np.array(cells).T)] = False
        done = start + len(passage) // 4
    return False


def _scan(batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
    """The one pass over all documents: in how many of them each n-gram of an item occurs, and the documents with enough
    of them close together."""
    known: Grams = held.value
    for pdf in batches:
        each = [words(t) for t in pdf["_text"]]
        bounds = np.cumsum([0, *map(len, each)])
        pos, at = known.hits(gram_ids(word_ids(chain.from_iterable(each), int(bounds[-1]))))
        doc = np.searchsorted(bounds, pos, "right") - 1
        inside = pos + SEED_N <= bounds[doc + 1]
        pos, at, doc = pos[inside], at[inside], doc[inside]
        count = np.bincount(np.unique(doc * len(known.grams) + at) % len(known.grams), minlength=len(known.grams))
        chosen = []
        for d in np.flatnonzero(np.bincount(doc, minlength=1) >= SHARED):
            lo, hi = np.searchsorted(doc, [d, d + 1])
            if len(known.dense(pos[lo:hi], at[lo:hi])):
                chosen.append(d)
        k = np.flatnonzero(count)
        none, rest = [None] * len(k), [None] * len(chosen)
        yield pd.DataFrame({"gram": [*known.grams[k].view(np.int64).tolist(), *rest], "n": [*count[k].tolist(), *rest], "doc_id": [*none, *pdf["doc_id"].iloc[chosen]], "_text": [*none, *pdf["_text"].iloc[chosen]]}, dtype=object)


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage", block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """(doc_id, item_id): documents that hold part of the items' passages. Rows of an id count once.

    Items are a stated query set: their n-grams are held by every task in blocks of at most ``block_grams``, and all
    documents are read once for each block; only documents that share enough n-grams with an item go on to the alignment.
    Passages under LEAST words, NULL and empty texts give nothing.
    """
    spark = docs.sparkSession
    rows = spread(docs.filter(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("_text")))
    chosen = items.filter(F.col(item_id).isNotNull() & F.col(passage).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).distinct().orderBy("i", "p")
    block: list[tuple[int, np.ndarray]] = []
    found, size = None, 0

    def searched(block: list[tuple[int, np.ndarray]], found: DataFrame | None) -> DataFrame:
        part = _find_in_block(spark, rows, block)
        return part if found is None else found.unionByName(part)

    for r in chosen.toLocalIterator():
        ids = word_ids(words(r["p"]))
        if len(ids) >= LEAST:
            if size + len(ids) > block_grams and block:
                found, block, size = searched(block, found), [], 0
            block.append((r["i"], ids))
            size += len(ids)
    if block:
        found = searched(block, found)
    return spark.createDataFrame([], "doc_id long, item_id long") if found is None else found.distinct()


def _find_in_block(spark, rows: DataFrame, block: list[tuple[int, np.ndarray]]) -> DataFrame:
    sc = spark.sparkContext
    passages = [ids for _, ids in block]
    known = Grams(passages)
    held = sc.broadcast(known)
    read = cut(rows.mapInPandas(lambda batches: _scan(batches, held), "gram long, n long, doc_id long, _text string"), "leaks")
    seen = read.filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # one row an n-gram of the block at most
    rarity = np.zeros(len(known.grams), np.int64)
    for r in seen:
        rarity[np.searchsorted(known.grams, np.int64(r["gram"]).view(np.uint64))] = r["n"]
    seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for k, p in enumerate(passages):
        g = gram_ids(p)
        for at in pick_seeds(g, rarity[np.searchsorted(known.grams, g)]):
            seeds[int(g[at])].append((k, int(at)))
    keys = np.array(sorted(seeds), np.uint64)
    kept = sc.broadcast((keys, [seeds[int(k)] for k in keys], block, known))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, places, block, known = kept.value
        for pdf in batches:
            out = []
            for d, text in zip(pdf["doc_id"], pdf["_text"], strict=True):
                ids = word_ids(words(text))
                g = gram_ids(ids)
                near = set(known.dense(*known.hits(g)).tolist())
                at = np.searchsorted(keys, g)
                at[at == len(keys)] = 0
                by = defaultdict(list)
                for pos in np.flatnonzero(keys[at] == g):
                    for item, in_passage in places[at[pos]]:
                        if item in near:
                            by[item].append((int(pos), in_passage))
                out += [(d, block[item][0]) for item, where in by.items() if leaked(ids, block[item][1], where)]
            yield pd.DataFrame(out, columns=["doc_id", "item_id"])

    return spread(read.filter(F.col("doc_id").isNotNull()).select("doc_id", "_text")).mapInPandas(search, "doc_id long, item_id long")
