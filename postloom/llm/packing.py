"""Filling sequences of a fixed number of tokens with documents.

Documents longer than a sequence are split into full sequences and a rest; all others stay whole. Items are spread over
blocks of bounded size. A block starts from a best-fit packing and is improved by swap-based local search between
underfull bins: one-for-one and two-for-one exchanges and moves that raise the sum of squared fills, until no exchange
helps; bins that run empty vanish. Bins still underfull after that give their items back, and the leftovers of all
blocks are packed once more together, in larger and fewer blocks, so that hardly any block leaves a half-full bin.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.storage import cut, spread

#: Tokens of a sequence, items of a block, share of a bin below which its items are packed again.
CAPACITY, BLOCK_ITEMS, UNDERFULL = 2_048, 4_000, 0.98
#: The public tokenizer's ranks and its pattern.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens). NULL and empty texts have 0 tokens; special tokens' strings are ordinary text. The vocabulary
    (some MB) is read on the driver and broadcast, so executors need no file."""
    held = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())
    rows = spread(docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(held.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": [len(x) for x in enc.encode_ordinary_batch(list(pdf["_text"]), num_threads=1)]})

    return rows.mapInPandas(count, "doc_id long, tokens long")


class Bins:
    """Bins of one block: fills and items, with underfull bins in order of fill."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.order: list[tuple[int, int]] = []  # (room, bin), sorted

    def start(self) -> None:
        """Best fit, largest items first, ties by position."""
        for i in sorted(range(len(self.sizes)), key=lambda i: (-self.sizes[i], i)):
            k = bisect_left(self.order, (self.sizes[i], -1))
            if k < len(self.order):
                room, b = self.order.pop(k)
            else:
                room, b = self.capacity, len(self.items)
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(i)
            self.fill[b] += self.sizes[i]
            if room > self.sizes[i]:
                insort(self.order, (room - self.sizes[i], b))

    def search(self) -> None:
        """Exchanges between underfull bins that raise the sum of squared fills, until none does.

        For bins a (fuller) and b, anything that makes a fuller without overflow raises the sum: a move from b, a small
        item for a larger one, one item for two. The emptiest bins are drained first, until they are empty or nothing
        fits any more."""
        sizes, cap = self.sizes, self.capacity
        better = True
        while better:  # the sum grows with every exchange, so this ends
            better = False
            low = sorted((b for b in range(len(self.items)) if self.items[b] and self.fill[b] < cap), key=lambda b: (self.fill[b], b))
            for b in low:
                if not self.items[b]:
                    continue
                for a in reversed(low):
                    room = cap - self.fill[a]
                    if a == b or not self.items[a] or not room or self.fill[a] < self.fill[b] or not self.items[b]:
                        continue
                    give = sorted(self.items[b], key=lambda i: sizes[i])
                    at = [sizes[i] for i in give]
                    best, plan = 0, None
                    k = bisect_left(at, room + 1) - 1
                    if k >= 0:
                        best, plan = at[k], ([], [give[k]])
                    for x in self.items[a]:
                        if best == room:
                            break
                        limit = room + sizes[x]
                        k = bisect_left(at, limit + 1) - 1  # one for one
                        if k >= 0 and at[k] - sizes[x] > best:
                            best, plan = at[k] - sizes[x], ([x], [give[k]])
                        lo, hi = 0, len(at) - 1  # two for one
                        while lo < hi:
                            both = at[lo] + at[hi]
                            if both > limit:
                                hi -= 1
                            else:
                                if both - sizes[x] > best:
                                    best, plan = both - sizes[x], ([x], [give[lo], give[hi]])
                                lo += 1
                    if plan:
                        out, into = plan
                        for i in out:
                            self.items[a].remove(i)
                            self.items[b].append(i)
                        for i in into:
                            self.items[b].remove(i)
                            self.items[a].append(i)
                        self.fill[a] += best
                        self.fill[b] -= best
                        better = True


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of the items of each bin; every item is at most ``capacity`` long."""
    bins = Bins(sizes, capacity)
    bins.start()
    bins.search()
    return [sorted(x) for x in bins.items if x]


def pack(counted: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(bin_id, doc_id, piece, tokens): each document, or each piece of one longer than ``capacity``, in one bin.

    ``counted`` has (doc_id, tokens), one row a document; a repeated doc_id counts once, by its greatest count. Documents
    without tokens take no room and are left out. An empty table gives no bins. No bin holds more than ``capacity``.
    """
    docs = counted.filter(F.col("doc_id").isNotNull() & (F.col("tokens") > 0)).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    full = F.floor(F.col("tokens") / capacity)
    pieces = docs.select("doc_id", F.posexplode(F.concat(F.array_repeat(F.lit(capacity).cast("long"), full.cast("int")), F.filter(F.array(F.col("tokens") - full * capacity), lambda x: x > 0))).alias("piece", "tokens"))
    pieces = cut(pieces, "pieces")  # texts are tokenised once
    whole = pieces.filter(F.col("tokens") == capacity).select(F.concat_ws("-", F.lit("f"), F.col("doc_id").cast("string"), F.col("piece").cast("string")).alias("bin_id"), "doc_id", "piece", "tokens")
    items = pieces.filter(F.col("tokens") < capacity)

    def packer(tag: str):
        def packed(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc_id", "piece"]).reset_index(drop=True)
            block = int(pdf["_block"].iloc[0]) if len(pdf) else 0
            bins = pack_block([int(x) for x in pdf["tokens"]], capacity)
            at = np.concatenate([np.array(x) for x in bins]) if bins else np.zeros(0, int)
            own = np.repeat(np.arange(len(bins)), [len(x) for x in bins])
            fill = np.array([pdf["tokens"].to_numpy()[x].sum() for x in bins])
            out = pdf.iloc[at][["doc_id", "piece", "tokens"]].reset_index(drop=True)
            return out.assign(bin_id=[f"{tag}-{block}-{k}" for k in own], fill=fill[own] if len(bins) else [])[["bin_id", "doc_id", "piece", "tokens", "fill"]]

        return packed

    def run(part: DataFrame, tag: str) -> DataFrame:
        count = part.count()
        blocks = max(1, -(-count // block_items))
        spread = part.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece", F.lit(tag)), F.lit(blocks)).cast("int"))
        return cut(spread.groupBy("_block").applyInPandas(packer(tag), "bin_id string, doc_id long, piece int, tokens long, fill long"), "packed")

    first = run(items, "a")
    poor = F.col("fill") < UNDERFULL * capacity
    second = run(first.filter(poor).select("doc_id", "piece", "tokens"), "b")
    return whole.unionByName(first.filter(~poor).drop("fill")).unionByName(second.drop("fill"))
