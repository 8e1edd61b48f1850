"""Abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling, in numpy.

A token enters as a word vector joined with the mean of the vectors of its character trigrams (hashed), after zero-width
signs are dropped and look-alike signs inside words are undone. The network reads windows of ``WIDTH`` tokens; windows
overlap by half, all windows of a text are scored, and the highest score is the text's. Weights are fitted on generated
sentences and, if given, on raters' labels of whole texts: of a text labelled harmless all windows are harmless, and of one
labelled bad the window stands for it whose words are most typical of bad texts, later the one that scores highest.
``python -m postloom.llm.abuse [folder ...]`` fits and stores the weights.
"""

from __future__ import annotations

import io
import pkgutil
import random
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.storage import spread

#: Tokens of a window and between the beginnings of windows.
WIDTH, STRIDE = 24, 12
#: Characters of a token at most.
LONGEST = 40
#: Hash buckets of words and of trigrams, size of their vectors, and hidden units of each direction.
BUCKETS, DIM, HIDDEN = 4096, 20, 24
#: Score from which a text counts as bad.
THRESHOLD = 0.5
#: Labelled texts used for fitting at most, and copies of each bad window with words changed.
MOST_LABELS, COPIES = 4000, 12
#: Share of words that a harmless window in fitting has replaced by made-up ones, so that unknown words alone say nothing,
#: and words on either side of the most telling one of a bad window that its copies keep.
UNKNOWN, CORE = 0.06, 8
#: Sum of the four highest log-odds of a window from which it is typical of bad texts.
TYPICAL = 13.0
WEIGHTS = Path(__file__).parent / "weights" / "abuse_bigru.npz"

_UNSEEN = re.compile("[​-‏⁠﻿­]")
_BLANK = re.compile(r"&nbsp;|&#160;|&#xa0;", re.I)
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_]){3,}\w(?!\w)")
_TOKEN = re.compile(r"\S+")
_INNER = re.compile(r"[^\w@$*!']+|_+")
_EDGE = ".,!?…:;()\"'«»“”„—–-[]{}<>`~|/\\#=+^&%"
# Signs that stand for letters inside a word.
TO_LATIN = str.maketrans("0134$5@7!авеёкморстухі", "oieassatiabeekmopctyxi")
TO_CYRILLIC = str.maketrans("036@$a4bceopxtyhkmi1!", "озбасачвсеорхтункмиии")


def tokens(text: str | None) -> list[str]:
    """Normalised tokens of a text."""
    t = _UNSEEN.sub("", unicodedata.normalize("NFKC", _BLANK.sub(" ", text or ""))).lower().replace("ё", "е")
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), t)
    return [w for m in _TOKEN.finditer(t) for w in _pieces(m[0])]


@lru_cache(1 << 16)
def _pieces(raw: str) -> tuple[str, ...]:
    """The token of a run without blanks; a run too long for one is split at inner signs, and its parts are cut, so
    nothing of it is dropped."""
    w = _plain(raw)
    parts = [w] if len(w) <= LONGEST else [_plain(x) for x in _INNER.split(raw)]
    return tuple(w[k : k + LONGEST] for w in parts for k in range(0, len(w), LONGEST))


def _plain(raw: str) -> str:
    w = raw.strip(_EDGE)
    if not w:
        return raw[:1] if raw[:1] in "!?" else ""
    cyr, lat = len(re.findall("[а-я]", w)), len(re.findall("[a-z]", w))
    if cyr + lat and not w.isalpha() or cyr and lat:
        if not (w[:1].isdigit() and cyr + lat < len(w) / 2):
            w = w.translate(TO_CYRILLIC if cyr >= lat else TO_LATIN)
    return re.sub(r"(.)\1{2,}", r"\1", w)


def _bucket(s: str) -> int:
    return xxhash.xxh32_intdigest(s) % BUCKETS


def token_ids(word: str) -> tuple[int, list[int]]:
    """The bucket of a word and those of its trigrams."""
    w = f"<{word}>"
    return _bucket(word), [_bucket("#" + w[i : i + 3]) for i in range(max(1, len(w) - 2))]


def window_starts(n: int, width: int = WIDTH, stride: int = STRIDE) -> list[int]:
    """Beginnings of overlapping windows that cover n tokens; the last one ends with the text."""
    if n <= width:
        return [0] if n else []
    starts = list(range(0, n - width, stride))
    return [*starts, n - width]


class BiGRU:
    """Parameters, forward pass, gradients and Adam steps."""

    SHAPES = {"word": (BUCKETS, DIM), "char": (BUCKETS, DIM), "wa": (2 * HIDDEN, HIDDEN), "ba": (HIDDEN,), "va": (HIDDEN,), "wo": (2 * HIDDEN,), "bo": (1,)} | {
        k + d: s for d in "fb" for k, s in {"wx": (2 * DIM, 3 * HIDDEN), "wh": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,)}.items()
    }

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        self.p = {k: (r.normal(size=s) * (0.1 if k in ("word", "char") else 1 / np.sqrt(s[0]) if len(s) > 1 else 0.1 if k in ("va", "wo") else 0)).astype(np.float32) for k, s in self.SHAPES.items()}
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    @classmethod
    @cache
    def stored(cls) -> BiGRU:
        net = cls()
        with np.load(io.BytesIO(pkgutil.get_data("postloom.llm", "weights/abuse_bigru.npz"))) as z:
            net.p = {k: z[k].astype(np.float32) for k in cls.SHAPES}
        return net

    def save(self) -> None:
        WEIGHTS.parent.mkdir(exist_ok=True)
        np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def vectors(self, vocabulary: list[str]) -> np.ndarray:
        """Input vectors of tokens; the last row is the empty token that pads short windows."""
        out = np.zeros((len(vocabulary) + 1, 2 * DIM), np.float32)
        for k, w in enumerate(vocabulary):
            i, grams = token_ids(w)
            out[k, :DIM] = self.p["word"][i]
            out[k, DIM:] = self.p["char"][grams].mean(0)
        return out

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """One direction over projected inputs (time, batch, 3H): update, reset, candidate."""
        wh, h = self.p["wh" + d], np.zeros((x.shape[1], HIDDEN), np.float32)
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            g = h @ wh
            zr = 0.5 * (1 + np.tanh(0.5 * (x[t, :, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])))
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            z = z * mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * HIDDEN :]))
            h = h + z * (c - h)
            out[t] = h
        return out

    def score(self, ids: np.ndarray, table: np.ndarray, batch: int = 4096) -> np.ndarray:
        """Probabilities for windows of token numbers (rows of ``table``; the last row pads)."""
        px = {d: table @ self.p["wx" + d] + self.p["b" + d] for d in "fb"}
        out = np.zeros(len(ids), np.float32)
        for lo in range(0, len(ids), batch):
            w = ids[lo : lo + batch].T
            mask = (w != len(table) - 1).astype(np.float32)
            h = np.concatenate([self._run(px[d][w], mask, d) for d in "fb"], axis=2)
            a = np.tanh(h @ self.p["wa"] + self.p["ba"]) @ self.p["va"] + (mask - 1) * 1e9
            a = np.exp(a - a.max(0))
            pooled = ((a / a.sum(0))[:, :, None] * h).sum(0)
            out[lo : lo + batch] = 1 / (1 + np.exp(-(pooled @ self.p["wo"] + self.p["bo"])))
        return out

    def step(self, windows: list[list[str]], y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One Adam step on a batch of windows; gives the mean loss."""
        p, n = self.p, len(windows)
        pairs = [[token_ids(w) for w in ws[:WIDTH]] for ws in windows]
        x = np.zeros((WIDTH, n, 2 * DIM), np.float32)
        mask = np.zeros((WIDTH, n), np.float32)
        at_t, at_b, word, grams, owner, share = [], [], [], [], [], []
        for b, ws in enumerate(pairs):
            for t, (i, g) in enumerate(ws):
                mask[t, b] = 1
                grams += g
                owner += [len(word)] * len(g)
                share += [1 / len(g)] * len(g)
                at_t.append(t)
                at_b.append(b)
                word.append(i)
        char = np.zeros((len(word), DIM), np.float32)
        owner, share = np.array(owner), np.array(share, np.float32)[:, None]
        np.add.at(char, owner, p["char"][grams] * share)
        x[at_t, at_b, :DIM], x[at_t, at_b, DIM:] = p["word"][word], char
        keep = {"f": [], "b": []}
        h = np.concatenate([self._run(x @ p["wx" + d] + p["b" + d], mask, d, keep[d]) for d in "fb"], axis=2)
        u = np.tanh(h @ p["wa"] + p["ba"])
        a = u @ p["va"] + (mask - 1) * 1e9
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * h).sum(0)
        out = 1 / (1 + np.exp(-(pooled @ p["wo"] + p["bo"])))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        err = ((out - y) * weight / weight.sum()).astype(np.float32)
        g["wo"], g["bo"] = pooled.T @ err, np.array([err.sum()], np.float32)
        dpool = err[:, None] * p["wo"]
        dh = a[:, :, None] * dpool
        da = (h * dpool).sum(2)
        da = a * (da - (a * da).sum(0))
        du = da[:, :, None] * p["va"] * (1 - u * u)
        g["va"] = np.einsum("tbh,tb->h", u, da)
        g["wa"], g["ba"] = np.einsum("tbi,tbj->ij", h, du), du.sum((0, 1))
        dh += du @ p["wa"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            wx, wh, carry = p["wx" + d], p["wh" + d], np.zeros((n, HIDDEN), np.float32)
            for t, h0, z, r, c, gc in reversed(keep[d]):
                carry = carry + dh[t, :, k * HIDDEN : (k + 1) * HIDDEN]
                dc = carry * z * (1 - c * c)
                m = mask[t][:, None]
                dz = carry * (c - h0) * np.where(m > 0, z * (1 - z), 0)
                dr = dc * gc * r * (1 - r)
                dg = np.concatenate([dz, dr, dc], 1)
                dgh = np.concatenate([dz, dr, dc * r], 1)
                g["wh" + d] += h0.T @ dgh
                g["wx" + d] += x[t].T @ dg
                g["b" + d] += dg.sum(0)
                dx[t] += dg @ wx.T
                carry = carry * (1 - z) + dgh @ wh.T
        np.add.at(g["word"], word, dx[at_t, at_b, :DIM])
        np.add.at(g["char"], grams, dx[at_t, at_b, DIM:][owner] * share)
        self.t += 1
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.002 * (g[k] * g[k] - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.998**self.t)) + 1e-8)
        return float(-(weight * np.log(np.where(y > 0, out, 1 - out) + 1e-7)).sum() / weight.sum())

    def fit(self, data: list[tuple[list[str], int, float]], rounds: int, rate: float = 3e-3, batch: int = 64, seed: int = 0) -> float:
        r, loss = np.random.default_rng(seed), 0.0
        for k in range(rounds):
            order, losses = r.permutation(len(data)), []
            for lo in range(0, len(order), batch):
                part = [data[i] for i in order[lo : lo + batch]]
                losses.append(self.step([x[0] if x[1] else with_unknown(x[0], r) for x in part], np.array([x[1] for x in part], np.float32), np.array([x[2] for x in part], np.float32), rate * (0.5 if k >= rounds - 2 else 1)))
            loss = float(np.mean(losses))
        return loss


class Scorer:
    """Scores texts; windows that were seen before in a task are not scored again."""

    def __init__(self, net: BiGRU):
        self.net = net

    def texts(self, texts: list[str]) -> np.ndarray:
        vocabulary: dict[str, int] = {}
        rows: dict[tuple, int] = {}
        own = []
        for text in texts:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in tokens(text)]
            own.append([rows.setdefault(tuple(ids[s : s + WIDTH]), len(rows)) for s in window_starts(len(ids))])
        if not rows:
            return np.zeros(len(texts))
        grid = np.full((len(rows), WIDTH), len(vocabulary), np.int64)
        for w, k in rows.items():
            grid[k, : len(w)] = w
        scores = self.net.score(grid, self.net.vectors(list(vocabulary)))
        return np.array([scores[o].max() if o else 0.0 for o in own])


def score_abuse(records: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id, score) for each row with a key: the highest score of all windows of the whole text.

    NULL, empty and blank texts score 0; NULL keys are left out. Rows are scored where they are, without a shuffle, and
    repeated rows come out as often as they come in.
    """
    rows = spread(records.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(BiGRU.stored())
        for pdf in batches:
            unique = list(dict.fromkeys(pdf["_text"]))
            by = dict(zip(unique, scorer.texts(unique).astype(float), strict=True))
            yield pd.DataFrame({"rec_id": pdf["rec_id"], "score": [by[t] for t in pdf["_text"]]})

    return rows.mapInPandas(each, "rec_id long, score double")


def with_unknown(words: list[str], r: np.random.Generator, share: float = UNKNOWN) -> list[str]:
    """A window with some words replaced by made-up ones."""
    hit = r.random(len(words)) < share * (r.random() < 0.5) * 2
    return [made_up(r) if h else w for w, h in zip(words, hit, strict=True)] if hit.any() else words


def made_up(r: np.random.Generator) -> str:
    soft, hard = ("аеиоуыюя", "бвгджзклмнпрстфхцчшщ") if r.random() < 0.5 else ("aeiou", "bcdfghjklmnpqrstvxz")
    return "".join(hard[r.integers(len(hard))] + soft[r.integers(len(soft))] for _ in range(r.integers(2, 6)))


def window_odds(labelled: list[tuple[str, int, int]]) -> dict[str, float]:
    """How much more often words and pairs of words stand in bad texts than in harmless ones."""
    count: dict[str, list[int]] = {}
    n = [1, 1]
    for text, bad, _ in labelled:
        ws = tokens(text)
        n[bad] += 1
        for x in {*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:], strict=False))}:
            count.setdefault(x, [0, 0])[bad] += 1
    return {x: float(np.log((c[1] + 0.5) / n[1]) - np.log((c[0] + 0.5) / n[0])) for x, c in count.items() if c[1] > 2}


def label_windows(net: BiGRU, labelled: list[tuple[str, int, int]], odds: dict[str, float], by_odds: bool, seed: int = 0) -> list[tuple[list[str], int, float]]:
    """Windows of labelled texts: all of a harmless text; of a bad one the window with the highest ``odds``, or the one that
    scores highest, and copies of its core between words of harmless texts, with words disguised. One rater's verdict
    counts where the window bears it out, as a single verdict may be an error."""
    from postloom.llm.abuse_corpus import disguise

    r = random.Random(seed)
    out, chosen = [], []
    for text, bad, raters in labelled:
        ws = tokens(text)
        windows = [ws[s : s + WIDTH] for s in window_starts(len(ws))]
        if not windows:
            continue
        typical = [sum(sorted(told(w, odds), reverse=True)[:4]) for w in windows]
        if not bad:
            out += [(w, 0, 1.0) for w, x in zip(windows, typical, strict=True) if raters > 1 or x < TYPICAL]
            continue
        if by_odds:
            value, enough = typical, TYPICAL
        else:
            vocabulary = {w: k for k, w in enumerate(dict.fromkeys(ws))}
            grid = np.full((len(windows), WIDTH), len(vocabulary), np.int64)
            for k, w in enumerate(windows):
                grid[k, : len(w)] = [vocabulary[x] for x in w]
            value, enough = net.score(grid, net.vectors(list(vocabulary))), THRESHOLD
        k = int(np.argmax(value))
        if raters > 1 or value[k] > enough and typical[k] > TYPICAL / 2:
            chosen.append(windows[k])
    around = [w for w, *_ in out] or [[]]
    for w in chosen:
        out.append((w, 1, 0.5))
        k = int(np.argmax(told(w, odds)))
        for _ in range(COPIES):
            core = [x if r.random() > 0.1 or len(x) < 3 else " ".join(tokens(disguise(r, x))) or x for x in w[max(0, k - r.randint(4, CORE)) : k + r.randint(4, CORE)]]
            left, right = r.choice(around), r.choice(around)
            lo = r.randint(0, WIDTH - min(len(core), WIDTH))
            out.append(([*(left[-lo:] if lo else []), *core, *right][:WIDTH], 1, 0.5))
    return out


def told(words: list[str], odds: dict[str, float]) -> list[float]:
    """For each word of a window the odds of it or of a pair it begins."""
    return [max(odds.get(x, 0.0), odds.get(f"{x} {y}", 0.0)) for x, y in zip(words, [*words[1:], ""], strict=True)]


def labelled_texts(folder: str, most: int = MOST_LABELS) -> list[tuple[str, int, int]]:
    """Texts with the majority of their raters' verdicts and their number; ties and missing verdicts are left out; at most ``most``."""
    tables = {"topics": ("id", "text"), "post_responses": ("request_id", "post_text"), "moderation_requests": ("request_id", "text")}
    labels = pd.read_parquet(f"{folder}/moderation_labels.parquet").dropna(subset=["is_bad"])
    votes = labels.groupby(["rec_table", "rec_id"])["is_bad"].agg(["mean", "size"])
    votes = votes[votes["mean"] != 0.5].sort_index()
    votes = votes.iloc[np.random.default_rng(0).permutation(len(votes))[:most]]
    texts = {t: pd.read_parquet(f"{folder}/{t}.parquet", columns=[i, c]).dropna().drop_duplicates(i).set_index(i)[c] for t, (i, c) in tables.items()}
    return [(texts[t][i], int(v > 0.5), int(n)) for (t, i), v, n in votes.itertuples(name=None) if i in texts[t].index]


def main(*folders: str) -> None:
    from postloom.llm.abuse_corpus import windows

    net = BiGRU()
    made = [(tokens(t), y, 1.0) for t, y in windows(40000, seed=1)]
    print("loss", net.fit(made, 2))
    labelled = [x for f in folders for x in labelled_texts(f, MOST_LABELS // len(folders))]
    if labelled:
        odds = window_odds(labelled)
        late = []
        for k in range(9):
            chosen = label_windows(net, labelled, odds, k < 3, k)
            print("loss with labels", net.fit(made + chosen + 2 * [x for x in chosen if not x[1]], 1, 2e-3 if k < 4 else 1e-3, seed=k), len(chosen), sum(y for _, y, _ in chosen))
            late = [*late, {x: v.copy() for x, v in net.p.items()}] if k > 4 else late
        net.p = {x: np.mean([p[x] for p in late], axis=0) for x in net.p}  # the mean of the last rounds
    held = windows(4000, seed=2)
    scores = Scorer(net).texts([t for t, _ in held])
    print("right on held-out windows", np.mean((scores >= THRESHOLD) == np.array([y for _, y in held])))
    net.save()


if __name__ == "__main__":
    main(*sys.argv[1:])
