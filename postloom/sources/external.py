"""Interfaces for what lies outside (embedding and chat models, the popularity service) and offline stand-ins."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text as tx
from postloom.storage import cut


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A stand-in without a model: signed hashes of character trigrams, unit length; a blank text is a zero vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            t = f" {(text or '').lower().strip()} "
            if len(t) > 2:
                h = pd.util.hash_array(np.array([t[i : i + 3] for i in range(len(t) - 2)], dtype=object), categorize=False)
                np.add.at(row, (h % np.uint64(self.dim)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


class ModelEmbedder:
    """An embedding model behind ``load``, a picklable function that gives an object with ``encode(texts)``; it is loaded
    once a task, and its vectors are brought to unit length."""

    def __init__(self, load: Callable[[], object], dim: int):
        self.load, self.dim, self.model = load, dim, None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "model": None}

    def __call__(self, texts: list[str]) -> np.ndarray:
        self.model = self.model or self.load()
        v = np.asarray(self.model.encode(texts), np.float32)
        if v.shape != (len(texts), self.dim):
            raise ValueError(f"the model gave vectors of {v.shape[1:]} instead of {self.dim} values")
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


class TermEmbedder(HashEmbedder):
    """Hashed words weighted by log frequency, unit length: the lexical backend, which needs no statistics of a corpus."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = np.array(re.findall(r"\w\w+", (text or "").lower()), dtype=object)
            if len(words):
                unique, n = np.unique(words.astype(str), return_counts=True)
                h = pd.util.hash_array(unique.astype(object), categorize=False)
                np.add.at(row, (h % np.uint64(self.dim)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0) * (1 + np.log(n)))
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-8)


class ServiceEmbedder:
    """An embedding service behind ``ask(texts)``: failing calls are repeated, vectors brought to unit length."""

    def __init__(self, ask: Callable[[list[str]], list], dim: int, tries: int = 3, pause: float = 1.2, sleep: Callable[[float], None] = time.sleep):
        self.ask, self.dim, self.tries, self.pause, self.sleep = ask, dim, tries, pause, sleep

    def __call__(self, texts: list[str]) -> np.ndarray:
        v = np.asarray(repeated(lambda: self.ask(texts), self.tries, self.pause, self.sleep), np.float32).reshape(len(texts), self.dim)
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


def repeated(call: Callable[[], object], tries: int, pause: float, sleep: Callable[[float], None] = time.sleep) -> object:
    """What ``call`` gives, tried several times; the last error is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k + 1 == tries:
                raise
            sleep(pause)
    raise ValueError("no tries")


BACKENDS: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "tfidf": TermEmbedder, "ru": ModelEmbedder, "en": ModelEmbedder, "multi": ModelEmbedder, "llm": ServiceEmbedder}


def backend(name: str, *args, **more) -> Embedder:
    """A registered embedder. Models (ru, en, multi) need a loader and the number of dimensions, the service (llm) a
    function to ask; more are added to BACKENDS."""
    if name not in BACKENDS:
        raise ValueError(f"no embedder {name}: {sorted(BACKENDS)}")
    return BACKENDS[name](*args, **more)


def embed_cached(rows: DataFrame, key: str, text: str, embedder: Embedder, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, emb), new rows of the cache): vectors from ``cache`` (text_hash, emb) where it has them; every other distinct
    text is embedded once, however many rows hold it. NULL texts are left out."""
    asked = rows.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), F.sha2(text, 256).alias("text_hash"))
    distinct = asked.groupBy("text_hash").agg(F.min("_text").alias("_text")).join(cache.select("text_hash"), "text_hash", "left_anti")
    new = cut(embed(distinct, "text_hash", "_text", embedder), "embedded")
    return asked.join(cache.select("text_hash", "emb").unionByName(new), "text_hash").select(key, "emb"), new


class Chat(Protocol):
    def __call__(self, messages: list[dict]) -> str: ...


class TemplateChat:
    """A stand-in without a model: the words of the last message that come most often, as a title and a text."""

    def __init__(self, words: int = 5):
        self.words = words

    def __call__(self, messages: list[dict]) -> str:
        found = re.findall(r"[^\W\d_]{4,}", messages[-1]["content"].lower()) if messages else []
        best = sorted(set(found), key=lambda w: (-found.count(w), w))[: self.words]
        return "" if not best else f"{' '.join(best).capitalize()}\n\n{messages[-1]['content'].strip().splitlines()[0]}"


def ask_chat(rows: DataFrame, key: str, prompt: str, chat: Chat, system: str | None = None, tries: int = 3, pause: float = 1.2, fallback: str | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, answer): one chat a row. A blank answer or a failing call is tried again; ``fallback`` stands for one that never
    comes. NULL and blank prompts are not sent."""
    kind = dict(rows.dtypes)[key]

    def answer(text: str) -> str | None:
        messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": text}]

        def once() -> str:
            got = (chat(messages) or "").strip()
            if not got:
                raise ValueError("a blank answer")
            return got

        try:
            return repeated(once, tries, pause, sleep)
        except Exception:
            return fallback

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": [answer(t) if isinstance(t, str) and t.strip() else fallback for t in pdf["_p"]]}).astype({"answer": object})

    return rows.select(key, F.col(prompt).alias("_p")).mapInPandas(each, f"{key} {kind}, answer string")


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, emb): one call of the embedder a batch; it is made once a task. NULL texts are left out."""
    kind = dict(rows.dtypes)[key]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({key: pdf[key], "emb": list(embedder(pdf["_t"].tolist()))})

    return rows.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_t")).mapInPandas(each, f"{key} {kind}, emb array<float>")


def fetch_popularity(wanted: DataFrame, ask: Callable[[str], dict], tries: int = 5, pause: float = 0.12, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(section, cluster_id, request_phrase, total_count_30d, top_max_phrase, top_max_count, top_requests, associations).

    ``ask`` gives {totalCount, topRequests, associations} of one phrase. A failing call is repeated with doubling pauses;
    a phrase that fails to the end is asked once more in its plain form and then has a NULL count; ``top_max_phrase`` and
    ``top_max_count`` are those of the highest count, the first on a tie. Calls are paced within a task, so the partitions set the rate."""

    def listed(items: list | None) -> list[dict]:
        return [{"phrase": str(x.get("phrase", "")), "count": int(x.get("count") or 0)} for x in items or []]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, c, phrase, plain in zip(pdf["section"], pdf["cluster_id"], pdf["phrase"], pdf["plain"], strict=True):
                wait, got = pause, None
                for k in range(tries + 1):
                    sleep(wait)
                    try:
                        got = ask(phrase if k < tries else plain)
                        break
                    except Exception:
                        wait = min(2 * wait, most)
                top, near = listed(got and got.get("topRequests")), listed(got and got.get("associations"))
                first = max(top, key=lambda x: x["count"], default={})  # the first on a tie
                out.append((s, c, phrase, None if got is None else int(got.get("totalCount") or 0), first.get("phrase"), first.get("count"), top, near))
            if out:
                yield pd.DataFrame(out, columns=["section", "cluster_id", "request_phrase", "total_count_30d", "top_max_phrase", "top_max_count", "top_requests", "associations"]).astype({"total_count_30d": "Int64", "top_max_count": "Int64"})

    pairs = "array<struct<phrase:string,count:long>>"
    return wanted.select("section", "cluster_id", "phrase", tx.plain_phrase("phrase").alias("plain")).mapInPandas(each, f"section string, cluster_id int, request_phrase string, total_count_30d long, top_max_phrase string, top_max_count long, top_requests {pairs}, associations {pairs}")


def probe(ask: Callable[[str], dict]) -> dict:
    """{ok, reason}: whether the service answers a harmless question as it should; what went wrong is told, not hidden."""
    try:
        answer = ask("test")
    except (OSError, TimeoutError, ValueError) as e:
        return {"ok": False, "reason": f"{type(e).__name__}: {e}"}
    return {"ok": True, "reason": None} if isinstance(answer, dict) and "totalCount" in answer else {"ok": False, "reason": "not an answer of this service"}


def has_table(spark: SparkSession, name: str) -> bool:
    """Whether a table exists and has rows."""
    return spark.catalog.tableExists(name) and bool(spark.table(name).limit(1).count())


def capabilities(spark: SparkSession, tables: list[str]) -> dict[str, bool]:
    """What a retriever may use: each table that exists and has rows, and similarity of trigrams, which is always there."""
    return {**{t: has_table(spark, t) for t in tables}, "trigrams": True}


def numbers(value: str | None) -> list[int]:
    """Whole numbers of a comma list; others are skipped."""
    return [int(x) for x in strings(value) if x.lstrip("-").isdigit()]


def strings(value: str | None) -> list[str]:
    return [x.strip() for x in (value or "").split(",") if x.strip()]


def settings(path: str, defaults: dict) -> dict:
    """Settings from YAML over defaults, section by section; unknown keys stay."""
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f) or {}
    return {k: ({**defaults.get(k, {}), **v} if isinstance(v, dict) else v) for k, v in {**defaults, **found}.items()}
