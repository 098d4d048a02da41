"""Row functions around a remote model, behind two small interfaces with deterministic stand-ins.

A Completer turns prompts into answers, an Embedder texts into vectors; both see a batch at a time inside an iterator
of Arrow batches, so one client serves a whole partition. Every input gives one output or the job fails: a lost batch
must not shift later rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Completer(Protocol):
    def complete(self, prompts: Sequence[str]) -> list[str]: ...


class Embedder(Protocol):
    size: int

    def embed(self, texts: Sequence[str]) -> np.ndarray: ...


class EchoCompleter:
    """Answers by a function of the prompt; the default gives the prompt's first line as a topic name."""

    def __init__(self, answer: Callable[[str], str] | None = None) -> None:
        self.answer = answer or (lambda p: json.dumps({"topic_name": p.strip().split("\n")[0][:80]}))

    def complete(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(p) for p in prompts]


class HashEmbedder:
    """Unit vectors of hashed word counts, signed; where all of them cancel, unsigned: only a text without words is zero."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.size))
        for i, t in enumerate(texts):
            hashes = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big") for w in re.findall(r"\w+", t.lower())]
            for h in hashes:
                out[i, h % self.size] += 1 if h >> 63 else -1
            if hashes and not out[i].any():
                for h in hashes:
                    out[i, h % self.size] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)


def completed(df: DataFrame, key: str, prompt: str, client: Completer, batch: int = 32, parallel: int = 1) -> DataFrame:
    """(key, answer): the client's answer to each row's prompt; null prompts have null answers.

    A task asks up to ``parallel`` batches at a time; answers keep the rows' order.
    """
    def ask(part: pd.DataFrame) -> pd.DataFrame:
        asked = part[prompt].dropna()
        got = client.complete(list(asked))
        if len(got) != len(asked):
            raise ValueError(f"{len(asked)} prompts, {len(got)} answers")
        return pd.DataFrame({key: part[key], "answer": pd.Series(got, index=asked.index, dtype=object).reindex(part.index)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for f in frames:
                yield from pool.map(ask, [f.iloc[a : a + batch] for a in range(0, len(f), batch)])

    return df.select(key, prompt).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, answer string")


def embedded(df: DataFrame, key: str, text: str, client: Embedder, batch: int = 32) -> DataFrame:
    """(key, embedding array<float>); null texts count as empty."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                part = f.iloc[a : a + batch]
                got = client.embed(list(part[text].fillna("")))
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} texts, {len(got)} vectors")
                yield pd.DataFrame({key: part[key], "embedding": [list(map(float, v)) for v in got]})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, embedding array<float>")


def spans(answer: str, sentences: Sequence[str]) -> list[str]:
    """Sentences joined by 1-based spans ``[[a, b], ...]``; spans out of range are clipped, broken answers give none."""
    try:
        pairs = json.loads(answer)
        return [" ".join(sentences[max(1, int(a)) - 1 : int(b)]) for a, b in pairs if int(a) <= len(sentences)]
    except (ValueError, TypeError):
        return []


def picked(answer: str, n: int, fallback: int = 3) -> list[int]:
    """0-based indices of an answer's 1-based ones; of a broken or empty answer, the first few."""
    found = [int(x) - 1 for x in re.findall(r"\d+", answer or "")]
    good = list(dict.fromkeys(i for i in found if 0 <= i < n))
    return good or list(range(min(n, fallback)))


def first_conclusive(judgements: Sequence[tuple[str, float]]) -> int:
    """The place of the judgement that counts: the first conclusive one, else the best scored neutral one."""
    best = 0
    for i, (verdict, score) in enumerate(judgements):
        if verdict != "NEUTRAL":
            return i
        if score > judgements[best][1]:
            best = i
    return best
