"""Language models, embedders and tokenizers from outside, as protocols, with small
deterministic stand-ins that let every pipeline run without them. The stand-ins
say nothing about quality."""

from __future__ import annotations

import hashlib
import os
import random
import time
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Scorer(Protocol):
    def score(self, prompts: list[str], answers: list[str]) -> list[float]: ...


class EchoGenerator:
    """Answers with a question and an answer made of the prompt's last line."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [f"\nQuestion: What follows from {p.strip().splitlines()[-1] if p.strip() else 'nothing'}? Answer: {p.strip().split(' ')[-1]}.\n\nrest" for p in prompts]


class HashEmbedder:
    """Counts hashed words into ``dims`` signed places and scales to unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % self.dims] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).tolist()


class LengthScorer:
    """A confidence between 0 and 1 that falls with the answer's length."""

    def score(self, prompts: list[str], answers: list[str]) -> list[float]:
        return [1.0 / (1.0 + len(a) / 16.0) for a in answers]


class Patient:
    """A generator that asks another up to ``tries`` times, with random pauses whose range doubles
    from ``low`` to ``high`` seconds. Prompts that still fail raise the last error."""

    def __init__(self, inner: Generator, tries: int = 5, low: float = 10.0, high: float = 30.0, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.tries, self.low, self.high, self.sleep = inner, tries, low, high, sleep

    def generate(self, prompts: list[str]) -> list[str]:
        for i in range(self.tries - 1):
            try:
                return self.inner.generate(prompts)
            except Exception:  # noqa: BLE001 (whatever a client raises)
                self.sleep(random.uniform(self.low, max(self.low, min(self.high, 2.0**i))))
        return self.inner.generate(prompts)


class Remembering:
    """A generator whose answers are kept as files in a folder that all executors share, so that a
    prompt is asked once for each ``name`` (a model and its settings). A file is
    written beside its place and moved there, so a lost executor leaves no half answer."""

    def __init__(self, inner: Generator, folder: str, name: str = ""):
        self.inner, self.folder, self.name = inner, folder, name
        os.makedirs(folder, exist_ok=True)

    def _file(self, prompt: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(f"{self.name}\0{prompt}".encode("utf-8", "surrogatepass")).hexdigest())

    def generate(self, prompts: list[str]) -> list[str]:
        new = [p for p in dict.fromkeys(prompts) if not os.path.exists(self._file(p))]
        for prompt, answer in zip(new, self.inner.generate(new) if new else [], strict=True):
            part = f"{self._file(prompt)}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(answer)
            os.replace(part, self._file(prompt))
        out = []
        for prompt in prompts:
            with open(self._file(prompt), encoding="utf-8", newline="") as f:
                out.append(f.read())
        return out


def _iterated(load: Callable, method: str, returns: str, arity: int):
    """An Arrow iterator UDF that loads its model once for each worker's task."""
    if arity == 1:

        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            call = getattr(load(), method)
            for texts in batches:
                yield pd.Series(call(texts.fillna("").tolist()))

        return F.pandas_udf(one, returns)

    def two(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        call = getattr(load(), method)
        for a, b in batches:
            yield pd.Series(call(a.fillna("").tolist(), b.fillna("").tolist()))

    return F.pandas_udf(two, returns)


def generate(prompt: Column, load: Callable[[], Generator] = EchoGenerator) -> Column:
    return _iterated(load, "generate", "string", 1)(prompt)


def embed(text: Column, load: Callable[[], Embedder] = HashEmbedder) -> Column:
    return _iterated(load, "embed", "array<double>", 1)(text)


def confidence(prompt: Column, answer: Column, load: Callable[[], Scorer] = LengthScorer) -> Column:
    return _iterated(load, "score", "double", 2)(prompt, answer)


def generate_once(df: DataFrame, prompt: str, output: str, load: Callable[[], Generator] = EchoGenerator) -> DataFrame:
    """Adds a generation to each row; equal prompts are generated once and joined back."""
    answers = df.select(prompt).where(F.col(prompt).isNotNull()).distinct().withColumn(output, generate(F.col(prompt), load))
    return df.join(answers, prompt, "left")
