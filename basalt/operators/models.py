"""Embedding models: a contract for user code that runs in Arrow batches, and rows that fail kept apart.

A ``Model`` names a loader that gives a function from texts to a matrix of token vectors each. A worker calls the loader once
and keeps what it gives. Texts are cut to ``max_seq_len`` tokens' worth of letters as models demand, sorted by length,
and put together while the longest times their number stays within ``batch_tokens``, so memory does not follow the
longest text times a fixed number. Pooling is the mean over tokens or the first token.

When a call fails, its texts are halved and tried again until the failing ones stand alone: those get a null vector
and the reason in ``skipped``; the others get their vectors.

Defined cases: a null or empty text is skipped with ``no_text``; rows keep their other columns; a model that returns a
wrong number of vectors fails like one that raises; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TokenVectors = Callable[[list[str]], list[np.ndarray]]
_LOADED: dict[str, TokenVectors] = {}


@dataclass(frozen=True)
class Model:
    """``load`` runs once in a worker; ``name`` tells models apart there."""

    name: str
    load: Callable[[], TokenVectors]
    max_seq_len: int = 1024
    pooling: str = "mean"
    batch_tokens: int = 16_384

    def __post_init__(self) -> None:
        if self.pooling not in ("mean", "cls"):
            raise ValueError("pooling is mean or cls")
        if self.max_seq_len < 1 or self.batch_tokens < 1:
            raise ValueError("max_seq_len and batch_tokens must be positive")

    def loaded(self) -> TokenVectors:
        if self.name not in _LOADED:
            _LOADED[self.name] = self.load()
        return _LOADED[self.name]


def batches(lengths: list[int], budget: int) -> Iterator[list[int]]:
    """Places of texts, shortest first, in groups whose padded size stays within ``budget``; a longer text stands alone."""
    group: list[int] = []
    for place in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        if group and lengths[place] * (len(group) + 1) > budget:
            yield group
            group = []
        group.append(place)
    if group:
        yield group


def _pooled(tokens: np.ndarray, pooling: str) -> list[float]:
    tokens = np.asarray(tokens, float)
    if tokens.ndim != 2 or not len(tokens):
        raise ValueError("a text must get a matrix of token vectors")
    return (tokens.mean(0) if pooling == "mean" else tokens[0]).tolist()


def isolated(texts: list[str], run: Callable[[list[str]], list]) -> list[tuple[object, str | None]]:
    """(result, reason) of each text: where ``run`` fails on several, halves are tried."""
    try:
        found = run(texts)
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} results for {len(texts)} texts")
        return [(x, None) for x in found]
    except Exception as why:  # noqa: BLE001  user code may fail in any way
        if len(texts) == 1:
            return [(None, f"{type(why).__name__}: {why}")]
        half = len(texts) // 2
        return isolated(texts[:half], run) + isolated(texts[half:], run)


def embed(df: DataFrame, text: str, model: Model, name: str = "embedding", skipped: str = "skipped") -> DataFrame:
    """``df`` with a vector per text and, where there is none, the reason."""

    @F.pandas_udf("struct<vector:array<double>,skipped:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vectors = model.loaded()

        def pooled(texts: list[str]) -> list:
            found = vectors(texts)
            if len(found) != len(texts):
                raise ValueError(f"{len(found)} matrices for {len(texts)} texts")
            return [_pooled(m, model.pooling) for m in found]

        for series in parts:
            texts = [None if t is None else t[: model.max_seq_len] for t in series]
            out: list[tuple] = [(None, "no_text")] * len(texts)
            full = [i for i, t in enumerate(texts) if t]
            for group in batches([len(texts[i]) for i in full], model.batch_tokens):
                own = [full[g] for g in group]
                for i, told in zip(own, isolated([texts[i] for i in own], pooled), strict=True):
                    out[i] = told
            yield pd.DataFrame(out, columns=["vector", "skipped"])

    told = df.withColumn("_e", run(F.col(text)))
    return told.withColumns({name: F.col("_e.vector"), skipped: F.col("_e.skipped")}).drop("_e")
