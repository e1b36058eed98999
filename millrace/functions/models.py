"""Models as columns: embedding functions and rerankers by name, called in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that a model gets at once (fixed value).
BATCH = 128
EMBEDDERS: dict[str, Callable[[list[str]], list[list[float]]]] = {}
RERANKERS: dict[str, Callable[[list[tuple[str, str]]], list[float]]] = {}


def register_embedder(name: str, encode: Callable[[list[str]], list[list[float]]]) -> None:
    """A function from texts to vectors under a name; what it refers to travels to the executors."""
    EMBEDDERS[name] = encode


def register_reranker(name: str, score: Callable[[list[tuple[str, str]]], list[float]]) -> None:
    """A function from (query, text) pairs to scores under a name."""
    RERANKERS[name] = score


def _called(model: Callable, inputs: list, batch: int, missing) -> list:
    """The model's answers, batch by batch; a batch that fails, or has another length, has none."""
    out: list = []
    for at in range(0, len(inputs), batch):
        part = inputs[at : at + batch]
        try:
            got = list(model(part))
        except Exception:  # one bad batch must not end the job
            got = []
        out += got if len(got) == len(part) else [missing] * len(part)
    return out


def embedded(text: Column, name: str, batch: int = BATCH) -> Column:
    """The vector of each text by a registered function; null texts have none, and so have batches that fail (empty arrays)."""
    encode = EMBEDDERS[name]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            known = part.dropna()
            vectors = pd.Series(_called(encode, known.tolist(), batch, []), index=known.index, dtype=object)
            yield vectors.reindex(part.index).where(part.notna(), None)

    return run(text)


def reranked(query: Column, text: Column, name: str, batch: int = BATCH) -> Column:
    """The score of each (query, text) pair by a registered function; null where one is null or a batch fails."""
    score = RERANKERS[name]

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, texts in parts:
            both = pd.DataFrame({"q": queries, "t": texts})
            known = both.dropna()
            scores = _called(score, list(known.itertuples(index=False, name=None)), batch, None)
            yield pd.Series(scores, index=known.index, dtype="float64").reindex(both.index)

    return run(query, text)
