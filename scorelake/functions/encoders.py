"""Similarity of texts by a sentence encoder, where there is one: vectors are made in Arrow batches, once for each distinct text of a batch.

make() gives a function from a list of texts to a matrix with a row for each; it is made once for each worker process and stays there. The stand-in without an encoder is captions.hashed_similarity.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake import workers

def _units(encode: Callable[[list[str]], np.ndarray], texts: list[str]) -> dict[str, np.ndarray]:
    """Each distinct text's vector, of length 1 (or 0)."""
    distinct = list(dict.fromkeys(texts))
    vectors = np.asarray(encode(distinct), float) if distinct else np.zeros((0, 1))
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return dict(zip(distinct, vectors / np.where(norms == 0, 1, norms), strict=True))


def encoder_similarity(make: Callable[[], Callable[[list[str]], np.ndarray]], name: str | None = None) -> Callable[[Column, Column], Column]:
    """A similarity of two text columns: the cosine of their vectors, null where a text is. Its attribute best gives, for a text and an array of texts, the place of the most similar one, the first among equals. Similarities of one name share a worker's encoder."""
    key = name or uuid.uuid4().hex

    def encoder() -> Callable[[list[str]], np.ndarray]:
        return workers.held(key, make)

    @F.pandas_udf("double")
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        whole = [(x, y) for x, y in zip(a, b, strict=True) if x is not None and y is not None]
        of = _units(encoder(), [t for pair in whole for t in pair])
        return pd.Series([float(of[x] @ of[y]) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")

    @F.pandas_udf("int")
    def places(text: pd.Series, options: pd.Series) -> pd.Series:
        lists = [[o for o in x] if x is not None else [] for x in options]
        of = _units(encoder(), [t for t in text if t is not None] + [o for x in lists for o in x if o is not None])
        out = [int(np.argmax([of[t] @ of[o] if o is not None else -np.inf for o in x])) if t is not None and x else None for t, x in zip(text, lists, strict=True)]
        return pd.Series(out, dtype="Int32")

    def similarity(a: Column, b: Column) -> Column:
        return pairs(a, b)

    similarity.best = lambda text, options: places(text, options)
    return similarity
