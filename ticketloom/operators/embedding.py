"""A slot for text encoders: vectors of records from any batch function, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weighted terms that make up a record's text.
TERMS = 320


def record_text(terms: Column, prefix: str = "") -> Column:
    """The first weighted terms joined by spaces ('empty issue' for none), behind a prefix such as 'query: '."""
    return F.concat(F.lit(prefix), F.coalesce(F.nullif(F.array_join(F.slice(terms, 1, TERMS), " "), F.lit("")), F.lit("empty issue")))


def embed(prepared: DataFrame, load: Callable[[], Callable[[Sequence[str]], Sequence[Sequence[float]]]], prefix: str = "", batch: int = 64) -> DataFrame:
    """(issue_id, vector) of unit length. `load` runs once in each worker and returns a function from a batch of texts to vectors."""

    @F.pandas_udf("array<double>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        encoder = load()
        for t in texts:
            rows = []
            for k in range(0, len(t), batch):
                v = np.asarray(encoder(t.iloc[k:k + batch].tolist()), float)
                rows += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).tolist()
            yield pd.Series(rows)

    return prepared.select("issue_id", encode(record_text(F.col("weighted_terms"), prefix)).alias("vector"))
