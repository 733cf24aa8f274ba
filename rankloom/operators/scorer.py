"""The boundary to a model: any function of a batch, in mapInPandas.

A task that runs again calls the scorer again, so a scorer must give the same
rows for the same batch.  Persist what it returns before computing on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def scored(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType, batch: int = 256) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch):
                yield scorer(f.iloc[at : at + batch])

    return df.mapInPandas(run, schema)


def stub(batch: pd.DataFrame) -> pd.DataFrame:
    """A score that the identifier alone fixes."""
    return pd.DataFrame({"event_id": batch["event_id"], "score": (batch["event_id"] % 97).astype(float)})
