"""Leaving out rows by a list of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.storage import materialize

#: Keys are broadcast up to so many; with more of them both sides are shuffled.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, key: Column, bad: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs`` whose key isn't among those of ``bad`` (one column); all columns stay, rows without a key too."""
    name = "__out"
    while name in docs.columns:
        name += "_"
    keys = materialize(bad.toDF(name), "keys-out")
    few = keys.count() <= most
    return docs.join(F.broadcast(keys) if few else keys, key == keys[name], "left_anti")
