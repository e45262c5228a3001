"""User-defined functions: an aggregate by Arrow batches and a table function, registered by name for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def geometric_mean(values: pd.Series) -> float:
    """Of the positive values of a group; null without any."""
    positive = values[values > 0].astype(float)
    return float(np.exp(np.log(positive).mean())) if len(positive) else None


class WordPairs:
    """Table function: (pos, pair) of every two words of a text that follow each other; nothing for null."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        words = text.split() if text else []
        for i, (a, b) in enumerate(zip(words, words[1:]), 1):
            yield i, f"{a} {b}"


def word_pairs():
    """The table function of ``WordPairs``; made here since its type needs a session."""
    return udtf(WordPairs, returnType="pos int, pair string")


def register(spark: SparkSession, functions: dict[str, Callable] | None = None) -> list[str]:
    """Register user functions for SQL: those given (aggregates, scalars), else this module's. Returns the names."""
    if functions is None:
        spark.udf.register("geometric_mean", geometric_mean)
        spark.udtf.register("word_pairs", word_pairs())
        return ["geometric_mean", "word_pairs"]
    for name, f in functions.items():
        spark.udf.register(name, f)
    return list(functions)
