"""Weights and scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomdex.config import DEFAULT, Config


def tag_weight(tag: Column, title: Column, config: Config = DEFAULT) -> Column:
    out = F.lit(1.0)
    for name, w in config.tag_weights:
        out = F.when(tag == name, F.lit(w)).otherwise(out)
    return F.when(title, F.lit(config.title_weight)).otherwise(out)


def tf(f: Column) -> Column:
    return F.when(f > 0, 1 + F.log10(f)).otherwise(F.lit(0.0))


def idf(n: Column, df: Column) -> Column:
    return F.log10(n / df)


def tf_idf(f: Column, n: Column, df: Column) -> Column:
    return tf(f) * idf(n, df)


def length_norm(n_tokens: Column) -> Column:
    return F.greatest(F.log10(n_tokens), F.lit(1.0))


def title_position(pos: Column) -> Column:
    return -(pos + 1)
