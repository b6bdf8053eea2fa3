"""SimHash footprints of token counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.config import DEFAULT, Config
from loomdex.runtime import flat_udf


def _half(token: Column, first: int) -> Column:
    """32 bits of the token's md5, from hex digit `first`."""
    return F.conv(F.substring(F.md5(token), first, 8), 16, 10).cast("long")


def footprints(counts: DataFrame, key: str = "doc_id") -> DataFrame:
    """counts(key, token, tf) -> (key, fp_hi, fp_lo): bit sums of +tf or -tf over the first 64 bits of the token's md5; a bit is 1 if its sum is 1 or more.

    64 conditional sums, pre-aggregated on the map side, so tokens are not multiplied by 64.
    """
    c = counts.select(key, F.col("tf").cast("long").alias("tf"), _half(F.col("token"), 1).alias("h"), _half(F.col("token"), 9).alias("l"))
    vote = lambda side, b: F.sum(F.when(F.shiftright(F.col(side), b).bitwiseAND(F.lit(1)) == 1, F.col("tf")).otherwise(-F.col("tf"))).alias(f"{side}{b}")
    sums = c.groupBy(key).agg(*[vote(s, b) for s in "hl" for b in range(32)])
    fold = lambda side: sum((F.when(F.col(f"{side}{b}") >= 1, F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(1, 32)), F.when(F.col(f"{side}0") >= 1, 1).otherwise(0).cast("long"))
    return sums.select(key, fold("h").alias("fp_hi"), fold("l").alias("fp_lo"))


@flat_udf("fp_hi long, fp_lo long")
def footprint(words: pa.Array) -> pa.Array:
    """The same footprint from a token array, without a shuffle."""
    from loomdex.functions import tally

    made = [tally.footprints(x.column(0)) for x in tally.pieces(pa.record_batch([words], names=["w"]), "w")]
    halves = [np.concatenate([m[k] for m in made]) if made else np.zeros(0, np.int64) for k in (0, 1)]
    return pa.StructArray.from_arrays([pa.array(h) for h in halves], names=["fp_hi", "fp_lo"])


def distance(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    return F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo))


def similarity(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(a_hi, a_lo, b_hi, b_lo) / 64


def length_ratio(a: Column, b: Column) -> Column:
    return F.least(a, b) / F.greatest(a, b)


def near_pairs(docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """docs(doc_id, n_tokens, fp_hi, fp_lo) -> (a, b) with a < b: near-duplicates in one length bucket.

    Over 0.975 of 64 bits equal means at most one differs, so one 32-bit half is equal: two equi-joins instead of a join within buckets.
    """
    if config.near_dup < 62 / 64:
        raise ValueError("two halves find pairs at one differing bit only")
    d = docs.select("doc_id", "n_tokens", "fp_hi", "fp_lo", F.floor(F.col("n_tokens") / config.bucket_tokens).alias("bucket"))
    band = d.select("*", F.explode(F.array(F.struct(F.lit(0).alias("band"), F.col("fp_hi").alias("half")), F.struct(F.lit(1).alias("band"), F.col("fp_lo").alias("half")))).alias("k")).select("*", "k.band", "k.half").drop("k")
    x, y = band.alias("x"), band.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "band", "half")] + [F.col("x.doc_id") < F.col("y.doc_id")]
    ok = (similarity(F.col("x.fp_hi"), F.col("x.fp_lo"), F.col("y.fp_hi"), F.col("y.fp_lo")) > config.near_dup) & (length_ratio(F.col("x.n_tokens"), F.col("y.n_tokens")) > config.near_dup)
    return x.join(y, on).where(ok).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
