"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.runtime import discard, hadoop_path, scratch_path, ship, stored, text_blocks, trimmed

__all__ = ["discard", "distinct_name", "hadoop_path", "keep_rows", "pick", "plain_names", "scratch_path", "ship", "size_of", "stored", "text_blocks", "trimmed", "utf8"]

def distinct_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names; whatever else df has can't clash."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def keep_rows(docs: DataFrame, placed: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs per root of placed(doc_id, mark, root), mark being xxhash64 of the text: the first by (no id, doc_id, mark). Columns are those of docs.

    Rows that agree in id and text are one; no other row is dropped for its id. Both sides go by a shuffle at every size, never as a broadcast of
    ids, whose number grows with the corpus.
    """
    kept = stored(placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark"), "kept")
    a, b = distinct_name(docs, "_kept_id"), distinct_name(docs, "_kept_mark")
    own = kept.select(F.col("doc_id").alias(a), F.col("mark").alias(b)).hint("merge")
    out = docs.join(own, docs[f"`{id_col}`"].cast("long").eqNullSafe(own[a]) & (F.xxhash64(docs[f"`{text_col}`"]) == own[b]), "left_semi")
    copies = placed.groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return out if copies.isEmpty() else out.dropDuplicates([id_col, text_col])


def plain_names(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """(df under names of its own, the name of one of its columns there): Python maps over rows don't take names with dots."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]), f"c{df.columns.index(column)}"


def size_of(df: DataFrame, *columns: str) -> tuple[int, int]:
    """(rows, characters in the string columns) of a table: what a broadcast is checked against."""
    n = [F.sum(F.length(c)) for c in columns] or [F.lit(0)]
    row = df.agg(F.count(F.lit(1)), *n).first()
    return row[0], sum(x or 0 for x in row[1:])


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string array's bytes as uint8 and its n + 1 offsets; null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type):
        kind = np.int64
    else:
        kind = np.int32
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64)
    first, last = offsets[0], offsets[-1]
    raw = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
    return raw, offsets - first
