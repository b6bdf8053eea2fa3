"""Token-ID output: documents as ids, in grammar-compressed shard files, and the way back."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.common import pick, ship, text_blocks
from loomdex.llm.encode import ENCODE_BYTES, encoder
from loomdex.llm.grammar import Shard, pack_shard

#: Tokens after which a shard is closed.
SHARD_TOKENS = 1_000_000
_FILES = "part int, seq int, part_start long, n_docs int, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Encode every whole text (null: empty), append end_id, and write the ids in ascending doc_id order to Parquet files at path.

    One row per shard: part and seq give its place, part_start the tokens of its part before it, payload the bytes of grammar.py. Documents are
    range-partitioned by doc_id once (null first; equal ids in no set order among themselves) and each task encodes its range, so that nothing
    but texts is moved; a document is never split over shards. An empty table makes no shard.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def each(batches):
        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        own, ids, sizes, held, seq, before = [], [], [], 0, 0, 0

        def shard():
            nonlocal own, ids, sizes, held, seq, before
            flat, ends = np.concatenate(ids), np.cumsum(np.concatenate(sizes))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "part_start": pa.array([before], pa.int64()), "n_docs": pa.array([len(own)], pa.int32()), "n_tokens": pa.array([len(flat)], pa.int64()), "payload": pa.array([pack_shard(own, flat, ends)], pa.binary())})
            seq, before = seq + 1, before + len(flat)
            own, ids, sizes, held = [], [], [], 0
            return out

        for batch in batches:
            for block in text_blocks(batch, "text", ENCODE_BYTES):
                flat, off = coder.encode(block.column("text"))
                size = np.diff(off)
                ids.append(np.insert(flat, off[1:], end_id).astype(np.uint32))
                sizes.append(size + 1)
                own += block.column("doc_id").to_pylist()
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield shard()
        if own:
            yield shard()

    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id").mapInArrow(each, _FILES).write.mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of write_tokens: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian u32), and the ids if asked for."""
    ship(spark)
    files = spark.read.schema(_FILES).parquet(path)
    # one row per part, i.e. per task of the writer: its number is bound by the partition count, whatever the input
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    at, starts = 0, {}
    for r in sorted(parts, key=lambda r: r.part):
        starts[r.part] = at
        at += r.n
    sent = spark.sparkContext.broadcast(starts)
    fields = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard = Shard.open(batch.column("payload")[k].as_py())
                base = sent.value[batch.column("part")[k].as_py()] + batch.column("part_start")[k].as_py()
                ends = np.cumsum(shard.n_tokens)
                # whole symbols of some documents at a time, so that memory follows the block and not the shard's expansion
                flat = shard.expand(0, len(shard.symbols)).astype("<u4")
                crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends - shard.n_tokens, ends, strict=True)]
                cols = {"doc_id": pa.array(shard.doc_ids, pa.int64()), "start": pa.array(base + ends - shard.n_tokens), "n_tokens": pa.array(shard.n_tokens), "ids_crc32": pa.array(crc, pa.int64())}
                if with_ids:
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(cols)

    return files.select("part", "part_start", "payload").mapInArrow(each, fields)


def read_document(spark: SparkSession, path: str, doc_id: int, first: int = 0, stop: int | None = None) -> list[int]:
    """Tokens first to stop of one document; only the symbols that hold them are expanded."""
    ship(spark)

    def each(batches):
        for batch in batches:
            for blob in batch.column("payload"):
                shard = Shard.open(blob.as_py())
                if doc_id in shard.doc_ids:
                    k = shard.doc_ids.index(doc_id)
                    got = shard.tokens(k, first, int(shard.n_tokens[k]) if stop is None else min(stop, int(shard.n_tokens[k])))
                    yield pa.RecordBatch.from_pydict({"ids": pa.array([got.astype(np.int32).tolist()], pa.list_(pa.int32()))})

    row = spark.read.schema(_FILES).parquet(path).select("payload").mapInArrow(each, "ids array<int>").first()
    return list(row.ids) if row else []
