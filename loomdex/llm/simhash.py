"""SimHash near-duplicates by a byte-position inverted index with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import keep_rows, pick, ship, stored, text_blocks, utf8
from loomdex.llm.components import components
from loomdex.llm.words import SPACED, Words, words_of

_ONES = np.uint64(0x0101010101010101)
_BYTES = 8


def shingle_hashes(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every shingle, each text's range of shingles). Fewer words than the width: the whole sequence; no word: none."""
    n = np.diff(w.first)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.repeat(w.first[:-1] - first[:-1], count) + np.arange(first[-1])
    span = np.repeat(np.minimum(n, width), count)
    blob, digest = w.data.tobytes(), xxhash.xxh64_intdigest
    h = [digest(blob[a:b], 42) for a, b in zip(w.start[begin].tolist(), w.end[begin + span - 1].tolist(), strict=True)]
    return np.array(h, np.uint64), first


def fold(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fingerprints: a bit is 1 if set in over half of a text's hashes; no hash: zero."""
    n = np.diff(first)
    full = n > 0
    out = np.zeros(len(n), np.uint64)
    if not full.any():
        return out
    blocks = -(-n[full] // 255)  # so many sums fit the eight byte counters of a word
    block_of = np.concatenate([[0], np.cumsum(blocks)])
    k = np.arange(block_of[-1]) - np.repeat(block_of[:-1], blocks)
    starts = np.repeat(first[:-1][full], blocks) + 255 * k
    votes = np.empty((len(blocks), 64), np.int64)
    for j in range(8):
        part = np.add.reduceat((h >> np.uint64(j)) & _ONES, starts)
        lanes = part.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes[:, j::8] = np.add.reduceat(lanes, block_of[:-1], axis=0)
    bits = (2 * votes > n[full][:, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, marks: bool = False) -> DataFrame:
    """(doc_id, fp long) per row: SimHash over word shingles, words being runs of anything but space and \\x09-\\x0D, A-Z lower-cased. marks: and mark long, a hash of the text."""
    ship(docs.sparkSession)
    more = ["mark"] * marks

    def each(batches):
        for batch in batches:
            for part in text_blocks(batch, "text"):
                fp = fold(*shingle_hashes(words_of(*utf8(part.column("text")), SPACED), width))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64)), *[part.column(c) for c in more]], names=["doc_id", "fp", *more])

    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.xxhash64("text").alias(c) for c in more])
    return rows.mapInArrow(each, "doc_id long, fp long" + ", mark long" * marks)


def list_links(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins the fingerprints of one list of the minimum's positions as all of its pairs of `most` differing bits or fewer do.

    Short lists are compared pair by pair. In a long one the bytes of the list's key agree, so the others hold few values and each fingerprint
    looks up its neighbours within `most` bits in a table of them.
    """
    n = len(v)
    if n <= 256:
        i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= most, 1))
    else:
        v = np.sort(v)
        free = np.bitwise_or.reduce(v ^ v[0])
        bits = [np.uint64(1) << np.uint64(k) for k in range(64) if int(free) >> k & 1]
        i, j = [], []
        for r in range(1, most + 1):
            for some in combinations(bits, r):
                near = v ^ np.bitwise_or.reduce(np.array(some))
                at = np.minimum(np.searchsorted(v, near), n - 1)
                ok = np.flatnonzero((v[at] == near) & (near > v))
                i.append(ok)
                j.append(at[ok])
        i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j))
    root = np.arange(n)
    if len(i):  # a forest with the same components: smallest label over neighbours until nothing moves
        while True:
            low = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, root[i], low)
            np.minimum.at(new, root[j], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
    own = np.flatnonzero(root != np.arange(n))
    return v[own], v[root[own]]


#: Members up to which a posting list gives all its pairs to the tally: a fingerprint is in few pairs a list, whatever the corpus.
SHORT = 16


def _masked(distinct: DataFrame, positions: int) -> DataFrame:
    """(k, bytes, fp): each fingerprint under every choice k of so many byte positions, by its values there."""
    masks = [sum(0xFF << 8 * p for p in some) for some in combinations(range(_BYTES), positions)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return distinct.select("fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("k", "mask")).select(F.col("k").cast("byte").alias("k"), F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"), "fp")


def _short_pairs(n: np.ndarray, begin: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of the groups of n members that begin at `begin`."""
    a, b = [np.zeros(0, fp.dtype)], [np.zeros(0, fp.dtype)]
    for size in np.unique(n):
        i, j = np.triu_indices(int(size), 1)
        at = begin[n == size][:, None]
        a.append(fp[at + i].ravel())
        b.append(fp[at + j].ravel())
    return np.concatenate(a), np.concatenate(b)


def _meetings(batches):
    """From rows (k, bytes, fp) in the order of (k, bytes): the pairs of short lists as (a, b), the members of long ones as (fp, null).

    Lists are read as a stream: what is held of one is SHORT members at most, whatever its length.
    """
    held, last, long = np.zeros(0, np.int64), None, False  # the list that the next batch may go on with

    def out(a, b, members):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.minimum(a, b), members])), pa.concat_arrays([pa.array(np.maximum(a, b)), pa.nulls(len(members), pa.int64())])], names=["a", "b"])

    none = np.zeros(0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        k, key, fp = (np.asarray(batch.column(c)) for c in ("k", "bytes", "fp"))
        cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (key[1:] != key[:-1])]))
        members = [none]
        if last == (k[0], key[0]):
            stop = int(cut[1]) if len(cut) > 1 else len(fp)
            if long or len(held) + stop > SHORT:
                members += [held, fp[:stop]]
                held, long = none, True
                fp, cut, k, key = fp[stop:], cut[1:] - stop, k[stop:], key[stop:]
            else:
                n = len(held)
                fp, k, key = np.concatenate([held, fp]), np.concatenate([np.repeat(k[:1], n), k]), np.concatenate([np.repeat(key[:1], n), key])
                cut = np.concatenate([[0], cut[1:] + n])
        elif 1 < len(held):
            yield out(*_short_pairs(np.array([len(held)]), np.array([0]), held), none)
        if not len(cut):
            yield out(none, none, np.concatenate(members))
            continue
        size = np.diff(np.append(cut, len(fp)))
        last, long = (k[cut[-1]], key[cut[-1]]), bool(size[-1] > SHORT)
        held = none if long else fp[cut[-1] :].copy()
        whole = np.arange(len(cut)) < len(cut) - 1  # the last one may go on
        big = np.flatnonzero(size > SHORT)
        members += [fp[cut[g] : cut[g] + size[g]] for g in big]
        some = whole & (size > 1) & (size <= SHORT)
        yield out(*_short_pairs(size[some], cut[some], fp), np.concatenate(members))
    if len(held) > 1:
        yield out(*_short_pairs(np.array([len(held)]), np.array([0]), held), none)


def links(distinct: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) whose components equal those of all pairs at `most` or fewer differing bits.

    Two such fingerprints share at least m = 8 - most positional bytes, the guaranteed minimum. The index lists every fingerprint under each
    choice of m - 1 positions and its bytes there, so that a pair with t bytes in common meets in C(t, m - 1) lists. Meetings are tallied per
    pair: m of them say that m bytes are shared, fewer that a pair shares m - 1 only and goes. What is left is verified bit by bit.

    A list of over SHORT members isn't paired. Its members are listed under each choice of m positions instead: a pair of the minimum that met
    in a long list meets there again, shares m bytes by its key, and has its bits verified in the list, of which only a forest leaves the task.
    Such a list has at most 256 ** most members however large the corpus. A pair of the minimum meets either in short lists only, and its tally
    is whole, or in a long one, so none is lost.
    """
    if not 1 <= most <= 2:
        raise ValueError("most must be 1 or 2")
    ship(distinct.sparkSession)
    least = _BYTES - most
    met = _masked(distinct, least - 1).repartition("k", "bytes").sortWithinPartitions("k", "bytes")
    met = stored(met.mapInArrow(_meetings, "a long, b long"), "meetings")
    tallied = met.where("b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    near = tallied.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")
    dense = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    lists = _masked(dense, least).groupBy("k", "bytes").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def each(batches):
        for batch in batches:
            col = batch.column("fps")
            flat, off = np.asarray(col.flatten()).view(np.uint64), np.asarray(col.offsets).astype(np.int64)
            off = off - off[0]
            got = [list_links(flat[a:b], most) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *[g[z] for g in got]]).view(np.int64)) for z in (0, 1)], names=["a", "b"])

    return near.unionByName(lists.mapInArrow(each, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, most: int = 2) -> DataFrame:
    """Per row of docs: doc_id, fp long, component_id (smallest doc_id reachable over links, itself included).

    Rows of one fingerprint are one node, so thousands of copies cost one. A null or wordless text has fingerprint zero and links like any
    other. Repeated rows stay; a null doc_id is never a component_id unless a component has no other.
    """
    marks = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    nodes = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    root = components(links(nodes.select("fp"), most))
    placed = stored(nodes.join(root, nodes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked")), "placed")
    least = stored(placed.where("linked").groupBy("root").agg(F.min("least").alias("component")), "least")
    named = stored(placed.join(least, "root", "left").select("fp", F.coalesce("component", "least").alias("component_id")), "named")
    return marks.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of docs of each component: the one of the smallest doc_id (a null comes last; of different texts under one id, that of the smallest hash).

    Rows are told apart by id and text, so texts that share an id, or have none, stay unless their own component has another row. Columns are those of docs.
    """
    marks = stored(fingerprints(docs, id_col, text_col, marks=True, **{k: v for k, v in kw.items() if k == "width"}), "simhash")
    nodes = marks.select("fp").distinct()
    root = components(links(stored(nodes, "nodes"), kw.get("most", 2)))
    placed = marks.join(root, marks.fp == root.node, "left").select("doc_id", "mark", F.coalesce("root", "fp").alias("root"))
    return keep_rows(docs, placed, id_col, text_col)
