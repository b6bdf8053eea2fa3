"""Benchmark decontamination by Wu-Manber multi-pattern search."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import distinct_name, pick, plain_names, ship, size_of, text_blocks, utf8
from loomdex.llm.words import ALNUM, Words, words_of

#: Characters of benchmark text that one pass over the documents searches for; beyond it the benchmark is taken in blocks.
PASS_CHARS = 4 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FOUND = T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()), T.StructField("to", T.IntegerType())]))


class Patterns:
    """Windows of one length class, ready for searching.

    A window is " w1 w2 ... wk " in bytes. m: the class's shortest window; only the first m bytes of each window are indexed.
    shift[h]: how far the search may jump where the block of B bytes that ends at the text position hashes to h; 0 means a window's
    m-prefix may end here, and bucket h (suffix hash) lists those windows for comparison.
    """

    def __init__(self, windows: list[bytes], owners: list[list[int]], n_words: list[int]):
        self.size = np.array([len(w) for w in windows], np.int64)
        self.words = np.array(n_words, np.int64)
        self.owners = owners
        self.m = int(self.size.min())
        self.block = max(2, min(16, self.m // 2))
        self.bits = int(min(22, max(12, math.ceil(math.log2(len(windows) * max(1, self.m - self.block + 1))) + 3)))
        self.text = np.frombuffer(b"".join(windows), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        reach = self.m - self.block
        self.shift = np.full(1 << self.bits, reach + 1, np.uint8 if reach < 255 else np.int32)
        for end in range(self.block, self.m + 1):  # blocks by the place where they end, so that the last one leaves the smallest shift
            h = self.hash(self.text, self.at + end)
            self.shift[h] = np.minimum(self.shift[h], self.m - end).astype(self.shift.dtype)
        last = self.hash(self.text, self.at + self.m)
        order = np.argsort(last, kind="stable")
        self.member, self.key = order, last[order]

    def hash(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of the `block` bytes before each end."""
        h = np.zeros(len(ends), np.uint64)
        for k in range(self.block, 0, -1):
            h = (h ^ data[ends - k]) * _MIX
            h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)


def pattern_classes(items: list[tuple[str, list[bytes]]], width: int) -> tuple[list[Patterns], list[str]]:
    """Windows of the items' words, those of similar lengths together so that a short one doesn't cost the others their shifts."""
    ids = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(ids)}
    owners: dict[bytes, set[int]] = {}
    count: dict[bytes, int] = {}
    for item, words in items:
        for k in range(max(1, len(words) - width + 1)):
            if part := words[k : k + width]:
                w = b" " + b" ".join(part) + b" "
                owners.setdefault(w, set()).add(number[item])
                count[w] = len(part)
    by: dict[int, list[bytes]] = {}
    for w in sorted(owners):
        by.setdefault(max(3, len(w).bit_length()), []).append(w)
    return [Patterns(ws, [sorted(owners[w]) for w in ws], [count[w] for w in ws]) for ws in by.values()], ids


def search(p: Patterns, data: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, pattern numbers) of all occurrences inside the ranges [low, high) of data.

    All ranges are searched side by side, each with its own position; a range jumps by the shift of the block at its position.
    Long texts come in as several overlapping ranges.
    """
    pos, stop = low + p.m, high
    here = pos <= stop
    pos, stop = pos[here], stop[here]
    found_at, found = [], []
    while len(pos):
        h = p.hash(data, pos)
        jump = p.shift[h].astype(np.int64)
        hit = jump == 0
        if hit.any():
            at, key = pos[hit] - p.m, h[hit]
            a, b = np.searchsorted(p.key, key), np.searchsorted(p.key, key, side="right")
            n = b - a
            start = np.repeat(at, n)
            which = p.member[np.repeat(a - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
            fits = start + p.size[which] <= len(data)
            start, which = start[fits], which[fits]
            for s, w in zip(start.tolist(), which.tolist(), strict=True):
                if np.array_equal(data[s : s + p.size[w]], p.text[p.at[w] : p.at[w] + p.size[w]]):
                    found_at.append(s)
                    found.append(w)
            jump[hit] = 1
        pos = pos + jump
        here = pos <= stop
        pos, stop = pos[here], stop[here]
    return np.array(found_at, np.int64), np.array(found, np.int64)


def _stream(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """" w1 w2 ... wn " of each text, texts apart by a byte that no window has; and each text's range."""
    n = len(w.first) - 1
    length = np.zeros(n, np.int64)
    full = w.first[1:] > w.first[:-1]
    a, b = w.first[:-1][full], w.first[1:][full] - 1
    body = w.end[b] + 1 - w.start[a]
    length[full] = body + 1
    low = np.concatenate([[0], np.cumsum(length + 1)])
    data = np.full(int(low[-1]), 0x20, np.uint8)
    keep = np.ones(len(data), bool)
    keep[low[:-1] + length] = False  # separators
    keep[low[:-1][full]] = False  # leading spaces
    data[low[:-1] + length] = 1
    data[keep] = w.data
    return data, low[:-1], low[:-1] + length


def scan(classes: list[Patterns], raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text; and of each occurrence: text, first word within it, words, owners as pairs) for a block."""
    w = words_of(raw, offsets, ALNUM)
    n_words = np.diff(w.first)
    data, low, high = _stream(w)
    begin = low[np.repeat(np.arange(len(low)), n_words)] + 1 + (w.start - np.repeat(w.start[np.minimum(w.first[:-1], max(0, len(w) - 1))] if len(w) else np.zeros(len(low), np.int64), n_words))
    texts, firsts, counts, owned = [], [], [], []
    for p in classes:
        longest = int(p.size.max())
        lane = max(2048, 4 * longest)
        pieces = np.maximum(1, -(-(high - low) // lane))
        text = np.repeat(np.arange(len(low)), pieces)
        k = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)])[:-1], pieces)
        a = low[text] + k * lane
        b = np.minimum(a + lane + p.m - 1, high[text])
        at, which = search(p, data, a, b)
        if len(at):
            pair = np.unique(np.stack([at, which]), axis=1)
            at, which = pair
            word = np.searchsorted(begin, at + 1)
            t = np.searchsorted(w.first, word, side="right") - 1
            texts.append(t)
            firsts.append(word - w.first[t])
            counts.append(p.words[which])
            owned += [p.owners[x] for x in which]
    if not texts:
        none = np.zeros(0, np.int64)
        return n_words, none, none, none, []
    return n_words, np.concatenate(texts), np.concatenate(firsts), np.concatenate(counts), owned


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 13) -> DataFrame:
    """docs with three columns more (names end in an underscore more if taken): n_words int, hit_runs array<struct<from, to>> (runs of
    words inside any occurrence of a window, counted from 0, end exclusive, merged) and items array<string> (sorted ids of the items with
    occurring windows).

    A word is a run of digits, letters a-z after lower-casing A-Z, and non-ASCII characters. A window is `width` consecutive words of an
    item; an item of fewer words, but not none, is one window. Benchmark rows without an id or without words are ignored. A null text has
    no words. Rows stay as they are, repeated ones too; an empty benchmark or table gives no hits. Texts are read whole.

    The documents are never shuffled. The benchmark's windows go to the executors if its text has at most PASS_CHARS characters; a larger
    one is cut into so many blocks by a hash of the id, and the documents pass a search for each block in turn.
    """
    spark = docs.sparkSession
    ship(spark)
    bench = pick(benchmark, item=item_col, body=item_text_col).where("item is not null and body is not null").withColumn("item", F.col("item").cast("string"))
    blocks = max(1, -(-size_of(bench, "body")[1] // PASS_CHARS))
    rows, text = plain_names(docs, text_col)
    out = rows.select("*", F.lit(0).alias("n_words"), F.array().cast(_FOUND).alias("hit_runs"), F.array().cast("array<string>").alias("items"))
    for k in range(blocks):
        rows = [(r.item, r.body) for r in bench.where(F.pmod(F.xxhash64("item", "body"), F.lit(blocks)) == k).toLocalIterator()]
        parts = []
        if rows:
            raw, offsets = utf8(pa.array([b for _, b in rows], pa.string()))
            w = words_of(raw, offsets, ALNUM)
            blob = w.data.tobytes()
            parts = [(rows[d][0], [blob[w.start[j] : w.end[j]] for j in range(w.first[d], w.first[d + 1])]) for d in range(len(rows))]
        sent = spark.sparkContext.broadcast(pattern_classes(parts, width))
        out = _search_pass(out, sent, text, "n_words", "hit_runs", "items")
    return out.toDF(*docs.columns, *[distinct_name(docs, c) for c in ("n_words", "hit_runs", "items")])


def _search_pass(docs: DataFrame, sent, text_col: str, n: str, runs: str, items: str) -> DataFrame:
    schema = docs.schema

    def each(batches):
        classes, ids = sent.value
        for batch in batches:
            for part in text_blocks(batch, text_col):
                raw, offsets = utf8(part.column(text_col))
                n_words, text, first, count, owned = scan(classes, raw, offsets)
                cols = {c: part.column(c) for c in part.schema.names}
                cols[n] = pa.array(n_words, pa.int32())
                if len(text):
                    all_runs, all_items = cols[runs].to_pylist(), cols[items].to_pylist()
                    new: dict[int, tuple[list, set]] = {}
                    for t, f, c, own in zip(text.tolist(), first.tolist(), count.tolist(), owned, strict=True):
                        r, i = new.setdefault(t, ([], set()))
                        r.append((f, f + c))
                        i.update(own)
                    for t, (r, i) in new.items():
                        all_runs[t] = [{"from": a, "to": b} for a, b in merge_runs(r + [(x["from"], x["to"]) for x in all_runs[t]])]
                        all_items[t] = sorted({ids[x] for x in i} | set(all_items[t]))
                    cols[runs] = pa.array(all_runs, part.schema.field(runs).type)
                    cols[items] = pa.array(all_items, part.schema.field(items).type)
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(each, schema)


def digest(leaks: DataFrame, id_col: str = "doc_id", share: int = 20, n: str = "n_words", runs: str = "hit_runs", items: str = "items") -> DataFrame:
    """Per row of find_leaks: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    hit = F.aggregate(runs, F.lit(0).cast("long"), lambda acc, r: acc + r["to"] - r["from"])
    out = leaks.select(F.col(id_col).alias("doc_id"), F.col(n).cast("long").alias("n_words"), hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int | None = 20, **kw) -> DataFrame:
    """The rows of docs, with their own columns only, that are not contaminated: by `share` as in digest(), or, if it is None, those without any hit."""
    leaks = find_leaks(docs, benchmark, **kw)
    n, runs, _ = leaks.columns[-3:]
    hit = F.aggregate(f"`{runs}`", F.lit(0).cast("long"), lambda acc, r: acc + r["to"] - r["from"])
    bad = hit > 0 if share is None else (hit > 0) & (share * hit >= F.col(f"`{n}`"))
    return leaks.where(~bad).select(*[f"`{c}`" for c in docs.columns])


def brute_force(text: str | None, items: dict[str, str], width: int = 13) -> tuple[int, int, int, str, bool]:
    """The digest of one text by plain comparison, for tests."""
    cut = lambda t: "".join(c.lower() if c.isascii() else c for c in (t or ""))
    import re

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", cut(t))
    words, hit, got = find(text), set(), set()
    for item, body in items.items():
        iw = find(body)
        for k in range(max(1, len(iw) - width + 1)):
            win = iw[k : k + width]
            for j in range(len(words) - len(win) + 1) if win else ():
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    got.add(str(item))
    return len(words), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)
