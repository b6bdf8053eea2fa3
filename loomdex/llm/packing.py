"""Best-fit packing of documents into sequences by a linear grouping scheme."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomdex.llm.common import pick, ship, stored, text_blocks
from loomdex.llm.encode import ENCODE_BYTES, encoder

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces_of(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each document's ids (whole text, null: empty, then end_id), cut into pieces of `size`, the last maybe shorter; a row per piece.

    (part, nth): the task that made the piece and its number among the task's pieces of that length, which ranks pieces of one length without
    bringing them together.
    """
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def each(batches):
        coder, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            for block in text_blocks(batch, "text", ENCODE_BYTES):
                flat, off = coder.encode(block.column("text"))
                flat = np.insert(flat, off[1:], end_id).astype("<u4")
                n = np.diff(off) + 1
                begin = np.cumsum(n) - n
                count = -(-n // size)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, n[doc] - start)
                order = np.argsort(length, kind="stable")
                sorted_l = length[order]
                rank = np.arange(len(order)) - np.searchsorted(sorted_l, sorted_l)
                nth = np.empty(len(order), np.int64)
                nth[order] = rank
                nth += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                a = begin[doc] + start
                crc = [zlib.crc32(flat[x : x + y].tobytes()) for x, y in zip(a.tolist(), length.tolist(), strict=True)]
                cols = [block.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part, np.int32)), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(np.concatenate([flat[x : x + y] for x, y in zip(a, length, strict=True)]).astype(np.int32) if len(a) else np.zeros(0, np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(each, _PIECES + ", ids array<int>" * keep_ids)


class Plan:
    """Which sequence and offset each length's pieces go to, by rank; made from the number of pieces of each length alone.

    Bins of one filling are a class: (first sequence, number, filled). A run says that pieces of length L with rank from `rank` on go to the
    class's sequences, `each` to a sequence, from offset `at`. The plan's size depends on the sequence's size, not on the corpus.
    """

    def __init__(self, counts: dict[int, int], size: int = 4096, groups: int = 48, large: float = 1 / 8):
        self.size, self.next = size, 0
        self.left = dict(counts)
        self.used = dict.fromkeys(counts, 0)
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in counts}  # length: (rank, sequence, each, offset)
        self.open: dict[int, list[tuple[int, int]]] = {}  # room: [(first sequence, number)]
        self.rooms: list[int] = []
        edge = int(size * large)
        if n := self.left.get(size):
            self._take(size, self._new(n), n, 1, 0)
        self._pack_large(self._group([n for n in sorted(self.left, reverse=True) if n >= edge and self.left[n]], groups))
        for n in sorted(self.left, reverse=True):
            self._best_fit(n)

    def _new(self, n: int) -> int:
        self.next += n
        return self.next - n

    def _take(self, length: int, sequence: int, bins: int, each: int, at: int) -> None:
        n = min(bins * each, self.left[length])
        self.runs[length].append((self.used[length], sequence, each, at))
        self.used[length] += n
        self.left[length] -= n

    def _free(self, room: int, sequence: int, n: int) -> None:
        if n and room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((sequence, n))

    def _group(self, lengths: list[int], groups: int) -> list[list[list[int]]]:
        """Large pieces, longest first, in groups of equal number; a group's pieces count as its longest. Each group: [[length, number], ...]."""
        total = sum(self.left[n] for n in lengths)
        each = max(1, -(-total // groups))
        out: list[list[list[int]]] = []
        room = 0
        for n in lengths:
            k = self.left[n]
            while k:
                if not room:
                    out.append([])
                    room = each
                some = min(k, room)
                out[-1].append([n, some])
                k, room = k - some, room - some
        return out

    def _configuration(self, sizes: list[int], need: list[int], must: int) -> list[int]:
        """How many of each size to put beside one of `must` so that a sequence is as full as can be."""
        room = self.size - sizes[must]
        reach, mask, trail = 1, (1 << room + 1) - 1, []
        for k in range(must, len(sizes)):
            for _ in range(min(need[k] - (k == must), room // sizes[k])):
                new = (reach | reach << sizes[k]) & mask
                if new == reach:
                    break
                trail.append((k, reach))
                reach = new
        at = reach.bit_length() - 1
        use = [0] * len(sizes)
        use[must] = 1
        for k, before in reversed(trail):
            if not before >> at & 1:
                use[k] += 1
                at -= sizes[k]
        return use

    def _pack_large(self, groups: list[list[list[int]]]) -> None:
        sizes = [g[0][0] for g in groups]
        need = [sum(k for _, k in g) for g in groups]
        for must in range(len(groups)):
            while need[must]:
                use = self._configuration(sizes, need, must)
                n = min(need[k] // u for k, u in enumerate(use) if u)
                for k, u in enumerate(use):
                    need[k] -= n * u
                self._substitute([k for k, u in enumerate(use) for _ in range(u)], groups, n)

    def _substitute(self, slots: list[int], groups: list[list[list[int]]], n: int) -> None:
        """Actual pieces, longest first, in each slot of n sequences; the sequences end up in classes of equal lengths."""
        fill: list[list[list[int]]] = []
        for k in slots:
            want, got = n, []
            while want:
                length, have = groups[k][0]
                some = min(have, want)
                got.append([length, some])
                want -= some
                if some == have:
                    groups[k].pop(0)
                else:
                    groups[k][0][1] -= some
            fill.append(got)
        while fill and fill[0]:
            some = min(f[0][1] for f in fill)
            first, at = self._new(some), 0
            for f in fill:
                self._take(f[0][0], first, some, 1, at)
                at += f[0][0]
                f[0][1] -= some
                if not f[0][1]:
                    f.pop(0)
            self._free(self.size - at, first, some)

    def _best_fit(self, length: int) -> None:
        while n := self.left[length]:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                each = self.size // length
                bins = max(1, n // each)
                room, first = self.size, self._new(bins)
            else:
                room = self.rooms[k]
                first, bins = self.open[room].pop()
                if not self.open[room]:
                    del self.open[room], self.rooms[k]
            each = min(room // length, n)
            full = min(bins, n // each)
            self._take(length, first, full, each, self.size - room)
            self._free(room - each * length, first, full)
            self._free(room, first + full, bins - full)

    def table(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        return {n: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for n, runs in self.runs.items() if runs}


def best_plan(counts: dict[int, int], size: int = 4096) -> Plan:
    """The plan with the fewest sequences over some numbers of groups and bounds of large lengths; each takes a moment, whatever the corpus."""
    return min((Plan(counts, size, groups, large) for large in (1 / 4, 1 / 8) for groups in (24, 48, 96, 200, 400)), key=lambda p: p.next)


def place(table: dict, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces."""
    seq, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        begin, first, each, offset = table[int(n)]
        k = np.searchsorted(begin, rank[own], side="right") - 1
        inner = rank[own] - begin[k]
        seq[own] = first[k] + inner // each[k]
        at[own] = offset[k] + inner % each[k] * n
    return seq, at


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, **kw) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids with keep_ids=True).

    Large pieces (from a quarter or an eighth of the size on) are put in groups of equal number and count as their group's longest; configurations of those few
    sizes are chosen by subset sums, each time around the longest size that is left, and used as often as the groups allow; actual pieces
    replace the rounded sizes, and small pieces go best-fit, longest first, into the room that is left. Of a few numbers of groups the one with the fewest sequences is taken. All this takes the number of pieces of each length
    only, at most `size` numbers. Pieces then find their place by their rank among those of their length, in one join on (task, length),
    by a shuffle at every size: both sides grow with the corpus.
    Repeated rows are packed each; an empty or null text is one piece of the end id; an empty table gives no rows.
    """
    spark = docs.sparkSession
    found = stored(pieces_of(docs, tokenizer, size, end_id, **kw), "pieces")
    made = stored(found.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(best_plan(counts, size).table())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(made.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    ranked = found.join(base.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tail = ["ids"] if "ids" in found.columns else []

    def each(batches):
        for batch in batches:
            seq, at = place(sent.value, np.asarray(batch.column("length")), np.asarray(batch.column("rank")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(at), *(batch.column(c) for c in tail)], names=[*names, "sequence_id", "offset", *tail])

    kept = ranked.select(*names, "rank", *tail)
    fields = [*(found.schema[c] for c in names), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), *(found.schema[c] for c in tail)]
    return kept.mapInArrow(each, T.StructType(fields))
