"""Texts whose sets of five-word shingles have a Jaccard similarity of a threshold or more: all of them, by prefix filtering and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import discard, keep_rows, pick, ship, stored, text_blocks, trimmed, utf8
from loomdex.llm.components import components
from loomdex.llm.simhash import fold, links, shingle_hashes
from loomdex.llm.words import SPACED, words_of

LEAST = 0.8
#: Rows (about; a hash of the text chooses them) that frequent shingles are told by, rows of those that a frequent one has, and how many are kept.
SAMPLE_ROWS, OFTEN, MOST_OFTEN = 8_192, 3, 65_536
#: Members up to which lists are compared many at once, and up to which a list is one task's.
SHORT, TILE = 16, 4_096
#: Shingles beyond which parities tell unlike sets apart badly, so that tallies go to the lists' tasks as well.
LONG = 512
#: Shingles beyond which 256 counts tell unlike sets apart badly, so that a set has more of them, 8 shingles to one at most.
FINE = 2_048
#: First shingles of a prefix that tell a pair's first list: of any set, and of a set of over LONG shingles.
HEAD, LONG_HEAD = 8, 64
#: One in so many lists, chosen by a hash, is taken by the first rounds.
SOME = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(h: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per text the sorted distinct five-word shingles, from its three-word ones: two of them, two words apart, tell five words. Fewer words: the whole sequence."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        x = h[a:b]
        if len(x) > 1:
            step = min(2, len(x) - 1)
            x = (x[:-step] * _MIX + (x[step:] ^ (x[step:] >> np.uint64(29)))) * _MIX
            x = np.unique(x ^ (x >> np.uint64(32)))
        out.append(x)
    return out


def prefix_size(n: int, least: float) -> int:
    """How many of a set's n shingles, first in any fixed order, have one at least in common with a set that is alike."""
    return n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0


def _blocks(batches, names):
    for batch in batches:
        for part in text_blocks(batch, "text"):
            h, first = shingle_hashes(words_of(*utf8(part.column("text")), SPACED), 3)
            yield [part.column(c) for c in names], h, first


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in arrays])]), pa.int32()), pa.array(flat))


def _digest(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes())


def tally(x: np.ndarray) -> bytes:
    """How many of a set's shingles fall to each of 256 values of a byte, 255 for more; sums of minima bound what two sets have in common."""
    return np.minimum(np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def parity(x: np.ndarray) -> bytes:
    """512 bits: whether an odd number of a set's shingles falls to each. Two sets differ in at least as many shingles as their bits differ."""
    return np.packbits((np.bincount(((x >> np.uint64(8)) & np.uint64(511)).astype(np.int64), minlength=512) & 1).astype(np.uint8)).tobytes()


def fine_tally(x: np.ndarray) -> bytes:
    """A set's counts as tally has them, over a power of two of values that follows its size; none up to FINE shingles."""
    if len(x) <= FINE:
        return b""
    values = 256 << (-(-len(x) // FINE) - 1).bit_length()
    return np.minimum(np.bincount((x & np.uint64(values - 1)).astype(np.int64), minlength=values), 255).astype(np.uint8).tobytes()


def finely_alike(x: bytes, y: bytes, n: int, least: float) -> bool:
    """Whether two sets of n shingles together can have the similarity, by their fine tallies: the longer one is folded to the shorter."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(p), len(q))
    if not size or max(p.max(), q.max()) == 255:
        return True
    most = int(np.minimum(p.reshape(-1, size).sum(0, dtype=np.int64), q.reshape(-1, size).sum(0, dtype=np.int64)).sum())
    return most >= least * (n - most) - 1e-9


def alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, least: float) -> np.ndarray:
    """Whether pairs of rows of tallies, of sets with n shingles together, can have the similarity."""
    most = np.minimum(x, y).sum(1, dtype=np.int64)
    return ((x & y) == 255).any(1) | (most >= least * (n - most) - 1e-9)


def _often(rows: DataFrame) -> np.ndarray:
    """Shingles frequent in a sample. They come last in the order, which any choice leaves valid: it only keeps lists short."""
    n = rows.count()
    share = min(1 << 20, -(-(SAMPLE_ROWS << 20) // max(n, 1)))
    some = rows.where(F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(1 << 20)) < share).select("text")

    def each(batches):
        for _, h, first in _blocks(batches, []):
            yield pa.RecordBatch.from_arrays([_lists(shingle_sets(h, first))], names=["s"])

    found = some.mapInArrow(each, "s array<long>").select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    top = found.orderBy(F.desc("n"), "h").limit(MOST_OFTEN).select("h").toArrow().column("h").combine_chunks()
    return np.sort(np.asarray(top).astype(np.int64).view(np.uint64))


def marked(rows: DataFrame, least: float) -> DataFrame:
    """(doc_id, mark, fp, node, n, tally, fine, bits, prefix) per row of rows(doc_id, mark, text): SimHash of three words, digest, size, tallies and parities of the set, its prefix."""
    sent = rows.sparkSession.sparkContext.broadcast(_often(rows))

    def each(batches):
        often = sent.value
        for cols, h, first in _blocks(batches, ["doc_id", "mark"]):
            sets = shingle_sets(h, first)
            head = []
            for x in sets:
                k = prefix_size(len(x), least)
                late = often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x if len(often) else np.zeros(len(x), bool)
                rare = x[~late][:k]
                head.append(rare if len(rare) == k else np.concatenate([rare, x[late][: k - len(rare)]]))
            node = np.array([_digest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fold(h, first).view(np.int64)), pa.array(node), pa.array([len(x) for x in sets], pa.int32()), *(pa.array([f(x) for x in sets], pa.binary()) for f in (tally, fine_tally, parity)), _lists(head)], names=["doc_id", "mark", "fp", "node", "n", "tally", "fine", "bits", "prefix"])

    return rows.mapInArrow(trimmed(each), "doc_id long, mark long, fp long, node long, n int, tally binary, fine binary, bits binary, prefix array<long>")


def _shared(batches):
    """The rows (h, node, n), which come in the order of h, of the h that have two rows or more. One row is held at most."""
    held, told = None, False  # the last row, and whether its h had others before
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.asarray(batch.column("h"))
        same = h[1:] == h[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if held is not None and held.column("h")[0].as_py() == h[0]:
            keep[0] = True
            if not told:
                yield held
        told = bool(keep[-1])
        held = batch.slice(batch.num_rows - 1, 1)
        yield batch.filter(pa.array(keep))


def partnered(h: np.ndarray, n: np.ndarray, root: np.ndarray, least: float) -> np.ndarray:
    """Whether rows in the order of (h, n) have another of their h, of another root, whose size lets the two be alike. The first and last run of one h and root may go on elsewhere: yes.

    Of the members of other roots, those next to a row's run of one root are nearest in size.
    """
    cut = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (root[1:] != root[:-1])]))
    size = np.diff(np.append(cut, len(h)))
    before, after = np.repeat(cut - 1, size), np.repeat(cut + size, size)
    out = (before < 0) | (after == len(h))
    for side in (before, np.minimum(after, len(h) - 1)):
        few, many = np.minimum(n, n[side]), np.maximum(n, n[side])
        out |= (h == h[side]) & (root != root[side]) & (few >= least * many - 1e-9)
    return out


def _groups(batches, columns: list[str]):
    """Tables of whole groups from rows that come in the order of the columns."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        keys = [np.asarray(t.column(c)) for c in columns]
        last = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0)) if len(t) else np.zeros(0, int)
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and len(rest):
        yield rest


def earlier(head: np.ndarray, a: np.ndarray, b: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the sets a and b, rows of head (sorted, filled up with the largest value), share a shingle of both heads below h.

    A head holds a prefix's smallest shingles, so such a pair meets in the list of the smallest one that both heads have, and in that one only does
    this say no. Heads without a common shingle say no in every list.
    """
    out, top = np.zeros(len(a), bool), np.iinfo(np.int64).max
    for k in range(0, len(a), 8_192):
        both = np.sort(np.concatenate([head[a[k : k + 8_192]], head[b[k : k + 8_192]]], axis=1), axis=1)
        out[k : k + 8_192] = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < h[k : k + 8_192, None]) & (both[:, 1:] != top)).any(1)
    return out


def _candidates(lists: DataFrame, big: DataFrame, sketches: DataFrame, root: DataFrame | None, least: float, mode: str) -> DataFrame:
    """Distinct pairs (a, b) of members of a list(h, node, n) whose roots differ and that sizes, parities and tallies of long sets don't rule out. big(h, tiles): lists of over TILE members.

    Members whom sizes and roots leave without a partner in their list go first, by narrow rows. With `all`, a pair is made in the first list that the heads of both tell.

    mode: `first` compares a list's first member by size, and in a long one the first beyond the sizes it can be like, with those after;
    `nearest` gives each member's most likely partner, in lists of up to SHORT members the next one by size; `all` gives all pairs. A list of over TILE
    members is dealt to tiles: by a hash for the first two modes, by pairs of blocks for `all`. Comparing stays in the task.
    """

    def useful(batches):
        for batch in batches:
            if batch.num_rows:
                h, n, root = (np.asarray(batch.column(c)) for c in ("h", "n", "root"))
                yield batch.filter(pa.array(partnered(h, n.astype(float), root, least))).select(["h", "node", "root"])

    rows = lists.withColumn("root", F.col("node")) if root is None else lists.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows = rows.select("h", "node", "n", "root").repartition("h").sortWithinPartitions("h", "n", "root")
    apart = stored(rows.mapInArrow(useful, "h long, node long, root long"), "apart")
    rows = apart.join(F.broadcast(big) if big.count() <= 100_000 else big.hint("merge"), "h", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))).join(sketches, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    if mode == "all":
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    else:
        rows = rows.withColumns({"x": F.col("own"), "y": F.col("own")})
    rows = rows.select("h", "x", "y", "own", "node", "n", "bits", "tally", "head", "root")
    slack = (1 - least) / (1 + least)

    def fits(words, n, root, i, j):
        """Whether the pairs (i, j) of arrays that broadcast can be alike, and how much room they leave."""
        differ = np.zeros(np.broadcast(i, j).shape, np.int16)
        for w in range(8):
            differ += np.bitwise_count(words[i, w] ^ words[j, w]).astype(np.int16)
        room = slack * (n[i] + n[j]) + 1e-6 - differ
        return (room >= 0) & (np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9) & (root[i] != root[j]), room

    def each(batches):
        for t in _groups(batches, ["h", "x", "y"]):
            h, x, y, own, node, n, root = (np.asarray(t.column(c)) for c in ("h", "x", "y", "own", "node", "n", "root"))
            words = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, 8)
            n = n.astype(float)
            order = np.lexsort((node, n, y, x, h))
            h, x, y, own, node, n, root, words = (z[order] for z in (h, x, y, own, node, n, root, words))
            told = t.column("tally").to_pylist()
            told = [told[k] for k in order.tolist()]
            long = np.array([len(z) > 0 for z in told])
            place, told = np.cumsum(long) - 1, np.frombuffer(b"".join(told), np.uint8).reshape(-1, 256)
            heads = t.column("head").combine_chunks().take(pa.array(order))
            width = np.asarray(pc.list_value_length(heads), np.int64)
            head = np.full((len(heads), int(width.max())), np.iinfo(np.int64).max)
            head[np.arange(head.shape[1]) < width[:, None]] = np.asarray(heads.flatten())
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            cut = np.flatnonzero(new)
            size = np.diff(np.append(cut, len(h)))
            mixed = np.maximum.reduceat(root, cut) != np.minimum.reduceat(root, cut)
            a, b = [], []
            for m in range(2, SHORT + 1):
                at = cut[(size == m) & mixed]
                if len(at):
                    # by size: the first with all others, neighbours, or all
                    p, q = {"first": (np.zeros(m - 1, int), np.arange(1, m)), "nearest": (np.arange(m - 1), np.arange(1, m)), "all": np.triu_indices(m, 1)}[mode]
                    i, j = (at[:, None] + p).ravel(), (at[:, None] + q).ravel()
                    ok = fits(words, n, root, i, j)[0] & ((x[i] == y[i]) | (own[i] != own[j]))
                    a.append(i[ok])
                    b.append(j[ok])
            for s, m in zip(cut[(size > SHORT) & mixed].tolist(), size[(size > SHORT) & mixed].tolist(), strict=True):
                if mode == "first":
                    i, stop = s, s + m
                    while i < stop - 1:
                        end = s + int(np.searchsorted(n[s:stop], n[i] / least + 1e-9, side="right"))
                        j = np.arange(i + 1, end)
                        j = j[fits(words, n, root, i, j)[0]] if len(j) else j
                        a.append(np.full(len(j), i))
                        b.append(j)
                        i = max(end, i + 1)
                    continue
                every = np.arange(s, s + m)
                for k in range(0, m, 256):
                    i = every[k : k + 256]
                    if mode == "all":
                        ok = fits(words, n, root, i[:, None], every)[0] & (i[:, None] < every) & ((x[s] == y[s]) | (own[i][:, None] != own[every]))
                        p, q = np.nonzero(ok)
                        a.append(i[p])
                        b.append(every[q])
                    else:
                        ok, room = fits(words, n, root, i[:, None], every)
                        best = np.where(ok, room / (n[i][:, None] + n[every]), -1).argmax(1)
                        has = ok[np.arange(len(i)), best]
                        a.append(i[has])
                        b.append(every[best[has]])
            a, b = (np.concatenate([np.zeros(0, np.int64), *z]).astype(np.int64) for z in (a, b))
            ok = np.ones(len(a), bool)
            both = np.flatnonzero(long[a] & long[b])
            for k in range(0, len(both), 4_096):
                p = both[k : k + 4_096]
                ok[p] = alike(told[place[a[p]]], told[place[b[p]]], n[a[p]] + n[b[p]], least)
            a, b = a[ok], b[ok]
            if mode == "all":
                ok = ~earlier(head, a, b, h[a])
                a, b = a[ok], b[ok]
            a, b = node[a], node[b]
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    dealt = rows.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    pairs = stored(dealt.mapInArrow(trimmed(each), "a long, b long").distinct(), "candidates")
    discard(apart)
    return pairs


class Verifier:
    """Which pairs have sets of the similarity. Tallies, fine ones for long sets, rule most others out; only texts of members of pairs that are left are read again, once."""

    def __init__(self, marks: DataFrame, known: DataFrame, rows: DataFrame, least: float):
        self.marks, self.known, self.rows, self.least, self.sets, self.read = marks, known, rows, least, None, []

    def _read(self, nodes: DataFrame) -> None:
        """Add the sets of nodes that aren't there yet."""
        new = nodes if self.sets is None else nodes.join(self.sets, "node", "left_anti")
        first = stored(self.marks.groupBy("node").agg(F.min(F.struct("mark", "doc_id")).alias("r")).join(new, "node", "left_semi").select("r.mark", "r.doc_id"), "ends")
        if first.isEmpty() and self.sets is not None:
            return

        def sets(batches):
            for _, h, at in _blocks(batches, []):
                s = shingle_sets(h, at)
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_digest(x) for x in s], np.uint64).view(np.int64)), _lists(s)], names=["node", "s"])

        on = [self.rows[c].eqNullSafe(first[c]) for c in ("mark", "doc_id")]
        found = stored(self.rows.join(first, on, "left_semi").select("text").mapInArrow(trimmed(sets), "node long, s array<long>").dropDuplicates(["node"]), "sets")
        self.read.append(found)
        self.sets = found if self.sets is None else self.sets.unionByName(found)

    def __call__(self, pairs: DataFrame) -> DataFrame:
        least = self.least

        def bounded(batches):
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("x", "y"))
                n = np.asarray(batch.column("n"))
                ok = alike(x, y, n, least)
                for k in np.flatnonzero(ok).tolist():
                    ok[k] = finely_alike(batch.column("fine_x")[k].as_py(), batch.column("fine_y")[k].as_py(), int(n[k]), least)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

        def exact(batches):
            for batch in batches:
                x, y = batch.column("x"), batch.column("y")
                (fx, ox), (fy, oy) = ((np.asarray(c.flatten()), np.asarray(c.offsets) - c.offsets[0].as_py()) for c in (x, y))
                ok = []
                for k in range(batch.num_rows):
                    p, q = fx[ox[k] : ox[k + 1]], fy[oy[k] : oy[k + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(both >= least * (len(p) + len(q) - both) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        tallied = lambda c, t: self.known.select(F.col("node").alias(c), F.col("tally").alias(t), F.col("n").alias(f"n_{t}"), F.col("fine").alias(f"fine_{t}"))
        both = pairs.join(tallied("a", "x"), "a").join(tallied("b", "y"), "b")
        left = stored(both.select("a", "b", "x", "y", "fine_x", "fine_y", (F.col("n_x") + F.col("n_y")).alias("n")).mapInArrow(bounded, "a long, b long"), "bounded")
        ends = stored(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
        self._read(ends)
        own = self.sets.join(ends, "node", "left_semi")  # of the sets of all rounds
        side = lambda c, s: own.select(F.col("node").alias(c), F.col("s").alias(s))
        found = stored(left.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(trimmed(exact), "a long, b long"), "found")
        discard(left, ends)
        return found


def _joined(root: DataFrame, links: DataFrame) -> DataFrame:
    """root(node, root) after more links(a, b): only the components that links join are contracted, not all links anew."""
    top = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    up = links.join(top("a"), "a", "left").join(top("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    over = components(up).withColumnRenamed("root", "over")
    moved = root.join(over.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    new = over.join(root, "node", "left_anti").select("node", F.col("over").alias("root"))
    return stored(moved.unionByName(new), "roots")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row of docs of each component: links are five-word Jaccard similarities of `least` or more, and op4's (three words, two bits).

    Equal sets are one node. A set's prefix, under an order with frequent shingles last, meets the prefix of every set that is alike in some list (a shingle's
    sets), so no link is missed. Rounds join most of what belongs together: over some of the lists the first member with the others, then each
    member with its most likely partner of another component, and so again over all lists. Last, all pairs of all lists whose members are
    still apart are compared: after the rounds these are few. The row that stays has the smallest doc_id. Columns are those of docs.
    """
    ship(docs.sparkSession)
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    wide = stored(marked(rows, least), "marked")
    marks = stored(wide.select("doc_id", "mark", "fp", "node"), "marks")
    nodes = stored(wide.drop("doc_id", "mark", "fp").dropDuplicates(["node"]), "nodes")
    discard(wide)
    known = stored(nodes.select("node", "n", "tally", "fine", "bits", F.slice(F.sort_array("prefix"), 1, F.when(F.col("n") > LONG, LONG_HEAD).otherwise(HEAD)).alias("head")), "sketches")
    lists = stored(nodes.select(F.explode("prefix").alias("h"), "node", "n").repartition("h").sortWithinPartitions("h").mapInArrow(_shared, "h long, node long, n int"), "lists")
    discard(nodes)
    big = stored(lists.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles")).where("tiles > 1"), "big-lists")
    some = lists.where(F.pmod(F.xxhash64("h"), F.lit(SOME)) == 0)
    long = F.col("n") > LONG
    sketches = lambda mode: known.select("node", "n", "bits", F.when(long, F.col("tally")).otherwise(F.lit(b"")).alias("tally"), F.col("head") if mode == "all" else F.array().cast("array<long>").alias("head"))
    by_fp = stored(marks.groupBy("fp").agg(F.min("node").alias("rep")), "reps")
    rep = lambda c: by_fp.select(F.col("fp").alias(c), F.col("rep").alias(f"{c}_rep"))
    near = links(by_fp.select("fp")).join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    same = marks.select("fp", "node").distinct().join(by_fp, "fp").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    found = stored(near.unionByName(same), "found")
    root, verify = stored(components(found), "roots"), Verifier(marks, known, rows, least)
    for mode, taken in (("first", some), ("nearest", some), ("nearest", lists), ("all", lists)):
        pairs = _candidates(taken, big, sketches(mode), root, least, mode)
        if not pairs.isEmpty():
            new, before = verify(pairs), root
            root = _joined(before, new)
            discard(before, new)
        discard(pairs)
    placed = marks.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    out = keep_rows(docs, placed, id_col, text_col)
    discard(marks, known, lists, big, by_fp, found, root, *verify.read)
    return out
