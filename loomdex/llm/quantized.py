"""Embedding near-duplicates by product quantisation over coarse inverted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.common import pick, ship, stored
from loomdex.llm.components import components

#: Vectors that a dimension's quantisers are fitted on at most (about; a hash of the row's number chooses them), and centroids of a level at most.
FIT_VECTORS = 16_384
CENTROIDS = 4_096
#: Vectors that a list should hold: where first-level centroids are too few for that, second-level ones split their cells.
LIST_VECTORS = 1_024
#: Vectors of a list, and queries, that one task compares at a time.
TILE = 2_048
#: Vectors of a dimension up to which they are one list, without a fitted quantiser.
FEW = 64
#: Rows of a table of lists or tiles up to which it is sent to every executor.
BROADCAST_ROWS = 100_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; each is divided by its largest component first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _cells(x: np.ndarray, c: np.ndarray, reach: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(each row's cells, nearest first, and the gap to each): its own and those whose Voronoi border lies within reach, `most` of them; others have gap inf."""
    d = _squared(x, c)
    own = d.argmin(1)
    row = np.arange(len(x))
    gap = (d - d[row, own][:, None]) / (2 * np.sqrt(np.maximum(_squared(c[own], c), 1e-12)))
    gap[row, own] = -1
    p = min(most, len(c))
    near = np.argpartition(gap, p - 1, axis=1)[:, :p]
    g = np.take_along_axis(gap, near, 1)
    order = np.argsort(g, axis=1, kind="stable")
    near, g = np.take_along_axis(near, order, 1), np.take_along_axis(g, order, 1)
    return near, np.where(g <= reach, g, np.inf)


class Quantiser:
    """Centroids on two levels, the second of what the first leaves, and one codebook of residuals for each subspace.

    A list is a pair of centroids, so lists can be as many as the square of CENTROIDS while the model stays bounded.
    """

    def __init__(self, sample: np.ndarray, lists: int, inner: int = 1, subspaces: int = 8, codes: int = 64, probes: int = 16):
        rng = np.random.default_rng(7)
        x, self.probes = unit(sample), probes
        self.coarse = _kmeans(x, lists, 8, rng)
        x = x - self.coarse[_squared(x, self.coarse).argmin(1)]
        self.fine = _kmeans(x, inner, 8, rng) if inner > 1 else np.zeros((1, x.shape[1]))
        x = x - self.fine[_squared(x, self.fine).argmin(1)]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(subspaces, x.shape[1]))
        self.books = [_kmeans(x[:, c], codes, 8, rng) for c in self.cuts]

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists_of(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(own list, lists to probe): the probes are the nearest lists, by the larger gap of the two levels, within reach; -1 where there are no more."""
        first, gap = _cells(x, self.coarse, reach, self.probes)
        n = len(self.fine)
        if n == 1:
            return first[:, 0], np.where(np.isfinite(gap), first, -1)
        lists, gaps = [], []
        for k in range(first.shape[1]):
            second, g = _cells(x - self.coarse[first[:, k]], self.fine, reach, self.probes)
            lists.append(first[:, [k]] * n + second)
            gaps.append(np.maximum(g, gap[:, [k]]))
        lists, gaps = np.concatenate(lists, 1), np.concatenate(gaps, 1)
        order = np.argsort(gaps, axis=1, kind="stable")[:, : self.probes]
        return lists[:, 0], np.where(np.isfinite(np.take_along_axis(gaps, order, 1)), np.take_along_axis(lists, order, 1), -1)

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return np.stack([np.argmin((b * b).sum(1) - 2 * rest[:, c] @ b.T, axis=1) for c, b in zip(self.cuts, self.books, strict=True)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), sum(map(len, self.cuts))))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out[:, c] = b[codes[:, k]]
        return out

    def asymmetric(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Squared distances of residual queries to coded residuals, by one table lookup a subspace."""
        out = np.zeros((len(queries), len(codes)))
        for k, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += _squared(queries[:, c], b)[:, codes[:, k]]
        return out


class OneList:
    """A dimension of few vectors: one list, whose codes say nothing."""

    fine = np.zeros((1, 1))

    def lists_of(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(x), np.int64), np.zeros((len(x), 1), np.int64)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return np.zeros((len(lists), 1))

    def encode(self, rest: np.ndarray) -> np.ndarray:
        return np.zeros((len(rest), 1), np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.zeros((len(codes), 1))

    def asymmetric(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return np.zeros((len(queries), len(codes)))


def rough(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(8-bit components, each row's step, each row's error): what a query sends to its probes."""
    step = np.abs(x).max(1) / 127
    q = np.rint(x / np.maximum(step, 1e-300)[:, None]).astype(np.int8)
    return q, step, np.linalg.norm(x - q * step[:, None], axis=1)


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links with the components of the links (a, b)."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


def _sent(table: DataFrame) -> DataFrame:
    """The table for a join: to every executor if it is small, else by a shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def fit(nodes: DataFrame, probes: int, most: int) -> dict:
    """A quantiser for each dimension, on about `most` of its vectors at most. One row per dimension comes to the driver."""
    count = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = {d: n for d, n in count.items() if n > FEW}
    out: dict = {d: OneList() for d in count if d not in large}
    for dim, n in large.items():
        share = min(1 << 20, -(-(most << 20) // n))
        some = nodes.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(11), "node"), F.lit(1 << 20)) < F.lit(share))).select("v").limit(2 * most)
        x = np.asarray(some.toArrow().column("v").combine_chunks().flatten()).astype(float).reshape(-1, dim)
        if not len(x):
            out[dim] = OneList()
            continue
        lists = int(min(CENTROIDS, max(1, len(x) // 8), max(1, round(n**0.5))))
        inner = int(min(CENTROIDS, max(1, len(x) // 8), n // (lists * LIST_VECTORS)))
        out[dim] = Quantiser(x, lists, inner, probes=probes)
    return out


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, probes: int = 16, most: int = FIT_VECTORS) -> DataFrame:
    """Per row: vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included), kept.

    Two vectors of one dimension link if their cosine, in double precision, is `least` or more and the list of one that has the smaller number is
    among the other's probes. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Equal vectors are
    one node with a weight; each of them counts the others as links. A null vec_id links like any other but is never a component_id unless its
    component has no other; repeated vec_ids are rows of their own.

    Every vector is indexed: its list and its residual's code are stored. Members go to their list as codes, queries to the lists they probe
    as 8-bit components; table-lookup distances rule out what the known errors of both allow to rule out. Only vectors of members and queries
    with a survivor are sent on, and exact cosines decide. Lists and queries of many vectors are split into tiles by hash. Tiles report
    counts and a forest of their links, never pairs.
    """
    spark = vectors.sparkSession
    ship(spark)
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"
    rows = pick(vectors, vec_id=id_col, v=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast(f"array<{kind}>").alias("v"))
    fine = F.col("v").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stored(rows.withColumn("v", F.when(fine, F.transform("v", lambda x: x + F.lit(0).cast(kind)))), "vectors")
    good = rows.where("v is not null")
    # numbers given once, as the table is written: no two nodes can share one
    nodes = stored(good.groupBy("v").agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("weight")).withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vector-nodes")
    none = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    models = fit(nodes, probes, most)
    if not models:
        return none
    sent = spark.sparkContext.broadcast(models)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def assign(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                same = batch.filter(pa.array(dims == dim))
                for k in range(0, same.num_rows, 4096):
                    part = same.slice(k, 4096)
                    x = unit(np.asarray(part.column("v").flatten()).astype(float).reshape(-1, dim))
                    z = sent.value[int(dim)]
                    own, probe = z.lists_of(x, reach)
                    rest = x - z.centre(own)
                    codes = z.encode(rest)
                    error = np.linalg.norm(rest - z.decode(codes), axis=1)
                    q, step, missed = rough(x)
                    # a pair is looked for once: in the list of the smaller number
                    ask = [p[(p >= 0) & (p <= o)] for p, o in zip(probe, own.tolist(), strict=True)]
                    cols = [part.column("node"), part.column("weight"), part.column("dim"), pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([x.tobytes() for x in q], pa.binary()), pa.array(step), pa.array(missed), pa.array(ask, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["node", "weight", "dim", "own", "code", "error", "q", "step", "missed", "ask"])

    index = stored(nodes.select("node", "weight", "dim", "v").mapInArrow(assign, "node long, weight long, dim int, own long, code binary, error double, q binary, step double, missed double, ask array<long>"), "vector-index")
    members = index.groupBy("dim", F.col("own").alias("cell")).agg(F.count(F.lit(1)).alias("members"))
    asked = index.select("dim", F.explode("ask").alias("cell")).groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("queries"))
    tiles = lambda n: F.ceil(F.col(n) / TILE).cast("int").alias(n)
    large = stored(members.join(asked, ["dim", "cell"]).where(F.greatest("members", "queries") > TILE).select("dim", "cell", tiles("members"), tiles("queries")), "vector-tiles")
    slot = lambda n: F.pmod(F.xxhash64("node"), F.coalesce(n, F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    at = ["dim", "cell", "mb", "qb"]

    def dealt(rows: DataFrame, member: bool, *columns) -> DataFrame:
        """rows(dim, cell, node, ...) to the tiles they belong to: a member to all blocks of queries, a query to all blocks of members."""
        own, other = ("members", "queries") if member else ("queries", "members")
        here = rows.join(_sent(large), ["dim", "cell"], "left").withColumn("own", slot(own)).select("dim", "cell", "own", every(other).alias("other"), "node", *columns)
        mb, qb = ("own", "other") if member else ("other", "own")
        return here.select("dim", "cell", F.col(mb).alias("mb"), F.col(qb).alias("qb"), F.lit(member).alias("member"), "node", *columns)

    def look_up(table: pa.Table) -> pa.Table:
        """Members and queries with a survivor."""
        dim, cell = table.column("dim")[0].as_py(), table.column("cell")[0].as_py()
        z, is_m = sent.value[dim], np.asarray(table.column("member"))
        mi, qi = np.flatnonzero(is_m), np.flatnonzero(~is_m)
        data, node = table.column("data").combine_chunks(), np.asarray(table.column("node"))
        scale, error = np.asarray(table.column("scale")), np.asarray(table.column("error"))
        hit = np.zeros(len(node), bool)
        if len(mi) and len(qi):
            bytes_of = lambda i, kind: np.frombuffer(b"".join(data.take(pa.array(i)).to_pylist()), kind).reshape(len(i), -1)
            codes, centre = bytes_of(mi, np.uint8), z.centre(np.array([cell]))
            for k in range(0, len(qi), 512):
                some = qi[k : k + 512]
                far = reach + error[some][:, None] + error[mi] + 1e-6
                near = z.asymmetric(bytes_of(some, np.int8) * scale[some][:, None] - centre, codes) <= far * far
                near &= node[some][:, None] != node[mi]
                hit[some] |= near.any(1)
                hit[mi] |= near.any(0)
        keep = np.flatnonzero(hit)
        return pa.table({"dim": np.full(len(keep), dim, np.int32), "cell": np.full(len(keep), cell, np.int64), "mb": np.asarray(table.column("mb"))[keep], "qb": np.asarray(table.column("qb"))[keep], "member": is_m[keep], "node": node[keep]})

    coded = index.select("dim", F.col("own").alias("cell"), "node", F.col("code").alias("data"), F.lit(0.0).alias("scale"), "error")
    asks = index.select("dim", F.explode("ask").alias("cell"), "node", F.col("q").alias("data"), F.col("step").alias("scale"), F.col("missed").alias("error"))
    both = dealt(coded, True, "data", "scale", "error").unionByName(dealt(asks, False, "data", "scale", "error"))
    left = stored(both.groupBy(*at).applyInArrow(look_up, "dim int, cell long, mb int, qb int, member boolean, node long"), "vector-survivors")

    def rerank(table: pa.Table) -> pa.Table:
        """Counts of links by node, and a forest of the links."""
        dim, cell = table.column("dim")[0].as_py(), table.column("cell")[0].as_py()
        is_m = np.asarray(table.column("member"))
        node, weight, own = (np.asarray(table.column(c)) for c in ("node", "weight", "own"))
        x = unit(np.asarray(table.column("v").combine_chunks().flatten()).astype(float).reshape(-1, dim))
        mi, qi = np.flatnonzero(is_m), np.flatnonzero(~is_m)
        n = np.zeros(len(node), np.int64)
        la, lb = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(qi) if len(mi) else 0, 512):
            some = qi[k : k + 512]
            # in its own list a query is a member too: of both directions only one counts
            fit = (x[some] @ x[mi].T >= least) & ((own[some][:, None] != cell) | (node[some][:, None] > node[mi]))
            i, j = np.nonzero(fit)
            i, j = some[i], mi[j]
            n += np.bincount(i, weights=weight[j], minlength=len(node)).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=len(node)).astype(np.int64)
            a, b = _forest(node[i], node[j])
            la.append(a)
            lb.append(b)
        got = np.flatnonzero(n)
        a, b = np.concatenate(la), np.concatenate(lb)
        return pa.table({"counts": np.repeat([True, False], [len(got), len(a)]), "a": np.concatenate([node[got], a]), "b": np.concatenate([n[got], b])})

    full = index.select("node", "weight", "own").join(nodes.select("node", "v"), "node")
    found = stored(left.join(full, "node").groupBy(*at).applyInArrow(rerank, "counts boolean, a long, b long"), "vector-links")
    root = components(found.where("not counts"))
    n_links = found.where("counts").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    named = stored(nodes.join(root, "node", "left").join(n_links, "node", "left").select("v", "least_id", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("n", F.lit(0)).alias("n")), "vector-named")
    low = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "vector-roots")
    named = stored(named.join(low, "root").select("v", (F.col("n") + F.col("weight") - 1).alias("n_links"), "component_id"), "vector-results")
    out = good.join(named, "v").select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(none.where(F.lit(False)).unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))))
