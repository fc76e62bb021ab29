"""Approximate nearest neighbours by stable projections (after SRS, Sun et al., PVLDB 2014).

Gaussian projections are 2-stable: a projected distance, divided by the true one, is chi with as
many degrees of freedom as projections. Projections are indexed by kd-trees; a query takes points
in order of projected distance and computes true distances, until the chi-square test says
that a point as near as the k-th found would have been met already, at the confidence asked for.

The top of the tree is one table of splits, fitted on a bounded sample; its cells deal out all
rows. Cells above a bound are cut by a hash of the id. A query visits the cell it falls in, and
with the k-th distance found there, all cells that the test doesn't rule out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradus.llm.common import keep


def chi2_cdf(x: np.ndarray, dims: int) -> np.ndarray:
    """Chi-square distribution for an even number of dims."""
    half = np.asarray(x, dtype=float) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(np.array(mid), dims) < p else (low, mid)
    return high


def projections(width: int, dims: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dims))


class Tree:
    """A kd-tree: points in the order of leaves, and the boxes of leaves."""

    def __init__(self, low: np.ndarray, leaf: int = 64):
        order = np.arange(len(low))
        parts, done = [order], []
        while parts:
            part = parts.pop()
            spread = np.ptp(low[part], axis=0) if len(part) > leaf else np.zeros(1)
            if len(part) <= leaf or spread.max() == 0:
                # Alike points stay in order of ids, in leaves of bounded size.
                done += [part[i : i + leaf] for i in range(0, len(part), leaf)]
            else:
                at = np.argsort(low[part, spread.argmax()], kind="stable")
                half = len(part) // 2
                parts += [np.sort(part[at[half:]]), np.sort(part[at[:half]])]
        self.order = np.concatenate(done) if done else order
        self.starts = np.cumsum([0, *map(len, done)])
        self.box_low = np.array([low[p].min(axis=0) for p in done])
        self.box_high = np.array([low[p].max(axis=0) for p in done])

    def leaves(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves by projected distance of their boxes, and these distances squared."""
        gap = np.maximum(0, np.maximum(self.box_low - q, q - self.box_high))
        d = (gap**2).sum(axis=1)
        order = np.argsort(d, kind="stable")
        return order, d[order]


def _slack(v: np.ndarray) -> float:
    """Square of what projections of equal vectors may differ by: their last bits depend on the batch."""
    v = np.asarray(v, dtype=float)
    return float(1e-20 * (v @ v))


def nearest(tree: Tree, ids: np.ndarray, points: np.ndarray, low: np.ndarray, q_id: int, q: np.ndarray, q_low: np.ndarray, k: int, stop: float, bound: float, seen: list[int] | None = None, chunk: int = 64, most_chunk: int = 1024) -> list[tuple[int, float]]:
    """The k nearest of the tree's points, in pairs (id, distance).

    Points come in order of projected distance: leaves are opened in growing runs, and a point is due
    once no unopened leaf's box is nearer. True distances are computed a chunk of points at a time, in growing chunks. stop is the
    chi-square quantile: the search ends when the square of the next projected distance exceeds stop times the
    square of the k-th true distance found, here or before (bound). At k-th distance 0 nothing is left to find but
    larger ids. Projections of copies may differ in their last bits, so points as near as that are always taken.
    seen gets the number of true distances.
    """
    order, far = tree.leaves(q_low)
    slack = _slack(q)
    far = np.where(far <= slack, 0.0, far)
    best_d, best_i = np.zeros(0), np.zeros(0, dtype=np.int64)
    due_d, due = np.zeros(0), np.zeros(0, dtype=np.int64)
    at, run, visited = 0, 1, 0

    def over(d: float) -> bool:
        kth = best_d[k - 1] if len(best_d) >= k else np.inf
        return d > stop * min(kth, bound) ** 2 or (kth == 0 and d > 0)

    while at < len(order) or len(due):
        if at < len(order) and not over(far[at]):
            rows = np.concatenate([tree.order[tree.starts[leaf] : tree.starts[leaf + 1]] for leaf in order[at : at + run]])
            rows = rows[ids[rows] != q_id]
            d = ((low[rows] - q_low) ** 2).sum(axis=1)
            d = np.where(d <= slack, 0.0, d)
            near = d <= stop * min(best_d[k - 1] if len(best_d) >= k else np.inf, bound) ** 2  # the rest can't be due any more
            due_d, due = np.concatenate([due_d, d[near]]), np.concatenate([due, rows[near]])
            by = np.argsort(due_d, kind="stable")
            due_d, due = due_d[by], due[by]
            at, run = at + run, min(2 * run, 32)
        else:
            at = len(order)  # all that is left lies beyond
        ready = int(np.searchsorted(due_d, far[at], side="right")) if at < len(order) else len(due)
        taken = 0
        while taken < ready:
            if over(due_d[taken]):
                at, due_d, due = len(order), due_d[:0], due[:0]
                break
            rows = due[taken : min(ready, taken + chunk)]
            taken += len(rows)
            visited += len(rows)
            chunk = min(2 * chunk, most_chunk)
            d = np.sqrt(((points[rows] - q) ** 2).sum(axis=1))
            best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[rows]])
            top = np.lexsort((best_i, best_d))
            # A repeated id counts once, at its nearest.
            _, first = np.unique(best_i[top], return_index=True)
            top = top[np.sort(first)][:k]
            best_d, best_i = best_d[top], best_i[top]
        due_d, due = due_d[taken:], due[taken:]
    if seen is not None:
        seen.append(visited)
    return list(zip(best_i.tolist(), best_d.tolist(), strict=True))


@dataclass(frozen=True)
class Cells:
    """Splits of the top of the tree: heap order, dimension and value; and boxes of its cells."""

    dim: np.ndarray
    value: np.ndarray
    levels: int

    def of(self, low: np.ndarray) -> np.ndarray:
        at = np.zeros(len(low), dtype=np.int64)
        for _ in range(self.levels):
            at = 2 * at + 1 + (low[np.arange(len(low)), self.dim[at]] > self.value[at])
        return at - (2**self.levels - 1)


def split_cells(sample: np.ndarray, levels: int) -> Cells:
    n = 2**levels - 1
    dim, value = np.zeros(max(n, 1), dtype=np.int64), np.zeros(max(n, 1))
    parts = {0: sample}
    for at in range(n):
        part = parts.pop(at)
        if len(part):
            dim[at] = np.argmax(part.var(axis=0))
            value[at] = np.median(part[:, dim[at]])
        below = part[:, dim[at]] <= value[at]
        parts[2 * at + 1], parts[2 * at + 2] = part[below], part[~below]
    return Cells(dim, value, levels)


_VEC = "array<double>"


def search(vectors: DataFrame, is_query, k: int = 10, dims: int = 24, confidence: float = 0.93, block_rows: int = 8192, sample_rows: int = 20_000, max_cells: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: of every row of vectors (vec_id, embedding) where is_query
    holds, the k nearest found of all other rows, by Euclidean distance in double precision.

    With 24 projections and a confidence of 0.93 about half of the points of `embeddings` (64 dimensions, far from
    each other) are met before the test stops, at a recall of about 0.95; the README has the figures.
    The splits come from a sample of at most sample_rows rows, those with the smallest hash of
    vec_id; all rows are indexed. Left out are rows with null vec_id, with null or zero
    vectors, with null or non-finite components, and with another length than most vectors have.
    Ties go to the smaller vec_id; repeated vec_ids count once, at their nearest. A table with
    fewer rows than k gives what there is; an empty one gives an empty result.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"), is_query.alias("asks"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    spark = vectors.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = sizes[0]
    rows = rows.where(F.size("v") == width)
    matrix = projections(width, dims, seed)
    stop = chi2_quantile(confidence, dims)

    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()
    sample = np.stack(picked["v"].to_numpy()) @ matrix
    levels = 0
    while 2**levels * block_rows < total and 2 ** (levels + 1) <= max_cells:
        levels += 1
    cells = split_cells(sample, levels)
    n_cells = 2**levels
    held = spark.sparkContext.broadcast((matrix, cells))

    @F.pandas_udf("cell int, low array<double>")
    def place(v: pd.Series) -> pd.DataFrame:
        matrix, cells = held.value
        low = np.stack(v.to_numpy()) @ matrix if len(v) else np.zeros((0, dims))
        return pd.DataFrame({"cell": cells.of(low).astype(np.int32), "low": list(low)})

    placed = keep(rows.withColumn("p", place("v")).select("id", "v", "asks", "p.cell", "p.low"), "vectors")
    bounds = [f(F.col("low")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))]
    stats = placed.groupBy("cell").agg(F.count("*").alias("n"), *bounds).collect()  # at most max_cells rows
    parts = {r.cell: -(-r.n // block_rows) for r in stats}
    part_of = F.create_map(*[F.lit(x) for c, n in parts.items() for x in (c, n)])[F.col("cell")]
    points = placed.withColumn("part", F.pmod(F.xxhash64("id"), part_of).cast("int")).select("cell", "part", "id", "v", "low")
    order = sorted(parts)
    boxes = {c: i for i, c in enumerate(order)}
    by_cell = {r.cell: r for r in stats}
    box_low = np.array([[by_cell[c][f"a{i}"] for i in range(dims)] for c in order])
    box_high = np.array([[by_cell[c][f"b{i}"] for i in range(dims)] for c in order])
    routes = spark.sparkContext.broadcast((order, boxes, parts, box_low, box_high))
    queries = placed.where("asks").select("id", "v", "low", "cell")

    def home(batches):
        """A query's own cell, one part of it: enough for a first bound."""
        _, _, parts, _, _ = routes.value
        for b in batches:
            n = b["cell"].map(parts).to_numpy()
            yield b.assign(part=(np.abs(b["id"].to_numpy()) % n).astype(np.int32), bound=np.inf)[["cell", "part", "id", "v", "low", "bound"]]

    def others(batches):
        """All parts of the cells that may hold one of the k nearest, given the bound."""
        order, boxes, parts, box_low, box_high = routes.value
        for b in batches:
            out = {c: [] for c in ("cell", "part", "id", "v", "low", "bound")}
            for q in b.itertuples(index=False):
                gap = np.maximum(0, np.maximum(box_low - q.low, q.low - box_high))
                near = np.flatnonzero((gap**2).sum(axis=1) <= stop * q.bound**2 + _slack(q.v))
                for c in (order[i] for i in near):
                    for part in range(parts[c]):
                        for col, x in zip(out.values(), (c, part, q.id, q.v, q.low, q.bound), strict=True):
                            col.append(x)
                if len(out["id"]) > 2000:
                    yield pd.DataFrame(out)
                    out = {c: [] for c in out}
            yield pd.DataFrame(out)

    def look(_, p, q):
        found = []
        if len(p) and len(q):
            p = p.sort_values("id")
            ids, full, low = p["id"].to_numpy(), np.stack(p["v"].to_numpy()), np.stack(p["low"].to_numpy())
            tree = Tree(low)
            for r in q.itertuples(index=False):
                found += [(r.id, i, d) for i, d in nearest(tree, ids, full, low, r.id, np.asarray(r.v), np.asarray(r.low), k, stop, r.bound)]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    route = f"cell int, part int, id long, v {_VEC}, low {_VEC}, bound double"

    def ask(routed: DataFrame) -> DataFrame:
        return points.groupBy("cell", "part").cogroup(routed.groupBy("cell", "part")).applyInPandas(look, "query_id long, vec_id long, score double")

    first = keep(ask(queries.mapInPandas(home, route)), "first")
    # The k-th best of a query's own cell; fewer than k there bound nothing.
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("score")).alias("kth"))
    bounded = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "v", "low", "cell", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    found = keep(ask(bounded.mapInPandas(others, route)), "found")
    both = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
