"""Operator 3: exact top-k inner products by dual-tree search over cover trees.

1. Equal vectors are one point with its smallest ids: of those that score alike, only the first by id can be among the best.
2. Data are dealt to cells, and queries to groups of blocks, each by its nearest pivot, a vector of a sample. Each query gets the kth score that it has against
   the sample, its floor, which is a lower bound of its true one. A group and a cell meet only where their bound

       <q, p> + |p| r_q + |q| r_p + r_q r_p        (centres q and p with covering radii r_q and r_p)

   isn't less than the group's worst floor; others are left out before any vector is copied.
3. Each block of queries and each part of a cell are indexed by a cover tree; the search walks both trees together, and leaves out a pair of nodes
   when the same bound is less than the worst kth score of the query node.

Scores are exact integers: in double precision where no sum can pass 2**53, as 64-bit integers up to 2**62, as Python's beyond.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.llm.common import written

#: Vectors of a part and queries of a block, about; pivots at most for each number of components; vectors of the sample.
SHARD, BLOCK, PIVOTS, SEEDS = 4096, 2048, 512, 2048
LEAF = 48
#: A child's radius against its parent's, at most.
SHRINK = 0.7
#: Centres that are tried at a time; points of leaves that are compared at a time at most, about (at first LEAF, then more and more).
TRIED, TOGETHER = 256, 1024
LONGEST = (1 << 63) - 1


class CoverTree:
    """Nodes with a centre (a point of the node), the radius that covers their points, and children with smaller radii; leaves hold points.

    A node's cover is made of centres that lie farther from each other than SHRINK of its radius. Centres that cover themselves alone are one leaf together.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        with np.errstate(all="ignore"):
            self.squares = (points * points).sum(1)
            self.norms = np.sqrt(self.squares)
            self.centre: list[int] = []
            self.radius: list[float] = []
            self.children: list[np.ndarray | None] = []
            self.members: list[np.ndarray] = []
            if len(points):
                self._build()

    def _distances(self, rows: np.ndarray, to: int) -> np.ndarray:
        gap = self.points[rows] - self.points[to]
        return np.sqrt((gap * gap).sum(1))

    def _node(self, rows: np.ndarray) -> int:
        """A node of rows, of which the first is the centre."""
        self.centre.append(int(rows[0]))
        self.radius.append(float(self._distances(rows, rows[0]).max()) * (1 + 1e-9))
        self.children.append(None)
        self.members.append(rows)
        return len(self.centre) - 1

    def _cover(self, rows: np.ndarray, limit: float) -> list[np.ndarray]:
        """rows in parts, each with its centre first: each centre is farther than limit from those before it, each row near the first centre that is near enough."""
        parts = []
        while len(rows):
            tried = rows[:TRIED]
            inside = self.squares[tried][:, None] + self.squares[rows][None, :] - 2 * (self.points[tried] @ self.points[rows].T) <= limit * limit
            free = np.ones(len(rows), bool)
            for i in range(len(tried)):
                if free[i]:
                    own = inside[i] & free
                    own[i] = False
                    parts.append(np.concatenate([tried[i : i + 1], rows[own]]))
                    free[i] = False
                    free &= ~own
            rows = rows[free]
        return parts

    def _build(self) -> None:
        todo = [self._node(np.arange(len(self.points)))]
        while todo:
            node = todo.pop()
            rows = self.members[node]
            if len(rows) <= LEAF or self.radius[node] == 0:
                continue
            parts = self._cover(rows, self.radius[node] * SHRINK)
            alone = [own[0] for own in parts if len(own) == 1]
            if len(alone) == len(rows) or len(parts) == 1:
                continue
            found = [self._node(own) for own in parts if len(own) > 1]
            todo += found
            if alone:
                found.append(self._node(np.array(alone)))
            self.children[node] = np.array(found)

    @property
    def size(self) -> int:
        return len(self.centre)


def exactly(a: np.ndarray, b: np.ndarray) -> type:
    """The kind of number in which all inner products of rows of a and b are exact."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def _as(kind: type, points: np.ndarray) -> np.ndarray:
    return points if kind is np.float64 else points.astype(np.int64) if kind is np.int64 else np.array([[int(x) for x in row] for row in points], object).reshape(points.shape)


def _below(scores: np.ndarray, kind: type) -> np.ndarray:
    """Scores as doubles that aren't larger."""
    return scores if kind is np.float64 else np.nextafter(scores.astype(np.float64), -np.inf)


def search(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, stats: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, ids, and whether there is one, each (queries, k), of the best k of data for each query, by score and then smaller id, among those that aren't less than the
    query's floor; a query's own id is left out. Points are whole numbers in double precision."""
    kind = exactly(queries, data) if len(queries) and len(data) else np.float64
    low = {np.float64: -np.inf, np.int64: np.iinfo(np.int64).min, object: -(1 << 5000)}[kind]
    best = np.full((len(queries), k), low, kind)
    owners = np.full((len(queries), k), np.iinfo(np.int64).max)
    worst = floors.astype(np.float64).copy()
    if not len(queries) or not len(data):
        return best, owners, best != low
    q, d = CoverTree(queries), CoverTree(data)
    qc, dc = queries[q.centre], data[d.centre]
    qr, dr, qn, dn = np.array(q.radius), np.array(d.radius), q.norms[q.centre], d.norms[d.centre]
    whole = _as(kind, queries), _as(kind, data)

    def bounds(a: int, nodes: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            reach = dn[nodes] * qr[a] + qn[a] * dr[nodes] + qr[a] * dr[nodes]
            return dc[nodes] @ qc[a] + reach + (reach + dn[nodes] * qn[a]) * 1e-9 + 1e-3

    def compare(rows: np.ndarray, cols: np.ndarray) -> None:
        for at in range(0, len(cols), 4096):
            here = cols[at : at + 4096]
            scores = whole[0][rows] @ whole[1][here].T
            scores[query_ids[rows][:, None] == ids[here][None, :]] = low
            least = best[rows, k - 1]
            if len(here) > k and kind is not object:
                least = np.maximum(least, np.partition(scores, -k, axis=1)[:, -k])
            x, y = np.nonzero((scores >= least[:, None]) & (scores >= floors[rows][:, None]) & (scores != low))
            if not len(x):
                continue
            own = rows[np.unique(x)]
            row = np.concatenate([rows[x], np.repeat(own, k)])
            score = np.concatenate([scores[x, y], best[own].ravel()])
            owner = np.concatenate([ids[here[y]], owners[own].ravel()])
            order = np.lexsort((owner, -np.unique(score, return_inverse=True)[1], row))
            row, score, owner = row[order], score[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            take = first[:, None] + np.arange(k)  # each has its k former ones at least
            best[own], owners[own] = score[take], owner[take]
            kth = best[own, k - 1]
            full = kth != low
            worst[own[full]] = np.maximum(worst[own[full]], _below(kth[full], kind))

    def count(what: str, n: int = 1) -> None:
        if stats is not None:
            stats[what] = stats.get(what, 0) + n

    count("nodes", d.size)
    count("query_nodes", q.size)
    count("all", len(queries) * len(data))
    inner = np.array([c is not None for c in d.children])

    def alive(a: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of nodes that may hold something for the query group, and their bounds: the others' are less than the group's worst kth score."""
        tops = bounds(a, nodes)
        keep = ~(tops < worst[q.members[a]].min())
        count("visited", len(nodes))
        count("pruned", int((~keep).sum()))
        return nodes[keep], tops[keep]

    stack = [(0, np.array([0]))]
    while stack:
        a, nodes = stack.pop()
        nodes, tops = alive(a, nodes)
        while (wide := inner[nodes] & ((dr[nodes] >= qr[a]) | (q.children[a] is None))).any():
            below, their_tops = alive(a, np.concatenate([d.children[n] for n in nodes[wide]]))
            nodes, tops = np.concatenate([nodes[~wide], below]), np.concatenate([tops[~wide], their_tops])
        if q.children[a] is not None:
            stack += [(int(child), nodes) for child in q.children[a]]
            continue
        order = np.argsort(-tops)  # the most promising come first, some points at a time
        nodes, tops = nodes[order], tops[order]
        sizes = np.cumsum([len(d.members[n]) for n in nodes])
        at, most = 0, LEAF
        while at < len(nodes):
            if tops[at] < worst[q.members[a]].min():
                count("pruned", len(nodes) - at)
                break
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
            cols = np.concatenate([d.members[n] for n in nodes[at:to]])
            count("compared", len(q.members[a]) * len(cols))
            compare(q.members[a], cols)
            at, most = to, min(2 * most, TOGETHER)
    return best, owners, best != low


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def whole_vectors(frame: DataFrame, id_column: str, vector_column: str, scale: float) -> DataFrame:
    """(id long, dim int, v array<double>): vectors with components floor(scale * x); without those that are null or empty, hold null or
    non-finite components (or, from doubles, ones that scaling makes so), or have a null id."""
    scaled = lambda x: x.cast("double") * scale
    # a double of 2**53 or more is whole; Spark's floor would make it a long
    v = F.transform(F.col(vector_column), lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    fine = F.forall(F.col(vector_column), lambda x: x.isNotNull() & (F.abs(scaled(x)) < float("inf")))
    rows = frame.filter(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & (F.size(vector_column) > 0)).filter(fine)
    return rows.select(F.col(id_column).cast("long").alias("id"), F.size(vector_column).alias("dim"), v.alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """rows (id, dim, v) in which each vector has its k + 1 smallest ids, each k times at most: all that can be among a query's k best, whose own id is left out."""
    counted = rows.groupBy("dim", "v", "id").agg(F.count("*").alias("n"))
    first = counted.withColumn("place", F.row_number().over(Window.partitionBy("dim", "v").orderBy("id"))).filter(F.col("place") <= k + 1)
    return first.select("id", "dim", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("copy")).drop("copy")


def top_k(frame: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank int from 1, id, score long): for each row where the column is_query holds, the k best of all other rows by inner product
    of whole vectors, ties to the smaller id; all of them if there are fewer.

    Only vectors of the same number of components are compared. Vectors null or empty, or with components null or non-finite, and rows with
    a null id, take no part. Every row with the query's id is its own. A query id of several rows asks with its smallest vector; candidates that repeat
    id and vector count as often as they are there. Scores beyond a long are ranked as they are and given as the nearest long. An empty table gives no rows.
    """
    spark = frame.sparkSession
    every = whole_vectors(frame, id_column, vector_column, scale)
    data = written(distinct_vectors(every, k), "vectors")
    asked = whole_vectors(frame.filter(is_query), id_column, vector_column, scale).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("x")).select("id", "x.dim", "x.v")
    sample = data.withColumn("draw", F.xxhash64("id")).orderBy("draw", "id").limit(SEEDS).select("id", "dim", "v").toArrow()  # SEEDS rows
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(sample.column("dim").to_pylist()):
        own = sample.filter(pc.equal(sample.column("dim"), dim))
        ids, first = np.unique(own.column("id").to_numpy(), return_index=True)
        seeds[dim] = (ids, _matrix(own.column("v"))[first])
    held = {r.dim: r["count"] for r in data.groupBy("dim").count().collect()}  # a row for each number of components
    n_asked = {r.dim: r["count"] for r in asked.groupBy("dim").count().collect()}
    few = lambda n, size: min(PIVOTS, -(-n // size))
    pivots = {dim: v[: few(held[dim], SHARD)] for dim, (_, v) in seeds.items()}
    block_pivots = {dim: v[: few(n_asked.get(dim, 1), BLOCK)] for dim, (_, v) in seeds.items()}

    def nearest(centres: dict[int, np.ndarray], floored: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    ids, dims = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                    cells, far, floors = np.zeros(len(ids), np.int32), np.zeros(len(ids)), np.full(len(ids), -np.inf)
                    for dim in np.unique(dims):
                        rows = np.flatnonzero(dims == dim)
                        v = _matrix(batch.column(2).take(pa.array(rows)))
                        if dim not in centres:
                            far[rows] = np.inf
                            continue
                        p = centres[dim]
                        with np.errstate(all="ignore"):
                            own = np.argmin((p * p).sum(1)[None, :] - 2 * v @ p.T, 1)
                            gap = v - p[own]
                            cells[rows], far[rows] = own, np.sqrt((gap * gap).sum(1)) * (1 + 1e-9)
                        if floored:
                            floors[rows] = least_scores(v, ids[rows], *seeds[dim])
                    extra = [pa.array(cells), pa.array(far)] + [pa.array(floors)] * floored
                    yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=["id", "dim", "v", "cell", "far"] + ["floor"] * floored)

        return run

    def least_scores(v: np.ndarray, own: np.ndarray, ids: np.ndarray, sampled: np.ndarray) -> np.ndarray:
        """Lower bounds of the queries' kth scores: those against the sample."""
        kind, out = exactly(v, sampled), np.full(len(v), -np.inf)
        if len(ids) > k:
            scores = _as(kind, v) @ _as(kind, sampled).T
            for i in range(len(v)):
                others = scores[i][ids != own[i]]
                out[i] = float(_below(np.sort(others)[-k:][:1], kind)[0])
        return np.nextafter(out, -np.inf)

    cells = written(data.mapInArrow(nearest(pivots, False), "id long, dim int, v array<double>, cell int, far double"), "cells")
    queries = written(asked.mapInArrow(nearest(block_pivots, True), "id long, dim int, v array<double>, cell int, far double, floor double"), "queries")
    # PIVOTS rows at most for each number of components
    own = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()
    groups = queries.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.min("floor").alias("floor")).collect()
    if not own or not groups:
        return spark.createDataFrame([], f"query_id long, rank int, {id_column} long, score long")
    met = [(c.dim, c.cell, -(-c.n // SHARD), g.cell, -(-g.n // BLOCK)) for c in own for g in groups if c.dim == g.dim and _meet(pivots.get(c.dim), block_pivots.get(c.dim), c, g)]
    pairs = spark.createDataFrame(met, "dim int, cell int, parts int, group int, blocks int")
    by_cell = F.broadcast(pairs.groupBy("dim", "cell").agg(F.max("parts").alias("parts"), F.collect_list(F.struct("group", "blocks")).alias("groups")))
    by_group = F.broadcast(pairs.groupBy("dim", F.col("group").alias("cell")).agg(F.max("blocks").alias("blocks"), F.collect_list(F.struct(F.col("cell").alias("of"), "parts")).alias("cells")))
    some = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    shards = cells.join(by_cell, ["dim", "cell"]).select("dim", "cell", some("parts").alias("part"), "id", "v", F.explode("groups").alias("g")).select("dim", "cell", "part", "id", "v", "g.group", "g.blocks").withColumn("block", each("blocks"))
    queries = queries.join(by_group, ["dim", "cell"]).select("dim", F.col("cell").alias("group"), some("blocks").alias("block"), "id", "v", "floor", F.explode("cells").alias("c"))
    queries = queries.select("dim", "group", "block", "id", "v", "floor", F.col("c.of").alias("cell"), "c.parts").withColumn("part", each("parts"))

    def pair(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return nothing
        ids, own = held.column("id").to_numpy(), asked.column("id").to_numpy()
        best, owners, found = search(_matrix(asked.column("v")), own, asked.column("floor").to_numpy(), _matrix(held.column("v")), ids, k)
        scores = [int(x) for x in best[found]]
        near = [max(-LONGEST - 1, min(LONGEST, x)) for x in scores]
        wide = [(x + (1 << 5000)).to_bytes(640, "big") if abs(x) >= 1 << 62 else None for x in scores]
        return pa.table({"query_id": np.repeat(own, found.sum(1)), "id": owners[found], "score": pa.array(near, pa.int64()), "wide": pa.array(wide, pa.binary())})

    nothing = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("wide", pa.binary())]).empty_table()
    keys = ["dim", "group", "block", "cell", "part"]
    found = queries.select(*keys, "id", "v", "floor").groupBy(*keys).cogroup(shards.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(pair, "query_id long, id long, score long, wide binary")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("wide"), "id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_column), "score")


def _meet(pivots: np.ndarray | None, block_pivots: np.ndarray | None, cell, group) -> bool:
    """Whether a cell may hold something that isn't less than all floors of a group of queries."""
    if pivots is None or block_pivots is None:
        return True
    p, q = pivots[cell.cell], block_pivots[group.cell]
    with np.errstate(all="ignore"):
        n_p, n_q = np.sqrt(p @ p), np.sqrt(q @ q)
        reach = n_p * group.far + n_q * cell.far + group.far * cell.far
        return not p @ q + reach + (reach + n_p * n_q) * 1e-9 + 1e-3 < group.floor
