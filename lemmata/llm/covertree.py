"""Exact top-k by inner product: cover trees over queries and data, searched together."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import in_batches, materialize

#: Points for each centre of a tree, about; points of one tree; queries that go to the workers at once, a bounded size.
LEAF, TREE_ROWS, QUERY_ROWS = 32, 16_384, 65_536
_COLUMNS = "dim int, n int, ids binary, points binary, tree binary"
_NODE = np.dtype([("centre", "<i4"), ("level", "<i4"), ("up", "<i4"), ("lo", "<i4"), ("hi", "<i4"), ("radius", "<f8")])


class CoverTree:
    """A cover tree over the rows of `points` (whole numbers), down to one centre for about LEAF rows.

    Centres are taken farthest first, and a centre's level is the power of two below its distance from those before it. So the centres of a level and above are more than
    2**level apart, lower ones are at most 2**(level + 1) from a centre of a higher level, their parent, and a centre stands for itself on all levels below. Rows that are no centres belong to the nearest one.
    Node i is a centre with all below it, under its exact covering radius; a centre that has children has a node for its own rows among them.
    """

    def __init__(self, points: np.ndarray):
        self.points, n = points, len(points)
        norms = (points**2).sum(axis=1)

        def squares(i: int) -> np.ndarray:
            return np.maximum(norms + norms[i] - 2 * (points @ points[i]), 0.0)

        nodes, owner = [], np.zeros(n, int)
        if n:
            start = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
            near, centres, levels, up = squares(start), [start], [int(2**20)], [-1]
            while len(centres) * LEAF < n:
                new = int(np.argmax(near))
                if near[new] <= 0:
                    break
                far = squares(new)
                level = int(np.ceil(np.log2(near[new]) / 2)) - 1  # 2**level < distance <= 2**(level + 1)
                higher = np.flatnonzero(np.array(levels) > level)
                up.append(int(higher[np.argmin(far[np.array(centres)[higher]])]))
                owner[far < near] = len(centres)
                near = np.minimum(near, far)
                centres.append(new)
                levels.append(level)
            nodes = self._arrange(np.array(centres), np.array(levels), np.array(up), owner)
        self.nodes = np.array(nodes, _NODE)
        self._link()

    def _arrange(self, centres: np.ndarray, levels: np.ndarray, up: np.ndarray, owner: np.ndarray) -> list[tuple]:
        """Rows of each subtree side by side in `order`, and the nodes."""
        below: list[list[int]] = [[] for _ in centres]
        for c, u in enumerate(up.tolist()):
            if u >= 0:
                below[u].append(c)
        own = np.split(np.argsort(owner, kind="stable"), np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])
        lo, hi, order, at = np.zeros(len(centres), int), np.zeros(len(centres), int), [], 0
        todo = [(0, False)]
        while todo:
            c, done = todo.pop()
            if done:
                hi[c] = at
                continue
            lo[c] = at
            order.append(own[c])
            at += len(own[c])
            todo += [(c, True), *((x, False) for x in below[c])]
        self.order = np.concatenate(order)

        def radius(c: int, a: int, b: int) -> float:
            return float(np.sqrt(((self.points[self.order[a:b]] - self.points[centres[c]]) ** 2).sum(axis=1).max())) if b > a else 0.0

        nodes = [(centres[c], levels[c], up[c], lo[c], hi[c], radius(c, lo[c], hi[c])) for c in range(len(centres))]
        for c in range(len(centres)):
            if below[c]:
                end = lo[c] + len(own[c])
                nodes.append((centres[c], levels[c], c, lo[c], end, radius(c, lo[c], end)))
        return nodes

    def _link(self) -> None:
        self.centre = self.points[self.nodes["centre"]]
        self.radius = self.nodes["radius"]
        self.stretch = list(zip(self.nodes["lo"].tolist(), self.nodes["hi"].tolist(), strict=True))
        self.children: list[list[int]] = [[] for _ in self.stretch]
        for i, u in enumerate(self.nodes["up"].tolist()):
            if u >= 0:
                self.children[u].append(i)

    def to_bytes(self) -> tuple[bytes, bytes]:
        """Points in the order of the tree, and its nodes."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        nodes = self.nodes.copy()
        nodes["centre"] = place[nodes["centre"]]
        return self.points[self.order].astype("<i8").tobytes(), nodes.tobytes()

    @classmethod
    def from_bytes(cls, dim: int, points: bytes, nodes: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        tree.points = np.frombuffer(points, "<i8").reshape(-1, dim).astype(np.float64)
        tree.order = np.arange(len(tree.points))
        tree.nodes = np.frombuffer(nodes, _NODE)
        tree._link()
        return tree


class Best:
    """The k best (score, id) of each query so far; higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        hit = (score >= self.score[rows, -1:]).any(axis=1)
        if not hit.any():
            return
        rows = rows[hit]
        score = np.concatenate([self.score[rows], score[hit]], axis=1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        first = np.lexsort((ids, -score), axis=1)[:, : self.score.shape[1]]
        self.score[rows], self.id[rows] = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, ids: np.ndarray, best: Best) -> int:
    """Brings `best` up to date with the data's rows; a row with the query's own id takes no part. Returns the number of pairs of a query and a row that were scored.

    A pair of nodes can't score above <c, d> + r|d| + s|c| + rs (centres c, d; radii r, s). Pairs are taken by
    falling bounds and pruned where the bound is below the worst kth score of the queries in the node.
    """
    if not len(data.points) or not len(queries.points):
        return 0
    qc, qr, dc, dr = queries.centre, queries.radius, data.centre, data.radius
    qn, dn = np.sqrt((qc**2).sum(axis=1)), np.sqrt((dc**2).sum(axis=1))
    norms = np.sqrt((queries.points**2).sum(axis=1))

    def bound(q: int, d: np.ndarray) -> np.ndarray:
        x = dc[d] @ qc[q] + qr[q] * dn[d] + dr[d] * qn[q] + qr[q] * dr[d]
        return x + 1e-9 * np.abs(x) + 1e-6

    scored = 0
    heap = [(-float(bound(0, np.array([0]))[0]), 0, 0)]
    while heap:
        high, q, d = heapq.heappop(heap)
        rows = queries.order[slice(*queries.stretch[q])]
        if -high < best.score[rows, -1].min():
            continue
        if queries.children[q] and (not data.children[d] or qr[q] >= dr[d]):
            pairs = [(c, np.array([d])) for c in queries.children[q]]
        elif data.children[d]:
            pairs = [(q, np.array(data.children[d]))]
        else:
            high = queries.points[rows] @ dc[d] + norms[rows] * dr[d]
            rows = rows[high + 1e-9 * np.abs(high) + 1e-6 >= best.score[rows, -1]]  # each query by its own bound
            if not len(rows):
                continue
            own = data.order[slice(*data.stretch[d])]
            scored += len(rows) * len(own)
            for a in range(0, len(own), 4096):
                some = own[a : a + 4096]
                score = queries.points[rows] @ data.points[some].T
                score[query_ids[rows][:, None] == ids[some][None, :]] = -np.inf
                best.add(rows, score, ids[some])
            continue
        for c, ds in pairs:
            worst = best.score[queries.order[slice(*queries.stretch[c])], -1].min()
            for x, b in zip(ds.tolist(), bound(c, ds).tolist(), strict=True):
                if b >= worst:
                    heapq.heappush(heap, (-b, c, x))
    return scored


def usable(vector: Column) -> Column:
    """Not null, not empty, and no component null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _arrays(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: ids, and vectors as floor(scale * x)."""
    column = batch.column("embedding")
    ids = np.asarray(batch.column("vec_id"), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.float64)
    sizes = np.asarray(pc.list_value_length(column))
    at = np.concatenate([[0], np.cumsum(sizes)])
    found = {}
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        found[int(n)] = ids[own], np.floor(scale * flat[at[own][:, None] + np.arange(n)])
    return found


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0) -> DataFrame:
    """query_id, rank from 1, vec_id, score of each query's k highest integer inner products with the rows (all, if fewer).

    Both frames have vec_id and embedding; components become floor(scale * x). Ties go to the smaller vec_id; rows with the query's own vec_id take no part, nor
    do null ids, vectors that are null, empty or hold null or non-finite components, and vectors of another dimension. Repeated query
    ids count once; repeated rows are candidates each. Scores are exact below 2**53.

    Trees over the rows are built once, each over what a task reads, and written; so are trees over the queries. The queries' trees go to the workers by QUERY_ROWS rows at most, a
    bounded size. For each such block every task searches its rows' trees together with the block's, and hands on k rows a query; these are merged by query.
    """
    spark = rows.sparkSession
    both = []
    for x in (rows, queries):
        both.append(x.select(F.col("vec_id").cast("bigint"), "embedding").where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()))
    asked = materialize(both[1].dropDuplicates(["vec_id"]))
    asked = planted(asked.coalesce(max(1, -(-asked.count() // TREE_ROWS))), scale)
    data = planted(both[0], scale)
    schema = "query_id bigint, vec_id bigint, score bigint"
    found = None
    for held in _blocks(asked):
        sent = spark.sparkContext.broadcast(held)

        def of(batches, sent=sent):
            groups = [(dim, CoverTree.from_bytes(dim, points, tree), np.frombuffer(ids, "<i8")) for dim, ids, points, tree in sent.value]
            groups = [(dim, tree, ids, Best(len(ids), k)) for dim, tree, ids in groups]
            for batch in batches:
                for row in batch.to_pylist():
                    tree, ids = CoverTree.from_bytes(row["dim"], row["points"], row["tree"]), np.frombuffer(row["ids"], "<i8")
                    for dim, queries, query_ids, best in groups:
                        if dim == row["dim"]:
                            search(queries, query_ids, tree, ids, best)
            for _, _, query_ids, best in groups:
                real = np.isfinite(best.score)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(query_ids, real.sum(axis=1))),
                        pa.array(best.id[real]),
                        pa.array(best.score[real].astype(np.int64)),
                    ],
                    ["query_id", "vec_id", "score"],
                )

        part = data.transform(in_batches, of, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def planted(rows: DataFrame, scale: float) -> DataFrame:
    """Written trees over the rows of each task, at most TREE_ROWS rows each."""

    def of(batches):
        def trees(parts):
            for dim in sorted({d for p in parts for d in p}):
                own = [p[dim] for p in parts if dim in p]
                ids, points = (np.concatenate([o[i] for o in own]) for i in range(2))
                for a in range(0, len(ids), TREE_ROWS):
                    tree = CoverTree(points[a : a + TREE_ROWS])
                    data, nodes = tree.to_bytes()
                    out = [[dim], [len(tree.order)], [ids[a : a + TREE_ROWS][tree.order].astype("<i8").tobytes()], [data], [nodes]]
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["dim", "n", "ids", "points", "tree"])

        parts, size = [], 0
        for batch in batches:
            parts.append(_arrays(batch, scale))
            size += batch.num_rows
            if size >= TREE_ROWS:
                yield from trees(parts)
                parts, size = [], 0
        yield from trees(parts)

    return materialize(rows.transform(in_batches, of, _COLUMNS))


def _blocks(asked: DataFrame):
    """The queries' trees, at most QUERY_ROWS rows at a time."""
    asked = materialize(asked.withColumn("place", F.monotonically_increasing_id()))
    block, size = [], 0
    trees = asked.select("place", "n").orderBy("place").collect()  # a row for each tree
    for i, row in enumerate(trees):
        block.append(row["place"])
        size += row["n"]
        if i + 1 == len(trees) or size + trees[i + 1]["n"] > QUERY_ROWS:
            got = asked.where(F.col("place").isin(block)).orderBy("place").toArrow()
            yield [(r["dim"], r["ids"], r["points"], r["tree"]) for r in got.to_pylist()]
            block, size = [], 0
