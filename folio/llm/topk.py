"""Exact top-k inner product search by M-trees.

Components become integers floor(scale * x).  One more coordinate, sqrt(M2 - |x|2) with M2 the largest squared
norm, gives all candidates the same norm, so the greatest inner product is the least Euclidean distance and
metric bounds apply.

1. Cells: every vector belongs to the nearest of up to PIVOTS sampled vectors; a cell has its pivot as centre and a
   covering radius.  A cell's vectors are dealt to trees of up to `tree_rows` by a hash, so a cell of any size is split.
2. A query first searches the trees of its own cell.  Its k-th best there bounds the distance, and only cells that
   reach into that distance are searched next, with that bound from the start.
3. The best k of all are merged.

A tree is paged: an inner entry stores a centre, its covering radius and its distance to the centre above, a leaf
entry its distance to the leaf's centre.  The search takes pages best first.  An entry is passed over without
computing its distance if |d(q, parent) - d(entry, parent)| - radius is already beyond the k-th best, and
a page if d(q, centre) - radius is.  Bounds are widened by a rounding margin; scores are exact integers.

Defined results: vectors that are null or empty or hold a null, NaN or infinite component take no part, nor do null ids;
only vectors of the query's length are its candidates; rows with the query's own id aren't; repeated rows
are candidates each; query rows with one id are one query, whose best are taken over all its vectors; ties go to the
smaller id; an empty table gives no rows.  A vector whose scaled squared norm is 2^62 or more, so that its scores need not fit
a long, takes no part either; `too_long` gives those.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, ragged

PAGE = 64
#: Cells at most, and vectors that a cell has on average until there are so many.
PIVOTS, CELL_ROWS = 64, 2048


class MTree:
    """Bulk-loaded M-tree over augmented vectors (n, d + 1)."""

    def __init__(self, ids: np.ndarray, ints: np.ndarray, m2: float):
        self.ids, self.ints, self.m2 = ids, ints, m2
        norm = (ints.astype(np.float64) ** 2).sum(1)
        self.points = np.column_stack([ints.astype(np.float64), np.sqrt(np.maximum(0.0, m2 - norm))])
        self.margin = 1e-7 * (np.sqrt(m2) + 1)
        self.nodes: list[tuple] = []
        centre = self.points.mean(0)
        self.root_centre = centre
        self.root = self._build(np.arange(len(ids)), centre, np.random.default_rng(3))

    def _distances(self, at: np.ndarray, centre: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, ((self.points[at] - centre) ** 2).sum(1)))

    def _build(self, at: np.ndarray, centre: np.ndarray, rng) -> int:
        to_parent = self._distances(at, centre)
        if len(at) <= PAGE or to_parent.max() == 0.0:
            self.nodes.append(("leaf", at, to_parent))
            return len(self.nodes) - 1
        fan = int(min(PAGE, max(2, -(-len(at) // PAGE))))
        pivots = self.points[rng.choice(at, fan, replace=False)]
        own = self.points[at]
        near = ((pivots**2).sum(1) - 2 * own @ pivots.T).argmin(1)
        groups = [g for g in (at[near == k] for k in range(fan)) if len(g)]
        if len(groups) == 1:  # equal pivots: halve by distance to the centre
            order = at[np.argsort(to_parent, kind="stable")]
            groups = [order[: len(order) // 2], order[len(order) // 2 :]]
        centres = np.array([self.points[g].mean(0) for g in groups])
        radii = np.array([self._distances(g, c).max() for g, c in zip(groups, centres, strict=True)])
        above = np.sqrt(np.maximum(0.0, ((centres - centre) ** 2).sum(1)))
        me = len(self.nodes)
        self.nodes.append(())
        children = np.array([self._build(g, c, rng) for g, c in zip(groups, centres, strict=True)])
        self.nodes[me] = ("inner", centres, radii, above, children)
        return me

    def search(self, own_id: int, q: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id) by score descending, id ascending, of scores of `least` at least; entries with own_id don't count."""
        point = np.append(q.astype(np.float64), 0.0)
        q2 = float((q.astype(np.float64) ** 2).sum())
        best: list[tuple[int, int]] = []
        limit = np.inf if least is None else float(np.sqrt(max(0.0, q2 + self.m2 - 2.0 * least))) + self.margin
        start = float(np.sqrt(((point - self.root_centre) ** 2).sum()))
        queue = [(0.0, self.root, start)]
        while queue:
            bound, node, d = heapq.heappop(queue)
            if bound > limit:
                break
            page = self.nodes[node]
            if page[0] == "leaf":
                at = page[1][np.abs(d - page[2]) <= limit]
                if not len(at):
                    continue
                score, ids = self.ints[at] @ q, self.ids[at]
                if len(best) == k:
                    keep = score >= best[-1][0]
                    score, ids = score[keep], ids[keep]
                other = ids != own_id
                score, ids = score[other], ids[other]
                if len(ids) > k:
                    first = np.lexsort((ids, -score))[:k]
                    score, ids = score[first], ids[first]
                if len(ids):
                    best = sorted(best + list(zip(score.tolist(), ids.tolist(), strict=True)), key=lambda x: (-x[0], x[1]))[:k]
                    if len(best) == k:
                        limit = min(limit, float(np.sqrt(max(0.0, q2 + self.m2 - 2.0 * best[-1][0]))) + self.margin)
            else:
                _, centres, radii, above, children = page
                near = np.flatnonzero(np.abs(d - above) - radii <= limit)
                dist = np.sqrt(((centres[near] - point) ** 2).sum(1))
                low = dist - radii[near]
                for i in np.flatnonzero(low <= limit):
                    heapq.heappush(queue, (max(0.0, float(low[i])), int(children[near[i]]), float(dist[i])))
        return best


def _norm_of_doubles(v: Column, scale: int) -> Column:
    """An upper bound of the scaled vector's squared norm, in doubles: components of any size add up, at worst to infinity."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + F.pow(F.abs(x.cast("double")) * scale + 1.0, F.lit(2.0)))


def _whole(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def too_long(vectors: DataFrame, vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The rows whose vectors are left out for their length alone."""
    v = F.col(vec_col)
    return vectors.where(F.when(v.isNotNull() & _whole(v), _norm_of_doubles(v, scale) >= 2.0**62).otherwise(False))


def as_integers(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    v = F.col(vec_col)
    x = vectors.where(v.isNotNull() & (F.size(v) > 0) & F.col(id_col).isNotNull() & F.when(_whole(v), _norm_of_doubles(v, scale) < 2.0**62).otherwise(False))
    return x.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def _by_length(col: pa.Array):
    """Yields (rows, matrix of integers) of the vectors of each length of an Arrow list column."""
    offs = np.asarray(col.offsets).astype(np.int64)
    flat, n = np.asarray(col.values), np.diff(offs)
    for size in np.unique(n).tolist():
        rows = np.flatnonzero(n == size)
        yield rows, flat[ragged(offs[rows], n[rows])].reshape(len(rows), size).astype(np.int64)


class Cells:
    """Pivots of each vector length with their cell numbers; a length without a pivot is one cell of its own, numbered below 0."""

    def __init__(self, pivots: list[list[int]], m2: float):
        self.m2, self.of = m2, {}
        for size in {len(v) for v in pivots}:
            at = [k for k, v in enumerate(pivots) if len(v) == size]
            self.of[size] = (np.array(at), self.raised(np.array([pivots[k] for k in at], np.int64)))

    def raised(self, ints: np.ndarray, query: bool = False) -> np.ndarray:
        x = ints.astype(np.float64)
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.m2 - (x**2).sum(1)))
        return np.column_stack([x, more])

    def distances(self, ints: np.ndarray, query: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(cells, distances of each vector to their centres)."""
        at, centres = self.of.get(ints.shape[1], (None, None))
        if at is None:
            return np.array([-ints.shape[1]]), np.zeros((len(ints), 1))
        x = self.raised(ints, query)
        return at, np.sqrt(np.maximum(0.0, ((x[:, None, :] - centres[None]) ** 2).sum(2))) if len(x) * centres.size < 1 << 22 else np.vstack([np.sqrt(((v - centres) ** 2).sum(1)) for v in x])


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", tree_rows: int = 16384, query_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k greatest integer inner products of each query over all other vectors."""
    spark = vectors.sparkSession
    x = as_integers(vectors, id_col, vec_col, scale).withColumn("q", F.coalesce(is_query, F.lit(False)))
    seen = x.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, b: a + b * b)).alias("m2")).first()
    m2 = float(seen["m2"] or 0)
    some = x.select("vec_id", "v").orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id", "v").limit(min(PIVOTS, -(-seen["n"] // CELL_ROWS))).collect()
    cells, margin = Cells([r["v"] for r in some], m2), 1e-7 * (np.sqrt(m2) + 1)

    def place(batches):
        for b in batches:
            cell, far = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for rows, ints in _by_length(b.column("v")):
                at, d = cells.distances(ints)
                near = d.argmin(1)
                cell[rows], far[rows] = at[near], d[np.arange(len(rows)), near]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), b.column("q"), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "v", "q", "cell", "far"])

    placed = materialize(x.mapInArrow(place, "vec_id long, v array<long>, q boolean, cell int, far double"), "vectors")
    stats = {r["cell"]: (r["n"], r["far"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}  # PIVOTS and lengths at most
    asked = placed.where("q").dropDuplicates(["vec_id", "v"]).select("vec_id", "v", "cell")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            by_length: dict[int, list] = {}
            for i, v in zip(left.column("vec_id").to_pylist(), left.column("v").to_pylist(), strict=True):
                by_length.setdefault(len(v), []).append((i, v))
            grown = {n: MTree(np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.int64), m2) for n, rows in by_length.items()}
            for i, v, least in zip(right.column("vec_id").to_pylist(), right.column("v").to_pylist(), right.column("least").to_pylist(), strict=True):
                if len(v) in grown:
                    out += [(i, j, s) for s, j in grown[len(v)].search(i, np.array(v, np.int64), k, least)]
        return pa.table({n: pa.array([r[c] for r in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    def searched(asks: DataFrame) -> DataFrame:
        """The best of each query (vec_id, v, cell, least) in the trees of a cell; trees meet queries in blocks of query_rows."""
        counts = {r["cell"]: r["n"] for r in asks.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        plan = [(c, -(-stats[c][0] // tree_rows), -(-n // query_rows)) for c, n in counts.items() if c in stats]
        plan = F.broadcast(spark.createDataFrame(plan, "cell int, trees int, blocks int"))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        dealt = lambda what, n: F.pmod(F.xxhash64(F.lit(what), "vec_id"), F.col(n)).cast("int")
        members = placed.join(plan, "cell").select("vec_id", "v", "cell", dealt("tree", "trees").alias("tree"), each("blocks").alias("block"))
        questions = asks.join(plan, "cell").select(*[F.col(c).alias(c) for c in ("vec_id", "v", "least", "cell")], dealt("block", "blocks").alias("block"), each("trees").alias("tree"))
        return members.groupBy("cell", "tree", "block").cogroup(questions.groupBy("cell", "tree", "block")).applyInArrow(search, "query_id long, vec_id long, score long")

    first = materialize(searched(asked.withColumn("least", F.lit(None).cast("long"))), "near")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    kth = first.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))

    def others(batches):
        """The further cells that hold vectors within the distance of a query's k-th best."""
        for b in batches:
            least, own = b.column("least").to_pylist(), np.asarray(b.column("cell"))
            rows_out, cells_out = [], []
            for rows, ints in _by_length(b.column("v")):
                at, d = cells.distances(ints, True)
                reach = np.array([stats.get(c, (0, -np.inf))[1] for c in at.tolist()])
                q2 = (ints.astype(np.float64) ** 2).sum(1)
                bound = np.array([np.inf if least[r] is None else np.sqrt(max(0.0, q2[n] + m2 - 2.0 * least[r])) for n, r in enumerate(rows.tolist())])
                r, c = np.nonzero((d - reach[None] <= bound[:, None] + margin) & (at[None] != own[rows][:, None]) & (reach[None] > -np.inf))
                rows_out.append(rows[r])
                cells_out.append(at[c])
            take = np.concatenate(rows_out) if rows_out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(take)) for c in ("vec_id", "v", "least")] + [pa.array(np.concatenate(cells_out) if cells_out else take, pa.int32())], ["vec_id", "v", "least", "cell"])

    more = asked.join(kth, "vec_id", "left").mapInArrow(others, "vec_id long, v array<long>, least long, cell int")
    found = first.unionByName(searched(materialize(more, "further")))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
