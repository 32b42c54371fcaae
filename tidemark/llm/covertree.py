"""Exact top-k inner products: cover trees over blocks of queries and of data, searched together with bounds."""

from __future__ import annotations

import io
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import discard, materialize

_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


#: Queries are few, and a group that lies wide bounds nothing: their trees have smaller leaves.
_QUERY_TREE = {"leaf": 4, "least": 2}


@dataclass
class Counts:
    """Node pairs that a search met, how many of them its bounds cut off, and the products that it computed."""

    visited: int = 0
    pruned: int = 0
    products: int = 0


class CoverTree:
    """A cover tree of points, in arrays by node: centre (a point's number), radius, first, last (its points are
    order[first:last]), kids and kids_end (its children are the nodes between).

    A node of radius r is covered by balls of radius r / base around some of its own points, its centre first, and each
    centre lies outside all balls before it, so siblings' centres are at least r / base apart; a child's radius is
    that of the points it took. Nodes of at most `leaf` points or of radius 0 are leaves, and so are nodes whose balls
    would hold fewer than `least` points each on average: the search for balls ends as soon as that is certain. This is
    usual in many dimensions, where distances hardly differ; a leaf may then hold many points.
    """

    def __init__(self, points: np.ndarray, *, base: float = 1.3, leaf: int = 64, least: int = 4):
        self.points = points
        self.order = np.arange(len(points))
        centre, radius, first, last = [0], [0.0], [0], [len(points)]
        if len(points):
            radius[0] = float(np.sqrt(self._squares(points, points[0]).max()))
        kids, kids_end = [0], [0]
        node = 0
        while node < len(centre):
            a, b, r = first[node], last[node], radius[node]
            if b - a > leaf and r > 0:
                own = self.order[a:b]
                of, seats, far = self._balls(points[own], int(np.flatnonzero(own == centre[node])[0]), r / base, (b - a) // least)
                if seats is not None:
                    by = np.argsort(of, kind="stable")
                    ends = np.cumsum(np.bincount(of, minlength=len(seats)))
                    begins = np.concatenate([[0], ends[:-1]])
                    radius += np.sqrt(np.maximum.reduceat(far[by], begins)).tolist()
                    centre += own[seats].tolist()
                    self.order[a:b] = own[by]
                    first += (a + begins).tolist()
                    last += (a + ends).tolist()
                    kids[node], kids_end[node] = len(kids), len(kids) + len(seats)
                    kids += [0] * len(seats)
                    kids_end += [0] * len(seats)
            node += 1
        self.centre, self.first, self.last = np.array(centre), np.array(first), np.array(last)
        self.radius = np.array(radius) * (1 + 1e-12)
        self.kids, self.kids_end = np.array(kids), np.array(kids_end)

    @staticmethod
    def _squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
        d = np.subtract(points, centre, dtype=np.float64)
        return np.einsum("ij,ij->i", d, d)

    def _balls(self, p: np.ndarray, start: int, reach: float, most: int) -> tuple:
        """Each point's ball, the balls' centres and the squared distances to them; Nones if there were over `most` balls."""
        of, far = np.empty(len(p), np.int64), np.empty(len(p))
        rest, seats, at = np.arange(len(p)), [], start
        while len(rest):
            if len(seats) >= most:
                return None, None, None
            d = self._squares(p[rest], p[at])
            inside = (d <= reach * reach) | (rest == at)
            of[rest[inside]], far[rest[inside]] = len(seats), d[inside]
            seats.append(at)
            rest = rest[~inside]
            at = rest[0] if len(rest) else -1
        return of, np.array(seats), far

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.kids == self.kids_end)

    def least_of(self, x: np.ndarray) -> np.ndarray:
        """For each node, the smallest of its points' values; x by point."""
        own = np.append(x[self.order], np.inf)
        return np.minimum.reduceat(own, np.stack([self.first, self.last], axis=1).ravel())[::2]

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, order=self.order, centre=self.centre, radius=self.radius, first=self.first, last=self.last, kids=self.kids, kids_end=self.kids_end)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> CoverTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(raw)) as f:
            self.__dict__.update({k: f[k] for k in f.files})
        return self


def upper_bound(dot: np.ndarray, rq: np.ndarray, nq: np.ndarray, rp: np.ndarray, np_: np.ndarray) -> np.ndarray:
    """A bound on <q, p> for all q, p of two balls: centres' product, radii, centres' norms.

    Of the two that hold, the smaller: by Cauchy-Schwarz on the offsets from the centres, and by the distance of the
    balls, from 2 <q, p> = |q|^2 + |p|^2 - |q - p|^2 with norms up to the centres' norms plus the radii.
    """
    cauchy = dot + rq * np_ + rp * nq + rq * rp
    apart = np.sqrt(np.maximum(nq * nq + np_ * np_ - 2 * dot, 0)) - rq - rp
    by_distance = ((nq + rq) ** 2 + (np_ + rp) ** 2 - np.maximum(apart, 0) ** 2) / 2
    top = np.minimum(cauchy, by_distance)
    return top + 1e-9 * ((nq + rq) * (np_ + rp) + 1)


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors; beyond a long's range they are held to its limits."""
    if not q.size or not p.size:
        return np.zeros((len(q), len(p)), np.int64)
    most = float(np.abs(q).max()) * float(np.abs(p).max()) * q.shape[1]
    if most < 2**53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ p.astype(np.int64).T
    whole = q.astype(np.int64).astype(object) @ p.astype(np.int64).astype(object).T
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Best:
    """The k best scores and ids so far of each query; places not filled hold the lowest score and the highest id."""

    k: int
    ids: np.ndarray  # of the queries, by point
    score: np.ndarray
    vec: np.ndarray
    floor: np.ndarray  # what a score must reach, known from elsewhere
    counts: Counts = field(default_factory=Counts)

    @classmethod
    def of(cls, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
        floor = np.full(len(ids), _LOW) if floor is None else floor
        return cls(k, ids, np.full((len(ids), k), _LOW), np.full((len(ids), k), _HIGH), floor)

    def worst(self) -> np.ndarray:
        """What the next score of each query has to reach to count; the lowest long if anything does."""
        return np.maximum(self.score[:, -1], self.floor)

    def meet(self, own: np.ndarray, q: np.ndarray, p: np.ndarray, ids: np.ndarray) -> None:
        """Queries with the numbers `own` and vectors q meet points p with these ids."""
        s, k = _products(q, p), self.k
        self.counts.products += s.size
        other = ids[None, :] != self.ids[own, None]
        ok = other & (s >= self.worst()[own, None])
        if s.shape[1] > 4 * k and ok.any():
            ok &= s >= np.partition(np.where(other, s, _LOW), -k, axis=1)[:, -k, None]
        row, column = np.nonzero(ok)
        if not len(row):
            return
        rows = np.concatenate([np.repeat(np.arange(len(own)), k), row])
        score, vec = np.concatenate([self.score[own].ravel(), s[row, column]]), np.concatenate([self.vec[own].ravel(), ids[column]])
        order = np.lexsort((vec, ~score, rows))  # ~ turns the order round
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        self.score[own[rows[top]], place[top]], self.vec[own[rows[top]], place[top]] = score[order][top], vec[order][top]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, score, vec_id of all that was found."""
        there = (self.score != _LOW) | (self.vec != _HIGH)
        return np.repeat(self.ids, there.sum(axis=1)), self.score[there], self.vec[there]


def _spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range's numbers one after another, and the number of the range that each belongs to."""
    n = last - first
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of], of


def dual_tree_search(queries: CoverTree, data: CoverTree, data_ids: np.ndarray, best: Best, *, step: int = 2048) -> None:
    """Brings `best` up to date with the data tree's points.

    First each query leaf meets the data leaves whose centres have the highest products with its own, until they hold some
    points. Then pairs of a query
    node and a data node go down from the two roots: a pair whose bound (see upper_bound) is below the worst kth score
    among the query node's queries is cut off with all that lies under it; of others, the node of the larger radius
    gives way to its children. Pairs of leaves that are left are compared for each query leaf from the highest bound on,
    few points at first and up to about `step` at once later, and those that meanwhile fell below the worst kth score are cut off too.
    """
    if not len(queries.points) or not len(data.points):
        return
    qc, dc = queries.points[queries.centre].astype(float), data.points[data.centre].astype(float)
    qn, dn = np.sqrt((qc**2).sum(axis=1)), np.sqrt((dc**2).sum(axis=1))
    q_leaves, d_leaves, counts = queries.leaves(), data.leaves(), best.counts

    def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a))
        for k in range(0, len(a), 8192):
            i, j = a[k : k + 8192], b[k : k + 8192]
            out[k : k + 8192] = upper_bound(np.einsum("ij,ij->i", qc[i], dc[j]), queries.radius[i], qn[i], data.radius[j], dn[j])
        return out

    def compare(leaf: int, nodes: np.ndarray) -> None:
        own = queries.order[queries.first[leaf] : queries.last[leaf]]
        at = data.order[_spread(data.first[nodes], data.last[nodes])[0]]
        for k in range(0, len(at), 4 * step):
            part = at[k : k + 4 * step]
            for i in range(0, len(own), 512):
                best.meet(own[i : i + 512], queries.points[own[i : i + 512]], data.points[part], data_ids[part])

    seed, d_sizes = {}, (data.last - data.first)[d_leaves]
    for leaf in q_leaves.tolist():
        near = np.argsort(-(dc[d_leaves] @ qc[leaf]), kind="stable")
        enough = 1 + int(np.searchsorted(np.cumsum(d_sizes[near]), 4 * best.k))
        seed[leaf] = d_leaves[near[:enough]]
        compare(leaf, seed[leaf])
    worst = queries.least_of(best.worst())
    a, b, left_a, left_b, left_top = np.array([0]), np.array([0]), [], [], []
    while len(a):
        top = bound(a, b)
        counts.visited += len(a)
        keep = top >= worst[a]
        counts.pruned += int((~keep).sum())
        a, b, top = a[keep], b[keep], top[keep]
        q_end, d_end = queries.kids[a] == queries.kids_end[a], data.kids[b] == data.kids_end[b]
        both = q_end & d_end
        left_a.append(a[both]), left_b.append(b[both]), left_top.append(top[both])
        down_q = ~both & (d_end | (~q_end & (queries.radius[a] > data.radius[b])))
        down_d = ~both & ~down_q
        kq, of_q = _spread(queries.kids[a[down_q]], queries.kids_end[a[down_q]])
        kd, of_d = _spread(data.kids[b[down_d]], data.kids_end[b[down_d]])
        a, b = np.concatenate([kq, a[down_d][of_d]]), np.concatenate([b[down_q][of_q], kd])
    a, b, top = np.concatenate(left_a), np.concatenate(left_b), np.concatenate(left_top)
    by = np.lexsort((-top, a))
    a, b, top = a[by], b[by], top[by]
    for leaf, at, end in zip(*(x.tolist() for x in _groups(a)), strict=True):
        nodes, tops = b[at:end], top[at:end]
        other = ~np.isin(nodes, seed[leaf])
        nodes, tops = nodes[other], tops[other]
        own = queries.order[queries.first[leaf] : queries.last[leaf]]
        sizes = data.last[nodes] - data.first[nodes]
        k, some = 0, step // 8
        while k < len(nodes):
            alive = int(np.searchsorted(-tops, -float(best.worst()[own].min()), side="right"))  # bounds fall, so a prefix is alive
            if alive <= k:
                counts.pruned += len(nodes) - k
                break
            n = k + 1 + int(np.searchsorted(np.cumsum(sizes[k:alive])[:-1], some))
            compare(leaf, nodes[k:n])
            k, some = n, min(2 * some, step)


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of sorted x, and where each begins and ends."""
    value, first = np.unique(x, return_index=True)
    return value, first, np.append(first[1:], len(x))


def dual_tree_top_k(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, **tree) -> tuple[pd.DataFrame, Counts]:
    """query_id, score, vec_id: the k highest inner products of each query with the data of other ids, ties to the smaller id."""
    best = Best.of(np.asarray(query_ids), k)
    dual_tree_search(CoverTree(queries, **tree | _QUERY_TREE), CoverTree(data, **tree), np.asarray(data_ids), best)
    return pd.DataFrame(dict(zip(("query_id", "score", "vec_id"), best.rows(), strict=True))), best.counts


def _seats(points: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the points, each the one farthest from all before it."""
    chosen, far = [0], ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < most and far.max() > 0:
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return points[chosen]


_TREES = """dim int, block string, queries long, rows long, d_tree binary, d_ids array<long>, d_centre array<double>, d_radius double, q_tree binary,
q_ids array<long>, q_centre array<double>, q_radius double, floor array<long>, least double, query_id array<long>, score array<long>, vec_id array<long>"""


def _build(k: int):
    """A block's two trees, and what its queries find in its own data; `floor` is each query's kth score there."""

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["id", "h"], kind="stable")
        q, d = own[own["q"]], own[~own["q"]]
        points = [np.stack(f["x"]) if len(f) else np.empty((0, int(key[0])), np.int64) for f in (q, d)]
        trees = [CoverTree(points[0], **_QUERY_TREE), CoverTree(points[1])]
        best = Best.of(q["id"].to_numpy(), k)
        dual_tree_search(*trees, d["id"].to_numpy(), best)
        out = {"dim": key[0], "block": ".".join(map(str, key)), "queries": len(q), "rows": len(d)}
        for name, f, tree in zip("qd", (q, d), trees, strict=True):
            centre = tree.points[:1].astype(float).ravel()
            out |= {f"{name}_tree": tree.dump(), f"{name}_ids": f["id"].to_numpy(), f"{name}_centre": centre, f"{name}_radius": float(tree.radius[0])}
        floor = best.worst()
        query_id, score, vec_id = best.rows()
        out |= {"floor": floor, "least": float(floor.min(initial=_HIGH)), "query_id": query_id, "score": score, "vec_id": vec_id}
        return pd.DataFrame({c: [v] for c, v in out.items()})[[c.split()[0] for c in _TREES.replace(chr(10), " ").split(", ")]]

    return run


def _search(k: int):
    """What several blocks' queries find in the data of another block, where it reaches their floors."""

    def run(key: tuple, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": [], "score": [], "vec_id": []}).astype("int64")]
        if len(data):
            tree, ids = CoverTree.load(data["d_tree"].iloc[0]), data["d_ids"].iloc[0]
            for raw, own, floor in zip(queries["q_tree"], queries["q_ids"], queries["floor"], strict=True):
                best = Best.of(own, k, floor)
                dual_tree_search(CoverTree.load(raw), tree, ids, best)
                found.append(pd.DataFrame(dict(zip(("query_id", "score", "vec_id"), best.rows(), strict=True))))
        return pd.concat(found)

    return run


def _bound() -> Column:
    """The smaller of upper_bound's two for the roots of a query and a data tree, with more room for rounding."""
    total = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    dot, rq, rp = total("q_centre", "d_centre"), F.col("q_radius"), F.col("d_radius")
    nq, np_ = F.sqrt(total("q_centre", "q_centre")), F.sqrt(total("d_centre", "d_centre"))
    apart = F.greatest(F.sqrt(F.greatest(nq * nq + np_ * np_ - 2 * dot, F.lit(0.0))) - rq - rp, F.lit(0.0))
    reach_q, reach_p = nq + rq, np_ + rp
    top = F.least(dot + rq * np_ + rp * nq + rq * rp, (reach_q * reach_q + reach_p * reach_p - apart * apart) / 2)
    return top + 1e-7 * (reach_q * reach_p + 1)


def top_k(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    k: int = 5,
    scale: float = 256.0,
    block_values: int = 1 << 20,
    layout_rows: int = 2048,
    most_cells: int = 1024,
    group_queries: int = 16_384,
) -> DataFrame:
    """The k highest integer inner products of each query row with all rows of other ids: query_id, rank, vec_id, score.

    queries: condition on the rows of vectors that are queries. Components count as floor(scale * x). Ties go to the
    smaller id.

    Of equal vectors only the k + 1 smallest ids can be in a result, so no more are searched. Rows go to the cell of the
    nearest of at most most_cells centres (a net of layout_rows rows, drawn by a hash; it decides where rows lie, never
    what is compared), cells to blocks of about block_values numbers by a hash. One task builds a block's cover tree of
    data and that of its queries, writes both, and searches the one with the other. Then the trees of other blocks meet
    (up to about group_queries queries in one task) unless the blocks' bound is below the worst kth score of the query
    block. The k best of each query in each block meet in a ranking by query.

    Vectors that are null, empty, or hold null or non-finite components take no part, and so do null ids and vectors of
    another length than the query's. Rows that repeat an id are candidates of their own, except for the queries
    of that id; queries that repeat an id share one list, in which a candidate stands once for each of their different
    vectors that brings it there. Fewer than k candidates are all returned. Components and scores beyond the range of a long
    are held to its limits. Other columns are ignored. An empty table gives an empty result.
    """
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), queries.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite)
    rows = rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("x"), F.coalesce("q", F.lit(False)).alias("q"))
    rows = rows.groupBy("id", "x").agg(F.max("q").alias("q"), F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("x").orderBy("id"))).where(F.col("place") <= k + 1)
    candidates = first.select("id", "x", F.lit(False).alias("q"), F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")
    rows = candidates.union(rows.where("q").select("id", "x", "q"))  # a query is a row beside its candidate
    rows = materialize(rows.withColumns({"dim": F.size("x"), "h": F.xxhash64("x")}), "vectors")

    net = rows.select("x", "dim", "h").orderBy("h").limit(layout_rows).toPandas()  # bounded by layout_rows
    n, seats = rows.count(), {}
    for dim, own in net.groupby("dim"):
        cells = -(-len(own) * n * int(dim) // (len(net) * block_values))
        seats[int(dim)] = _seats(np.stack(own["x"]).astype(float), max(1, min(most_cells, int(cells))))
    shared = rows.sparkSession.sparkContext.broadcast(seats)  # most_cells vectors at most for each length in the net

    def place(batches):
        for batch in batches:
            cell = np.zeros(len(batch), np.int64)
            for dim, at in batch.groupby("dim").indices.items():
                s = shared.value.get(int(dim), np.zeros((1, 1)))
                if len(s) > 1:
                    p = np.stack(batch["x"].to_numpy()[at]).astype(float)
                    cell[at] = np.argmax(p @ s.T - (s**2).sum(axis=1) / 2, axis=1)
            yield batch.assign(cell=cell)

    whole, rows = rows, materialize(rows.mapInPandas(place, "id long, x array<long>, q boolean, dim int, h long, cell long"), "cells")
    discard(whole)
    parts = rows.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) * F.first("dim") / block_values).alias("parts"))
    placed, rows = rows, rows.join(parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts"))
    trees = rows.select("dim", "cell", "part", "id", "x", "q", "h").groupBy("dim", "cell", "part").applyInPandas(_build(k), _TREES)
    trees = materialize(trees, "cover-trees")
    discard(placed)
    home = trees.select(F.explode(F.arrays_zip("query_id", "score", "vec_id")).alias("r")).select("r.query_id", "r.score", "r.vec_id")

    asked = trees.where("queries > 0").select("dim", F.col("block").alias("q_block"), "q_centre", "q_radius", "least", "queries")
    given = trees.where("rows > 0").select("dim", "block", "d_centre", "d_radius")
    met = asked.join(given, "dim").where(F.col("q_block") != F.col("block")).where(_bound() >= F.col("least"))  # a row for each block
    groups = max(1, -(-(trees.agg(F.sum("queries")).first()[0] or 0) // group_queries))
    met = materialize(met.select("block", "q_block", F.pmod(F.xxhash64("q_block"), F.lit(groups)).alias("group")), "block-pairs")
    data = trees.select(F.col("block").alias("at"), "d_tree", "d_ids").join(met.select(F.col("block").alias("at"), F.col("group").alias("of")).distinct(), "at")
    asking = trees.select(F.col("block").alias("q_block"), "q_tree", "q_ids", "floor").join(met, "q_block").select("block", "group", "q_tree", "q_ids", "floor")
    away = data.groupBy("at", "of").cogroup(asking.groupBy("block", "group")).applyInPandas(_search(k), "query_id long, score long, vec_id long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = home.unionByName(away).withColumn("rank", F.row_number().over(best))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
