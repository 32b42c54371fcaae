"""Near-duplicate embeddings: navigable small-world graphs per shard, searched by every vector of the label."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize
from .graph import components
from .shingles import mix


class SmallWorld:
    """A hierarchical navigable small-world graph of unit vectors, built and searched in numpy batches.

    links[l] has for each vector its neighbours on level l (-1: none); a vector is on levels 0..levels[i], drawn by
    a hash with a chance of 1 / degree for each further level. Vectors come in order of falling level, in batches
    at most as large as what is there already, so each batch is one search of the graph so far.
    """

    def __init__(self, x: np.ndarray, degree: int = 16, beam: int = 48):
        self.x, self.degree, self.beam = np.ascontiguousarray(x, np.float32), degree, beam
        n = len(x)
        u = (mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(11)).astype(float) / 2**53
        levels = np.floor(-np.log(np.maximum(u, 1e-300)) / np.log(degree)).astype(int)
        order = np.argsort(-levels, kind="stable")
        top = int(levels.max()) if n else 0
        self.links = [np.full((n, degree * (2 if level == 0 else 1)), -1, np.int32) for level in range(top + 1)]
        self.entry = int(order[0]) if n else -1
        done = 0
        while done < n:
            batch = order[done : done + max(32, min(done, 512))]
            self._insert(batch, order[:done], levels)
            done += len(batch)

    def _insert(self, batch: np.ndarray, before: np.ndarray, levels: np.ndarray) -> None:
        at = np.full((len(batch), 1), self.entry)
        for level in range(len(self.links) - 1, -1, -1):
            rows = np.flatnonzero(levels[batch] >= level)
            old = len(before) and (levels[before] >= level).any()
            found = np.full((len(batch), 0), -1)
            if old:
                ids, _ = self._beam(self.x[batch], at, level, self.beam)
                at, found = ids[:, :4], ids
            if not len(rows):
                continue
            own = batch[rows]
            near = np.argsort(-(self.x[own] @ self.x[own].T), axis=1, kind="stable")[:, : self.beam + 1]
            near = own[near]
            near[near == own[:, None]] = -1
            wide = np.concatenate([found[rows], near], axis=1)
            chosen = self._choose(own, wide, self.links[level].shape[1] // 2 if level == 0 else self.degree)
            self.links[level][own, : chosen.shape[1]] = chosen
            self._link_back(own, chosen, level)

    def _choose(self, nodes: np.ndarray, wide: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates, the nearest that aren't nearer to one chosen before, then the nearest left."""
        out = np.full((len(nodes), most), -1, np.int32)
        for k in range(0, len(nodes), 256):
            v, c = nodes[k : k + 256], wide[k : k + 256]
            sims = np.einsum("qd,qcd->qc", self.x[v], self.x[c])
            sims[(c < 0) | (c == v[:, None])] = -9
            order = np.argsort(-sims, axis=1, kind="stable")
            c, sims = np.take_along_axis(c, order, 1), np.take_along_axis(sims, order, 1)
            again = np.zeros(c.shape, bool)
            for j in range(1, c.shape[1]):
                again[:, j] = (c[:, :j] == c[:, j : j + 1]).any(axis=1)
            sims[again] = -9
            among = np.einsum("qad,qbd->qab", self.x[c], self.x[c])
            taken = np.zeros(c.shape, bool)
            for j in range(c.shape[1]):
                blocked = (taken[:, :j] & (among[:, j, :j] > sims[:, j : j + 1])).any(axis=1)
                taken[:, j] = (sims[:, j] > -9) & ~blocked & (taken.sum(axis=1) < most)
            rank = np.where(taken, 0, np.where(sims > -9, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
            first = np.argsort(rank, axis=1)[:, :most]
            got = np.where(np.take_along_axis(sims, first, 1) > -9, np.take_along_axis(c, first, 1), -1)
            out[k : k + 256, : got.shape[1]] = got
        return out

    def _link_back(self, nodes: np.ndarray, chosen: np.ndarray, level: int) -> None:
        links = self.links[level]
        to, of = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        of, to = of[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        to, of = to[order], of[order]
        heads, start, count = np.unique(to, return_index=True, return_counts=True)
        for k in range(0, len(heads), 1024):
            h, s, n = heads[k : k + 1024], start[k : k + 1024], count[k : k + 1024]
            more = np.full((len(h), min(int(n.max()), 4 * links.shape[1])), -1)
            for j in range(more.shape[1]):
                ok = n > j
                more[ok, j] = of[s[ok] + j]
            wide = np.concatenate([links[h], more], axis=1)
            room = (wide >= 0).sum(axis=1) <= links.shape[1]
            packed = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)[:, : links.shape[1]]
            links[h[room]] = packed[room]
            if (~room).any():
                links[h[~room]] = self._choose(h[~room], wide[~room], links.shape[1])

    def _beam(self, q: np.ndarray, start: np.ndarray, level: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best vectors that a beam search from `start` meets for each query, and their products."""
        n, m = len(q), len(self.x)
        links, rows = self.links[level], np.arange(n)[:, None]
        seen = np.zeros((n, m + 1), bool)  # the last column stands for no neighbour
        ids = np.full((n, width), -1)
        sims = np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)

        def add(live: np.ndarray, new: np.ndarray) -> None:
            fresh = np.ones(new.shape, bool)
            order = np.argsort(new, axis=1, kind="stable")
            ordered = np.take_along_axis(new, order, 1)
            np.put_along_axis(fresh, order[:, 1:], ordered[:, 1:] != ordered[:, :-1], 1)
            fresh &= ~seen[live[:, None], new] & (new >= 0)
            seen[live[:, None], new] = True
            s = np.where(fresh, np.einsum("qd,qcd->qc", q[live], self.x[new]), -np.inf).astype(np.float32)
            all_ids, all_sims = np.concatenate([ids[live], new], 1), np.concatenate([sims[live], s], 1)
            all_open = np.concatenate([open_[live], fresh], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            open_[live] = np.take_along_axis(all_open, top, 1) & np.isfinite(sims[live])

        add(np.arange(n), start)
        live = np.arange(n)
        while len(live := live[open_[live].any(axis=1)]):
            pick = np.argsort(~open_[live], axis=1, kind="stable")[:, :4]  # the best open ones
            ok = np.take_along_axis(open_[live], pick, 1)
            nodes = np.where(ok, np.take_along_axis(ids[live], pick, 1), -1)
            open_[live[:, None], pick] = False
            add(live, np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1))
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def search(self, q: np.ndarray, width: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The `width` best vectors of each query, from the top level down."""
        out = []
        for k in range(0, len(q), block):
            part = np.asarray(q[k : k + block], np.float32)
            at = np.full((len(part), 1), self.entry)
            for level in range(len(self.links) - 1, 0, -1):
                at = self._beam(part, at, level, 4)[0]
            out.append(self._beam(part, at, 0, width))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, *self.links, entry=self.entry)
        return out.getvalue()

    @classmethod
    def load(cls, x: np.ndarray, raw: bytes) -> SmallWorld:
        self = cls.__new__(cls)
        self.x = np.ascontiguousarray(x, np.float32)
        with np.load(io.BytesIO(raw)) as f:
            self.links = [f[f"arr_{i}"] for i in range(len(f.files) - 1)]
            self.entry = int(f["entry"])
        return self


def _close(x: np.ndarray, q: np.ndarray, least: float) -> list[np.ndarray]:
    """For each query, the vectors with a cosine of at least `least`, by comparison with every vector."""
    return [np.flatnonzero(row) for k in range(0, len(q), 256) for row in q[k : k + 256] @ x.T >= least]


def _within(graph: SmallWorld, x: np.ndarray, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
    """What a search finds of each query's matches; the beam is doubled for queries whose beam is more than half matches.

    Queries that would need more than eight times the beam are in a dense group: they are compared with every vector.
    """
    found: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
    width, todo = min(beam, len(x)), np.arange(len(q))
    while len(todo):
        if width >= len(x) or width > 8 * beam:
            for i, row in zip(todo, _close(x, q[todo], least), strict=True):
                found[i] = row
            break
        ids, sims = graph.search(q[todo], width)
        full = (sims >= least).sum(axis=1) * 2 > width
        near = sims >= least - 1e-3  # single precision; confirmed below
        for i, row, ok in zip(todo, ids, near, strict=True):
            own = row[ok & (row >= 0)]
            found[i] = np.sort(own[x[own] @ q[i] >= least])
        todo, width = todo[full], min(2 * width, len(x))
    return found


def _spread(n: int, most: int) -> np.ndarray:
    """Up to `most` of the first n places, evenly spread."""
    return np.unique(np.linspace(0, n - 1, min(most, n)).astype(int))


def _passes(found: list[np.ndarray], truth: list[np.ndarray], recall: float) -> bool:
    got = sum(len(np.intersect1d(f, t, assume_unique=True)) for f, t in zip(found, truth, strict=True))
    return got >= recall * sum(map(len, truth))


def audited_beam(graph: SmallWorld, x: np.ndarray, least: float, *, beam: int = 48, recall: float = 0.999, audit: int = 1024) -> int:
    """The beam, doubled until a search finds `recall` of what up to `audit` queries match that surely match something.

    The queries are members of the index, evenly spread, each turned in a random direction to a cosine between `least` and 1.
    """
    own, rng = x[_spread(len(x), audit)], np.random.default_rng(len(x))
    off = rng.normal(size=own.shape)
    off -= (off * own).sum(axis=1, keepdims=True) * own
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
    cosine = np.clip(rng.uniform(least, 1, (len(own), 1)), -1, 1)
    q = cosine * own + np.sqrt(1 - cosine**2) * off
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    truth = _close(x, q, least)
    while beam < len(x) and not _passes(_within(graph, x, q, least, beam), truth, recall):
        beam *= 2
    return beam


def matches(graph: SmallWorld, x: np.ndarray, q: np.ndarray, least: float, *, beam: int = 48, recall: float = 0.999, audit: int = 64) -> list[np.ndarray]:
    """For each unit query, the indexed unit vectors with a cosine of at least `least`, confirmed in double precision.

    The beam (see audited_beam, which has evidence for any index) is doubled for the queries whose beam is more than half
    matches, and for all of them until an audit passes: up to `audit` queries, evenly spread, and as many of those
    that found something are compared with every vector, and the search must have found `recall` of what they
    match. A beam as wide as the index is a comparison with every vector.
    """
    checked, truth = np.empty(0, int), None
    while True:
        found = _within(graph, x, q, least, beam)
        if truth is None:
            linked = np.flatnonzero([len(f) > 0 for f in found])
            checked = np.union1d(_spread(len(q), audit), linked[_spread(len(linked), audit)] if len(linked) else checked)
            truth = _close(x, q[checked], least)
        if beam >= len(x) or _passes([found[i] for i in checked], truth, recall):
            return found
        beam *= 2


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node of the edges (a, b) to the smallest that it is connected to: labels hook to the smaller and jump."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while len(u):
        x, y = label[u], label[v]
        apart = x != y
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    *,
    cosine: float = 0.93,
    shard_rows: int = 8192,
    query_rows: int = 16_384,
    degree: int = 16,
    beam: int = 48,
) -> DataFrame:
    """Groups of vectors of one label with a cosine of at least `cosine`, in double precision.

    Returns one row per row of vectors: id_col, n_links (other rows linked directly), component_id (smallest id
    reachable by links), kept (id = component_id).

    Equal vectors of a label are one class with a count. Each label's classes are dealt by a hash to shards of about
    shard_rows, each shard gets one small-world graph and the beam that finds 0.999 of the matches of perturbed members (see
    audited_beam), and blocks of about query_rows of the label's classes search every shard (see matches: beams
    widen further until an audit of the block's queries passes). A task counts its queries' links and
    returns a spanning forest of them, so dense groups are never expanded into all their pairs; components are then
    joined over all tasks.

    Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing; so do
    vectors of different lengths with each other. Rows with a null id link with nothing, have a null
    component_id and are kept. Rows that repeat an id are one vertex, and each counts as a link. Other columns are
    ignored. Equal cosines need no order: every link counts. An empty table gives an empty result.
    """
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & finite
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, c: a + c * c))
    rows = rows.withColumn("x", F.when(usable, F.transform("x", lambda c: c / F.array_max(F.transform("x", F.abs)))))  # no overflow in squares
    rows = rows.withColumn("x", F.transform("x", lambda c: c / norm(F.col("x")))).withColumn("dim", F.size("x"))
    kind = dict(rows.dtypes)["label"]
    rows = materialize(rows.withColumn("h", F.xxhash64("x")), "vectors")
    group = ["label", "dim", "h", "x"]
    classes = rows.where("x is not null").groupBy(*group).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.ceil(F.col("n") / shard_rows).alias("shards"), F.ceil(F.col("n") / query_rows).alias("parts"))
    classes = classes.join(sizes, F.expr("label = l and dim = d")).drop("l", "d").withColumns({"shard": F.pmod("h", "shards"), "part": F.pmod(F.xxhash64("h"), "parts")})
    classes = materialize(classes, "classes")

    def build(key: tuple, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("rep", kind="stable")
        x = np.stack(data["x"])
        graph = SmallWorld(x, degree, beam)
        return pd.DataFrame({"label": key[0], "dim": key[1], "shard": key[2], "parts": data["parts"].iloc[:1], "rep": [data["rep"].to_numpy()], "weight": [data["weight"].to_numpy()], "flat": [x.ravel()], "graph": [graph.dump()], "beam": audited_beam(graph, x, cosine, beam=beam)})

    schema = f"label {kind}, dim int, shard long, parts long, rep array<long>, weight array<long>, flat array<double>, graph binary, beam int"
    graphs = built = materialize(classes.select("label", "dim", "shard", "parts", "rep", "weight", "x").groupBy("label", "dim", "shard").applyInPandas(build, schema), "graphs")
    graphs = graphs.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    asked = classes.select("label", "dim", "part", "rep", "x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))

    def search(key: tuple, graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")]
        if len(graph) and len(queries):
            g = graph.iloc[0]
            x, rep, weight = g["flat"].reshape(len(g["rep"]), -1), g["rep"], g["weight"]
            own = queries["rep"].to_numpy()
            found = matches(SmallWorld.load(x, g["graph"]), x, np.stack(queries["x"]), cosine, beam=int(g["beam"]))
            a = np.repeat(own, [len(f) for f in found])
            b = np.concatenate(found)
            keep = rep[b] != a
            u, v = _forest(a[keep], rep[b][keep])
            out.append(pd.DataFrame({"u": own, "v": own, "n": [int(weight[f[rep[f] != o]].sum()) for f, o in zip(found, own, strict=True)]}))
            out.append(pd.DataFrame({"u": u, "v": v, "n": 0}))
        return pd.concat(out)

    keys = ("label", "dim", "shard", "part")
    found = graphs.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(search, "u long, v long, n long")
    found = materialize(found, "vector-links")
    discard(built)
    counts = found.where("u = v").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    members = rows.where("x is not null").join(classes.select(*group, "rep", "weight"), group).select("id", "rep", "h", "label", "weight")
    placed = components(found.where("u <> v").select("u", "v").union(members.where("id <> rep").select("id", "rep").distinct()), "vectors")
    linked = members.dropDuplicates(["id", "h", "label"]).join(counts, "rep").select(F.col("id").alias("i"), F.col("h").alias("k"), F.col("label").alias("l"), (F.col("n") + F.col("weight") - 1).alias("n"))
    out = rows.join(linked, F.expr("id = i and h = k and label = l and x is not null"), "left").join(placed, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
