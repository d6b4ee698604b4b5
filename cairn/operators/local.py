"""Iterative graph algorithms in one task, for link tables of a checked size.

A loop of joins pays for scheduling in every round, which on a few hundred thousand links is all it pays for. Below
``cairn.local.links`` rows (LOCAL_LINKS) the loop therefore runs inside one task, over arrays; beyond it the joins run.
Both give the same rows: the tests run each with either.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame

from cairn.plans.runtime import conf_int

#: Links that one task may hold: at about 60 bytes each some 120 MB.
LOCAL_LINKS = 2_000_000


def fits(links: DataFrame) -> bool:
    """Whether a cut table of links is small enough for one task; its rows are counted from the files' footers."""
    return links.count() <= conf_int(links.sparkSession, "cairn.local.links", LOCAL_LINKS)


def one_task(df: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over all rows of a small table at once."""
    names = df.columns

    def whole(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held).select(names)).to_batches()

    return df.coalesce(1).mapInArrow(whole, schema)


class Nodes:
    """Strings numbered in their own order, so that the least number is the least string."""

    def __init__(self, *columns: pa.ChunkedArray):
        names = pa.chunked_array([c for col in columns for c in col.chunks]).drop_null().unique()
        self.names = names.take(pc.sort_indices(names))
        self.n = len(self.names)

    def of(self, column: pa.ChunkedArray) -> np.ndarray:
        """Numbers of a column, -1 for null."""
        return pc.fill_null(pc.index_in(column, self.names), -1).to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(at))


class Least:
    """Least value over the links into each node."""

    def __init__(self, src: np.ndarray, dst: np.ndarray):
        order = np.argsort(dst, kind="stable")
        self.src = src[order]
        self.at, self.starts = np.unique(dst[order], return_index=True)

    def lower(self, values: np.ndarray) -> np.ndarray:
        out = values.copy()
        if len(self.at):
            out[self.at] = np.minimum(out[self.at], np.minimum.reduceat(values[self.src], self.starts))
        return out

    def settle(self, values: np.ndarray) -> np.ndarray:
        while True:
            new = self.lower(values)
            if (new == values).all():
                return new
            values = new


def reached(max_depth: int, ways: tuple[str, ...]) -> Callable[[pa.Table], pa.Table]:
    """(source_id, target_id) links, and seeds as rows without a target, to (direction, id, depth), a direction being
    downstream, upstream or either."""

    def run(t: pa.Table) -> pa.Table:
        nodes = Nodes(t["source_id"], t["target_id"])
        s, d = nodes.of(t["source_id"]), nodes.of(t["target_id"])
        seeds, links = s[(d < 0) & (s >= 0)], (s >= 0) & (d >= 0)
        s, d = s[links], d[links]
        parts = []
        for way in ways:
            a, b = {"downstream": (s, d), "upstream": (d, s), "either": (np.r_[s, d], np.r_[d, s])}[way]
            depth = np.full(nodes.n, -1)
            depth[seeds] = 0
            for k in range(max_depth):
                to = b[depth[a] == k]
                to = to[depth[to] < 0]
                if not len(to):
                    break
                depth[to] = k + 1
            at = np.flatnonzero(depth >= 0)
            parts.append(pa.table({"direction": pa.array([way] * len(at), pa.string()), "id": nodes.take(at), "depth": pa.array(depth[at], pa.int32())}))
        return pa.concat_tables(parts)

    return run


def components(t: pa.Table) -> pa.Table:
    """(source_id, target_id) with lone nodes as rows without a target, to (id, component)."""
    nodes = Nodes(t["source_id"], t["target_id"])
    s, d = nodes.of(t["source_id"]), nodes.of(t["target_id"])
    ok = (s >= 0) & (d >= 0)
    near, lab = Least(np.r_[s[ok], d[ok]], np.r_[d[ok], s[ok]]), np.arange(nodes.n)
    while True:
        new = near.lower(lab)
        new = np.minimum(new, new[new])
        if (new == lab).all():
            break
        lab = new
    own = np.unique(s[d < 0])
    return pa.table({"id": nodes.take(own), "component": nodes.take(lab[own])})


def strong_components(t: pa.Table) -> pa.Table:
    """(a, b) without loops to (id, component) of components of two nodes and more; the rounds of quality.strong_components."""
    nodes = Nodes(t["a"], t["b"])
    a, b = nodes.of(t["a"]), nodes.of(t["b"])
    out, rng = np.full(nodes.n, -1), np.random.default_rng(7)
    while len(a):
        rank = rng.permutation(nodes.n)
        f, g = Least(a, b).settle(rank), Least(b, a).settle(rank)
        ends = np.unique(np.r_[a, b])
        whole = ends[f[ends] == g[ends]]
        least = np.full(nodes.n, nodes.n)
        np.minimum.at(least, f[whole], whole)
        size = np.bincount(f[whole], minlength=nodes.n)
        real = whole[size[f[whole]] > 1]
        out[real] = least[f[real]]
        keep = (f[a] == f[b]) & (g[a] == g[b]) & (f[a] != g[a])
        a, b = a[keep], b[keep]
    at = np.flatnonzero(out >= 0)
    return pa.table({"id": nodes.take(at), "component": nodes.take(out[at])})


def communities(rounds: int, resolution: float) -> Callable[[pa.Table], pa.Table]:
    """Links (a, b), each from both ends and once, to (id, community); the moves of quality.communities."""

    def run(t: pa.Table) -> pa.Table:
        nodes = Nodes(t["a"], t["b"])
        a, b, n = nodes.of(t["a"]), nodes.of(t["b"]), nodes.n
        m2, k, c, still = len(a), np.bincount(a, minlength=n).astype(float), np.arange(n), 0
        odd = np.array([xxhash.xxh64_intdigest(x.encode(), 42) & 1 for x in nodes.names.to_pylist()])
        for r in range(rounds):
            tot = np.bincount(c, weights=k, minlength=n)
            pair, w = np.unique(a * n + c[b], return_counts=True)
            i, to = pair // n, pair % n
            own = to == c[i]
            gain = w - resolution * k[i] * (tot[to] - np.where(own, k[i], 0.0)) / m2
            order = np.lexsort((to, -gain, i))
            first = order[np.unique(i[order], return_index=True)[1]]
            now = np.zeros(n)
            now[i[own]] = gain[own]
            move = np.zeros(n, bool)
            move[i[first]] = gain[first] > now[i[first]] + 1e-12
            move &= odd == r % 2
            goal = c.copy()
            goal[i[first]] = to[first]
            c = np.where(move, goal, c)
            still = 0 if move.any() else still + 1
            if still == 2:
                break
        at = np.flatnonzero(np.bincount(c, minlength=n)[c] > 1)
        return pa.table({"id": nodes.take(at), "community": nodes.take(c[at])})

    return run


def pagerank(iterations: int, damping: float) -> Callable[[pa.Table], pa.Table]:
    """(source_id, target_id, w), nodes as rows without a target, to (id, rank)."""

    def run(t: pa.Table) -> pa.Table:
        ends = pc.is_null(t["target_id"])
        nodes = Nodes(t.filter(ends)["source_id"])
        n = nodes.n
        links = t.filter(pc.invert(ends))
        s, d, w = nodes.of(links["source_id"]), nodes.of(links["target_id"]), links["w"].to_numpy()
        _, which = np.unique(pc.index_in(links["source_id"], links["source_id"].unique()).to_numpy(), return_inverse=True)
        p = w / np.bincount(which, weights=w)[which] if len(w) else w
        inside = (s >= 0) & (d >= 0)
        sends = np.zeros(n, bool)
        sends[s[s >= 0]] = True
        s, d, p = s[inside], d[inside], p[inside]
        rank = np.full(n, 1.0 / n)
        for _ in range(iterations):
            got = np.bincount(d, weights=rank[s] * p, minlength=n)
            rank = (1 - damping) / n + damping * (got + rank[~sends].sum() / n)
        return pa.table({"id": nodes.names, "rank": rank})

    return run
