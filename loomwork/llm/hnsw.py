"""A navigable small-world graph over unit vectors in flat numpy arrays, built and searched for many
queries at a time.

Layout: ``vectors`` (n, d) float32; ``near`` (n, 2m) int32, the neighbours of each node on level 0,
-1 where unused; the upper levels are smaller graphs of the same kind over a prefix of the nodes
(nodes are in random order, so the first n/m^l of them are a random sample, and no id table is
needed). A search starts at the top level with every node of it, and goes down by beam search.

Building inserts blocks of nodes: each searches the graph made so far, is compared with its own
block exactly, keeps m neighbours chosen for different directions, and is entered into the lists of
these; where such a list is full, the weakest reverse entry goes, but links from nodes whose first
or second choice this was go last, so that outlying nodes stay reachable.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_NONE = np.float32(-2.0)


@dataclass
class Graph:
    vectors: np.ndarray
    near: np.ndarray
    above: Graph | None = None
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))


def _merge(ids, sims, done, new_ids, new_sims, ef):
    """Best ``ef`` of beam and newcomers; newcomers that are in the beam or repeated are dropped."""
    b, r = new_ids.shape
    order = np.argsort(new_ids, axis=1, kind="stable")
    sorted_ids = np.take_along_axis(new_ids, order, 1)
    again = np.zeros((b, r), bool)
    again[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
    drop = np.empty((b, r), bool)
    np.put_along_axis(drop, order, again, 1)
    new_sims[drop | (new_ids < 0)] = _NONE
    worst = sims.min(axis=1)
    new_sims[new_sims <= worst[:, None]] = _NONE
    width = int((new_sims > _NONE).sum(axis=1).max(initial=0))
    if not width:
        return ids, sims, done
    if width < r:
        part = np.argpartition(-new_sims, width - 1, axis=1)[:, :width]
        new_ids, new_sims = np.take_along_axis(new_ids, part, 1), np.take_along_axis(new_sims, part, 1)
    # a newcomer that the beam holds already has exactly the similarity that is there
    held = (new_ids[:, :, None] == ids[:, None, :]).any(axis=2)
    new_sims[held] = _NONE
    all_ids = np.concatenate([ids, new_ids], 1)
    all_sims = np.concatenate([sims, new_sims], 1)
    all_done = np.concatenate([done, np.zeros(new_ids.shape, bool)], 1)
    part = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
    take = lambda a: np.take_along_axis(a, part, 1)
    return take(all_ids), take(all_sims), take(all_done)


def _beam(g: Graph, q: np.ndarray, ids: np.ndarray, sims: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Beam search from given nodes (b, s), up to ``wide`` expansions a round."""
    b = len(q)
    if ids.shape[1] < ef:
        more = ef - ids.shape[1]
        ids = np.concatenate([ids, np.full((b, more), -1, np.int32)], 1)
        sims = np.concatenate([sims, np.full((b, more), _NONE)], 1)
    elif ids.shape[1] > ef:
        part = np.argpartition(-sims, ef - 1, axis=1)[:, :ef]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    done = sims <= _NONE
    active = np.arange(b)
    while len(active):
        a_ids, a_sims, a_done = ids[active], sims[active], done[active]
        open_sims = np.where(a_done, _NONE, a_sims)
        k = min(wide, ef)
        pick = np.argpartition(-open_sims, k - 1, axis=1)[:, :k]
        chosen = np.take_along_axis(open_sims, pick, 1) > _NONE
        going = chosen.any(axis=1)
        if not going.all():
            active, pick, chosen = active[going], pick[going], chosen[going]
            a_ids, a_sims, a_done = a_ids[going], a_sims[going], a_done[going]
            if not len(active):
                break
        np.put_along_axis(a_done, pick, True, 1)
        nodes = np.where(chosen, np.take_along_axis(a_ids, pick, 1), -1)
        cand = g.near[np.maximum(nodes, 0)]
        cand[nodes < 0] = -1
        cand = cand.reshape(len(active), -1)
        got = np.einsum("bcd,bd->bc", g.vectors[np.maximum(cand, 0)], q[active], optimize=False)
        a_ids, a_sims, a_done = _merge(a_ids, a_sims, a_done, cand, got, ef)
        ids[active], sims[active], done[active] = a_ids, a_sims, a_done
    return ids, sims


def search(g: Graph, q: np.ndarray, k: int, ef: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(ids, similarities) of the k nearest of each row of ``q``, best first, -1 where there are none."""
    out_ids, out_sims = np.full((len(q), k), -1, np.int32), np.full((len(q), k), _NONE)
    for at in range(0, len(q), block):
        ids, sims = _found(g, q[at : at + block], max(ef, k))
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        out_ids[at : at + block, : ids.shape[1]] = np.where(sims > _NONE, ids, -1)
        out_sims[at : at + block, : ids.shape[1]] = sims
    return out_ids, out_sims


def _found(g: Graph, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    if g.above is None:  # the top level is small: compare with all of it
        sims = q @ g.vectors[: len(g.near)].T
        k = min(ef, sims.shape[1])
        ids = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int32)
        return ids, np.take_along_axis(sims, ids, 1)
    ids, sims = _found(g.above, q, 4)
    return _beam(g, q, ids, sims, ef)


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
    """Of candidates sorted by similarity, m that lie in different directions (nearer to the node
    than to any one taken before), filled up with the nearest of the rest. (b, c) -> mask (b, c)."""
    b, c = ids.shape
    v = vectors[np.maximum(ids, 0)]
    among = v @ v.transpose(0, 2, 1)
    taken = np.zeros((b, c), bool)
    closest = np.full((b, c), _NONE)
    count = np.zeros(b, np.int32)
    rows = np.arange(b)
    for j in range(c):
        ok = (ids[:, j] >= 0) & (closest[:, j] < sims[:, j]) & (count < m)
        taken[ok, j] = True
        count += ok
        r = rows[ok]
        closest[r] = np.maximum(closest[r], among[r, j])
    rest = (ids >= 0) & ~taken
    rank = np.cumsum(rest, axis=1)
    taken |= rest & (rank <= (m - count)[:, None])
    return taken


def _level(vectors: np.ndarray, n: int, m: int, ef: int, above: Graph | None, block: int) -> Graph:
    width = 2 * m
    near = np.full((n, width), -1, np.int32)
    keep = np.full((n, width), np.float32(-9), np.float32)  # worth of each entry; forward ones stay
    g = Graph(vectors, near, above)
    done = 0
    while done < n:
        # blocks grow with the graph; the first ones are compared exactly only
        size = min(block, max(256, done // 2), n - done)
        ids = np.arange(done, done + size, dtype=np.int32)
        q = vectors[done : done + size]
        own = q @ q.T
        own[np.arange(size), np.arange(size)] = _NONE
        k = min(m, size - 1)
        cand_ids, cand_sims = np.zeros((size, 0), np.int32), np.zeros((size, 0), np.float32)
        if k > 0:
            part = np.argpartition(-own, k - 1, axis=1)[:, :k]
            cand_ids, cand_sims = part.astype(np.int32) + done, np.take_along_axis(own, part, 1)
        if done:
            if done <= 2048:
                sims = q @ vectors[:done].T
                k = min(ef, done)
                part = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int32)
                f_ids, f_sims = part, np.take_along_axis(sims, part, 1)
            else:
                # entry points of the level above that are in this level's graph already
                start, s = _found(above, q, 4)
                bad = start >= done
                start = np.where(bad, 0, start)
                s = np.where(bad, (q @ vectors[0])[:, None], s).astype(np.float32)
                dup = np.zeros_like(bad)
                dup[:, 1:] = np.sort(start, 1)[:, 1:] == np.sort(start, 1)[:, :-1]
                o = np.argsort(start, 1, kind="stable")
                start, s = np.take_along_axis(start, o, 1), np.take_along_axis(s, o, 1)
                s[dup], start[dup] = _NONE, -1
                f_ids, f_sims = [], []
                for at in range(0, size, 512):
                    i, x = _beam(Graph(vectors, near), q[at : at + 512], start[at : at + 512].astype(np.int32), s[at : at + 512], ef)
                    f_ids.append(i)
                    f_sims.append(x)
                f_ids, f_sims = np.concatenate(f_ids), np.concatenate(f_sims)
            cand_ids, cand_sims = np.concatenate([cand_ids, f_ids], 1), np.concatenate([cand_sims, f_sims], 1)
        cand_ids = np.where(cand_sims > _NONE, cand_ids, -1)
        width_c = min(cand_ids.shape[1], 3 * m)
        order = np.argsort(-cand_sims, axis=1, kind="stable")[:, :width_c]
        cand_ids, cand_sims = np.take_along_axis(cand_ids, order, 1), np.take_along_axis(cand_sims, order, 1)
        if width_c:
            taken = np.concatenate([_diverse(vectors, cand_ids[a : a + 256], cand_sims[a : a + 256], m) for a in range(0, size, 256)])
            rank = np.cumsum(taken, axis=1) - 1
            r, c = np.nonzero(taken)
            near[ids[r], rank[r, c]] = cand_ids[r, c]
            keep[ids[r], rank[r, c]] = 9 + cand_sims[r, c]
            _enter(near, keep, cand_ids[r, c], ids[r], cand_sims[r, c] + np.where(rank[r, c] == 0, 2, np.where(rank[r, c] == 1, 1, 0)), m)
        done += size
    return g


def _enter(near, keep, at, node, worth, m) -> None:
    """Reverse entries: node into the list of ``at``, places m and up (and unused forward places)."""
    order = np.lexsort((-worth, at))
    at, node, worth = at[order], node[order], worth[order].astype(np.float32)
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    for p in range(min(int(place.max(initial=-1)) + 1, near.shape[1])):  # one entry for each list at a time
        s = place == p
        a, v, w = at[s], node[s], worth[s]
        slot = np.argmin(keep[a], axis=1)
        better = keep[a, slot] < w
        better &= ~(near[a] == v[:, None]).any(axis=1)
        near[a[better], slot[better]] = v[better]
        keep[a[better], slot[better]] = w[better]


def build(vectors: np.ndarray, m: int = 12, ef: int = 48, block: int = 2048, top: int = 1024) -> Graph:
    """Graph over unit vectors, which must be in random order."""
    sizes = [len(vectors)]
    while sizes[-1] > top:
        sizes.append(max(top // 2, sizes[-1] // m))
    g = None
    for n in reversed(sizes):
        g = _level(vectors, n, m, ef, g, block) if g is not None or n > top else Graph(vectors, np.full((n, 2 * m), -1, np.int32), None)
    return g


def levels(g: Graph) -> list[np.ndarray]:
    out = []
    while g is not None:
        out.append(g.near)
        g = g.above
    return out


def assemble(vectors: np.ndarray, near: list[np.ndarray]) -> Graph:
    g = None
    for n in reversed(near):
        g = Graph(vectors, n, g)
    return g
