"""Betweenness over compact arrays: what a worker does with a stream of neighbour lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 4_000_000  # edges looked at in one step; bounds the memory of a level


def adjacency(batches):
    """(ids, starts, ends, near, member, groups) of streamed (group, id, member, near) rows: places of all nodes by id, the places of each one's neighbours.

    Of several groups in one partition, each of which holds the whole graph, the first is read and all are named."""
    ids, member, lengths, near, groups, first = [], [], [], [], set(), None
    for batch in batches:
        group = batch.column("group").to_numpy(zero_copy_only=False)
        if not len(group):
            continue
        first = int(group[0]) if first is None else first
        groups.update(np.unique(group).tolist())
        batch = batch.filter(pa.array(group == first)) if (group != first).any() else batch
        ids.append(batch.column("id").to_numpy(zero_copy_only=False))
        member.append(batch.column("member").to_numpy(zero_copy_only=False))
        lists = batch.column("near")
        lengths.append(np.diff(lists.offsets.to_numpy()).astype(np.int64))
        near.append(lists.flatten().to_numpy(zero_copy_only=False))
    if first is None:
        return None
    at = np.concatenate(ids)
    order = np.argsort(at, kind="stable")
    at = at[order]
    for k, some in enumerate(near):  # in place: long ids go as their places come
        near[k] = np.searchsorted(at, some).astype(np.int32)
    size = np.concatenate(lengths)
    begin = np.cumsum(size) - size
    starts, ends = begin[order], (begin + size)[order]
    return at, starts, ends, np.concatenate(near), np.concatenate(member)[order], sorted(groups)


def _chunks(front: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """``front`` in parts of about CHUNK edges, each as (part, owner of each edge in the part, place of each edge)."""
    size = ends[front] - starts[front]
    cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // CHUNK)) + 1
    for part, n in zip(np.split(front, cuts), np.split(size, cuts)):
        owner = np.repeat(np.arange(len(part)), n)
        yield part, owner, np.repeat(starts[part] - (np.cumsum(n) - n), n) + np.arange(len(owner))


def _summed(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys below ``n`` and the sums of their values; by sorting where keys are few."""
    if len(keys) * 16 < n:
        some, back = np.unique(keys, return_inverse=True)
        return some, np.bincount(back, weights=values, minlength=len(some))
    sums = np.bincount(keys, weights=values, minlength=n)
    some = np.flatnonzero(np.bincount(keys, minlength=n))
    return some, sums[some]


def dependencies(sources: np.ndarray, starts: np.ndarray, ends: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Sums over ``sources`` of Brandes' dependencies of each node: level by level, forth and back. Parallel edges are paths of their own."""
    n = len(starts)
    total, paths, gain = np.zeros(n), np.zeros(n), np.zeros(n)
    depth = np.full(n, -1, dtype=np.int32)
    for source in sources:
        levels = [np.array([source])]
        depth[source], paths[source] = 0, 1.0
        while True:
            found, d = [], len(levels)
            for part, owner, edge in _chunks(levels[-1], starts, ends):
                to = near[edge]
                ahead = (depth[to] == -1) | (depth[to] == d)
                some, sums = _summed(to[ahead], paths[part][owner[ahead]], n)
                new = some[depth[some] == -1]
                depth[new] = d
                paths[some] += sums
                found.append(new)
            front = np.concatenate(found) if found else np.array([], dtype=np.int64)
            if not len(front):
                break
            levels.append(front)
        for d in range(len(levels) - 2, -1, -1):
            for part, owner, edge in _chunks(levels[d], starts, ends):
                to = near[edge]
                ahead = depth[to] == d + 1
                to = to[ahead]
                gain[part] = np.bincount(owner[ahead], weights=(1 + gain[to]) / paths[to], minlength=len(part)) * paths[part]
        for front in levels[1:]:
            total[front] += gain[front]
        for front in levels:
            depth[front], paths[front], gain[front] = -1, 0.0, 0.0
    return total
