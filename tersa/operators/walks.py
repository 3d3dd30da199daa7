"""Walks over a directed graph in one task: nodes are numbers from 0, node u leads to ``to[first[u]:first[u + 1]]``. Time and memory are linear in nodes and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def indexed(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, first, to: nodes and what each leads to in the order of their ids."""
    ids = np.unique(np.concatenate([src, dst]))
    u, v = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    order = np.lexsort((v, u))
    return ids, np.concatenate([[0], np.cumsum(np.bincount(u, minlength=len(ids)))]).astype(np.int64), v[order].astype(np.int64)


def numbers(n: int) -> memoryview:
    return memoryview(np.zeros(n, dtype=np.int64))


def strong(first: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A number for each node; nodes that reach each other share it (Tarjan's algorithm with its own stack)."""
    n, count = len(first) - 1, 0
    first, to, at = memoryview(first), memoryview(to), memoryview(first.copy())
    seen, low, label = numbers(n), numbers(n), numbers(n)
    open_, line = [], []
    for start in range(n):
        if seen[start]:
            continue
        line.append(start)
        while line:
            u = line[-1]
            if not seen[u]:
                count += 1
                seen[u] = low[u] = count
                open_.append(u)
            i, end = at[u], first[u + 1]
            while i < end:
                v = to[i]
                if not seen[v]:  # looked at again when its own walk is over
                    line.append(v)
                    break
                if not label[v] and low[v] < low[u]:
                    low[u] = low[v]
                i += 1
            at[u] = i
            if i == end:
                line.pop()
                while low[u] == seen[u] and not label[u]:
                    label[open_.pop()] = u + 1
    return np.asarray(label)


def inside(first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """first, to without the edges that lead from one strong component to another."""
    label, u = strong(first, to), np.repeat(np.arange(len(first) - 1), np.diff(first))
    kept = label[u] == label[to]
    return np.concatenate([[0], np.cumsum(np.bincount(u[kept], minlength=len(first) - 1))]).astype(np.int64), to[kept]


def closing(first: np.ndarray, to: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """line, depth of every edge that leads back to an open node: the nodes of the walk so far, and where in it the cycle begins. The line is the walk's own, to be read before the next."""
    first, to, at = memoryview(first), memoryview(to), memoryview(first.copy())
    n = len(first) - 1
    colour, depth = bytearray(n), numbers(n)  # 0: not met, 1: open, 2: done
    for start in range(n):
        if colour[start]:
            continue
        colour[start], depth[start], line = 1, 0, [start]
        while line:
            u = line[-1]
            i = at[u]
            if i == first[u + 1]:
                colour[line.pop()] = 2
                continue
            at[u] = i + 1
            v = to[i]
            if colour[v] == 1:
                yield line, depth[v]
            elif not colour[v]:
                colour[v], depth[v] = 1, len(line)
                line.append(v)
