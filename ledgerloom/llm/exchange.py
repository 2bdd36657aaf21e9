"""Postings dealt by key as packed arrays: a group of texts ships each distinct key once, so no key fills a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A group of texts ends at either count.
GROUP_TEXTS, GROUP_KEYS = 1 << 14, 1 << 19


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of the key space, in order."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def deal(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """(part, slice) of sorted keys."""
    p = part_of(keys, parts)
    edges = np.flatnonzero(np.diff(p)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(p)], strict=True):
        if b > a:
            yield int(p[a]), slice(a, b)


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1])


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[new], b[new]


def stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges (node, least node of a key it has) over keys that two nodes or more have: linear in the postings."""
    order = np.argsort(keys, kind="stable")
    keys, nodes = keys[order], nodes[order]
    at = runs(keys)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(nodes, at), np.diff(np.concatenate([at, [len(keys)]])))
    other = nodes != least
    return distinct_pairs(nodes[other], least[other])
