"""Hashes of a Merkle tree, vertex by vertex: plain functions on bytes, which workers import and nothing else."""

from __future__ import annotations

import hashlib

#: What goes to a vertex: a child's digest, or its own path.
UP, DOWN = 0, 1


def parent_of(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right else "")).encode()).digest()


def levels_of(nodes: list[bytes], total: int, levels: int) -> list[list[bytes]]:
    """A vertex's nodes level by level. total: of its whole level; a tree ends where one node remains."""
    out = [nodes]
    for _ in range(levels if total > 1 << levels else (total - 1).bit_length()):
        row = out[-1]
        out.append([parent_of(row[k], row[k + 1] if k + 1 < len(row) else None) for k in range(0, len(row), 2)])
    return out


def siblings(rows: list[list[bytes]], k: int) -> tuple[str, bytes]:
    """From a vertex's k-th node to its root: at each level on which side the other child is (L, R, or - for none), and
    the others' digests."""
    sides, others = [], []
    for row in rows[:-1]:
        other = k ^ 1
        sides.append("-" if other >= len(row) else "L" if other < k else "R")
        others += row[other : other + 1]
        k >>= 1
    return "".join(sides), b"".join(others)


def folded(leaf: bytes, sides: str, others: bytes) -> bytes:
    """The root that a leaf and its path give."""
    at = 0
    for side in sides:
        other, at = (None, at) if side == "-" else (others[at : at + 32], at + 32)
        leaf = parent_of(other, leaf) if side == "L" else parent_of(leaf, other)
    return leaf


def dealt(key: tuple[int, int]) -> int:
    return hash(key)  # of integers, hence the same in every process


def nodes_of(held, bottom: bool) -> tuple[int, list[bytes]]:
    """The nodes of a vertex's whole level, and its own in order, of what it was sent."""
    if bottom:
        _, _, total, rows = next(x for x in held if x[0] == UP)
        return total, [leaf for _, leaf, _ in rows]
    sent = sorted((x[1:] for x in held if x[0] == UP), key=lambda x: x[0])
    return sent[0][1], [digest for _, _, digest in sent]
