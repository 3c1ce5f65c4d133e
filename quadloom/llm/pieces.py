"""A SentencePiece vocabulary as numpy tables, and batched lattices over equal-length words.

Words of one length advance together: at each position the hashes of the substrings ending there probe the sorted
hashes of the pieces. Both the Viterbi encoder and the language scorer are built on these probes.
"""

from __future__ import annotations

import struct

import numpy as np

from quadloom.llm import text as X

BASE = X.U64(0xC2B2AE3D27D4EB4F)
MARK = "▁"
#: Characters of words that advance together at most.
CELLS = 1 << 19
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message; bytes for length-delimited ones."""
    at, n = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out, at
            shift += 7

    while at < n:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def load(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id of a SentencePiece model file."""
    out = []
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                own = dict(_fields(value))
                out.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
    return out


def matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)


def by_length(words: list[str], most: int = 1 << 14):
    """Indices of words of equal length, at most `most` at a time, fewer of long ones."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(n, kind="stable")
    cuts = np.flatnonzero(np.diff(n[order])) + 1
    for part in np.split(order, cuts):
        step = max(1, min(most, CELLS // (int(n[part[0]]) + 1))) if len(part) else 1
        for a in range(0, len(part), step):
            yield int(n[part[0]]), part[a : a + step]


class Table:
    """Pieces by substring hash."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.power = np.array([pow(int(BASE), i, 1 << 64) for i in range(self.longest + 1)], X.U64)
        keys = np.array([self._key(p) for p in pieces], X.U64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        # Most probes end in a direct-mapped table; only hashes whose slot holds several keys are searched for.
        slot = self._slot(keys)
        self.direct, self.own = np.full(1 << 20, -1, np.int32), keys
        self.direct[slot] = np.arange(len(keys))
        crowded = np.bincount(slot, minlength=1 << 20) > 1 if len(slot) else np.zeros(1 << 20, bool)
        self.direct[crowded] = -2

    @staticmethod
    def _key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & ((1 << 64) - 1)
        return h

    def prefixes(self, points: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of each row, by length along the first axis."""
        out = np.zeros((points.shape[1] + 1, len(points)), X.U64)
        for j in range(points.shape[1]):
            out[j + 1] = out[j] * BASE + (points[:, j].astype(X.U64) + X.U64(1))
        return out

    def probe(self, hashes: np.ndarray, start: int, end: int) -> np.ndarray:
        """For each row the number of the piece that is its substring start:end, or -1. hashes: of prefixes()."""
        return self.find(hashes[end] - hashes[start] * self.power[end - start])

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * X.U64(0x9E3779B97F4A7C15)) >> X.U64(44)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the piece of each hash, or -1."""
        out = self.direct[self._slot(h)]
        crowded = np.flatnonzero(out == -2)
        out = np.where(self.own[out] == h, out, -1)
        if len(crowded):
            at = np.searchsorted(self.keys, h[crowded])
            at[at == len(self.keys)] = 0
            out[crowded] = np.where(self.keys[at] == h[crowded], self.order[at], -1)
        return out
