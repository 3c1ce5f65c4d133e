"""Spans found in UTF-8 bytes and reported in code points; shared by the secret and personal-data scans."""

from __future__ import annotations

import hashlib

import numpy as np


def to_points(raw: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Byte offsets as code point offsets."""
    if not spans or raw.isascii():
        return spans
    lead = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80, out=lead[1:])
    return [(k, int(lead[a]), int(lead[b])) for k, a, b in spans]


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs, at least `least` long, of bytes with member[byte], inside one row: row, start and end in data."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = member[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    ok = ends - starts >= least
    starts, ends = starts[ok], ends[ok]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def members(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out
