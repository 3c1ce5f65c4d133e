"""Token ids of a public byte-level BPE vocabulary, by chunks that repeat.

A text falls apart before each single space that follows a visible character: no token crosses it but by
starting with it. Chunks recur, so ids are kept by chunk (a bounded table for each worker) and gathered with
numpy. Chunks that are empty or end in white space, and texts that hold a special token's string, are left
to the tokenizer itself, whole text by whole text. Ids equal those of tokenizers' encode_batch(add_special_tokens=False).
"""

from __future__ import annotations

import base64
from array import array
from itertools import repeat

import numpy as np

from quadloom.llm import text as X

MOST_CHUNKS = 300_000
SPECIAL = "<|endoftext|>"


class Encoder:
    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.own = None
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.length = array("I"), array("q"), array("q")

    def _add(self, chunk: str) -> int:
        """The number of a chunk that stands after a space; -1 if it can't be told apart from its surroundings."""
        if not chunk or chunk[-1].isspace():
            n = -1
        else:
            ids = self.bpe.encode_ordinary(" " + chunk)
            n = len(self.start)
            self.start.append(len(self.flat))
            self.length.append(len(ids))
            self.flat.extend(ids)
        self.index[chunk] = n
        return n

    def _whole(self, text: str) -> list[int]:
        if SPECIAL not in text:
            return self.bpe.encode_ordinary(text)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.json_path)
        return self.own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if len(self.index) > MOST_CHUNKS:
            self.clear()
        heads, chunks, ends, alone = [], [], [], {}
        for i, t in enumerate(texts):
            head, *rest = t.split(" ")
            if SPECIAL in t or head[-1:].isspace() or (not head and rest):
                alone[i] = None
                head, rest = "", []
            heads.append(head)
            chunks += rest
            ends.append(len(chunks))
        number = np.fromiter(map(self.index.get, chunks, repeat(-2)), np.int64, len(chunks))
        for i in np.flatnonzero(number == -2).tolist():
            n = self.index.get(chunks[i], -2)
            number[i] = self._add(chunks[i]) if n == -2 else n
        bad = np.zeros(len(chunks) + 1, np.int64)
        np.cumsum(number < 0, out=bad[1:])
        start, length = np.array(self.start, np.int64), np.array(self.length, np.int64)
        flat = np.frombuffer(self.flat, np.uint32).copy() if len(self.flat) else np.zeros(0, np.uint32)
        good = np.where(number < 0, 0, number)
        lengths = np.where(number < 0, 0, length[good]) if len(length) else np.zeros(len(chunks), np.int64)
        ids = flat[X.ragged(start[good] if len(start) else good, lengths)]
        stop = np.r_[0, np.cumsum(lengths)]
        out, a = [], 0
        for i, b in enumerate(ends):
            if i in alone or bad[b] > bad[a]:
                out.append(np.array(self._whole(texts[i]), np.uint32))
            else:
                body = ids[stop[a] : stop[b]]
                out.append(np.r_[np.array(self.bpe.encode_ordinary(heads[i]), np.uint32), body] if heads[i] else body)
            a = b
        return out


_HELD: dict[tuple, Encoder] = {}


def encoder(*paths: str | None) -> Encoder:
    """One encoder for each worker process."""
    if paths not in _HELD:
        _HELD[paths] = Encoder(*paths)
    return _HELD[paths]
