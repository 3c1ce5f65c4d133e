"""SentencePiece encoding and decoding by batched numpy Viterbi.

The public model file is of the pair-merging kind, so the best path is the one its merges make. A segmentation is that
path exactly if each piece comes out of its own text whole and no merge would cross the border of two neighbours (if
the pieces were the whole text). So the lattice's last piece at each position is decided by the last piece at the
piece's start alone: an edge scores 0 where the two fit and minus infinity where they don't, one edge into each position
fits, and the vectorised maximum over the starts stores it as the backpointer; words that have reached 0, the bound of
all paths, are left out of the further starts. Whether two pieces fit is worked out from
the right and left spines of their merge trees, vectorised too, and kept in a direct-mapped table of fixed size.
The ids are those of the sentencepiece library.

Texts are cut where a space follows a visible character (pieces hold the space mark only in front); the chunks of a slice
that the worker has not met are encoded together, equal lengths at a time: substring hashes probe the sorted piece keys.
Chunks recur, so their ids are kept in a bounded table. Characters outside the table fall back to byte pieces.

Defined cases: null and empty texts have no pieces; very long chunks are encoded one by one with the same recursion;
decode(encode(t)) is t for every text without the mark U+2581 itself (decoded as a space); repeated rows are encoded each;
other columns are ignored; empty tables give empty tables.
"""

from __future__ import annotations

import re
import zlib
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm import pieces as P
from quadloom.llm import text as X

MOST_CHUNKS, MOST_CHARACTERS, LONG = 500_000, 20_000_000, 256
SLOTS = 1 << 21
#: Bytes of text that are encoded together: the new chunks of one length in them advance as one.
TOGETHER = 8_000_000
NEVER = 1 << 40
_PARTS = re.compile(f"{P.MARK}*[^{P.MARK}]+|{P.MARK}+")


class Merges:
    """The merge trees of all pieces, and which pieces fit side by side. Made once and sent to the workers."""

    def __init__(self, path: str | None = None):
        import public_tokenizers

        self.all = P.load(path or public_tokenizers.path("piece_bpe_32k.model"))
        kept = [(i, p, s) for i, (p, s, k) in enumerate(self.all) if k in (P.NORMAL, P.USER)]
        self.ids = np.array([i for i, _, _ in kept], np.int64)
        self.rank = np.array([-round(s) for _, _, s in kept], np.int64)
        self.number = {p: i for i, (_, p, _) in enumerate(kept)}
        children = [self._tree(p) for _, p, _ in kept]
        self.whole = np.array([c is not None for c in children])
        order = sorted(range(len(kept)), key=lambda i: len(kept[i][1]))
        born, left, right = np.zeros(len(kept), np.int64), [[i] for i in range(len(kept))], [[i] for i in range(len(kept))]
        for i in order:
            if children[i]:
                l, r = children[i]
                born[i] = max(born[l], born[r], self.rank[i])
                left[i], right[i] = [i, *left[l]], [i, *right[r]]
        deep = max(map(len, left + right))
        self.born = born
        self.left = np.array([x + [-1] * (deep - len(x)) for x in left], np.int32)
        self.right = np.array([x + [-1] * (deep - len(x)) for x in right], np.int32)

    def _tree(self, piece: str) -> tuple | None:
        """The last merge of a piece's own text; () for one character, None if it does not come out whole."""
        if len(piece) == 1:
            return ()
        now, last, rank = [self.number.get(c, -1) for c in piece], None, self.rank
        texts = list(piece)
        while len(texts) > 1:
            found = [(rank[k], i) for i in range(len(texts) - 1) if (k := self.number.get(texts[i] + texts[i + 1], -1)) >= 0]
            if not found:
                return None
            _, i = min(found)
            last = (now[i], now[i + 1])
            texts[i : i + 2] = [texts[i] + texts[i + 1]]
            now[i : i + 2] = [self.number[texts[i]]]
        return last


class Codec:
    def __init__(self, merges: Merges):
        self.all, self.ids, self.number, self.merges = merges.all, merges.ids, merges.number, merges
        names = [self.all[i][0] for i in self.ids.tolist()]
        self.table = P.Table(names)
        self.hash = np.array([P.Table._key(n) for n in names], X.U64)
        self.size = np.array([len(n) for n in names], np.int64)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.all) if k == P.BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(self.all) if k == P.UNKNOWN)
        self.slot_key, self.slot_fits = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        self.clear()

    def _crossed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether some merge would cross the border of the pieces a and b."""
        m, out = self.merges, np.zeros(len(a), bool)
        deep = m.left.shape[1]
        for i in range(deep):
            x = m.right[a, i]
            if (x < 0).all():
                break
            for j in range(deep):
                live = np.flatnonzero((x >= 0) & ~out)
                y = m.left[b[live], j]
                live, y = live[y >= 0], y[y >= 0]
                if not len(live):
                    break
                z = self._joined(x[live], y)
                hit = z >= 0
                live, y, z = live[hit], y[hit], z[hit]
                own = x[live]
                at, rank = np.maximum(np.maximum(m.born[own], m.born[y]), m.rank[z]), m.rank[z]
                if i:
                    up = m.right[a[live], i - 1]
                    before_x = (at < m.born[up]) | ((at == m.born[up]) & (rank < m.rank[up]))
                else:
                    before_x = np.ones(len(live), bool)
                if j:
                    up = m.left[b[live], j - 1]
                    before_y = (at < m.born[up]) | ((at == m.born[up]) & (rank <= m.rank[up]))
                else:
                    before_y = np.ones(len(live), bool)
                out[live] |= before_x & before_y
        return out

    def _joined(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The piece that is x and y together, or -1."""
        n = self.size[y]
        fits = self.size[x] + n <= self.table.longest
        h = self.hash[x] * self.table.power[np.minimum(n, self.table.longest)] + self.hash[y]
        return np.where(fits, self.table.find(h), -1)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the pieces a and b stay apart side by side."""
        key = a.astype(np.int64) * len(self.ids) + b
        slot = (X.mix(key.astype(X.U64)) & X.U64(SLOTS - 1)).astype(np.int64)
        miss = self.slot_key[slot] != key
        out = self.slot_fits[slot]
        if miss.any():
            fresh, back = np.unique(key[miss], return_inverse=True)
            found = ~self._crossed(fresh // len(self.ids), fresh % len(self.ids))
            at = (X.mix(fresh.astype(X.U64)) & X.U64(SLOTS - 1)).astype(np.int64)
            self.slot_key[at], self.slot_fits[at] = fresh, found
            keep = self.slot_key[at] == fresh  # of keys that share a slot one stays
            self.slot_fits[at[keep]] = found[keep]
            out[miss] = found[back]
        return out

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.length, self.characters = array("I"), array("q"), array("q"), 0

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers (-1 for a character outside the table) of words of one length, one after the other, and how many each has."""
        points = P.matrix(words)
        rows, n = points.shape
        hashes = self.table.prefixes(points)
        best, back, piece = np.full((n + 1, rows), -np.inf, np.float32), np.zeros((n + 1, rows), np.int32), np.full((n + 1, rows), -1, np.int32)
        best[0] = 0
        for end in range(1, n + 1):
            open_ = np.arange(rows)  # words below the bound 0 here, which no path exceeds
            for start in range(max(0, end - self.table.longest), end):
                k = self.table.find(hashes[end, open_] - hashes[start, open_] * self.table.power[end - start])
                hit = np.flatnonzero(k >= 0)
                hit = hit[self.merges.whole[k[hit]]]
                if not len(hit):
                    continue
                own, edge = open_[hit], np.zeros(len(hit), np.float32)
                known = np.flatnonzero(piece[start, own] >= 0)
                if len(known):
                    edge[known[~self.fits(piece[start, own[known]], k[hit[known]])]] = -np.inf
                score = np.maximum(best[end, own], best[start, own] + edge)
                won = score > best[end, own]
                best[end, own] = score
                back[end, own[won]], piece[end, own[won]] = start, k[hit[won]]
                open_ = open_[best[end, open_] < 0]
                if not len(open_):
                    break
            best[end, open_], back[end, open_] = best[end - 1, open_], end - 1  # a character outside the table
        out = np.full((rows, n), -2, np.int64)
        at = np.full(rows, n)
        own = np.arange(rows)
        for slot in range(n - 1, -1, -1):
            live = np.flatnonzero(at > 0)
            if not len(live):
                break
            out[live, slot] = piece[at[live], own[live]]
            at[live] = back[at[live], own[live]]
        some = out != -2
        return out[some], some.sum(1)

    def viterbi_one(self, word: str) -> list[int]:
        """The same recursion for one long word."""
        n, get, whole = len(word), self.number.get, self.merges.whole
        back, last = [0] * (n + 1), [-1] * (n + 1)
        memo: dict[tuple[int, int], bool] = {}
        for end in range(1, n + 1):
            back[end] = end - 1
            for start in range(max(0, end - self.table.longest), end):
                k = get(word[start:end], -1)
                if k < 0 or not whole[k]:
                    continue
                if start and last[start] >= 0:
                    pair = (last[start], k)
                    if pair not in memo:
                        memo[pair] = bool(self.fits(np.array([pair[0]]), np.array([pair[1]]))[0])
                    if not memo[pair]:
                        continue
                back[end], last[end] = start, k
                break
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _ids(self, word: str, numbers: list[int]) -> list[int]:
        if min(numbers) >= 0:
            return self.ids[numbers].tolist()
        out, at = [], 0
        for k in numbers:
            if k >= 0:
                out.append(int(self.ids[k]))
                at += len(self.all[out[-1]][0])
            else:
                out += [self.bytes.get(b, self.unknown) for b in word[at].encode("utf-8", "surrogatepass")]
                at += 1
        return out

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.start)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        self.start.frombytes((len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int64).tobytes())
        self.length.frombytes(sizes.astype(np.int64).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())
        self.characters += sum(map(len, words))

    def _learn(self, chunks: list[str]) -> None:
        for _, part in P.by_length([c if len(c) <= LONG else "" for c in chunks]):
            words = [chunks[i] for i in part.tolist()]
            if len(words[0]) > LONG:
                for w in words:
                    ids = self._ids(w, self.viterbi_one(w))
                    self._keep([w], np.array(ids), np.array([len(ids)]))
                continue
            flat, sizes = self.viterbi(words)
            owner = np.repeat(np.arange(len(words)), sizes)
            foreign = np.zeros(len(words), bool)  # with a character outside the table
            foreign[owner[flat < 0]] = True
            self._keep([w for w, f in zip(words, foreign.tolist(), strict=True) if not f], self.ids[flat[~foreign[owner]]], sizes[~foreign])
            ends = np.cumsum(sizes)
            for i in np.flatnonzero(foreign).tolist():
                ids = self._ids(words[i], flat[ends[i] - sizes[i] : ends[i]].tolist())
                self._keep([words[i]], np.array(ids), np.array([len(ids)]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts one after the other, and the n + 1 offsets of each text's."""
        if len(self.index) > MOST_CHUNKS or self.characters > MOST_CHARACTERS:
            self.clear()
        chunks, ends = [], [0]
        for t in texts:
            if t:
                if "  " in t or t[0] == " " or t[-1] == " " or P.MARK in t:
                    chunks += _PARTS.findall(P.MARK + t.replace(" ", P.MARK))
                else:
                    chunks += [P.MARK + c for c in t.split(" ")]
            ends.append(len(chunks))
        number = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        miss = np.flatnonzero(number < 0)
        if len(miss):
            self._learn(sorted({chunks[i] for i in miss.tolist()}))
            number[miss] = [self.index[chunks[i]] for i in miss.tolist()]
        start, length = np.array(self.start, np.int64), np.array(self.length, np.int64)
        if not len(number):
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        flat = np.frombuffer(self.flat, np.uint32).copy()
        lengths = length[number]
        return flat[X.ragged(start[number], lengths)], np.r_[0, np.cumsum(lengths)][ends]

    def decode(self, ids: list[int]) -> str:
        out = bytearray()
        for i in ids:
            p, _, kind = self.all[i]
            if kind == P.BYTE:
                out.append(int(p[3:5], 16))
            elif kind != P.CONTROL:
                out += p.encode()
        text = out.decode("utf-8", "replace").replace(P.MARK, " ")
        return text[1:] if text[:1] == " " else text


_HELD: dict[str | None, Codec] = {}
_MADE: dict[str | None, Merges] = {}


def merges(path: str | None = None) -> Merges:
    """The merge trees of a model file, made once in a process."""
    if path not in _MADE:
        _MADE[path] = Merges(path)
    return _MADE[path]


def codec(path: str | None = None, made: Merges | None = None) -> Codec:
    """One codec for each worker process; made: merge trees that the driver sent."""
    if path not in _HELD:
        _HELD[path] = Codec(made or merges(path))
    return _HELD[path]


def _encode(path: str | None, sent=None):
    def run(batches):
        own = codec(path, sent.value if sent is not None else None)
        for whole in batches:
            for batch in X.slices(whole, most=TOGETHER):
                ids, ends = own.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _decode(path: str | None, sent=None):
    def run(batches):
        own = codec(path, sent.value if sent is not None else None)
        texts = np.array([("" if k == P.CONTROL else p) for p, _, k in own.all], object)
        plain = np.array([k != P.BYTE for _, _, k in own.all])
        for b in batches:
            flat, ends = np.asarray(b.column(1).flatten()), np.r_[0, np.cumsum(np.asarray(b.column(1).value_lengths()))]
            out = []
            for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids = flat[a:z]
                if plain[ids].all():
                    t = "".join(texts[ids].tolist()).replace(P.MARK, " ")
                    out.append(t[1:] if t[:1] == " " else t)
                else:
                    out.append(_mixed(own, ids, plain, texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return run


def _mixed(own: Codec, ids: np.ndarray, plain: np.ndarray, texts: np.ndarray) -> str:
    """Runs of byte pieces decoded as UTF-8 between plain ones."""
    cut = np.flatnonzero(np.diff(plain[ids].astype(np.int8))) + 1
    parts = []
    for run in np.split(ids, cut):
        if plain[run[0]]:
            parts.append("".join(texts[run].tolist()))
        else:
            parts.append(bytes(int(own.all[i][0][3:5], 16) for i in run.tolist()).decode("utf-8", "replace"))
    t = "".join(parts).replace(P.MARK, " ")
    return t[1:] if t[:1] == " " else t


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids array<int> of each row of docs(doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(merges(path))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(path, sent), "doc_id long, ids array<int>")


def decoded(ids: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of each row of ids(doc_id, ids)."""
    sent = ids.sparkSession.sparkContext.broadcast(merges(path))
    return ids.select("doc_id", "ids").mapInArrow(_decode(path, sent), "doc_id long, text string")


def _both(path: str | None, sent):
    """Both directions over one read: the digests of the ids, and whether the text comes back."""
    forth, back = _encode(path, sent), _decode(path, sent)

    def run(batches):
        for whole in batches:
            for batch in X.slices(whole, most=TOGETHER):
                (ids,) = forth([batch])
                (texts,) = back([ids])
                flat, ends = np.asarray(ids.column(1).flatten()).astype("<u4"), np.r_[0, np.cumsum(np.asarray(ids.column(1).value_lengths()))]
                crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                same = [(a or "").replace(P.MARK, " ") == b for a, b in zip(batch.column(1).to_pylist(), texts.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends)), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    return run


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = X.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_both(None, spark.sparkContext.broadcast(merges())), "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
