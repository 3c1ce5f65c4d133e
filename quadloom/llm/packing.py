"""Best-fit packing by bin completion.

Documents become token pieces of at most `capacity` tokens. Which pieces share a sequence depends on the lengths
alone, so the plan is made from the histogram of lengths (at most `capacity` rows, whatever the input): a depth-first
branch and bound completes the sequence of the largest length left with each undominated filling, least waste first, uses
the filling as often as its counts allow (and, coming back, less often), and cuts a branch by the waste it has made, the
waste that the large pieces left must make, the L2 bound of what is left, and states that failed before. Best-fit decreasing
gives the first incumbent; each packing found replaces it. Of packings too large for one search, wasteful and
random sequences are opened and packed again by the same search. The searches have a budget of nodes: `least` of the result
is a number of sequences that no packing falls under, so a packing of so many is proved to be least and one of more is the
best that the budget found. Pieces then get their places by their rank among equal lengths: ranks are counted in
salted shards, so no length and no repeated row gathers in one task.

Defined cases: a null or empty text is the piece of its end token; very long documents are cut, the first piece being the
short one; rows that repeat a doc_id, or have none, are packed each; pieces of one length are alike, so ties change no
count; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm import text as X
from quadloom.llm import tokens

CAPACITY, END = 1024, 2
#: Nodes of one search, steps of an enumeration of fillings that weigh as much as a node, pieces from which on the scarcest length goes first, fillings shuffled, sequences packed again at once, and how often.
NODES, NODE_STEPS, FEW, SHUFFLED, REOPENED, RESTARTS = 2000, 200, 300, 64, 40, 24
SHARD_ROWS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    first = n - (n - 1) // capacity * capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def _pieces(capacity: int, end: int, paths: tuple):
    def run(batches):
        own = tokens.encoder(*paths)
        tail = np.array([end], np.uint32)
        for whole in batches:
            for batch in X.slices(whole):
                rows = []
                ids_of = own.encode([t or "" for t in batch.column(1).to_pylist()])
                for doc, ids in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                    ids = np.r_[ids, tail].astype("<u4")
                    raw = ids.tobytes()
                    rows += [(doc, i, a, n, zlib.crc32(raw[4 * a : 4 * (a + n)])) for i, (a, n) in enumerate(_cut(len(ids), capacity))]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

    return run


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: no packing has fewer sequences."""
    c = np.zeros(capacity + 1, np.int64)
    for n, k in counts.items():
        c[n] = k
    return _bound(c, capacity)


def _bound(c: np.ndarray, capacity: int) -> int:
    """L2 of the counts by length."""
    half = capacity // 2
    number, size = np.cumsum(c), np.cumsum(c * np.arange(capacity + 1))
    k = np.arange(half + 1)
    mid, mid_size = number[capacity - k] - number[half], size[capacity - k] - size[half]
    low = size[half] - np.r_[0, size[:half]]
    need = number[-1] - number[half] + np.maximum(0, -((mid * capacity - mid_size - low) // capacity))
    return max(int(need.max()), -(-int(size[-1]) // capacity))


def _reach(lengths: list[int], counts: np.ndarray, room: int) -> list[int]:
    """Bit s of item i: lengths[i:] can sum to s."""
    mask, out = (1 << (room + 1)) - 1, [1] * (len(lengths) + 1)
    for i in range(len(lengths) - 1, -1, -1):
        n = lengths[i]
        bits, left, step = out[i + 1], min(int(counts[n]), room // n), 1
        while left:
            take = min(step, left)
            bits |= (bits << (take * n)) & mask
            left -= take
            step *= 2
        out[i] = bits
    return out


def fillings(room: int, lengths: list[int], counts: np.ndarray, most_waste: int, budget: list[int]):
    """(waste, [(length, times)]) of the undominated fillings of `room`, least waste and larger pieces first. lengths: falling.

    A filling is dominated, and left out, where a free piece fits into its waste, where a free piece can stand for a smaller
    one or for two of its own, and a free piece is one that is not in the filling. Each step takes one of budget[0]; there are no more
    fillings once that is spent.
    """
    fit = [n for n in lengths if n <= room]
    reach: list[int] | None = _reach(fit, counts, room)
    free = sum(1 << n for n in fit)
    for waste in range(min(most_waste, room) + 1):
        if not reach[0] >> (room - waste) & 1:
            continue
        if room == waste and not _dominated((), waste, free, counts):
            yield waste, []
        levels: list[list] = [[0, None, room - waste, ()]]  # next length, next times of it, room left, what is taken
        while levels:
            i, c, left, taken = levels[-1]
            budget[0] -= 1
            if budget[0] < 0:
                return
            while i < len(fit) and left and reach[i] >> left & 1:  # else nothing from here on fills it
                n = fit[i]
                c = min(int(counts[n]), left // n) if c is None else c
                while c and not reach[i + 1] >> (left - c * n) & 1:
                    c -= 1
                if c:
                    break
                i, c = i + 1, None
            if not c:
                levels.pop()
                continue
            levels[-1][:2] = i, c - 1
            n, more = fit[i], (*taken, (fit[i], c))
            if left > c * n:
                levels.append([i + 1, None, left - c * n, more])
            elif not _dominated(more, waste, free, counts):
                reach = None  # a search holds many of these generators; most are never asked again
                yield waste, list(more)
                reach = _reach(fit, counts, room)


def _dominated(taken: tuple[tuple[int, int], ...], waste: int, free: int, counts: np.ndarray) -> bool:
    for n, c in taken:
        if c == counts[n]:
            free &= ~(1 << n)
    if waste and free & ((2 << waste) - 1):
        return True
    gap, one = (1 << waste) - 1, (2 << waste) - 1
    for i, (n, c) in enumerate(taken):
        if waste and free >> (n + 1) & gap:
            return True
        if c > 1 and free >> 2 * n & one:
            return True
        if any(free >> (n + m) & one for m, _ in taken[i + 1 :]):
            return True
    return False


def _least_waste(left: np.ndarray, lengths: list[int], capacity: int) -> int:
    """What the pieces over half a sequence, each in one of its own, waste at least."""
    small = [n for n in lengths if 2 * n <= capacity]
    sums, out = _reach(small, left, capacity // 2)[0], 0
    for n in lengths:
        if 2 * n <= capacity:
            break
        out += int(left[n]) * (capacity - n + 1 - (sums & ((2 << (capacity - n)) - 1)).bit_length())
    return out


def _scarcest(left: np.ndarray, lengths: list[int], capacity: int, slack: int) -> tuple[int, dict[int, float]]:
    """The length with the fewest fillings within the slack, the longest of equals, 0 if one has none; and how many each has,
    as far as they were counted (up to a million)."""
    ways = np.zeros(capacity + 1)
    ways[0] = 1
    for n in lengths:
        before = ways.copy()
        for k in range(1, min(int(left[n]), capacity // n) + 1):
            ways[k * n :] += before[: capacity + 1 - k * n]
        np.minimum(ways, 1e6, out=ways)
    sums = np.cumsum(ways).tolist()

    def within(room: int) -> float:
        return (sums[room] if room >= 0 else 0) - (sums[room - slack - 1] if room > slack else 0)

    known: dict[int, float] = {}
    for n in lengths:
        found, c = 0.0, int(left[n])
        for room in range(capacity - n, -1, -(c + 1) * n):  # the ways that leave one piece of this length out
            found += within(room) - within(room - c * n)
        known[n] = found
        if found < 1:
            return 0, known
    return min(lengths, key=lambda n: known[n]), known


def search(counts: dict[int, int], capacity: int, goal: int, nodes: int = NODES, r: random.Random | None = None) -> tuple[list[tuple[list[tuple[int, int]], int]] | None, bool]:
    """A packing in at most goal sequences, or None; and whether the search came to its end within `nodes` nodes.

    Depth first over the fillings around the largest length left (once no more than FEW pieces are left: around the one with the
    fewest fillings), each used as often as it can be and, later, less often. A node is cut where its waste or the L2 bound of
    what is left passes the goal, where a length has no filling, or where the same pieces were left before. r: takes
    first, of fillings of equal waste, those of pieces that few fillings take, with some chance.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    slack = goal * capacity - sum(n * c for n, c in counts.items())
    failed: dict[bytes, int] = {}
    budget = [nodes * NODE_STEPS]
    plan: list[tuple[list[tuple[int, int]], int]] = []

    def options(waste: int, used: int, banned):
        """The choices at this node, none where a bound cuts it."""
        lengths = np.flatnonzero(left)[::-1].tolist()
        key = hashlib.blake2b(left.tobytes(), digest_size=16).digest()
        if waste > slack or failed.get(key, goal + 1) <= used or used + _bound(left, capacity) > goal or waste + _least_waste(left, lengths, capacity) > slack:
            return
        top, ways = (lengths[0], {}) if int(left.sum()) > FEW else _scarcest(left, lengths, capacity, slack - waste)
        later = []
        if not top:
            failed[key] = min(used, failed.get(key, used))
            return
        left[top] -= 1
        rest = [n for n in lengths if left[n]]
        whole = left.copy()
        left[top] += 1
        found = fillings(capacity - top, rest, whole, slack - waste, budget)
        if r is not None:
            head = list(itertools.islice(found, SHUFFLED))
            found = itertools.chain(sorted(head, key=lambda f: (f[0], -sum(1 / ways.get(n, 1e6) for n, _ in f[1]) * r.uniform(0.5, 1))), found)
        for w, filling in found:
            uses = dict(filling)
            uses[top] = uses.get(top, 0) + 1
            pattern = sorted(uses.items(), reverse=True)
            if pattern == banned:
                continue
            times = min(int(left[n]) // c for n, c in pattern)
            if w:
                times = min(times, (slack - waste) // w)
            if times:
                yield pattern, times, w
                later.append((pattern, times, w))
        if budget[0] < 0:
            return
        for pattern, times, w in later:
            for t in range(times - 1, 0, -1):
                yield pattern, t, w
        failed[key] = min(used, failed.get(key, used))

    stack = [(options(0, 0, None), 0, 0)] if slack >= 0 else []
    while stack:
        choices, waste, used = stack[-1]
        choice = next(choices, None)
        if budget[0] < 0:
            return None, False
        if choice is None:
            stack.pop()
            if plan:
                pattern, times = plan.pop()
                for n, c in pattern:
                    left[n] += c * times
            continue
        pattern, times, w = choice
        for n, c in pattern:
            left[n] -= c * times
        plan.append((pattern, times))
        if not left.any():
            return plan, True
        budget[0] -= NODE_STEPS
        stack.append((options(waste + times * w, used + times, pattern), waste + times * w, used + times))
    return None, True


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing: each piece, the longest first, goes to the fullest sequence that has room; equal sequences at once."""
    open_: dict[int, dict[tuple[tuple[int, int], ...], int]] = {}
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in open_ if r >= n), default=capacity)
            each = min(left, room // n)
            if room in open_:
                pattern, have = open_[room].popitem()
                if not open_[room]:
                    del open_[room]
            else:
                pattern, have = (), left // each
            times = min(have, left // each)
            if have > times:
                open_.setdefault(room, {})[pattern] = have - times if pattern else 0
                if not pattern:
                    del open_[room]
            fuller = open_.setdefault(room - each * n, {})
            fuller[(*pattern, (n, each))] = fuller.get((*pattern, (n, each)), 0) + times
            left -= times * each
    return [(list(pattern), times) for kinds in open_.values() for pattern, times in kinds.items()]


def _bins(plan) -> int:
    return sum(t for _, t in plan)


def _reopened(plan, capacity: int, r: random.Random, nodes: int):
    """The plan with some of its sequences, all wasteful ones among them, packed again in one less; None if that fails."""
    waste = [capacity - sum(n * c for n, c in pattern) for pattern, _ in plan]
    again = {i: min(plan[i][1], REOPENED) for i in range(len(plan)) if waste[i]}
    for i in r.choices(range(len(plan)), weights=[t for _, t in plan], k=REOPENED):
        again[i] = min(plan[i][1], again.get(i, 0) + 1)
    counts: dict[int, int] = {}
    for i, t in again.items():
        for n, c in plan[i][0]:
            counts[n] = counts.get(n, 0) + c * t
    made, _ = search(counts, capacity, sum(again.values()) - 1, nodes)
    if made is None:
        return None
    return made + [(pattern, t - again.get(i, 0)) for i, (pattern, t) in enumerate(plan) if t > again.get(i, 0)]


def planned(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, restarts: int = RESTARTS) -> tuple[list[tuple[list[tuple[int, int]], int]], int]:
    """A packing of counts {length: pieces} as patterns [(length, times in it)] with how often each is used, and a number of
    sequences that no packing falls under: where both agree the packing is proved to be least, else a budget ended the search."""
    counts = {int(n): int(c) for n, c in counts.items() if c}
    best, low = best_fit(counts, capacity), lower_bound(counts, capacity)
    r, ended, few = random.Random(17), True, sum(counts.values()) <= FEW
    while ended and low < _bins(best):  # the bound rises as long as whole trees fall short of it
        made, ended = search(counts, capacity, low, nodes)
        for _ in range(restarts if few and not (made or ended) else 0):
            made, ended = search(counts, capacity, low, nodes // 4, r)
            if made or ended:
                break
        best, low = made or best, low + (ended and made is None)
    goal = _bins(best) - 1
    while low < goal < _bins(best):  # a first descent, then goals halfway to the bound until one fails
        made, _ = search(counts, capacity, goal, nodes)
        best = made or best
        goal = (low + _bins(best)) // 2 if made else low
    for _ in range(restarts):
        if _bins(best) <= low:
            break
        best = _reopened(best, capacity, r, nodes // 4) or best
    return best, low


class Slots:
    """Where the piece of a given length and rank goes."""

    def __init__(self, plan):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        base = 0
        for pattern, times in plan:
            at = 0
            for n, c in pattern:
                rows.setdefault(n, []).append((used.get(n, 0), base, c, at))
                used[n] = used.get(n, 0) + c * times
                at += n * c
            base += times
        self.rows = {n: np.array(r, np.int64) for n, r in rows.items()}

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(length[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            own = order[a:b]
            n = int(length[own[0]])
            rows = self.rows[n]
            hit = rows[np.searchsorted(rows[:, 0], rank[own], "right") - 1]
            q = rank[own] - hit[:, 0]
            sequence[own] = hit[:, 1] + q // hit[:, 2]
            offset[own] = hit[:, 3] + q % hit[:, 2] * n
        return sequence, offset


def _place(slots: Slots, least: int):
    def run(batches):
        for b in batches:
            sequence, offset = slots.find(np.asarray(b.column(3)), np.asarray(b.column(5)))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset), pa.array(np.full(b.num_rows, least))], names=[*b.schema.names[:5], "sequence_id", "offset", "least"])

    return run


def packed(docs: DataFrame, capacity: int = CAPACITY, end: int = END, paths: tuple = ()) -> DataFrame:
    """One row for each piece of docs(doc_id, text) with its sequence and place; least: no packing has fewer sequences."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(capacity, end, paths), PIECES)
    pieces = X.written(pieces.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "pieces")
    histogram = {r.length: r.c for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most `capacity` rows
    plan, least = planned(histogram, capacity)
    shards = max(8, -(-sum(histogram.values()) // SHARD_ROWS))
    dealt = pieces.withColumn("shard", F.pmod("salt", F.lit(shards))).drop("salt")
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("c")).select("length", "shard", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(sizes, ["length", "shard"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("own") - 1).alias("rank"))
    return ranked.mapInArrow(_place(Slots(plan), least), f"{PIECES}, sequence_id long, offset long, least long")


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed(X.read(spark, sf_dir, "documents"))
