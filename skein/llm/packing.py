"""Best-fit packing of token sequences with a swap-based local search.

A packing depends on the lengths alone, so it is found for the histogram of lengths, which has at most `capacity` entries
however many documents there are: best fit, longest first, over groups of equal bins; then a local search over the underfull
groups exchanges one item for one, two for one, one for two, or moves an item, each step increasing the sum of squared fills,
until no exchange does or the bin count meets its lower bound. Pieces take the slots of their length by rank: the rank of a piece is its
place among its task's pieces of that length plus the counts of earlier tasks, so no length is gathered in one task.

Defined cases: a null or empty text is a sequence of the end id alone; only documents longer than `capacity` are cut; repeated
rows are packed as often as they occur; an empty table gives no pieces; further columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, foreign_kept, join_checked, released, task_count, tokenizer_path, written
from .tokenize import encoder, in_slices

Bins = list[tuple[dict[int, int], int]]  # lengths with their counts, and the number of bins of that kind


def best_fit(histogram: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first: each item goes where it leaves least room, which is the same bin again while it fits."""
    rooms: list[int] = []  # those with open bins, ascending
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = defaultdict(list)

    def put(pattern: dict[int, int], bins: int, room: int) -> None:
        if bins:
            if not open_bins[room]:
                bisect.insort(rooms, room)
            open_bins[room].append((pattern, bins))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                pattern, bins = open_bins[room].pop()
                if not open_bins[room]:
                    rooms.pop(i)
            else:
                room, pattern, bins = capacity, {}, left
            each = room // length
            full = min(bins, left // each)
            put(pattern | {length: each}, full, room - each * length)
            left -= full * each
            bins -= full
            if bins and left:
                put(pattern | {length: left}, 1, room - left * length)
                bins, left = bins - 1, 0
            if pattern:
                put(pattern, bins, room)
    merged: dict[tuple, int] = defaultdict(int)
    for kinds in open_bins.values():
        for pattern, bins in kinds:
            merged[tuple(sorted(pattern.items()))] += bins
    return [(dict(k), n) for k, n in merged.items()]


def _fill(pattern: dict[int, int]) -> int:
    return sum(x * n for x, n in pattern.items())


def _changed(pattern: dict[int, int], out: tuple[int, ...], into: tuple[int, ...]) -> dict[int, int]:
    new = dict(pattern)
    for x in out:
        new[x] -= 1
        if not new[x]:
            del new[x]
    for x in into:
        new[x] = new.get(x, 0) + 1
    return new


def _least_bins(bins: Bins, capacity: int) -> int:
    """A lower bound of the number of bins: items above half need one each, and the others what room those leave, for each least length."""
    n = np.zeros(capacity + 1, np.int64)
    for pattern, count in bins:
        for x, each in pattern.items():
            n[x] += each * count
    up_n, up_sum, half = np.append(0, np.cumsum(n)), np.append(0, np.cumsum(n * np.arange(capacity + 1))), capacity // 2
    k = np.arange(half + 1)  # items below k are left out, those above capacity - k share with none
    pairable, room = up_n[capacity - k + 1] - up_n[half + 1], up_sum[capacity - k + 1] - up_sum[half + 1]
    over = up_sum[half + 1] - up_sum[k] - (pairable * capacity - room)
    return int((up_n[-1] - up_n[half + 1] + np.maximum(0, -(-over // capacity))).max())


class _Underfull:
    """The underfull patterns by room, with the sums that one or two of their items make, as bits counted down from capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sums: dict[tuple, tuple[set[int], set[int], int, int]] = {}  # of one item, of two, and both as bits: one; none, one or two
        self.rooms: dict[int, dict[tuple, None]] = {}
        self.bits: dict[int, tuple[int, int]] = {}
        self.order: list[int] = []  # rooms, ascending

    def add(self, key: tuple) -> None:
        room = self.capacity - _fill(dict(key))
        if room:
            one = {x for x, _ in key}
            two = {x + y for i, (x, n) in enumerate(key) for y, _ in key[i + (n < 2) :]}
            low, high = (sum(1 << (self.capacity - x) for x in v) for v in (one, one | two | {0}))
            self.sums[key] = one, two, low, high
            if room not in self.rooms:
                bisect.insort(self.order, room)
                self.rooms[room], self.bits[room] = {}, (0, 0)
            self.rooms[room][key] = None
            if room in self.bits:
                self.bits[room] = self.bits[room][0] | low, self.bits[room][1] | high

    def remove(self, key: tuple) -> None:
        room = self.capacity - _fill(dict(key))
        if room:
            del self.sums[key], self.rooms[room][key]
            self.bits.pop(room, None)
            if not self.rooms[room]:
                del self.rooms[room]
                self.order.remove(room)

    def _of(self, room: int, but: tuple | None) -> tuple[int, int]:
        if but is None and room in self.bits:
            return self.bits[room]
        low = high = 0
        for key in self.rooms[room]:
            if key != but:
                low, high = low | self.sums[key][2], high | self.sums[key][3]
        if but is None:
            self.bits[room] = low, high
        return low, high

    def _gain(self, key: tuple, low: int, high: int, least: int, most: int) -> int:
        """The most, from least to most, that the pattern key can give more than it takes of the sums; 0 if nothing."""
        one, two = self.sums[key][:2]
        shift, mask, found = self.capacity, (1 << (most - least + 1)) - 1, 0
        for x in one:
            found |= high >> (shift - x + least)
        for x in two:
            found |= low >> (shift - x + least)
        found &= mask
        return least + found.bit_length() - 1 if found else 0

    def exchange(self, source: tuple, alone: bool) -> tuple[tuple, tuple[int, ...], tuple[int, ...]] | None:
        """(target, taken from source, given back) that adds most to another bin and increases the squared fills; None if there is none."""
        own = self.capacity - _fill(dict(source))
        gain, where = 0, 0
        for room in reversed(self.order):
            if room <= gain:
                break
            least = max(gain, room - own) + 1  # a smaller gain doesn't increase the squared fills
            if least <= room and (x := self._gain(source, *self._of(room, source if alone and room == own else None), least, room)):
                gain, where = x, room
        if not gain:
            return None
        target = next(k for k in self.rooms[where] if not (alone and k == source) and self._gain(source, *self.sums[k][2:], gain, gain))
        one, back = self.sums[source][0], self.sums[target][0]
        for x in one:
            if x == gain:
                return target, (x,), ()
            if x - gain in back:
                return target, (x,), (x - gain,)
        for x in one:
            if y := _two(target, x - gain):
                return target, (x,), y
        y = next(y for y in back if y + gain in self.sums[source][1])
        return target, _two(source, y + gain), (y,)


def _two(key: tuple, total: int) -> tuple[int, ...]:
    """Two items of a pattern with that sum; empty if there are none."""
    counts = dict(key)
    return next(((x, total - x) for x, n in key if counts.get(total - x, 0) > (x * 2 == total)), ())


def local_search(bins: Bins, capacity: int) -> Bins:
    """Empties bins: the least filled bins give to others what increases the sum of squared fills most, until no exchange does.

    An exchange is made in as many bins of the two patterns at once as there are; each pass takes every pattern, and the last one
    changes nothing unless the bins meet their lower bound.
    """
    counts: dict[tuple, int] = defaultdict(int)
    under = _Underfull(capacity)
    waiting: list[tuple[int, tuple]] = []

    def change(pattern: dict[int, int], by: int) -> None:
        key = tuple(sorted(pattern.items()))
        if pattern:
            if not counts[key]:
                under.add(key)
            counts[key] += by
            if by > 0:
                heapq.heappush(waiting, (_fill(pattern), key))
            if not counts[key]:
                del counts[key]
                under.remove(key)

    for pattern, n in bins:
        change(pattern, n)
    number, least = sum(counts.values()), _least_bins(bins, capacity)
    changed = True
    while changed and number > least:
        changed, done = False, {}
        waiting[:] = [(_fill(dict(k)), k) for k in under.sums]
        heapq.heapify(waiting)
        while waiting and number > least:
            _, source = heapq.heappop(waiting)
            n = counts.get(source, 0)
            if source not in under.sums or done.get(source) == min(n, 2):
                continue
            best = under.exchange(source, n < 2)
            if best is None:
                done[source] = min(n, 2)
                continue
            target, out, back = best
            times = n // 2 if target == source else min(n, counts[target])
            rest = _changed(dict(source), out, back)
            change(dict(source), -times)
            change(dict(target), -times)
            change(_changed(dict(target), back, out), times)
            change(rest, times)
            if source in counts:
                heapq.heappush(waiting, (_fill(dict(source)), source))
            number -= 0 if rest else times
            changed = True
    return [(dict(k), n) for k, n in counts.items()]


def _runs(bins: Bins) -> tuple[np.ndarray, ...]:
    """For each run of slots of one length in equal bins, sorted: key (length and first rank), first bin, offset, length, slots a bin."""
    used: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for pattern, n in sorted(bins, key=lambda x: sorted(x[0].items())):
        at = 0
        for length, each in sorted(pattern.items(), reverse=True):
            rows.append(((length << 45) | used[length], first, at, length, each))
            used[length] += n * each
            at += length * each
        first += n
    return tuple(np.array(c, np.int64) for c in (zip(*sorted(rows), strict=True) if rows else [[]] * 5))


def _tokenise(path: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        end, seen, width = np.array([end_id], "<u4").tobytes(), defaultdict(int), 4 * capacity
        for b in batches:
            texts, ids = b.column("content").to_pylist(), b.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for i, j in in_slices(texts):
                for doc, coded in zip(ids[i:j], enc.encode(texts[i:j]), strict=True):
                    coded += end
                    for k, at in enumerate(range(0, len(coded), width)):
                        piece = coded[at : at + width]
                        n = len(piece) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(piece), part, seen[n], piece if keep_ids else None))
                        seen[n] += 1
            kinds = (b.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids")
            columns = zip(*rows, strict=True) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _place(runs: tuple[np.ndarray, ...]):
    key, first, at, length, each = runs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            i = np.searchsorted(key, (n << 45) | rank, side="right") - 1
            slot = rank - (key[i] & ((1 << 45) - 1))
            out = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")]
            out += [pa.array(first[i] + slot // each[i]), pa.array(at[i] + slot % each[i] * length[i])]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"])

    return run


@foreign_kept
def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and ids (little-endian unsigned 32-bit; null unless keep_ids)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = tokenizer if "/" in tokenizer else tokenizer_path(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("content"))
    head = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = written(rows.mapInArrow(released(_tokenise(path, end_id, capacity, keep_ids)), f"{head}, part int, nth long, ids binary"), "pieces", task_count(docs, 4 << 20))
    counts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "counts", task_count(docs))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    bins = local_search(best_fit(histogram, capacity), capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = join_checked(pieces, written(bases, "bases", task_count(docs)), ["part", "length"])
    return placed.mapInArrow(released(_place(_runs(bins))), f"{head}, ids binary, sequence_id long, offset long")
