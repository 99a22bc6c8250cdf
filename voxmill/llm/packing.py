"""Best-fit packing of documents into sequences, improved by swaps.

Texts are tokenised once and dealt, piece by piece, over shards of a bounded amount of text; each shard is packed alone,
so a shard more than the fewest possible sequences costs at most one sequence for some million tokens.  In a shard,
pieces go longest first into the fullest sequence that has room.  Then the emptiest sequence gives its pieces away: it
moves one, exchanges one for a shorter one, or two for a shorter one, with a sequence that has the room.  Every step
makes the sum of squared fills larger, and the search ends when a sequence less is impossible or no step is left.

Defined results: a null or empty text has the end id alone; a text over the capacity is cut into full pieces and a
rest; rows with a null doc_id, and repeated rows, are packed like any others, and many of them are dealt over many
shards; other columns are ignored; an empty table has no rows.  The same rows in the same files give the same sequences.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._shingles import slices
from voxmill.llm._store import small_batches
from voxmill.llm._tokens import END_ID, encoder

CAPACITY = 4096
#: Characters of text that a shard gets on average.
SHARD_CHARS = 8_000_000


class Packing:
    """Items of given lengths in bins of one capacity."""

    def __init__(self, lengths: list[int], capacity: int = CAPACITY):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []
        self._best_fit()
        self._improve()

    def _best_fit(self) -> None:
        waiting: dict[int, list[int]] = defaultdict(list)  # bins by room
        rooms = 0  # bit r: some bin has room r
        for item in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            length = self.lengths[item]
            fits = rooms >> length
            if fits:
                room = length + (fits & -fits).bit_length() - 1
                at = waiting[room].pop()
                if not waiting[room]:
                    rooms &= ~(1 << room)
            else:
                room, at = self.capacity, len(self.bins)
                self.bins.append([])
                self.room.append(0)
            self.bins[at].append(item)
            self.room[at] = room - length
            waiting[room - length].append(at)
            rooms |= 1 << (room - length)

    def _least(self) -> int:
        return -(-sum(self.lengths) // self.capacity)

    def _shift(self, give: list[int], source: int, take: list[int], target: int) -> None:
        gain = sum(self.lengths[i] for i in give) - sum(self.lengths[i] for i in take)
        for i in give:
            self.bins[source].remove(i)
            self.holders[self.lengths[i]].discard((source, i))
            self.holders[self.lengths[i]].add((target, i))
        for i in take:
            self.bins[target].remove(i)
            self.holders[self.lengths[i]].discard((target, i))
            self.holders[self.lengths[i]].add((source, i))
        self.bins[source] += take
        self.bins[target] += give
        self.room[source] += gain
        self.room[target] -= gain

    def _step(self, source: int, others: list[int]) -> bool:
        """One move that makes `source` emptier and a bin at least as full fuller."""
        most = max((self.room[b] for b in others), default=0)
        fill = self.capacity - self.room[source]
        better = lambda target, gain: target != source and 0 < gain <= self.room[target] and self.capacity - self.room[target] + gain > fill
        items = sorted(self.bins[source], key=lambda i: -self.lengths[i])
        for i in items:
            fitting = [b for b in others if better(b, self.lengths[i])] if self.lengths[i] <= most else []
            if fitting:
                self._shift([i], source, [], min(fitting, key=lambda b: self.room[b]))
                return True
        for i in items:
            length = self.lengths[i]
            for wanted in range(max(1, length - most), length):
                for target, j in self.holders.get(wanted, ()):
                    if better(target, length - wanted):
                        self._shift([i], source, [j], target)
                        return True
        return self._two_for_one(source, others, items, fill)

    def _two_for_one(self, source: int, others: list[int], items: list[int], fill: int) -> bool:
        """Gives two items for a shorter one.  Bit s of `sums`: two items of `source` are s long together."""
        many = Counter(self.lengths[i] for i in items)
        once, sums = sum(1 << length for length in many), 0
        for length, n in many.items():
            sums |= (once if n > 1 else once & ~(1 << length)) << length
        for target in others:
            room = self.room[target]
            least = max(1, fill - (self.capacity - room) + 1)
            if least > room:
                continue
            for j in self.bins[target]:
                fitting = sums >> (self.lengths[j] + least) & ((1 << (room - least + 1)) - 1)
                if fitting:
                    total = self.lengths[j] + least + fitting.bit_length() - 1  # the longest pair that fits
                    by_length = {self.lengths[i]: i for i in items}
                    for i in items:
                        k = by_length.get(total - self.lengths[i])
                        if k == i:
                            k = next((x for x in items if x != i and self.lengths[x] == self.lengths[i]), None)
                        if k is not None:
                            self._shift([i, k], source, [j], target)
                            return True
        return False

    def _improve(self) -> None:
        if len(self.bins) <= self._least():
            return
        self.holders: dict[int, set[tuple[int, int]]] = defaultdict(set)
        under = [b for b, room in enumerate(self.room) if room]
        for b in under:
            for i in self.bins[b]:
                self.holders[self.lengths[i]].add((b, i))
        count, stuck = len(self.bins), set()
        while count > self._least():
            left = [b for b in under if b not in stuck and self.bins[b]]
            if not left:
                break
            source = max(left, key=lambda b: self.room[b])
            if not self._step(source, [b for b in under if b != source and self.bins[b] and self.room[b]]):
                stuck.add(source)
            elif not self.bins[source]:
                count, stuck = count - 1, set()
        self.bins = [b for b in self.bins if b]


def _pieces(vocabulary: str, capacity: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, bounds = encoder(vocabulary).encode(batch.column("text"))
            whole = np.insert(ids, bounds[1:], END_ID).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            total = np.diff(bounds)
            count = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = bounds[row] + piece * capacity
            length = np.minimum(capacity, bounds[row + 1] - begin)
            raw = whole.tobytes()
            tokens = pa.array([raw[4 * a : 4 * (a + n)] for a, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.binary())
            start = begin - bounds[row]
            part = np.full(len(row), TaskContext.get().partitionId())
            columns = [batch.column("doc").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), tokens, pa.array(part, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "tokens", "part"])

    return run


def _pack(capacity: int) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.drop_columns(["part"]) for b in batches if b.num_rows]
        if not held:
            return
        lengths = np.concatenate([b.column("length").to_numpy() for b in held])
        packing = Packing(lengths.tolist(), capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, items in enumerate(packing.bins):
            sequence[items] = k
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
        sequence += TaskContext.get().partitionId() << 32
        at = 0
        for b in held:
            to = at + b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence[at:to]), pa.array(offset[at:to])], [*b.schema.names, "sequence_id", "offset"])
            at = to

    return run


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", *, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, piece, start, length, tokens (little-endian 32-bit ids), sequence_id and offset of every piece."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    chars = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    pieces = rows.mapInArrow(_pieces(vocabulary, capacity), "doc_id long, piece int, start long, length long, tokens binary, part int")
    # Equal rows of different files go to different shards; the order in a shard does not depend on what arrives first.
    dealt = pieces.repartition(max(1, -(-chars // shard_chars)), "doc_id", "piece", "length", "part")
    dealt = dealt.sortWithinPartitions("doc_id", "piece", "length", "tokens")
    return dealt.mapInArrow(_pack(capacity), "doc_id long, piece int, start long, length long, tokens binary, sequence_id long, offset long")
