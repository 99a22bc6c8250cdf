"""Benchmark decontamination: passages of documents that repeat a benchmark item, word for word or nearly.

Every item has a window of as many words as itself, and that window slides over every document.  A shingle of five words
that occurs for the second time in a window or an item counts as another one than the first, and so on, so that multisets
become sets, and their weighted Jaccard similarity the plain one of these.  A window's SimHash adds up 256 bits over them.
Similarity 0.75 then means an angle of 0.54 between the two vectors, so 44 differing bits on average, whatever repeats.

Items are found by shingle first: an index from shingles to the items that hold them names the few items that a document
can match at all (a window that is so similar shares three quarters of its shingles with the item).  Their fingerprints are
looked up in a multi-index of 32 blocks of 8 bits: two fingerprints within the radius of 76 differ in 3 bits or more in 25
blocks at most, so 7 blocks at least are within 2 bits, and none within the radius is missed; what 7 blocks name is compared
over all bits.  Verification is exact: the weighted Jaccard similarity of the two shingle multisets is 0.75 or more.

Items are worked in blocks of a bounded number of shingles, one pass over the documents each; nothing is shuffled but the
matches.

Defined results: a null or empty document or item, or one without words, matches nothing.  An item under five words is
one shingle and is found word for word, at its first place.  A document shorter than an item is one window.  Items with a
null id match as item null; equal items each have their row; repeated document rows each have their rows; rows with a null
doc_id keep it; other columns are ignored; an empty table on either side has no matches.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._shingles import FEW_BYTES, mix, shingles, slices, words
from voxmill.llm._store import small_batches

#: Bits of a fingerprint, and how many may differ: five standard deviations over what similarity 0.75 has on average.
BITS, RADIUS = 256, 76
SIMILARITY = 0.75
#: Shingles of the items that one pass over the documents looks for: they take some 50 bytes each.
ITEM_SHINGLES = 1_000_000
_BLOCKS, _NEAR = BITS // 8, 2
_TABLES = _BLOCKS - RADIUS // (_NEAR + 1)
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: Which values of a block are within _NEAR bits of which.
_WITHIN = _ONES[np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)] <= _NEAR
MATCH = "doc_id long, item_id long, start long, n_words long, similarity double, distance int"


def signs(found: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    lanes = np.stack([mix(found + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) % (1 << 64))) for k in range(BITS // 64)], axis=1)
    return np.unpackbits(lanes.view(np.uint8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """The SimHash of each row of summed signs, as blocks of 8 bits."""
    return np.packbits(sums > 0, axis=1)


def occurrences(found: np.ndarray) -> np.ndarray:
    """How often each shingle has come before."""
    order = np.argsort(found, kind="stable")
    new = np.append(True, found[order][1:] != found[order][:-1])[: len(found)]
    out = np.empty(len(found), np.int64)
    out[order] = np.arange(len(found)) - np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return out


def told_apart(found: np.ndarray, before: np.ndarray) -> np.ndarray:
    """A shingle and how often it has come before, as one hash."""
    return found + before.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


def window_sums(found: np.ndarray, have: int) -> np.ndarray:
    """Summed signs of every window of `have` shingles, repeats in a window told apart."""
    n = len(found)
    before = occurrences(found)
    plain = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(found), axis=0, dtype=np.int32)])
    if not before.any():
        return plain[have:] - plain[: n - have + 1]
    # From one window to the next, the leaving shingle's last occurrence goes and the entering one's next comes.
    order = np.argsort(found, kind="stable")
    group = np.cumsum(np.append(True, found[order][1:] != found[order][:-1])) - 1
    place = np.empty(n, np.int64)
    place[order] = group * (n + 1)  # places of one shingle are a run of sorted keys
    keys = np.sort(place + np.arange(n))
    first = np.arange(n - have)
    last = first + have
    in_window = lambda of, a, b: np.searchsorted(keys, place[of] + b) - np.searchsorted(keys, place[of] + a)
    leaving = told_apart(found[first], in_window(first, first, last) - 1)
    entering = told_apart(found[last], in_window(last, first + 1, last))
    start = signs(told_apart(found[:have], before[:have])).sum(axis=0, dtype=np.int32)[None]
    steps = signs(entering).astype(np.int32) - signs(leaving)
    return np.concatenate([start, start + np.cumsum(steps, axis=0, dtype=np.int32)])


class Items:
    """One block of benchmark items with its index by shingle and its multi-index."""

    def __init__(self, rows: list[tuple]):
        self.ids, self.bags, self.sizes, prints = [], [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}  # by words, then shingle
        held: list[np.ndarray] = []
        for item, text in rows:
            marks, _ = words(pa.array([text], pa.string()))
            if not len(marks):
                continue
            if len(marks) < 5:
                whole = int(shingles(marks, np.array([0, len(marks)]), len(marks))[0][0])
                self.short.setdefault(len(marks), {}).setdefault(whole, []).append(item)
            found, _ = shingles(marks, np.array([0, len(marks)]))
            held.append(np.unique(found))
            self.ids.append(item)
            self.bags.append(Counter(found.tolist()))
            self.sizes.append(len(marks))
            prints.append(fingerprints(signs(told_apart(found, occurrences(found))).sum(axis=0, dtype=np.int32)[None])[0])
        self.sizes = np.array(self.sizes, np.int64)
        flat, owner = np.concatenate([*held, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(flat, kind="stable")
        self.known, starts = np.unique(flat[order], return_index=True)
        self.owners, self.starts = owner[order], np.append(starts, len(flat))
        self.prints = np.array(prints, np.uint8).reshape(-1, _BLOCKS)
        # Sixteen places for each shingle, so that most others are told by one look: every worker holds them.
        self.maybe = np.zeros(1 << min(24, (16 * len(self.known)).bit_length()), bool)
        self.maybe[self._place(self.known)] = True

    def _place(self, found: np.ndarray) -> np.ndarray:
        return (found & np.uint64(len(self.maybe) - 1)).astype(np.int64)

    def hits(self, found: np.ndarray) -> np.ndarray:
        """The place of each shingle among the items', or -1."""
        out = np.full(len(found), -1, np.int64)
        if len(self.known):
            some = np.flatnonzero(self.maybe[self._place(found)])
            at = np.minimum(np.searchsorted(self.known, found[some]), len(self.known) - 1)
            out[some] = np.where(self.known[at] == found[some], at, -1)
        return out

    def named(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of a hit, item) for all items that hold the shingle there."""
        at = np.flatnonzero(hit >= 0)
        count = self.starts[hit[at] + 1] - self.starts[hit[at]]
        first = np.repeat(self.starts[hit[at]] - np.cumsum(count) + count, count)
        return np.repeat(at, count), self.owners[first + np.arange(int(count.sum()))]

    def near(self, items: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of the items within the radius of each window's print, by way of the blocks."""
        blocks = np.zeros((len(prints), len(items)), np.uint8)
        for k in range(_BLOCKS):
            blocks += _WITHIN[prints[:, k]][:, self.prints[items, k]]
        window, item = np.nonzero(blocks >= _TABLES)
        distance = _ONES[self.prints[items[item]] ^ prints[window]].sum(axis=1, dtype=np.int32)
        fine = distance <= RADIUS
        return window[fine], items[item[fine]], distance[fine]


def _overlap(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _of_document(items: Items, found: np.ndarray, hit: np.ndarray, n_words: int) -> dict[int, tuple]:
    """item -> (similarity, -start, words, distance) of its best window."""
    place, item = items.named(hit)
    have = np.maximum(np.minimum(items.sizes[item], n_words) - 4, 1)
    # A window needs three quarters of its shingles among the item's, so an item needs as many hits.
    distinct, counts = np.unique(item, return_counts=True)
    likely = distinct[4 * counts >= 3 * np.maximum(np.minimum(items.sizes[distinct], n_words) - 4, 1)]
    keep = np.isin(item, likely)
    place, item, have = place[keep], item[keep], have[keep]
    best: dict[int, tuple] = {}
    for n in np.unique(have).tolist():
        of = np.unique(item[have == n])
        at = np.unique(place[have == n])
        flags = np.zeros(len(found) + 1, np.int64)
        flags[at + 1] = 1
        flags = np.cumsum(flags)
        starts = np.flatnonzero(4 * (flags[n:] - flags[: len(flags) - n]) >= 3 * n)
        if not len(starts):
            continue
        low, high = int(starts[0]), int(starts[-1]) + n
        prints = fingerprints(window_sums(found[low:high], n)[starts - low])
        for k in range(0, len(of), 256):
            bags: dict[int, Counter] = {}
            for window, i, distance in zip(*(x.tolist() for x in items.near(of[k : k + 256], prints)), strict=True):
                start = int(starts[window])
                if start not in bags:
                    bags[start] = Counter(found[start : start + n].tolist())
                similarity = _overlap(bags[start], items.bags[i])
                if similarity >= SIMILARITY:
                    best[i] = max(best.get(i, (0,)), (similarity, -start, min(n + 4, n_words), distance))
    return best


def _scan(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in slices(batches, limit=FEW_BYTES):
            marks, word_bounds = words(batch.column("text"))
            found, bounds = shingles(marks, word_bounds)
            hit = items.hits(found)
            docs, rows = batch.column("doc"), []
            counted = np.concatenate([[0], np.cumsum(hit >= 0)])
            for k in np.flatnonzero(np.diff(counted[bounds])).tolist():
                a, b = bounds[k], bounds[k + 1]
                for item, (similarity, start, n, distance) in _of_document(items, found[a:b], hit[a:b], int(word_bounds[k + 1] - word_bounds[k])).items():
                    rows.append((docs[k].as_py(), items.ids[item], -start, n, similarity, distance))
            for size, of in items.short.items():
                runs, at = shingles(marks, word_bounds, size)
                told = set()
                for p in np.flatnonzero(np.isin(runs, np.array(list(of), np.uint64))).tolist():
                    k = int(np.searchsorted(at, p, "right")) - 1
                    if word_bounds[k + 1] - word_bounds[k] >= max(size, 5) and (k, int(runs[p])) not in told:
                        told.add((k, int(runs[p])))
                        rows += [(docs[k].as_py(), item, p - int(at[k]), size, 1.0, 0) for item in of[int(runs[p])]]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "item_id", "start", "n_words", "similarity", "distance"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", *, item_shingles: int = ITEM_SHINGLES) -> DataFrame:
    """doc_id, item_id, start (in words), n_words, similarity and distance of the best window for each document and item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    scans, block, held = [], [], 0

    def scanned() -> DataFrame:
        return rows.mapInArrow(_scan(spark.sparkContext.broadcast(Items(block))), MATCH)

    for row in items.toLocalIterator():  # a partition at a time: the driver holds one block of items
        block.append((row.item, row.text))
        held += len(row.text) // 2 + 1  # a word has a sign and a blank at least
        if held >= item_shingles:
            scans, block, held = [*scans, scanned()], [], 0
    if block or not scans:
        scans.append(scanned())
    return functools.reduce(DataFrame.union, scans)
