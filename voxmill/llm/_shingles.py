"""Words and word shingles of whole texts as 64-bit fingerprints, computed on Arrow buffers without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LOWER = np.array([*range(256)], np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False
_PLACES = 4096
#: Bytes of text whose words are worked out at once, where nothing is gained by more: some fifty times as much is held for it.
FEW_BYTES = 1 << 18
#: A weight for each place in a word and in a shingle, from a fixed seed: every worker and every run makes the same.
_WEIGHTS = np.random.Generator(np.random.PCG64(20260913)).integers(1, 1 << 63, _PLACES, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in pieces of about `limit` bytes of text, one row at least: what a worker holds at once has a bound."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            most = (ends[at - 1] if at else 0) + limit
            to = max(at + 1, int(np.searchsorted(ends, most, "right")))
            yield batch.slice(at, to - at)
            at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of all texts; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_starts(texts: pa.Array, in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, which of them are in a word, starts, bounds): the words of text i begin at starts[bounds[i]:bounds[i + 1]]."""
    signs, offsets = text_bytes(texts)
    inside = in_word[signs]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(signs)]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return signs, inside, starts, np.searchsorted(starts, offsets)


def words(texts: pa.Array, lower: bool = True, in_word: np.ndarray = _IN_WORD) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds): those of text i are fingerprints[bounds[i]:bounds[i + 1]].

    A word is a run of bytes other than ASCII white space (or of those in `in_word`), with A-Z in lower case.  Nulls have
    no words.
    """
    signs, inside, starts, bounds = word_starts(texts, in_word)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    place = np.arange(len(signs)) - np.concatenate([np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(signs))))])
    value = _BYTES[_LOWER[signs] if lower else signs]
    weight = _WEIGHTS[place & (_PLACES - 1)]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        weight[far] += mix((place[far] >> 12).astype(np.uint64)) << np.uint64(1)
    value *= weight
    value[~inside] = 0
    return mix(np.add.reduceat(value, starts)), bounds


def shingles(fingerprints: np.ndarray, bounds: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bounds) of the runs of `size` words; a text with fewer words, but with one, has the whole as one."""
    counts = np.diff(bounds)
    have = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(have)])
    padded = np.concatenate([fingerprints, np.zeros(size, np.uint64)])
    at = np.arange(out_bounds[-1]) + np.repeat(bounds[:-1] - out_bounds[:-1], have)
    out = np.zeros(len(at), np.uint64)
    for j in range(size):
        out += padded[at + j] * _WEIGHTS[j]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        out[out_bounds[short]] = 0
        for j in range(size - 1):
            more = short[counts[short] > j]
            out[out_bounds[more]] += padded[bounds[more] + j] * _WEIGHTS[j]
        out[out_bounds[short]] += counts[short].astype(np.uint64) * _WEIGHTS[size + 1]
    return mix(out), out_bounds


def runs_of(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces that end where the value of `column` changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        changes = np.flatnonzero(values[1:] != values[:-1])
        if held and held[-1].column(column)[-1].as_py() != values[0]:
            yield pa.concat_batches(held)
            held = []
        if len(changes):
            to = int(changes[-1]) + 1
            yield pa.concat_batches([*held, batch.slice(0, to)])
            held = [batch.slice(to)]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
