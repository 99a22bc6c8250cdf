"""Token ids of whole texts through the `tokenizers` library, with every distinct run of signs encoded once.

The vocabulary used here (README.md of /opt/tokenizers) drops white space before it looks at anything else, so the ids
of a text are the ids of its pieces between ASCII white space, one after the other; and a piece is its runs of letters,
single digits and runs of other marks, control characters among them, each encoded by the library's BPE model alone.
Natural text repeats runs more than pieces, so texts are split into runs on their bytes, and a worker keeps the ids of runs
it has met (one bounded memory, emptied when full) and asks the library only for new ones.  Pieces with a quote, or with
signs that the bytes do not tell apart, are kept whole; those with signs beyond the Latin blocks go to the library as they
are.
`tests/llm/test_llm_operators.py` holds this against the library's own encoding of whole texts.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex

from voxmill.llm._shingles import text_bytes

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
# Fixed value: the runs that the vocabulary file's own splitting rule names.  White space is ASCII white space alone here.
_RUNS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\x09-\x0d\x20\p{L}\p{N}]+|\n")
_LATIN = regex.compile(r"[\x21-\x7e¡-¬®-ɏ]*")
# Bytes in lower case, all ASCII white space as a blank.
_PLAIN = np.array([*range(256)], np.uint8)
_PLAIN[65:91] += 32
_PLAIN[9:14] = 32
# Kinds of bytes; those of U+00C0 to U+024F are letters.  Pieces with other signs beyond ASCII, with a quote (as in 's) or
# with what may be a special token are taken whole.
_SPACE, _LETTER, _DIGIT, _MARK = range(4)
_KINDS = np.full(256, _MARK, np.uint8)
_KINDS[32] = _SPACE
_KINDS[48:58] = _DIGIT
_KINDS[[*range(97, 123), *range(128, 256)]] = _LETTER
_HARD = np.zeros(256, bool)
_HARD[[0x27, 0xC2, *range(0xCA, 256)]] = True
# The signs × and ÷ are no letters, and İ is two signs in lower case.
_HARD_PAIRS = np.zeros(1 << 16, bool)
_HARD_PAIRS[[0xC397, 0xC3B7, 0xC4B0, 0x3C7C]] = True


def _byte_signs() -> dict[int, str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TextEncoder:
    """Encodes Arrow string arrays; nulls and empty texts have no ids."""

    def __init__(self, path: str, capacity: int = 500_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.signs = _byte_signs()
        self.capacity = capacity
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.uint16)
        self.ends = np.zeros(1 << 14, np.int64)  # where in pool the ids of the k-th known run end
        self.used = 0

    def _run(self, run: str) -> list[int]:
        written = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.signs)
        return [t.id for t in self.model.tokenize(written)]

    def _piece(self, piece: str) -> list[int]:
        if not piece.isascii() and not (_LATIN.fullmatch(piece) and unicodedata.is_normalized("NFC", piece)) or "<|" in piece:
            return self.library.encode(piece, add_special_tokens=False).ids
        return [i for run in _RUNS.findall(piece.lower()) for i in self._run(run)]

    def _learn(self, runs: list[str], whole: list[bool]) -> None:
        count, flat, ends = len(self.known), array("H"), []
        for run, piece in zip(runs, whole, strict=True):
            flat.extend(self._piece(run) if piece else self._run(run.lower()))
            ends.append(len(flat))
        # Ids of this vocabulary fit into two bytes.
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(flat), len(self.pool)), np.uint16)])
        if count + len(runs) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(max(len(runs), len(self.ends)), np.int64)])
        self.pool[self.used : self.used + len(flat)] = np.frombuffer(flat, np.uint16)
        self.ends[count : count + len(runs)] = self.used + np.array(ends, np.int64)
        self.known.update(zip(runs, range(count, count + len(runs)), strict=True))
        self.used += len(flat)

    @staticmethod
    def _split(signs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, whole, inside): where runs start, which of them are whole pieces, and which bytes are in one."""
        kind = _KINDS[signs]
        inside = kind != _SPACE
        edge = np.zeros(len(signs), bool)
        edge[offsets[:-1][offsets[:-1] < len(signs)]] = True
        edge[1:] |= ~inside[:-1]
        pieces = np.flatnonzero(edge & inside)
        if not len(pieces):
            return pieces, np.zeros(0, bool), inside
        hard = _HARD[signs]
        hard[1:] |= _HARD_PAIRS[signs[:-1].astype(np.uint16) << 8 | signs[1:]]
        whole = np.logical_or.reduceat(hard, pieces)
        starts = kind == _DIGIT
        starts[1:] |= kind[1:] != kind[:-1]
        starts &= inside
        # Of pieces with signs that need the library or the rule itself, nothing but the start counts.
        odd = np.flatnonzero(whole)
        if len(odd):
            bounds = np.append(pieces, len(signs))
            length = bounds[odd + 1] - bounds[odd]
            starts[np.repeat(bounds[odd] - (np.cumsum(length) - length), length) + np.arange(length.sum())] = False
        starts[pieces] = True
        starts = np.flatnonzero(starts)
        return starts, whole[np.searchsorted(pieces, starts, "right") - 1], inside

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ids[offsets[i]:offsets[i + 1]]."""
        signs, offsets = text_bytes(texts)
        signs = _PLAIN[signs]
        starts, whole, inside = self._split(signs, offsets)
        # Runs follow each other without the white space between them.
        before = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
        packed = pa.py_buffer(np.append(before[starts], before[-1])), pa.py_buffer(signs[inside])
        runs = pa.LargeStringArray.from_buffers(len(starts), *packed).dictionary_encode()
        if len(self.known) > self.capacity:
            self.known, self.used = {}, 0
        which, distinct = runs.indices.to_numpy(zero_copy_only=False), runs.dictionary.to_pylist()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            pieces = np.zeros(len(distinct), bool)
            pieces[which] = whole
            at[new] = len(self.known) + np.arange(len(new))
            self._learn([distinct[k] for k in new.tolist()], pieces[new].tolist())
        begins = np.where(at > 0, self.ends[at - 1], 0)
        lengths = self.ends[at] - begins
        counts = lengths[which]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        ids = self.pool[np.repeat(begins[which] - (after - counts), counts) + np.arange(total)]
        return ids, np.concatenate([[0], after])[np.searchsorted(starts, offsets)]


@functools.cache
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path)
