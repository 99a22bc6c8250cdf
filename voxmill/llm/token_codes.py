"""Token ids on disk as directly addressable codes: any id can be read without decoding a block.

An id is split into chunks of eight bits, lowest first.  Level k holds the k-th chunks of all ids that have one, in
order, and a bitmap with a set bit where the id goes on in level k + 1.  A rank directory counts the set bits before
every 512th place, so the place of an id in the next level takes one look at the directory and at most 64 bytes.

A file row is a segment: whole documents of one range of doc_id, about a million bytes of text.  Files are written by
Spark, so they lie wherever Spark can write.

Defined results: a null or empty text has the end id alone; rows with a null doc_id come first; rows with equal doc_id
follow each other, in order of a hash of their text; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm._shingles import slices
from voxmill.llm._tokens import END_ID, encoder

_BLOCK = 512
_SEGMENT = "part int, segment int, before long, tokens long, doc_ids array<long>, ends array<long>, codes binary"
_SET_BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """The code of an array of ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest > 0xFF
        bitmap = np.packbits(goes_on, bitorder="little")
        padded = np.concatenate([bitmap, np.zeros(-len(bitmap) % (_BLOCK // 8), np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_SET_BITS[padded].reshape(-1, _BLOCK // 8).sum(axis=1, dtype=np.int64))])[:-1] if len(padded) else np.zeros(0)
        levels.append((len(rest), ranks.astype("<u4").tobytes() + bitmap.tobytes() + (rest & 0xFF).astype(np.uint8).tobytes()))
        rest = rest[goes_on] >> 8
        if not len(rest):
            break
    header = np.array([len(levels), *(n for n, _ in levels)], "<u4").tobytes()
    return header + b"".join(body for _, body in levels)


class Codes:
    """Reads ids from a code in place."""

    def __init__(self, code: bytes):
        depth = int(np.frombuffer(code, "<u4", 1)[0])
        at = 4 * (depth + 1)
        self.levels = []
        for n in np.frombuffer(code, "<u4", depth, 4).tolist():
            blocks, width = -(-n // _BLOCK), -(-n // 8)
            ranks = np.frombuffer(code, "<u4", blocks, at)
            bitmap = np.frombuffer(code, np.uint8, width, at + 4 * blocks)
            chunks = np.frombuffer(code, np.uint8, n, at + 4 * blocks + width)
            self.levels.append((n, ranks, bitmap, chunks))
            at += 4 * blocks + width + n

    def __len__(self) -> int:
        return self.levels[0][0]

    def _rank(self, level: int, i: int) -> int:
        """Set bits before place i."""
        n, ranks, bitmap, _ = self.levels[level]
        if i >= n:
            return self.levels[level + 1][0] if level + 1 < len(self.levels) else 0
        block = i // _BLOCK
        part = bitmap[block * _BLOCK // 8 : i // 8]
        within = int(_SET_BITS[part].sum()) + int(_SET_BITS[bitmap[i // 8] & ((1 << i % 8) - 1)])
        return int(ranks[block]) + within

    def __getitem__(self, i: int) -> int:
        value, shift = 0, 0
        for level, (_, _, bitmap, chunks) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i // 8] >> (i % 8) & 1:
                break
            i, shift = self._rank(level, i), shift + 8
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """ids a to b (without b); nothing outside that range is read but two rank blocks a level."""
        out = np.zeros(b - a, np.uint32)
        places, shift = np.arange(b - a), 0
        for level, (_, _, bitmap, chunks) in enumerate(self.levels):
            if a == b:
                break
            out[places] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(bitmap[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 : a % 8 + b - a]
            places = places[bits.astype(bool)]
            a, b, shift = self._rank(level, a), self._rank(level, b), shift + 8
        return out


def _write_segments(vocabulary: str) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, segment = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches):
            ids, bounds = encoder(vocabulary).encode(batch.column("text"))
            ends = bounds[1:] + np.arange(1, len(bounds))
            whole = np.insert(ids, bounds[1:], END_ID)
            doc_ids = batch.column("doc").to_pylist()
            values = [[part], [segment], [before], [len(whole)], [doc_ids], [ends.tolist()], [encode(whole)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["part", "segment", "before", "tokens", "doc_ids", "ends", "codes"])
            before, segment = before + len(whole), segment + 1

    return run


def write_codes(docs: DataFrame, path: str, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> None:
    """Writes the ids of all texts, each followed by the end id, in ascending order of doc_id."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    # Ranges are drawn from ids and hashes: no text reaches the driver, and rows that share an id still split.
    rows = rows.withColumn("print", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.col("doc").asc_nulls_first(), "print")
    ordered = ordered.sortWithinPartitions(F.col("doc").asc_nulls_first(), "print", F.col("text").asc_nulls_first())
    ordered.mapInArrow(_write_segments(vocabulary), _SEGMENT).write.parquet(path)


def _bases(files: DataFrame) -> dict[int, int]:
    """Ids before each part: one number for each file task, added up on the driver."""
    totals = files.groupBy("part").agg(F.sum("tokens").alias("tokens")).orderBy("part").collect()
    out, before = {}, 0
    for row in totals:
        out[row.part] = before
        before += row.tokens
    return out


def _read_documents(bases: dict[int, int]) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, doc_ids, ends, code = (batch.column(c)[row].as_py() for c in ("part", "before", "doc_ids", "ends", "codes"))
                codes, start, base = Codes(code), 0, bases[part] + before
                out = [[], [], [], []]
                for doc, end in zip(doc_ids, ends, strict=True):
                    tokens = codes.slice(start, end).astype("<u4").tobytes()
                    for column, value in zip(out, (doc, base + start, end - start, tokens), strict=True):
                        column.append(value)
                    start = end
                    if len(out[0]) >= 500:
                        yield _documents(out)
                        out = [[], [], [], []]
                yield _documents(out)

    return run


def _documents(columns: list[list]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "n_tokens", "tokens"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and tokens (little-endian 32-bit ids) of every document in the files."""
    files = spark.read.schema(_SEGMENT).parquet(path)
    return files.select("part", "before", "doc_ids", "ends", "codes").mapInArrow(_read_documents(_bases(files)), "doc_id long, start long, n_tokens long, tokens binary")


def _looked_up(asked: pa.Table, segment: pa.Table) -> pa.Table:
    """All positions asked of one segment, from one copy of its codes."""
    codes = Codes(segment.column("codes")[0].as_py())
    found = [int(codes[within]) for within in asked.column("within").to_pylist()]
    return pa.table({"position": asked.column("position"), "token": pa.array(found, pa.int64())})


def read_tokens(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """position and token for a table of positions in the whole corpus, each id read straight from its segment.

    Positions meet a narrow directory of segments first, bucket by bucket of positions; codes are read for the segments
    that were asked for alone, and each goes to one task with all that is asked of it.
    """
    files = spark.read.schema(_SEGMENT).parquet(path)
    bases = spark.createDataFrame(list(_bases(files).items()), "part int, base long")
    bucket = 1 << 20
    directory = files.select("part", "segment", "before", "tokens").join(F.broadcast(bases), "part").withColumn("first", F.col("base") + F.col("before"))
    directory = directory.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor((F.col("first") + F.col("tokens") - 1) / bucket))))
    asked = positions.select(F.col("position").cast("long").alias("position")).withColumn("bucket", F.floor(F.col("position") / bucket))
    inside = (asked.bucket == directory.bucket) & asked.position.between(F.col("first"), F.col("first") + F.col("tokens") - 1)
    met = asked.join(directory, inside).select("part", "segment", "position", (F.col("position") - F.col("first")).alias("within"))
    wanted = met.select(F.col("part").alias("p"), F.col("segment").alias("s")).distinct()
    held = spark.read.schema(_SEGMENT).parquet(path).select("part", "segment", "codes").join(wanted, (F.col("part") == F.col("p")) & (F.col("segment") == F.col("s")), "left_semi")
    held = held.select(F.col("part").alias("p"), F.col("segment").alias("s"), "codes")
    return met.groupBy("part", "segment").cogroup(held.groupBy("p", "s")).applyInArrow(_looked_up, "position long, token long")
