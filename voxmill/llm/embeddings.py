"""Near duplicates among embeddings by product quantisation, without a lost link.

Equal vectors of a label are one class, by partial aggregation; classes are searched.  A class lies in the inverted list
of its nearest coarse centroid, as codes of its residual's subspaces and the length of what the codes leave out.  A query
probes every list that can hold a vector within the radius (cosine 0.98 between unit vectors is a distance of 0.2): one
whose cell, half a space away from the query's own, begins within the radius.  In a list, distances are looked up in
tables of the query's residual against the codebooks; a vector stays if its looked-up distance is within the radius plus
its own error, so that by the triangle inequality none within the radius goes.  What stays is decided by the exact cosine.

Lists are dealt into tiles of a bounded size, and queries visit all tiles of their own list and of the probed lists that
come after it: of two lists, one probes the other, and what links counts for both sides.  Their number follows from the
largest label, as vectors of others are never compared.  Vectors travel in the precision that they came in.  A tile returns
for each vector the number of links and only as many of the links as join its parts together.  Codebooks are trained on a bounded sample;
every row is indexed, and the sample decides speed alone.

Defined results: a vector that is null, empty, zero, or holds nulls or non-finite numbers, and any vector with a null label
or null id, links with nothing; vectors of different lengths do not link; repeated rows are vectors of their own that link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm._graph import components
from voxmill.llm._store import cut

COSINE = 0.98
#: Vectors that codebooks are trained on; vectors of a list, on average; most lists; vectors of a tile.
TRAINED, PER_LIST, MOST_LISTS, TILE = 16_384, 256, 1024, 2048
_PARTS, _CODES = 8, 64


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, squared distances) of the nearest centre."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        at, _ = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Quantiser:
    """Coarse centroids and one codebook for each subspace of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.centres = np.unique(_means(sample, lists), axis=0)
        at, _ = _nearest(sample, self.centres)
        residuals = sample - self.centres[at]
        self.parts = [p for p in np.array_split(np.arange(self.width), _PARTS) if len(p)]
        self.books = [_means(residuals[:, p], _CODES) for p in self.parts]
        gaps = self.centres[:, None, :] - self.centres[None, :, :] if len(self.centres) <= 64 else None
        self.apart = np.sqrt((gaps**2).sum(axis=2)) if gaps is not None else np.sqrt(np.maximum((self.centres**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * self.centres @ self.centres.T, 0))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of what the codes leave out) of each vector."""
        at, _ = _nearest(x, self.centres)
        residuals = x - self.centres[at]
        found = [_nearest(residuals[:, p], book) for p, book in zip(self.parts, self.books, strict=True)]
        decoded = np.concatenate([book[codes] for book, (codes, _) in zip(self.books, found, strict=True)], axis=1)
        return at, np.stack([codes for codes, _ in found], axis=1).astype(np.uint8), np.sqrt(((residuals - decoded) ** 2).sum(axis=1))

    def probes(self, x: np.ndarray, own: np.ndarray, radius: float) -> list[np.ndarray]:
        """Lists that can hold a vector within the radius."""
        d = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(axis=1), 0)
        mine = d[np.arange(len(x)), own]
        # the way to the plane halfway between the own centre and the list's
        way = (d - mine[:, None]) / (2 * np.maximum(self.apart[own], 1e-9))
        near = way <= radius + 1e-6
        near[np.arange(len(x)), own] = True
        return [np.flatnonzero(row) for row in near]

    def looked_up(self, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of query residuals from coded residuals, from one table a subspace."""
        out = np.zeros((len(queries), len(codes)))
        for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True)):
            q = queries[:, p]
            table = np.maximum((q * q).sum(axis=1)[:, None] - 2 * q @ book.T + (book * book).sum(axis=1), 0)
            out += table[:, codes[:, k]]
        return np.sqrt(out)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """Rows in double precision, filled up with zeros, which changes no cosine of vectors of one length."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _unpacked(column: pa.Array, width: int) -> np.ndarray:
    """Vectors from their bytes, in single or double precision."""
    return np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * width else np.float64).astype(np.float64) for b in column.to_pylist()])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _radius(cosine: float) -> float:
    return float(np.sqrt(max(0.0, 2 - 2 * cosine)))


def _placed(shared, cosine: float) -> callable:
    """A resident row for each class, and a visitor row for each list that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser: Quantiser = shared.value
        for batch in batches:
            raw = _vectors(batch.column("vec"), quantiser.width)
            x = _unit(raw)
            own, codes, left_out = quantiser.encode(x)
            probes = [p[p >= o] for p, o in zip(quantiser.probes(x, own, _radius(cosine)), own, strict=True)]
            many = np.array([len(p) for p in probes], int)
            row = np.concatenate([np.arange(len(x)), np.repeat(np.arange(len(x)), many)])
            where = np.concatenate([own, *probes])
            visitor = np.arange(len(row)) >= len(x)
            short = raw.astype(np.float32)
            packed = short if (short == raw).all() else raw
            vectors = pa.array([v.tobytes() for v in packed], pa.binary())
            taken = batch.drop_columns(["vec"]).append_column("vec", vectors).take(pa.array(row))
            extra = [pa.array(where, pa.int32()), pa.array(own[row], pa.int32()), pa.array(visitor), pa.array([c.tobytes() for c in codes], pa.binary()).take(pa.array(row)), pa.array(left_out[row])]
            yield pa.RecordBatch.from_arrays([*taken.columns, *extra], [*taken.schema.names, "list", "own", "visitor", "codes", "left_out"])

    return run


def _links(shared, cosine: float) -> callable:
    """From rows in order of tile, residents first: (cid, n, null) counts of queries and (cid, null, other) links that join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser: Quantiser = shared.value
        radius, now, held = _radius(cosine), None, {}

        def close() -> None:
            if held.get("rows"):
                whole = pa.Table.from_batches(held.pop("rows")).combine_chunks().to_batches()[0]
                x = _unit(_unpacked(whole.column("vec"), quantiser.width))
                codes = np.frombuffer(b"".join(whole.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
                held.update(x=x, codes=codes, left_out=whole.column("left_out").to_numpy(), cid=whole.column("cid").to_numpy(), n=whole.column("n").to_numpy(), part=np.arange(len(x)))

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("label", "width", "list", "tile", "visitor")), strict=True))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at] and to - at < 512:
                    to += 1
                piece, (*tile, visitor) = batch.slice(at, to - at), keys[at]
                if tile != now:
                    now, held = tile, {}
                if not visitor:
                    held.setdefault("rows", []).append(piece)
                else:
                    close()
                    if held:
                        yield from _visit(quantiser, held, piece, tile[2], radius, cosine)
                at = to

    return run


def _visit(quantiser: Quantiser, held: dict, piece: pa.RecordBatch, of: int, radius: float, cosine: float) -> Iterator[pa.RecordBatch]:
    q, me = _unit(_unpacked(piece.column("vec"), quantiser.width)), piece.column("cid").to_numpy()
    near = quantiser.looked_up(q - quantiser.centres[of], held["codes"]) <= radius + held["left_out"] + 1e-6
    a, b = np.nonzero(near)
    exact = np.concatenate([np.einsum("ij,ij->i", q[a[k : k + 65536]], held["x"][b[k : k + 65536]]) for k in range(0, len(a), 65536)]) if len(a) else np.zeros(0)
    linked = (exact >= cosine) & (me[a] != held["cid"][b])
    a, b = a[linked], b[linked]
    counts = np.bincount(a, weights=held["n"][b], minlength=len(q)).astype(np.int64)
    # A vector of another list comes here alone, and is not visited in turn.
    across = (piece.column("own").to_numpy() != of)[a]
    back = np.bincount(b[across], weights=piece.column("n").to_numpy()[a[across]], minlength=len(held["cid"])).astype(np.int64)
    ends: list[tuple[int, int]] = []
    for k, some in zip(*_runs(a, b), strict=True):
        parts = np.unique(held["part"][some])
        firsts = [int(some[np.argmax(held["part"][some] == p)]) for p in parts]
        ends += [(int(me[k]), int(held["cid"][f])) for f in firsts]
        if len(parts) > 1:
            held["part"][np.isin(held["part"], parts)] = parts[0]
    has, returned = np.flatnonzero(counts), np.flatnonzero(back)
    cid = np.concatenate([me[has], held["cid"][returned], [e[0] for e in ends]]).astype(np.int64)
    n = pa.array([*counts[has].tolist(), *back[returned].tolist(), *[None] * len(ends)], pa.int64())
    other = pa.array([*[None] * (len(has) + len(returned)), *(e[1] for e in ends)], pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(cid), n, other], ["cid", "n", "other"])


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    if not len(a):
        return [], []
    cuts = np.flatnonzero(np.diff(a)) + 1
    return a[np.concatenate([[0], cuts])].tolist(), np.split(b, cuts)


def link_vectors(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", *, trained: int = TRAINED, per_list: int = PER_LIST, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"), F.col(label_column).cast("string").alias("label"))
    sound = F.expr("vec_id is not null and label is not null and size(vec) > 0 and forall(vec, v -> v is not null and not isnan(v) and abs(v) <= 1.7976931348623157e308) and exists(vec, v -> v <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = rows.where("sound").drop("sound")
    classes = cut(rows.groupBy("label", "vec").agg(F.min("vec_id").alias("head"), F.count("*").alias("n")), "vectors")
    classes = cut(classes.withColumns({"cid": F.monotonically_increasing_id(), "width": F.size("vec")}), "classes")
    many, width = classes.groupBy("label").agg(F.count("*").alias("n"), F.max("width").alias("width")).agg(F.max("n"), F.max("width")).first()
    if not many:
        return alone.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    sample = classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(trained).toArrow().combine_chunks()
    quantiser = Quantiser(_unit(_vectors(sample["vec"].combine_chunks() if isinstance(sample["vec"], pa.ChunkedArray) else sample["vec"], width)), int(min(MOST_LISTS, max(1, many // per_list))))
    shared = spark.sparkContext.broadcast(quantiser)
    plain = classes.select("cid", "n", "label", "width", "vec")
    placed = cut(plain.mapInArrow(_placed(shared, cosine), "cid long, n long, label string, width int, vec binary, list int, own int, visitor boolean, codes binary, left_out double"), "placed")
    sizes = placed.where("not visitor").groupBy("label", "width", "list").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    tiled = placed.join(cut(sizes, "sizes"), ["label", "width", "list"])
    tiled = tiled.withColumn("tile", F.explode(F.when(F.col("visitor"), F.expr("sequence(0, tiles - 1)")).otherwise(F.array(F.expr("cast(pmod(xxhash64(cid), tiles) as int)"))))).drop("tiles")
    dealt = tiled.repartition("label", "width", "list", "tile").sortWithinPartitions("label", "width", "list", "tile", "visitor", "cid")
    found = cut(dealt.mapInArrow(_links(shared, cosine), "cid long, n long, other long"), "links")
    counts = found.where("n is not null").groupBy("cid").agg(F.sum("n").alias("links"))
    parts = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")), "parts").withColumnsRenamed({"id": "cid"})
    whole = classes.select("cid", "label", "vec", "head", "n").join(counts, "cid", "left").join(parts, "cid", "left")
    whole = cut(whole.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("n") - 1, "component": F.coalesce("component", "cid")}), "whole")
    roots = whole.groupBy("component").agg(F.min("head").alias("root"))
    told = cut(whole.join(roots, "component").select("label", "vec", "links", "root"), "told")
    linked = rows.join(told, ["label", "vec"]).select("vec_id", F.col("links").alias("n_links"), F.col("root").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
