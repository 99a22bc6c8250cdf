"""Quality classifier by co-training: what a text says and what its page tells about it teach each other.

Two views see a document apart: its text (words of a learnt lexicon, and the shape of the writing) and its metadata
(language, source, length).  For each of two targets, quality and toxicity, a logistic model of each view starts from the
same labelled rows; for some rounds each labels the documents that it is sure of for the other, in proportion to the
classes: the surest ones of all documents without a label in the sample.  Both are then calibrated on labelled rows that
neither saw, and their log odds add up to a score for every document.  A document goes if its quality is under a cut, or
if it is more likely toxic than clean.  The cut is the largest up to 1/2 under which no more than FALSE_REJECTS of the good
held-out rows lie.

Models are fitted on the driver, on LABELLED labelled rows at most: as many of each class of (quality, toxic) as there are,
up to an even share, chosen by a hash of doc_id and weighted by how many rows each stands for.  What they exchange is
EXCHANGED documents a round, view and target at most, as numbers of a bounded count.  Everything else, measuring all whole
texts first, runs in Spark's tasks.

Defined results: a null text is empty; null metadata is a value of its own; a document with several labels has the worst
of them; labels with a null count only for the other target; repeated rows are scored alike.  Without labelled rows of both
classes, a target's probability is the smoothed share of its labels (quality 1 and toxicity 0 without any); other columns
are ignored; an empty table has no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm._shingles import FEW_BYTES, signed, slices, text_bytes, words
from voxmill.llm._store import cut, small_batches

#: Labelled rows that models are fitted on at most.
LABELLED = 8000
ROUNDS, SURE, EXCHANGED = 3, 0.97, 300
#: Share of good held-out rows that the cut may cost.  A document is kept below this toxicity.
FALSE_REJECTS, MOST_TOXIC = 0.002, 0.5
#: Columns that values of metadata are hashed to, for each of language and source.
_VALUES = 256
#: Words of the lexicon for each target, and labelled documents that a word must be in.
LEXICON, LEAST_DOCS = 96, 4
_TARGETS = ("quality", "toxic")
_BINS = 10
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KINDS = np.zeros((5, 256), np.uint8)
_KINDS[0, 65:91] = 1
_KINDS[1, 48:58] = 1
_KINDS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KINDS[3, [32, *range(9, 14)]] = 1
_KINDS[4, 10] = 1


def shape(batch_texts: pa.Array, marks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Numbers for the writing of each text: shares of kinds of signs, words and how often they repeat."""
    signs, offsets = text_bytes(batch_texts)
    size = np.maximum(np.diff(offsets), 1)
    columns = [np.diff(np.concatenate([[0], np.cumsum(kind[signs], dtype=np.int64)])[offsets]) / size for kind in _KINDS]
    count = np.diff(bounds)
    row = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((marks, row))
    new = np.append(True, (np.diff(row[order]) != 0) | (marks[order][1:] != marks[order][:-1]))[: len(row)]
    distinct = np.bincount(row[order][new], minlength=len(count))
    again = np.append((np.diff(row) == 0) & (marks[1:] == marks[:-1]), False)[: len(row)]
    words_ = np.maximum(count, 1)
    columns += [np.log1p(count), distinct / words_, distinct / words_**0.8, np.bincount(row[again], minlength=len(count)) / words_, size / words_]
    return np.stack(columns, axis=1)


def _binned(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """One column for each bin of each number."""
    at = np.stack([np.searchsorted(e, values[:, k], "right") for k, e in enumerate(edges)], axis=1)
    out = np.zeros((len(values), len(edges) * _BINS), np.float32)
    out[np.arange(len(values))[:, None], at + np.arange(len(edges)) * _BINS] = 1
    return out


def _edges(values: np.ndarray) -> np.ndarray:
    return np.quantile(values, np.arange(1, _BINS) / _BINS, axis=0).T


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights by Newton's method, the last one constant; a row counts `times`."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (times * p * (1 - p) + 1e-6)) @ x + np.diag(ridge), x.T @ (times * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-3:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1].astype(np.float32) + w[-1]


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


@dataclass
class Classifier:
    """Both views of both targets, fitted and calibrated; small enough for every task."""

    lexicon: np.ndarray
    text_edges: np.ndarray
    size_edges: np.ndarray
    #: target -> [(weights, calibration) of text, of metadata], log odds of the target
    heads: dict[str, tuple] = field(default_factory=dict)
    #: shares of held-out rows: right ones of each target, good and clean ones that go, bad and toxic ones that stay
    held_out: dict[str, float] = field(default_factory=dict)
    least_quality: float = 0.5

    def text_numbers(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Which words of the lexicon a text has, and its shape."""
        marks, bounds = words(batch.column("text"), in_word=_LETTERS)
        present = np.zeros((batch.num_rows, len(self.lexicon)), np.float32)
        if len(self.lexicon) and len(marks):
            at = np.minimum(np.searchsorted(self.lexicon, marks), len(self.lexicon) - 1)
            known = self.lexicon[at] == marks
            present[np.repeat(np.arange(batch.num_rows), np.diff(bounds))[known], at[known]] = 1
        return present, shape(batch.column("text"), marks, bounds)

    def text_view(self, batch: pa.RecordBatch) -> np.ndarray:
        present, shapes = self.text_numbers(batch)
        return np.hstack([present, _binned(shapes, self.text_edges)])

    def metadata_view(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((batch.num_rows, 2 * _VALUES), np.float32)
        for at, name in ((0, "lang"), (_VALUES, "source")):
            for k, value in enumerate(batch.column(name).to_pylist()):
                out[k, at + zlib.crc32(f"{name}={value}".encode()) % _VALUES] = 1
        return np.hstack([out, _binned(_size(batch), self.size_edges)])

    def measured_view(self, batch: pa.RecordBatch) -> np.ndarray:
        """The text view of measured rows."""
        bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        present = np.unpackbits(bits, axis=1, count=len(self.lexicon)).astype(np.float32)
        shapes = np.array(batch.column("shape").to_pylist(), np.float64).reshape(batch.num_rows, -1)
        return np.hstack([present, _binned(shapes, self.text_edges)])

    def scores(self, target: str, text: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        views, prior = self.heads[target]
        if views is None:
            same = np.full(len(text), _probability(np.float64(prior)))
            return same, same, same
        one, two = (c[0] * _odds(x, w) + c[1] for x, (w, c) in zip((text, metadata), views, strict=True))
        return _probability(one), _probability(two), _probability(one + two - prior)


def _size(batch: pa.RecordBatch) -> np.ndarray:
    return np.log1p(np.nan_to_num(np.maximum(batch.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64), 0), nan=0.0))[:, None]


def _words_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=FEW_BYTES):
        marks, bounds = words(batch.column("text"), in_word=_LETTERS)
        each = [np.unique(marks[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        row = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(each))), *(batch.column(t).take(row) for t in (*_TARGETS, "times"))], ["word", *_TARGETS, "times"])


def _lexicon(sample: DataFrame) -> np.ndarray:
    """Words whose share of a class's documents differs most surely, for each target."""
    counted = sample.mapInArrow(_words_of_sample, "word long, quality int, toxic int, times double").groupBy("word")
    classes = [(t, v) for t in _TARGETS for v in (0, 1)]
    weighed = [F.sum(F.when(F.col(t) == v, F.col("times")).otherwise(0.0)).alias(f"{t}{v}") for t, v in classes]
    counts = counted.agg(F.count("*").alias("docs"), *weighed)
    totals = sample.agg(*weighed).first()
    found = set()
    for t in _TARGETS:
        n = [totals[f"{t}{v}"] or 0.0 for v in (0, 1)]
        rate = [(F.col(f"{t}{v}") + 0.5) / F.lit(n[v] + 1.0) for v in (0, 1)]
        both = (F.col(f"{t}0") + F.col(f"{t}1") + 1.0) / F.lit(n[0] + n[1] + 2.0)
        z = F.abs(rate[0] - rate[1]) / F.sqrt(F.greatest(both * (1 - both), F.lit(1e-9)) * F.lit(1 / (n[0] + 1) + 1 / (n[1] + 1)))
        rows = counts.where(f"docs >= {LEAST_DOCS} and {t}0 + {t}1 > 0").orderBy(z.desc(), "word").limit(LEXICON).select("word").collect()
        found |= {r.word for r in rows}
    return np.sort(np.array(list(found), np.int64).view(np.uint64))


_MEASURED = "doc long, bits binary, shape array<float>, lang string, source string, n_chars long"


def _measure(model: Classifier, carried: list[str]) -> callable:
    """What the models need of each row: which words of the lexicon it has, its shape and its metadata."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=FEW_BYTES):
            present, shapes = model.text_numbers(batch)
            bits = pa.array([row.tobytes() for row in np.packbits(present.astype(bool), axis=1)], pa.binary())
            columns = [batch.column("doc"), bits, pa.array(list(shapes.astype(np.float32)), pa.list_(pa.float32())), *(batch.column(c) for c in ("lang", "source", "n_chars", *carried))]
            yield pa.RecordBatch.from_arrays(columns, [*(part.split()[0] for part in _MEASURED.split(", ")), *carried])

    return run


def _surest(model: Classifier, weights: dict[str, list[np.ndarray]], taken: dict[str, set[int]]) -> callable:
    """Of each batch, the measured rows that a view is surest of: at most EXCHANGED for each target, view and value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = None
        for batch in batches:
            if not batch.num_rows:
                continue
            views, docs = [model.measured_view(batch), model.metadata_view(batch)], batch.column("doc").to_numpy(zero_copy_only=False)
            for target, of in weights.items():
                free = ~np.isin(docs, np.array(sorted(taken[target]), np.int64))
                for teacher in (0, 1):
                    p = _probability(_odds(views[teacher], of[teacher]))
                    for value, sure in ((1, p), (0, 1 - p)):
                        picked = np.flatnonzero(free & (sure >= SURE))
                        picked = picked[np.argsort(-sure[picked], kind="stable")][:EXCHANGED]
                        part = batch.take(pa.array(picked))
                        same = [pa.array([x] * len(picked), t) for x, t in ((target, pa.string()), (teacher, pa.int32()), (value, pa.int32()))]
                        names = names or [*part.schema.names, "target", "teacher", "value", "sure"]
                        yield pa.RecordBatch.from_arrays([*part.columns, *same, pa.array(sure[picked].astype(np.float64))], names)

    return run


def _exchanged(pool: DataFrame, model: Classifier, weights: dict, taken: dict, shares: dict[str, float]) -> pa.RecordBatch | None:
    """The documents that each view labels for the other in one round, out of all."""
    sure = pool.mapInArrow(_surest(model, weights, taken), f"{_MEASURED}, target string, teacher int, value int, sure double")
    group, order = ["target", "teacher", "value"], [F.desc("sure"), F.xxhash64("doc"), "doc"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    # The surest of each part first, so that none of the few groups is gathered whole.
    parts = sure.withColumn("place", place(*group, F.pmod(F.xxhash64("doc"), F.lit(64)))).where(F.col("place") <= EXCHANGED)
    most = F.lit(0)
    for target, share in shares.items():
        for value in (0, 1):
            most = F.when((F.col("target") == target) & (F.col("value") == value), max(1, round(EXCHANGED * (share if value else 1 - share)))).otherwise(most)
    picked = parts.withColumn("place", place(*group)).where(F.col("place") <= most).drop("place")
    rows = picked.dropDuplicates(["target", "doc"]).toArrow().combine_chunks()
    return rows.to_batches()[0] if rows.num_rows else None


def _sample(docs: DataFrame, labels: DataFrame, labelled: int) -> DataFrame:
    """Labelled documents, an even share of each class at most, and how many each stands for (one on average)."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    known = cut(known.where("quality is not null or toxic is not null"), "known")
    classes = sorted(known.groupBy(*_TARGETS).count().collect(), key=lambda r: r["count"])
    left, parts, whole = labelled, [], sum(r["count"] for r in classes)
    for k, row in enumerate(classes):
        take = min(row["count"], left // (len(classes) - k))
        left -= take
        here = known.where(F.col("quality").eqNullSafe(row.quality) & F.col("toxic").eqNullSafe(row.toxic))
        parts.append((here.orderBy(F.xxhash64("doc"), "doc").limit(take), row["count"] / max(take, 1), take))
    total = sum(take for _, _, take in parts)
    out = None
    for part, times, _ in parts:
        part = part.withColumn("times", F.lit(times * total / whole))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = known.withColumn("times", F.lit(1.0))
    # At most `labelled` rows of four numbers.
    return cut(docs.join(F.broadcast(out), "doc").dropDuplicates(["doc"]), "sample")


def fit(docs: DataFrame, labels: DataFrame, *, labelled: int = LABELLED, rounds: int = ROUNDS) -> tuple[Classifier, DataFrame | None]:
    """(classifier, measured docs).  docs: doc, text, lang, source, n_chars; labels: doc_id, quality, toxic."""
    sample = _sample(docs, labels, labelled)
    model = Classifier(_lexicon(sample), np.zeros((10, _BINS - 1)), np.zeros((1, _BINS - 1)))
    extra = [*_TARGETS, "times"]
    rows = sample.mapInArrow(_measure(model, extra), f"{_MEASURED}, quality int, toxic int, times double").toArrow().combine_chunks()
    measured = cut(docs.mapInArrow(_measure(model, []), _MEASURED), "measured")
    if not rows.num_rows:
        model.heads = {"quality": (None, 30.0), "toxic": (None, -30.0)}
        return model, measured
    rows = rows.take(np.argsort(rows["doc"].to_numpy())).combine_chunks().to_batches()[0]
    model.text_edges = _edges(np.array(rows.column("shape").to_pylist(), np.float64))
    model.size_edges = _edges(_size(rows))
    views, times = [model.measured_view(rows), model.metadata_view(rows)], rows.column("times").to_numpy()
    apart = np.random.default_rng(5).random(rows.num_rows) < 0.25
    told, weights, taught, shares, taken = {}, {}, {}, {}, {}
    for target, without in zip(_TARGETS, (30.0, -30.0), strict=True):
        y = rows.column(target).to_numpy(zero_copy_only=False).astype(np.float64)
        has = ~np.isnan(y)
        train, test = has & ~apart, has & apart
        share = ((times * y)[has].sum() + 0.5) / (times[has].sum() + 1)
        if min((y[has] == v).sum() for v in (0, 1)) < 10 or min(len(np.unique(y[x])) for x in (train, test)) < 2:
            model.heads[target] = (None, float(np.log(share / (1 - share))) if has.any() else without)
            continue
        told[target], shares[target], taken[target] = (y, test), share, set()
        taught[target] = [[(x[train], y[train], times[train])] for x in views]
        weights[target] = [_logistic(*parts[0]) for parts in taught[target]]
    pool = measured.where("doc is not null").join(F.broadcast(sample.select("doc")), "doc", "left_anti")
    for _ in range(rounds if told else 0):
        new = _exchanged(pool, model, weights, taken, shares)
        if new is None:
            break
        seen = [model.measured_view(new), model.metadata_view(new)]
        targets, teachers, values = (np.array(new.column(c).to_pylist()) for c in ("target", "teacher", "value"))
        for target in told:
            taken[target] |= set(new.column("doc").filter(pa.array(targets == target)).to_pylist())
            for pupil in (0, 1):
                at = (targets == target) & (teachers == 1 - pupil)
                taught[target][pupil].append((seen[pupil][at], values[at].astype(np.float64), np.ones(int(at.sum()))))
            weights[target] = [_logistic(*(np.concatenate(part) for part in zip(*parts, strict=True))) for parts in taught[target]]
    for target, (y, test) in told.items():
        calibrated = []
        for x, w in zip(views, weights[target], strict=True):
            slope, base = _logistic(_odds(x[test], w)[:, None], y[test], times[test])
            calibrated.append((w, (max(slope, 0.0), base)))
        model.heads[target] = (calibrated, float(np.log(shares[target] / (1 - shares[target]))))
        p = model.scores(target, views[0][test], views[1][test])[2]
        least = MOST_TOXIC
        if target == "quality":
            good = np.sort(p[y[test] == 1])
            least = model.least_quality = float(min(0.5, good[int(FALSE_REJECTS * len(good))]))
        weigh = lambda at: float((times[test] * at).sum() / max((times[test] * 1.0).sum(), 1e-9))  # noqa: E731, B023
        rate = lambda at, of: weigh(at & of) / max(weigh(of), 1e-9)
        one = y[test] == 1
        model.held_out |= {f"{target}_right": weigh((p >= least) == one), f"{target}_1_under": rate(p < least, one), f"{target}_0_over": rate(p >= least, ~one)}
    return model, measured


_SCORES = "doc_id long, quality_text double, quality_metadata double, p_quality double, toxic_text double, toxic_metadata double, p_toxic double, kept boolean"


def _score(shared, carried: list[str] | None) -> callable:
    """Scores of measured rows, or of rows with their text if carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Classifier = shared.value
        for batch in batches if carried is None else slices(batches, limit=FEW_BYTES):
            if not batch.num_rows:
                continue
            text, metadata = model.measured_view(batch) if carried is None else model.text_view(batch), model.metadata_view(batch)
            quality, toxic = (model.scores(t, text, metadata) for t in _TARGETS)
            kept = (quality[2] >= model.least_quality) & (toxic[2] < MOST_TOXIC)
            columns = [batch.column("doc"), *(pa.array(x, pa.float64()) for x in (*quality, *toxic)), pa.array(kept)]
            names = [part.split()[0] for part in _SCORES.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in carried or [])], [*names, *(carried or [])])

    return run


def _view(docs: DataFrame) -> DataFrame:
    columns = [F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), *((F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long")))]
    return docs.select(*columns)


def score_documents(docs: DataFrame, labels: DataFrame, carried: bool = False, **bounds: int) -> DataFrame:
    """doc_id, the probabilities of each view and of both, and kept, for every row of docs; with its columns if carried."""
    small_batches(docs.sparkSession)
    view = _view(docs)
    model, measured = fit(view, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if not carried:
        return measured.mapInArrow(_score(shared, None), _SCORES)
    own = "text string, lang string, source string, n_chars long"
    return view.mapInArrow(_score(shared, ["text", "lang", "source", "n_chars"]), f"{_SCORES}, {own}")
