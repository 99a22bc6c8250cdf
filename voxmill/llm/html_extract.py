"""The main text of web pages: gradient-boosted trees over DOM nodes, decoded from the root down.

Each node, elements and texts alike, is described by its own tag and names, those above and below it, its depth, the text,
links and marks in its subtree, and its siblings (`_dom.features`).  Two models of boosted trees, trained by Spark, tell
how likely some of a node's text is main text, and how likely all of it is.  Decoding finds the assignment of largest
joint probability in which a node is all main text, none, or mixed, and where what is in an all or none node is the same:
a dynamic program over the tree, so that a paragraph cannot contradict the comment section round it.

Labels: the pages at hand have none, so training pages are made of them.  The words of TRAIN_PAGES pages (the bound of the
sample, those with the smallest hashes) are laid out anew, LAYOUTS times each, with articles, menus, headers, footers,
sidebars, notices, adverts, forms and comments of many shapes, whose place is known (`_layouts`).  Every page is scored.

Defined results: a null or empty page, and one without text, gives an empty text.  Broken tags and cut-off pages are read
as far as they go.  Repeated rows give repeated results; rows are read one by one, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm._dom import Nodes, features
from voxmill.llm._layouts import MARK, Layout
from voxmill.llm._shingles import slices
from voxmill.llm._store import cut, new_path

TRAIN_PAGES = 400
LAYOUTS = 4
ROUNDS = 12
DEPTH = 5
SLICE_BYTES = 1 << 20


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, some, all) for the nodes with text of the pages laid out from each given page."""
    for batch in slices(batches):
        for source in batch.column("text").to_pylist():
            source = source or ""
            seen = Nodes()
            seen.parse(source)
            words = " ".join(t for t in seen.text if t).split()
            seed = zlib.crc32(source.encode())
            nodes = Nodes()
            for k in range(LAYOUTS):
                nodes.parse(Layout(words, seed + k).page())
            main = np.array([len(t) if t.startswith(MARK) else 0 for t in nodes.text], np.float64)
            nodes.text = [t.replace(MARK, "") for t in nodes.text]
            chars, end = np.array([len(t) for t in nodes.text], np.float64), np.array(nodes.end)
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (main > 0, chars > 0)]
            found, texts = (s[end] - s[:-1] for s in sums)
            keep = texts > 0
            rows = features(nodes)[keep].astype(np.float64)
            bounds = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            some, whole = (found > 0)[keep].astype(np.float64), (found == texts)[keep].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(bounds, pa.array(rows.ravel())), pa.array(some), pa.array(whole)], ["x", "some", "all"])


class Trees:
    """Boosted trees as full binary trees of one depth, to be asked about many rows at once."""

    def __init__(self, model: GBTClassificationModel, path: str):
        model.save(path)
        rows = SparkSession.active().read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
        nodes = {(r.treeID, r.id): r for r in rows}
        size = 2**DEPTH - 1
        self.feature, self.bound = np.zeros((len(model.treeWeights), size), np.int64), np.full((len(model.treeWeights), size), np.inf)
        self.value = np.zeros((len(model.treeWeights), size + 1))
        for k, weight in enumerate(model.treeWeights):
            stack = [(nodes[k, 0], 0, 0)]
            while stack:
                node, place, level = stack.pop()
                if level == DEPTH:
                    self.value[k, place - size] = weight * node.prediction
                elif node.leftChild < 0:
                    # A leaf above the last level sends all rows on to equal leaves.
                    stack += [(node, 2 * place + 1, level + 1), (node, 2 * place + 2, level + 1)]
                else:
                    self.feature[k, place], self.bound[k, place] = node.split.featureIndex, node.split.leftCategoriesOrThreshold[0]
                    stack += [(nodes[k, node.leftChild], 2 * place + 1, level + 1), (nodes[k, node.rightChild], 2 * place + 2, level + 1)]

    def logit(self, rows: np.ndarray) -> np.ndarray:
        out, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, bound, value in zip(self.feature, self.bound, self.value, strict=True):
            place = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                place = 2 * place + 1 + (rows[every, feature[place]] > bound[place])
            out += value[place - len(feature)]
        return 2 * out


def train(pages: DataFrame, html_column: str = "html") -> tuple[Trees, Trees] | None:
    """Models of "some of it is main text" and "all of it is"; none where there is no page."""
    sample = pages.select(F.col(html_column).cast("string").alias("text")).orderBy(F.xxhash64("text"), "text").limit(TRAIN_PAGES)
    rows = cut(sample.repartition(8, "text").mapInArrow(_labelled, "x array<double>, some double, all double"), "nodes")
    if rows.isEmpty():
        return None
    rows = cut(rows.select(array_to_vector("x").alias("features"), "some", "all"), "vectors")
    spark = rows.sparkSession
    fit = lambda label: Trees(GBTClassifier(labelCol=label, maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.4, maxBins=32, seed=7).fit(rows), new_path(spark, "trees"))
    # Many small jobs: both models side by side.
    with ThreadPool(2) as pool:
        some, whole = pool.map(inheritable_thread_target(spark)(fit), ["some", "all"])
    return some, whole


def decode(nodes: Nodes, some: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Which texts are main text, by the likeliest assignment without contradictions; some and whole are logits."""
    parent, depth = np.array(nodes.parent), np.array(nodes.depth)
    is_text = np.array([bool(t) for t in nodes.text])
    end = np.array(nodes.end)
    texts = np.concatenate([[0], np.cumsum(is_text)])
    silent = texts[end] == texts[:-1]
    log_some, log_none = -np.logaddexp(0, -some), -np.logaddexp(0, some)
    log_all, log_not = -np.logaddexp(0, -whole), -np.logaddexp(0, whole)
    # States: all, none, mixed.  A text is never mixed; nodes without text and roots have no say.
    score = np.stack([log_all, log_none, log_some + log_not], axis=1)
    score[is_text, 0] = log_some[is_text]
    score[silent | (parent < 0)] = 0
    score[is_text, 2] = -np.inf
    levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)] if len(depth) else []
    best = score.copy()
    for level in reversed(levels[1:]):
        up = parent[level]
        np.add.at(best[:, 0], up, best[level, 0])
        np.add.at(best[:, 1], up, best[level, 1])
        np.add.at(best[:, 2], up, best[level].max(axis=1))
    state = best.argmax(axis=1)
    state[parent < 0] = 2
    for level in levels[1:]:
        above = state[parent[level]]
        state[level] = np.where(above == 2, best[level].argmax(axis=1), above)
    return is_text & (state == 0)


def _texts(nodes: Nodes, kept: np.ndarray) -> list[str]:
    out = []
    for a, b in zip(nodes.roots, [*nodes.roots[1:], len(nodes.tag)], strict=True):
        pieces, skipped = [], False
        for k in range(a, b):
            if nodes.text[k]:
                if kept[k]:
                    pieces.append(" " + nodes.text[k] if nodes.apart[k] or skipped else nodes.text[k])
                skipped = not kept[k]
        out.append(" ".join("".join(pieces).split()))
    return out


def extract(pages: DataFrame, models: tuple[Trees, Trees] | None = None, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each page; without models, they are trained on words of the pages."""
    models = models or train(pages, html_column)
    id_type = pages.schema[id_column].dataType.simpleString()

    def main(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE_BYTES):
            nodes = Nodes()
            for source in batch.column("text").to_pylist():
                nodes.parse(source or "")
            rows = features(nodes)
            kept = decode(nodes, *(model.logit(rows) for model in models))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(_texts(nodes, kept), pa.string())], ["page_id", "url", "text"])

    asked = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("text"))
    found = asked.mapInArrow(main, f"page_id {id_type}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
