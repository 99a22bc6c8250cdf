"""Ranked lexical search: impact-ordered postings, scored a score at a time.

`build_index` writes the postings of all terms of all documents.  A shard is a run of documents of about SHARD_BYTES of
text that one task read; within it, each term has one row: its exact impacts in descending order, how many documents have
each, and those documents.  An impact is the part of a score that does not depend on the query, so it is fixed when the
index is written; the weight of a term comes from its document frequency when a query is asked.

`search` joins the index with the terms of the queries, block by block of at most BLOCK queries, and deals the rows by
(shard, block): a task holds one shard's postings of one block's terms, whatever the corpus.  For each query it takes the
(term, impact) groups in descending order of what they add to a score and adds them up.  What the groups to come can still
add to any document is known after every one; the task stops as soon as this bound leaves few documents that could be
among the best k, and completes the scores of these from the groups left.  A frequent term is one row in each shard, so
it never meets in one task; what leaves a shard is k documents a query.

Defined results: a document is a row, so rows that share an id, equal ones too, are ranked each.  Null or empty texts have
no terms: they count neither as documents nor as matches, and such a query finds nothing.  Equal scores rank by ascending
id, null ids last; ids are integers.  Equal queries are answered each.  Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxmill.llm._shingles import slices, text_bytes, word_starts
from voxmill.llm._store import cut

SHARD_BYTES = 16 << 20
BLOCK = 4096
#: Up to so many (query, term) pairs, some 50 bytes each, are sent to all tasks; beyond, the index is dealt by term.
FEW_PAIRS = 500_000
_IN_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: Bytes in lower case; those that end a term are blanks.
_PLAIN = np.where(_IN_TERM, np.arange(256), 32).astype(np.uint8)
_PLAIN[65:91] += 32
INDEX = "shard long, term string, impacts array<long>, counts array<int>, rows array<int>, ids array<long>"
#: No term is empty: the row under this one has the ids of a shard's documents, by their numbers there.
_IDS = ""


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, which one each occurrence is, text of each occurrence): maximal runs of letters and digits, A-Z lowered."""
    signs, offsets = text_bytes(texts)
    plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_PLAIN[signs]))
    parts = pc.split_pattern(plain, " ")
    words = parts.flatten().dictionary_encode()
    which = words.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    empty = pc.index(words.dictionary, _IDS).as_py()
    if empty >= 0:
        text, which = text[which != empty], which[which != empty]
    return words.dictionary, which.astype(np.int64), text


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with a term, and terms, of each piece of rows."""
    for batch in slices(batches):
        counts = np.diff(word_starts(batch.column("text"), _IN_TERM)[3])
        yield pa.RecordBatch.from_arrays([pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], ["n_docs", "n_terms"])


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows gathered to shards of about `limit` bytes of text; a longer text is a shard of its own."""
    held, size = [], 0
    for piece in slices(batches, limit=min(limit, 1 << 20)):
        held.append(piece)
        size += piece.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def _index_shard(table: pa.Table, shard: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    table = table.take(pc.sort_indices(table, [("id", "ascending")], null_placement="at_end"))
    dictionary, which, doc = terms(table.column("text").combine_chunks())
    lengths = np.bincount(doc, minlength=table.num_rows)
    place = pc.sort_indices(dictionary).to_numpy()
    order = np.empty(len(place), np.int64)
    order[place] = np.arange(len(place))
    key, tf = np.unique(order[which] * table.num_rows + doc, return_counts=True)
    term, doc = np.divmod(key, table.num_rows)
    m = 75 + 25 * lengths[doc] * n_docs // n_terms if n_terms else lengths[doc]
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
    by = np.argsort((term << 20) + ((1 << 20) - 1 - impact), kind="stable")
    term, doc, impact = term[by], doc[by], impact[by]
    groups = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(impact, prepend=-1))
    rows = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.append(groups, len(term)))
    in_groups, in_docs = np.searchsorted(groups, np.append(rows, len(term))), np.append(rows, len(term))
    names = dictionary.take(pa.array(place[term[rows]])).cast(pa.string())
    schema = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("impacts", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("rows", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("id").combine_chunks())
    yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([_IDS]), pa.array([None], schema.types[2]), pa.array([None], schema.types[3]), pa.array([None], schema.types[4]), ids], schema=schema)
    for at in range(0, len(rows), 20_000):
        part = slice(at, at + 20_001)
        g, d = in_groups[part], in_docs[part]
        lists = [_lists(impact[groups[g[0] : g[-1]]], g - g[0]), _lists(sizes[g[0] : g[-1]].astype(np.int32), g - g[0]), _lists(doc[d[0] : d[-1]].astype(np.int32), d - d[0])]
        count = len(g) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.full(count, shard)), names[at : at + count], *lists, pa.nulls(count, schema.types[5])], schema=schema)


def build_index(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the postings of all documents to path/postings and the two counts of the corpus to path/corpus."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    counted = docs.select("text").mapInArrow(_measure, "n_docs long, n_terms long")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_terms")]
    counted.agg(*sums).write.parquet(f"{path}/corpus")
    n_docs, n_terms = docs.sparkSession.read.parquet(f"{path}/corpus").first()

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, table in enumerate(_shards(batches, shard_bytes)):
            yield from _index_shard(table, first + number, n_docs, n_terms)

    docs.mapInArrow(index, INDEX).write.parquet(f"{path}/postings")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, term, times) of (query, text)."""
    for batch in slices(batches):
        dictionary, which, row = terms(batch.column("text"))
        pairs, times = np.unique(which * batch.num_rows + row, return_counts=True)
        term, row = np.divmod(pairs, max(batch.num_rows, 1))
        out = [batch.column("query").take(pa.array(row)), dictionary.take(pa.array(term)).cast(pa.string()), pa.array(times)]
        yield pa.RecordBatch.from_arrays(out, ["query", "term", "times"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in pieces of equal shard and block."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy() for c in ("shard", "block")])
        starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if held and tuple(keys[:, a]) != last:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = tuple(keys[:, a])
    if held:
        yield pa.concat_batches(held)


def best_rows(impacts: list[np.ndarray], counts: list[np.ndarray], rows: list[np.ndarray], weights: list[int], n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the k best by score, then row, of those above 0; one entry of each list for each term of a query."""
    lengths = np.array([len(i) for i in impacts])
    term = np.repeat(np.arange(len(impacts)), lengths)
    adds = np.concatenate(impacts) * np.repeat(np.array(weights, np.int64), lengths)
    sizes, docs = np.concatenate(counts).astype(np.int64), np.concatenate(rows)
    starts = np.cumsum(sizes) - sizes
    # What a term can still add falls to its next group's share, or to nothing, once a group is through.
    falls = adds - np.where(np.append(term[1:] == term[:-1], False), np.append(adds[1:], 0), 0)
    order = np.argsort(-adds, kind="stable")
    adds, sizes, starts = adds[order], sizes[order], starts[order]
    bound = np.cumsum(falls[::1][order])
    bound = bound[-1] - bound
    through = np.cumsum(sizes)
    scores = np.zeros(n_rows, np.int64)

    def postings(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = sizes[a:b]
        at = np.arange(n.sum()) + np.repeat(starts[a:b] - (np.cumsum(n) - n), n)
        return docs[at], np.repeat(adds[a:b], n)

    done, step = 0, 4 * k
    while done < len(adds):
        to = min(len(adds), int(np.searchsorted(through, (through[done - 1] if done else 0) + step)) + 1)
        found, added = postings(done, to)
        np.add.at(scores, found, added)
        done, step = to, 2 * step
        if n_rows > k and done < len(adds):
            least = np.partition(scores, n_rows - k)[n_rows - k]
            if least > bound[done - 1]:
                open_rows = scores + bound[done - 1] >= least
                if open_rows.sum() <= 4 * k:
                    found, added = postings(done, len(adds))
                    still = open_rows[found]
                    np.add.at(scores, found[still], added[still])
                    scores[~open_rows] = 0
                    done = len(adds)
    best = np.flatnonzero(scores)
    if len(best) > k:
        best = best[scores[best] >= np.partition(scores[best], len(best) - k)[len(best) - k]]
    best = best[np.lexsort((best, -scores[best]))][:k]
    return best, scores[best]


def _rank(k: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            names = group.column("term").to_pylist()
            at = names.index(_IDS)
            ids = group.column("ids")[at].values
            lists = {c: group.column(c) for c in ("impacts", "counts", "rows", "queries", "times")}
            cut_at = {c: x.offsets.to_numpy() for c, x in lists.items()}
            flat = {c: x.values.to_numpy(zero_copy_only=False) for c, x in lists.items()}
            weights = group.column("weight").to_numpy(zero_copy_only=False)
            part = lambda c, r: flat[c][cut_at[c][r] : cut_at[c][r + 1]]
            uses: dict[int, list[tuple[int, int]]] = {}
            for r in range(len(names)):
                if r != at and weights[r] > 0:
                    for query, times in zip(part("queries", r).tolist(), part("times", r).tolist(), strict=True):
                        uses.setdefault(query, []).append((r, int(weights[r]) * times))
            out_query, out_row, out_score = [], [], []
            for query, used in uses.items():
                best, scores = best_rows(*([part(c, r) for r, _ in used] for c in ("impacts", "counts", "rows")), [w for _, w in used], len(ids), k)
                out_query.append(np.full(len(best), query, np.int64))
                out_row.append(best)
                out_score.append(scores)
            if out_query:
                rows = np.concatenate(out_row)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_query)), ids.take(pa.array(rows)), pa.array(np.concatenate(out_score))], ["query", "doc_id", "score"])

    return rank


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(id of the query, rank, doc_id, score): the k best documents of the index for each query, those with a score above 0."""
    index = spark.read.schema(INDEX).parquet(f"{path}/postings")
    n_docs = spark.read.parquet(f"{path}/corpus").first()[0]
    numbered = cut(queries.select(F.col(id_column).alias("given"), F.col(text_column).cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()), "queries")
    asked = cut(numbered.select("query", "text").mapInArrow(_asked, "query long, term string, times long"), "asked")
    few = asked.count() <= FEW_PAIRS
    block = (F.col("query") - F.col("query") % BLOCK).alias("block")
    wanted = asked.groupBy(block, "term").agg(F.collect_list(F.struct("query", "times")).alias("uses"))
    words = asked.select("term").distinct()
    df = index.select("term", F.size("rows").alias("n")).join(F.broadcast(words) if few else words, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    uses = wanted.join(df.select("term", weight.alias("weight")), "term").select("block", "term", "weight", F.col("uses.query").alias("queries"), F.col("uses.times").alias("times"))
    uses = F.broadcast(uses) if few else uses
    none = F.array().cast("array<long>")
    # A shard's ids go to each block once.
    named = asked.select(block).distinct().select("block", F.lit(_IDS).alias("term"), F.lit(0).cast("long").alias("weight"), none.alias("queries"), none.alias("times"))
    dealt = index.join(uses, "term").union(index.where(F.col("term") == _IDS).join(named, "term")).repartition("shard", "block").sortWithinPartitions("shard", "block")
    found = dealt.mapInArrow(_rank(k), "query long, doc_id long, score long")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= k)
    return best.join(numbered, "query").select(F.col("given").alias(id_column), "rank", "doc_id", "score")
