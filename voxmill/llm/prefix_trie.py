"""Conversation prefix trie: MSD radix partitioning over dictionary ids of turns, multikey quicksort within small buckets.

`encode_turns` gives each distinct turn (role, text) an id, in the order of role and text.  Texts go through one shuffle,
by ranges and after each task has dropped its own repeats, so a turn that a third of all conversations open with is a few
rows there.  `sequences` orders the ids of each conversation, optionally behind the first turns of another one, and
`distinct_sequences` folds equal conversations into one row with their count, the smallest id and the digest of all ids.
For the digest, ids are sorted by ranges, so a large group of copies is many tasks' work, joined to chunks of text there;
one task then only feeds chunks to SHA-256, whose state cannot be split.

`prefix_trie` starts with one bucket, the root, and deals a bucket's sequences by their next id.  A part with over
`local_turns` turns left and more than one sequence becomes a bucket of the next round; its node comes from the counts of
the round.  All other parts are finished by multikey quicksort, many to a task, which emits their nodes.  As copies are
folded, rounds go on only while many different sequences share a prefix.  What a bucket's parts add up to is summed for
all its ancestors at the end.

Defined results: null roles and texts are empty.  Rows without conv_id belong to no conversation.  Turns go by number,
null first; equal numbers by role, then text; repeated rows are turns of their own.  A table without conversations has no
nodes, not even a root.  Other columns may have any name.  The ids of one conversation, 12 bytes a turn, are held by one
task, its text never is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxmill.llm._store import cut

LOCAL_TURNS = 1 << 13
CHUNK_BYTES = 1 << 20
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in f"{NODE}, turn_id long".split(", ")] + [("top", pa.bool_())])
_EMPTY = hashlib.sha256(b"").hexdigest()
_KEY = "unhex(md5(concat(length(role), ':', role, text))) as key"


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of each batch."""
    for batch in batches:
        if batch.num_rows:
            yield from pa.Table.from_batches([batch]).group_by(batch.schema.names, use_threads=False).aggregate([]).to_batches()


def encode_turns(turns: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", base: Column | None = None, lead: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(dictionary, turns): (turn_id, role, text, key, words), and (conv_id, turn, turn_id, words, base, lead) of each turn.

    A conversation takes the first `lead` turns of conversation `base` in place of as many of its own; by default, none.
    """
    conv = F.col(conv_column).cast("long")
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_column, "role"), (text_column, "text"))]
    base, lead = base if base is not None else conv, lead if lead is not None else F.lit(0)
    kept = turns.where(conv.isNotNull())
    once = kept.select(*said).mapInArrow(_fewer, "role string, text string").repartitionByRange("role", "text")
    ordered = once.groupBy("role", "text").agg(F.lit(0)).select("role", "text").sortWithinPartitions("role", "text")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("words")
    dictionary = cut(ordered.select(F.monotonically_increasing_id().alias("turn_id"), "role", "text", F.expr(_KEY), words), "dictionary")
    keyed = kept.select(conv.alias("conv_id"), F.col(turn_column).alias("turn"), *said, base.cast("long").alias("base"), lead.cast("int").alias("lead"))
    keyed = keyed.select("conv_id", "turn", "base", "lead", F.expr(_KEY))
    return dictionary, keyed.join(dictionary.select("key", "turn_id", "words"), "key").drop("key")


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal rows begin and end."""
    n = len(columns[0])
    changes = np.flatnonzero(reduce(np.logical_or, (c[1:] != c[:-1] for c in columns))) + 1 if n else []
    starts = [0, *changes] if n else []
    return zip(starts, [*starts[1:], n], strict=True)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to a row for each conversation; the base comes first of those that share it."""
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    first: tuple = (None, [], [])
    now: tuple = (None, None, 0)
    ids, words = [], []

    def finish() -> None:
        nonlocal first
        base, conv, lead = now
        if conv is None:
            return
        own, own_words = np.concatenate(ids), np.concatenate(words)
        if conv == base:
            first = (base, own, own_words)
        elif lead and first[0] == base:
            own, own_words = np.concatenate([first[1][:lead], own[lead:]]), np.concatenate([first[2][:lead], own_words[lead:]])
        elif lead:
            own, own_words = own[lead:], own_words[lead:]
        found.append((conv, own, own_words))

    def out() -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(i) for _, i, _ in found)]).astype(np.int32)
        flat = [np.concatenate([f[k] for f in found]) if found else [] for k in (1, 2)]
        lists = [pa.ListArray.from_arrays(ends, pa.array(flat[0], pa.int64())), pa.ListArray.from_arrays(ends, pa.array(flat[1], pa.int32()))]
        keys = pa.array([hashlib.md5(i.tobytes(), usedforsecurity=False).digest() for _, i, _ in found], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), keys, *lists], ["conv_id", "key", "ids", "words"])

    for batch in batches:
        base, conv, lead, turn, length = (batch.column(c).to_numpy() for c in ("base", "conv_id", "lead", "turn_id", "words"))
        for a, b in _runs(base, conv):
            if (base[a], conv[a]) != now[:2]:
                finish()
                now, ids, words = (base[a], conv[a], int(lead[a])), [], []
            ids.append(turn[a:b])
            words.append(length[a:b])
        if found:
            yield out()
            found.clear()
    finish()
    if found:
        yield out()


def sequences(encoded: DataFrame) -> DataFrame:
    """(conv_id, key, ids, words): the turns of each conversation in order, and a digest of its ids."""
    dealt = encoded.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "turn_id")
    return dealt.mapInArrow(_ordered, "conv_id long, key binary, ids array<long>, words array<int>")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations sorted by (key, conv_id) to chunks of their ids as text, with the sequence of the first one."""
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        convs = batch.column("conv_id").to_numpy()
        firsts, counts, texts = [], [], []
        for a, b in _runs(keys):
            for at in range(a, b, CHUNK_BYTES // 20):
                part = convs[at : min(b, at + CHUNK_BYTES // 20)]
                firsts.append(at)
                counts.append(len(part))
                texts.append(",".join(map(str, part.tolist())))
        if firsts:
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c).take(pa.array(firsts)) for c in ("key", "conv_id", "ids", "words")}, "n": pa.array(counts, pa.int64()), "text": texts})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, conv_id) to a row for each key."""
    last, count, state = None, 0, None
    held: pa.RecordBatch | None = None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(held.column(c) for c in ("conv_id", "ids", "words")), pa.array([count]), pa.array([state.hexdigest()])], ["conv_id", "ids", "words", "n", "sha"])

    for batch in batches:
        out = []
        keys, counts, texts = batch.column("key").to_pylist(), batch.column("n").to_pylist(), batch.column("text")
        for i, key in enumerate(keys):
            if key != last:
                if held is not None:
                    out.append(done())
                last, count, state, held = key, 0, hashlib.sha256(), batch.slice(i, 1)
            elif count:
                state.update(b",")
            count += counts[i]
            state.update(texts[i].as_buffer())
        if out:
            yield pa.concat_batches(out)
    if held is not None:
        yield done()


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(conv_id, ids, words, n, sha) of each distinct sequence: its smallest conversation, how many there are, and the SHA-256 of all their ids in order."""
    chunks = sequences.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, conv_id long, ids array<long>, words array<int>, n long, text string")
    return chunks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_digested, "conv_id long, ids array<long>, words array<int>, n long, sha string")


class _Nodes:
    """Nodes of finished buckets; a parent is always put before its children."""

    def __init__(self) -> None:
        self.rows: list[list] = []

    def add(self, depth: int, parent: int, turn: int, words: int) -> int:
        # depth, parent, turn, words, smallest conversation, conversations, children, leaves, saved, digest
        self.rows.append([depth, parent, turn, words, None, 0, 0, 0, 0, _EMPTY])
        return len(self.rows) - 1

    def end(self, node: int, conv: int, n: int, sha: str) -> None:
        row = self.rows[node]
        row[4], row[5], row[9] = conv if row[4] is None else min(conv, row[4]), row[5] + n, sha

    def sort(self, depth: int, sequences: list[tuple]) -> None:
        """Multikey quicksort of sequences (ids, words, conv, n, sha) that share their first depth + 1 ids."""
        top = self.add(depth + 1, -1, sequences[0][0][depth], sequences[0][1][depth])
        stack = [(sequences, depth + 1, top)]
        while stack:
            some, at, node = stack.pop()
            if len(some) == 1:
                ids, words, *rest = some[0]
                for p in range(at, len(ids)):
                    node = self.add(p + 1, node, ids[p], words[p])
                self.end(node, *rest)
                continue
            ids = [s[0][at] if at < len(s[0]) else -1 for s in some]
            pivot = sorted((ids[0], ids[len(ids) // 2], ids[-1]))[1]
            more, less = [s for s, i in zip(some, ids, strict=True) if i > pivot], [s for s, i in zip(some, ids, strict=True) if i < pivot]
            same = [s for s, i in zip(some, ids, strict=True) if i == pivot]
            stack += [(part, at, node) for part in (more, less) if part]
            if pivot < 0:
                self.end(node, *same[0][2:])
            else:
                stack.append((same, at + 1, self.add(at + 1, node, pivot, same[0][1][at])))

    def out(self, parents: dict[int, int]) -> pa.RecordBatch:
        """All nodes, summed up; parents has the conversation of the bucket above each top."""
        rows = self.rows
        for row in reversed(rows):
            row[7] = row[7] or 1
            row[8] += (row[5] - 1) * row[3]
            if row[1] >= 0:
                up = rows[row[1]]
                up[4] = row[4] if up[4] is None else min(row[4], up[4])
                up[5] += row[5]
                up[6] += 1
                up[7] += row[7]
                up[8] += row[8]
        above = [parents[k] if row[1] < 0 else rows[row[1]][4] for k, row in enumerate(rows)]
        column = lambda k: [row[k] for row in rows]
        arrays = [column(4), column(0), above, column(5), column(6), column(7), column(8), column(9), column(2), [row[1] < 0 for row in rows]]
        return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, _NODE_ARROW, strict=True)], schema=_NODE_ARROW)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences sorted by (depth, node, digit) to the nodes of their buckets."""
    last, bucket = None, []
    nodes, parents = _Nodes(), {}

    def flush() -> None:
        if bucket:
            parents[len(nodes.rows)] = last[1]
            nodes.sort(last[0], bucket)

    for batch in batches:
        for depth, parent, digit, *rest in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "digit", "ids", "words", "conv_id", "n", "sha")), strict=True):
            if (depth, parent, digit) != last:
                flush()
                last, bucket = (depth, parent, digit), []
                if len(nodes.rows) > 20_000:
                    yield nodes.out(parents)
                    nodes, parents = _Nodes(), {}
            bucket.append(tuple(rest))
    flush()
    if nodes.rows:
        yield nodes.out(parents)


def prefix_trie(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie over distinct sequences: NODE and the turn_id of a node's last turn, null at the root."""
    live = sequences = cut(sequences, "sequences")
    root, total = sequences.agg(F.min("conv_id"), F.sum("n")).first()
    live = live.withColumn("node", F.lit(root).cast("long"))
    spark = sequences.sparkSession
    whole = spark.createDataFrame([(0, root, None, total, None, 0, [])] if root is not None else [], "depth long, node long, parent_conv_id long, n_convs long, turn_id long, own long, above array<struct<depth: long, node: long>>")
    large, parts, ends, children, rounds = [whole], [], [], [], []
    depth = 0
    while True:
        live = live.withColumn("digit", F.get("ids", F.lit(depth)))
        turns = F.sum(F.size("ids") - depth).alias("turns")
        counts = cut(live.groupBy("node", "digit").agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("child"), F.count("*").alias("seqs"), turns, F.max(F.get("words", F.lit(depth))).alias("words")), "counts")
        rounds.append(counts)
        ends.append(live.where("digit is null").select(F.lit(depth).cast("long").alias("depth"), "node", "sha"))
        children.append(counts.where("digit is not null").groupBy(F.lit(depth).cast("long").alias("depth"), "node").agg(F.count("*").alias("n_children")))
        big = counts.where(f"digit is not null and seqs > 1 and turns > {local_turns}").select("node", "digit", "child", "n_convs", "words")
        some = not big.isEmpty()
        rest = live.where("digit is not null")
        rest = rest.join(big.select("node", "digit"), ["node", "digit"], "left_anti") if some else rest
        parts.append(rest.select(F.lit(depth).alias("depth"), "node", "digit", "ids", "words", "conv_id", "n", "sha"))
        if not some:
            break
        above = F.array_append("above", F.struct("depth", "node"))
        new = big.join(large[-1].select("depth", "node", "above"), "node")
        new = new.select(F.lit(depth + 1).cast("long").alias("depth"), F.col("child").alias("node"), F.col("node").alias("parent_conv_id"), "n_convs", F.col("digit").alias("turn_id"), ((F.col("n_convs") - 1) * F.col("words")).alias("own"), above.alias("above"))
        large.append(cut(new, "large"))
        live = live.join(big.select("node", "digit", "child"), ["node", "digit"]).select("conv_id", "ids", "words", "n", "sha", F.col("child").alias("node"))
        live = cut(live, "live")
        depth += 1
    union = lambda tables: reduce(DataFrame.union, tables)
    dealt = union(parts).repartition("depth", "node", "digit").sortWithinPartitions("depth", "node", "digit")
    nodes = cut(dealt.mapInArrow(_finish, f"{NODE}, turn_id long, top boolean"), "nodes")
    # A bucket's leaves and savings go to it and to all buckets above it.
    tops = nodes.where("top").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("node")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    large = union(large)
    own = large.join(tops, ["depth", "node"], "left").join(union(children), ["depth", "node"], "left")
    shares = own.select(F.explode(F.array_append("above", F.struct("depth", "node"))).alias("to"), F.coalesce("n_leaves", F.when(F.col("n_children").isNull(), 1)).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + F.col("own")).alias("saved"))
    sums = shares.groupBy("to.depth", "to.node").agg(F.coalesce(F.sum("n_leaves"), F.lit(0)).cast("long").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    whole = own.select("depth", "node", "parent_conv_id", "n_convs", "turn_id", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children")).join(sums, ["depth", "node"]).join(union(ends), ["depth", "node"], "left")
    whole = whole.select(F.col("node").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(_EMPTY)).alias("ends_sha256"), "turn_id")
    return nodes.drop("top").union(whole)


def conversation_trie(turns: DataFrame, local_turns: int = LOCAL_TURNS, **columns) -> tuple[DataFrame, DataFrame]:
    """(dictionary, nodes) of a table of turns; columns as in `encode_turns`."""
    dictionary, encoded = encode_turns(turns, **columns)
    return dictionary, prefix_trie(distinct_sequences(sequences(encoded)), local_turns)
