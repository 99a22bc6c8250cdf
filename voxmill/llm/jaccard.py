"""N-gram Jaccard join: exact links between documents whose sets of word shingles overlap by three quarters or more.

The document by shingle incidence matrix is multiplied by its transpose in blocks.  What may meet in a block comes from
a prefix filter: two sets with a Jaccard similarity of 3/4 share one of the first n - ceil(3n/4) + 1 shingles of each, in
any order that all documents keep to.  Ours puts shingles that one document alone has first and those of many documents
late, so that a passage that many documents share brings together only documents that hold little else.

1. One pass over all texts gives each document its set size and a 128-bit set fingerprint, and counts the most frequent
   shingles, which come last.  Documents with equal sets form a class; only its smallest id goes on.
2. A second pass writes the incidence of the half of the other shingles that has the smaller fingerprints.  One shuffle
   by shingle counts their sets exactly and drops what one set alone has; one by set, in order of the counts, cuts the
   prefixes.  A set with fewer counted shingles than its prefix needs takes the missing ones from the rest, uncounted.
   Sets with a common prefix shingle are tied to the list's first set.  Ties are not links: their components, the
   blocks, only bound where links can be.
3. Each block gets its texts once and is multiplied: overlap counts accumulate by column, densely for frequent columns
   and as co-occurring row pairs for rare ones, and a pair stays if 7 * overlap >= 3 * (size + size).  Only a spanning
   forest of a block's links leaves it.  A block over the size bound is dealt into tiles; documents outside its main
   component then visit the other tiles, in slices of the same bound, which compares what no link has joined so far.  Where
   tiles are many, they visit those alone in which a prefix shingle, by its place in the order, still allows a link.  So no
   product is larger than two bounds, however large a block.

Defined results: a null or empty text, or one without words, has an empty set and links with nothing.  A text under five
words has its whole word sequence as one shingle.  Rows with a null id count their shingles and have a null component.
Rows that share an id are one document for linking: what either links with, both do.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxmill.llm._graph import components
from voxmill.llm._shingles import FEW_BYTES, mix, runs_of, shingles, signed, slices, words
from voxmill.llm._store import cut, drop, small_batches

#: How many of the most frequent shingles go last in the order.  It changes which blocks form, never which links hold.
FREQUENT = 1 << 18
#: A block within these is one task's product; a larger one is dealt into tiles.
BLOCK_DOCS, BLOCK_SHINGLES = 1536, 1_000_000
_PIVOTS = 32
#: In a block of up to so many tiles, what its main component lacks visits all of them; in a larger one, those it may link in.
FEW_TILES = 8
#: Up to so many members of blocks, some 50 bytes each, are sent to all tasks; beyond, texts are dealt by document first.
FEW_MEMBERS = 1_000_000


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    found, bounds = shingles(*words(batch.column("text")))
    return [np.unique(found[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _set_print(items: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one, two = mix(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), mix(items + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (0, doc, size, fingerprint) of documents and (1, null, count, shingle, 0) of shingles met three times or more
    among some millions: in a task's share of the corpus, that is what frequent means."""

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        values, counts = values[counts >= 3], counts[counts >= 3]
        return _rows(1, pa.nulls(len(values), pa.int64()), counts, signed(values), np.zeros(len(values), np.int64))

    held, amount = [], 0
    for batch in slices(batches, limit=FEW_BYTES):
        sets = _sets(batch)
        prints = [_set_print(s) for s in sets]
        yield _rows(0, batch.column("doc"), [len(s) for s in sets], [p[0] for p in prints], [p[1] for p in prints])
        held += sets
        amount += sum(map(len, sets))
        if amount > 1_500_000:
            yield counted(held)
            held, amount = [], 0
    if held:
        yield counted(held)


def _rows(kind: int, doc, n, s1, s2) -> pa.RecordBatch:
    columns = [pa.array(x, pa.int64()) if not isinstance(x, pa.Array) else x for x in (doc, n, s1, s2)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind), pa.int32()), *columns], ["kind", "doc", "n", "s1", "s2"])


def _counted(items: np.ndarray) -> np.ndarray:
    """Which shingles have their documents counted: a half of them by fingerprint, the same half everywhere."""
    return items >> np.uint64(63) == 0


def _incidence(frequent) -> callable:
    """Rows (shingle, set, room, late) of each distinct set of a slice.  late 0: a counted shingle, with the set's room,
    that is how many counted shingles it has beyond its prefix, less than none if they do not fill it; late 1: an entry of
    the prefix whatever the counts are, with its lead (see `_shared_prefixes`) in place of the room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = frequent.value
        seen: set[tuple[int, int]] = set()
        for batch in slices(batches, limit=FEW_BYTES):
            keys, prints, rooms, lates = [], [], [], []
            for items in _sets(batch):
                if not len(items) or (p := _set_print(items)) in seen:
                    continue
                seen.add(p)
                late = np.zeros(len(items), bool)
                if len(last):
                    late = last[np.minimum(np.searchsorted(last, items), len(last) - 1)] == items
                keep = len(items) - (3 * len(items) + 3) // 4 + 1
                counted = _counted(items) & ~late
                room = int(counted.sum()) - keep
                more = np.concatenate([items[~counted & ~late], items[late]])[: max(0, -room)]
                keys += [items[counted], more]
                prints.append(np.full(len(keys[-2]) + len(more), p[0]))
                rooms += [np.full(len(keys[-2]), room), -room - np.arange(len(more))]
                lates.append(np.repeat([0, 1], [len(keys[-2]), len(more)]))
            if keys:
                yield _entries(signed(np.concatenate(keys)), np.concatenate(prints), np.concatenate(rooms), np.concatenate(lates))

    return run


def _entries(key: np.ndarray, of: np.ndarray, room: np.ndarray, late: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(of, pa.int64()), pa.array(room, pa.int32()), pa.array(late, pa.int32())], ["key", "of", "room", "late"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of shingle: (set, room, sets with the shingle, shingle) of shingles that several sets have."""
    for batch in runs_of(batches, "key"):
        key, of, room = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "of", "room"))
        new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))  # copies of a set from several workers
        key, of, room = key[new], of[new], room[new]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        many = np.repeat(np.diff(np.append(starts, len(key))), np.diff(np.append(starts, len(key))))
        keep = many > 1
        yield pa.RecordBatch.from_arrays([pa.array(of[keep], pa.int64()), pa.array(room[keep], pa.int32()), pa.array(many[keep], pa.int32()), pa.array(key[keep], pa.int64())], ["of", "room", "many", "key"])


def _shared_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of set, count and shingle: (shingle, set, lead) of the entries in the prefix.  Shingles of one set
    alone come first in the order and are not among the rows; a set's last `room` rows are beyond its prefix.  The lead is
    how many places an entry is before the prefix's end: the last one has 1."""
    for batch in runs_of(batches, "of"):
        of, room, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("of", "room", "key"))
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        counts = np.diff(np.append(starts, len(of)))
        left = np.repeat(starts + counts, counts) - np.arange(len(of))
        keep = left > room
        yield pa.RecordBatch.from_arrays([pa.array(key[keep], pa.int64()), pa.array(of[keep], pa.int64()), pa.array((left - room)[keep], pa.int32())], ["key", "doc", "lead"])


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)] & (a != b)
    return a[new], b[new]


def _tie_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of shingle and set: ties (a, b) of each set with the first of its list."""
    before = (None, 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        key, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc"))
        new = np.append(key[0] != before[0], key[1:] != key[:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        head = np.where(at >= 0, doc[at], before[1])
        before = (key[-1], head[-1])
        a, b = _distinct(head[~new], doc[~new])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def overlap_links(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i in order of size that link with i), as positions in `sets`, which come in order of size."""
    sizes = np.array([len(s) for s in sets])
    n = len(sets)
    flat = np.concatenate(sets)
    rows = np.repeat(np.arange(n), sizes)
    _, column, degree = np.unique(flat, return_inverse=True, return_counts=True)
    shared = degree[column] >= 2
    order = np.argsort(column[shared], kind="stable")
    rows, column = rows[shared][order], column[shared][order]
    degree = degree[column]
    dense = degree >= max(16, n // 8)
    counts = np.zeros((n, n), np.float32)
    for d in np.unique(degree[~dense]):
        together = rows[~dense & (degree == d)].reshape(-1, d)
        i, j = np.triu_indices(d, 1)
        step = max(1, 500_000 // len(i))
        for k in range(0, len(together), step):
            part = together[k : k + step]
            np.add.at(counts, (part[:, i].ravel(), part[:, j].ravel()), np.float32(1))
    _, column = np.unique(column[dense], return_inverse=True)
    rows = rows[dense]
    widest = np.searchsorted(sizes, sizes * 4 / 3, "right")
    for k in range(0, int(column.max()) + 1 if len(column) else 0, 1024):
        here = (column >= k) & (column < k + 1024)
        matrix = np.zeros((n, 1024), np.float32)
        matrix[rows[here], column[here] - k] = 1
        for i in range(0, n, 256):  # later rows are larger, and too large from `widest` on
            to = widest[min(i + 256, n) - 1]
            counts[i : i + 256, i:to] += matrix[i : i + 256] @ matrix[i:to].T
    for i in range(n - 1):
        to = widest[i]
        linked = 7 * counts[i, i + 1 : to] >= 3 * (sizes[i] + sizes[i + 1 : to])
        yield i, i + 1 + np.flatnonzero(linked)


def _forest(sets: list[np.ndarray], docs: np.ndarray, labels: np.ndarray, visitor: np.ndarray, fresh: bool) -> tuple[list, list]:
    """Spanning links of a tile.  fresh: all pairs count; otherwise only a visitor with a resident of another label."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, docs, labels, visitor = [sets[i] for i in order], docs[order], labels[order], visitor[order]
    group = np.arange(len(docs)) if fresh else np.unique(labels, return_inverse=True)[1]
    a, b = [], []
    for i, js in overlap_links(sets):
        if not fresh:
            js = js[visitor[js] != visitor[i]]
        js = js[group[js] != group[i]]
        while len(js):
            a.append(docs[i])
            b.append(docs[js[0]])
            group[group == group[js[0]]] = group[i]
            js = js[group[js] != group[i]]
    return a, b


def _multiply(fresh: bool) -> callable:
    """Over rows in order of block and tile: links (a, b) within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {"sets": [], "doc": [], "label": [], "visitor": []}
        now = None

        def done() -> pa.RecordBatch:
            a, b = _forest(held["sets"], *(np.array(held[k]) for k in ("doc", "label", "visitor")), fresh) if len(held["sets"]) > 1 else ([], [])
            for k in held:
                held[k] = []
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches, limit=FEW_BYTES):
            columns = [batch.column(c).to_pylist() for c in ("block", "tile", "doc", "label", "visitor")]
            for block, tile, doc, label, visitor, items in zip(*columns, _sets(batch), strict=True):
                if (block, tile) != now:
                    if held["sets"]:
                        yield done()
                    now = (block, tile)
                for k, v in (("sets", items), ("doc", doc), ("label", label), ("visitor", visitor)):
                    held[k].append(v)
        if held["sets"]:
            yield done()

    return run


def _products(texts: DataFrame, members: DataFrame, fresh: bool) -> DataFrame:
    """Links within tiles.  Few members, by their count, are sent to the texts, so that theirs alone are shuffled."""
    members = F.broadcast(members) if members.count() <= FEW_MEMBERS else members
    dealt = members.join(texts, "doc").select("block", "tile", "doc", "label", "visitor", "text")
    dealt = dealt.repartition("block", "tile").sortWithinPartitions("block", "tile", "doc", "visitor")
    return dealt.mapInArrow(_multiply(fresh), "a long, b long")


def link_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (see the module's text)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    found = cut(texts.mapInArrow(_describe, "kind int, doc long, n long, s1 long, s2 long"), "prints")
    described = found.where("kind = 0")
    top = found.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s1").limit(FREQUENT).select("s1").toPandas()["s1"]
    frequent = spark.sparkContext.broadcast(np.sort(top.to_numpy(np.int64).view(np.uint64)))

    sized = described.where("n > 0 and doc is not null")
    first = cut(sized.groupBy("s1", "s2", "n").agg(F.min("doc").alias("head")), "heads")
    same = cut(sized.join(first, ["s1", "s2", "n"]).where("doc <> head").select(F.col("head").alias("a"), F.col("doc").alias("b")).distinct(), "same")

    rows = cut(texts.where("doc is not null").mapInArrow(_incidence(frequent), "key long, of long, room int, late int"), "incidence")
    counted = rows.where("late = 0").select("key", "of", "room").repartition("key").sortWithinPartitions("key", "of")
    shared = counted.mapInArrow(_shared, "of long, room int, many int, key long")
    entries = shared.repartition("of").sortWithinPartitions("of", "many", "key").mapInArrow(_shared_prefixes, "key long, doc long, lead int")
    entries = entries.union(rows.where("late = 1").select("key", F.col("of").alias("doc"), F.col("room").alias("lead")))
    entries = cut(entries, "entries")
    lists = entries.select("key", "doc").repartition("key").sortWithinPartitions("key", "doc")
    ties = cut(lists.mapInArrow(_tie_lists, "a long, b long").distinct(), "ties")
    drop(rows)
    blocks = components(ties, "blocks")

    heads = first.select(F.col("head").alias("doc"), "s1", "n")
    members = cut(heads.join(blocks.select(F.col("id").alias("s1"), F.col("component").alias("block")), "s1").groupBy("doc", "block").agg(F.sum("n").alias("n")), "members")
    sizes = members.groupBy("block").agg(F.count("*").alias("docs"), F.sum("n").alias("total")).where("docs > 1")
    sizes = cut(sizes.select("block", F.greatest(F.ceil(F.col("docs") / block_docs), F.ceil(F.col("total") / block_shingles), F.lit(1)).cast("int").alias("tiles")), "sizes")
    members = members.join(sizes, "block")
    home = members.select("block", "tiles", F.expr("cast(pmod(xxhash64(doc), tiles) as int)").alias("tile"), "doc", F.col("doc").alias("label"), F.lit(False).alias("visitor"), "n")
    most = sizes.agg(F.max("tiles")).first()[0] or 1
    many = most > 1
    rows = home
    if many:
        pivots = members.where("tiles > 1").withColumn("place", F.row_number().over(Window.partitionBy("block").orderBy(F.xxhash64("doc"), "doc"))).where(f"place <= {_PIVOTS}")
        everywhere = pivots.select("block", "tiles", F.explode(F.expr("sequence(0, tiles - 1)")).alias("tile"), "doc", F.col("doc").alias("label"), F.lit(True).alias("visitor"), "n")
        rows = home.unionByName(everywhere)
    links = cut(_products(texts, rows.drop("tiles", "n"), True), "links")
    if many:
        joined = components(links, "joined").select(F.col("id").alias("doc"), F.col("component").alias("found"))
        labelled = cut(home.where("tiles > 1").join(joined, "doc", "left").withColumn("label", F.coalesce("found", "label")).drop("found"), "labelled")
        by_label = labelled.groupBy("block", "label").count()
        main = by_label.groupBy("block").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
        open_blocks = cut(labelled.join(main.drop("labels"), "block"), "open")
        near = open_blocks.where(f"tiles <= {FEW_TILES} and label <> main").withColumn("to", F.explode(F.expr("sequence(0, tiles - 1)"))).where("to <> tile")
        visits = near.select("block", "tiles", F.col("to").alias("tile"), "doc", "label", F.lit(True).alias("visitor"), "n")
        if most > FEW_TILES:
            visits = visits.union(_visits(open_blocks.where(f"tiles > {FEW_TILES}"), heads.select("s1", "doc"), entries.withColumnRenamed("doc", "s1")))
        slices_ = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("int")
        sliced = cut(visits.groupBy("block", "tile").agg(slices_.alias("slices")), "slices")
        # A slice of a tile's visitors meets all of its residents in a tile of its own.
        of_slice = (F.col("tile") + F.col("slice") * F.col("tiles")).cast("int").alias("tile")
        guests = visits.join(sliced, ["block", "tile"]).withColumn("slice", F.expr("cast(pmod(xxhash64(doc, 1), slices) as int)"))
        hosts = open_blocks.join(sliced, ["block", "tile"]).withColumn("slice", F.explode(F.expr("sequence(0, slices - 1)")))
        product = ["block", of_slice, "doc", "label", "visitor"]
        more = _products(texts, hosts.select(*product).unionByName(guests.select(*product)), False)
        links = links.union(cut(more, "links"))
    parts = components(links.union(same), "parts").select(F.col("id").alias("doc"), F.col("component").alias("part"))
    drop(first)
    out = described.join(parts, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("part", "doc").alias("component_id"))


def _visits(rows: DataFrame, prints: DataFrame, entries: DataFrame) -> DataFrame:
    """Documents outside their block's main component, once for each other tile where one of their prefix shingles can link.

    Two sets that meet first in a shingle share it and what comes after it in both at most: r shingles from there on, of n,
    allow a partner of (7r - 3n) / 3 shingles at most.  A tile is visited if its least set with the shingle is small enough
    for the visitor, and the visitor for its most generous one.  What shares a passage, but has too much of its own to link,
    visits nothing through it.
    """
    held = entries.join(prints, "s1").join(rows, "doc").withColumn("outside", F.col("label") != F.col("main"))
    r = F.col("lead") + F.expr("(3 * n + 3) div 4 - 1")
    held = held.withColumn("widest", F.floor((7 * r - 3 * F.col("n")) / 3)).select("key", "block", "tiles", "tile", "doc", "label", "n", "widest", "outside")
    held = cut(held.distinct(), "held")
    to = held.groupBy("key", "block", F.col("tile").alias("to")).agg(F.min("n").alias("least"), F.max("widest").alias("most"))
    meet = ["key", "block"]
    met = held.where("outside").alias("v").join(to.alias("t"), [F.col(f"v.{c}") == F.col(f"t.{c}") for c in meet] + [F.expr("tile <> to and least <= widest and n <= most")])
    return cut(met.select("v.block", "tiles", F.col("to").alias("tile"), "doc", "label", F.lit(True).alias("visitor"), "n").distinct(), "visits")
