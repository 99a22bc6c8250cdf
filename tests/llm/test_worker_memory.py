"""What a Python worker and an executor hold for the pipeline's stages."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxmill.llm import _store, decontaminate, jaccard, packing


def _largest_batch(docs):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [batch.nbytes]})

    return docs.mapInArrow(sizes, "size long").agg(F.max("size")).first()[0]


@pytest.mark.parametrize("stage", ["find_leaks", "link_documents", "pack_documents"])
def test_workers_get_small_batches(spark, stage):
    session = spark.newSession()
    docs = session.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('w', id, ' '), 900)").alias("text"))
    run = {
        "find_leaks": lambda: decontaminate.find_leaks(docs, session.sql("select 1L as item_id, 'one two three four five six' as text")),
        "link_documents": lambda: jaccard.link_documents(docs.limit(3)),
        "pack_documents": lambda: packing.pack_documents(docs, "any"),
    }[stage]
    run()
    assert _largest_batch(docs) < 1.5 * _store.BATCH_BYTES


def test_a_sessions_own_bound_stays(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1048576")
    _store.small_batches(session)
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1048576"


def test_leaks_need_no_frame_made_in_python(spark):
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.lit("one two three four five six").alias("text"))
    items = spark.sql("select 7L as item_id, 'one two three four five six' as text union all select 8L, 'six five four three two one'")
    for item_shingles, blocks in ((1_000_000, 1), (2, 2)):
        found = decontaminate.find_leaks(docs, items, item_shingles=item_shingles)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "ExistingRDD" not in plan and plan.count("MapInArrow") == blocks
        assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(0, 7), (1, 7)]
    none = decontaminate.find_leaks(docs, items.where("item_id < 0"))
    assert none.columns == ["doc_id", "item_id", "start", "n_words", "similarity", "distance"] and none.count() == 0


def test_the_first_look_is_as_large_as_the_items():
    items = decontaminate.Items([(k, " ".join(f"w{k}x{j}" for j in range(50))) for k in range(20)])
    assert len(items.maybe) <= 32 * len(items.known)
    some = np.concatenate([items.known[::3], np.random.default_rng(1).integers(0, 1 << 63, 5000, np.uint64)])
    assert ((items.hits(some) >= 0) == np.isin(some, items.known)).all()
    assert (items.known[items.hits(items.known)] == items.known).all()
    assert (decontaminate.Items([]).hits(some) == -1).all()
