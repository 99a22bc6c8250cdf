"""Empty tables, nulls, repeated rows, very long texts and columns whose names clash, for every operator and stage."""

import gzip
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from voxmill.llm import chat, decontaminate, embeddings, jaccard, packing, passages, pii, quality, token_codes, warc
from voxmill.llm._graph import components
from voxmill.llm._tokens import TextEncoder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
#: Names that operators use inside.
CLASHING = "doc key of n room late print around c high kind pair side asked label list own row pieces found new matches number piece part tokens".split()


def _long(n=40_000):
    r = random.Random(1)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


ROWS = [(1, "the quick brown fox " * 30, "en", "a", 600), (1, "the quick brown fox " * 30, "en", "a", 600), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "mail a@b.example.com " * 20, "de", "a", 10), (4, _long(), "en", "c", 250_000), (5, "x\x00\x07y", "xx", "c", 4)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHING})


def _run(spark, name, docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)] if not docs.isEmpty() else [], LABELS)
    items = spark.createDataFrame([(1, "the quick brown fox " * 8)], ITEMS)
    if name == "op1":
        token_codes.write_codes(docs, f"{tmp_path}/codes", VOCABULARY)
        return token_codes.read_documents(spark, f"{tmp_path}/codes")
    if name == "op2":
        return chat.rotate(docs.select("doc_id", "n_chars", "lang", "text", *CLASHING), "doc_id", "n_chars", "lang", "text")
    if name == "op3":
        warc.write_archives(docs, f"{tmp_path}/archives", "doc_id", "source", "text")
        return warc.captures(spark, f"{tmp_path}/archives")
    if name == "op5":
        vectors = docs.select("doc_id", F.when(F.col("text") != "", F.array(F.lit(1.0), F.length("text").cast("double"))).alias("v"), "lang", *CLASHING)
        return embeddings.link_vectors(vectors, id_column="doc_id", vector_column="v", label_column="lang")
    return {
        "op4": lambda: pii.pseudonymise(docs, "k"), "op6": lambda: quality.score_documents(docs, labels), "op7": lambda: passages.repeated_passages(docs),
        "op8": lambda: decontaminate.find_leaks(docs, items), "op9": lambda: jaccard.link_documents(docs), "op10": lambda: packing.pack_documents(docs, VOCABULARY),
    }[name]()


OPERATORS = [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", OPERATORS)
def test_an_empty_table_has_no_rows(spark, name, tmp_path):
    assert _run(spark, name, _frame(spark, []), tmp_path).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name, tmp_path):
    out = _run(spark, name, _frame(spark, ROWS), tmp_path).collect()
    if name in ("op1", "op3", "op4", "op5", "op6", "op9"):
        assert len(out) == len(ROWS)
    if name == "op4":
        assert all(r[c] == "clash" for r in out for c in CLASHING)
        assert [r.text for r in out if r.doc_id is None][0].count("@") == 20 and not any("a@b.example" in (r.text or "") for r in out)
    if name == "op7":
        assert out == []  # the only text that repeats has one id
    if name == "op8":
        assert {(r.doc_id, r.item_id, r.similarity) for r in out} == {(1, 1, 1.0)} and len(out) == 2
    if name == "op9":
        assert {(r.doc_id, r.component_id) for r in out} == {(k, k) for k in (None, 1, 2, 3, 4, 5)}
    if name == "op10":
        assert sum(r.length for r in out) == sum(len(Tokenizer.from_file(VOCABULARY).encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)


def test_ids_equal_the_librarys_on_any_text():
    import pyarrow as pa

    library, own, r = Tokenizer.from_file(VOCABULARY), TextEncoder(VOCABULARY), random.Random(3)
    signs = [chr(i) for i in range(0x180)] + list("абвЖИ漢字かなقمل 　́​😀İßŉ'’") + ["'s", "'LL", "  ", "\n", "<|endoftext|>", "hello", "World"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(10_000)] + ["a\x00b", "\x1c\x07\x7f"]
    ids, bounds = own.encode(pa.array(texts))
    assert all(ids[bounds[k] : bounds[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts))


def test_records_are_members_of_their_own(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"u{k}", "x" * 900 + str(k)) for k in range(40)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"{tmp_path}/w", file_bytes=6000)
    files = [r.content for r in spark.read.format("binaryFile").load(f"{tmp_path}/w").select("content").collect()]
    records = [body for f in files for body in warc.members(f)]
    assert len(files) > 2 and len(records) == 120 and all(body.startswith(b"WARC/1.1\r\n") and len(list(warc.parse_archive(body))) == 1 for body in records)
    assert b"".join(gzip.decompress(f) for f in files) == b"".join(records)


def test_two_for_one_in_bins_of_many_items():
    lengths = [60] * 68 + [4036] + [3976] + [120]  # the last bin's pairs of 60 take the place of the 120
    packed = packing.Packing(lengths, 4096)
    assert sum(len(b) for b in packed.bins) == len(lengths) and all(sum(lengths[i] for i in b) <= 4096 for b in packed.bins)
    assert len(packed.bins) == -(-sum(lengths) // 4096)


def test_an_index_serves_positions(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"word{k} " * 50) for k in range(30)], "doc_id long, text string")
    token_codes.write_codes(docs, f"{tmp_path}/c", VOCABULARY)
    flat = np.concatenate([np.frombuffer(r.tokens, "<u4") for r in token_codes.read_documents(spark, f"{tmp_path}/c").orderBy("start").collect()])
    asked = spark.createDataFrame([(k,) for k in range(0, len(flat), 97)], "position long")
    assert {r.position: r.token for r in token_codes.read_tokens(spark, f"{tmp_path}/c", asked).collect()} == {k: int(flat[k]) for k in range(0, len(flat), 97)}


def test_stages_and_the_whole_pipeline(spark, tmp_path):
    r = random.Random(9)
    prose = lambda seed, n=80: " ".join(random.Random(seed).choices([f"w{k}" for k in range(400)], k=n))
    rows = [(k, prose(k), "en", "s", 1) for k in range(120)] + [(500 + k, prose(k) + " end", "en", "s", 1) for k in range(10)]
    rows += [(600 + k, prose(900) + " " + prose(700 + k, 20), "en", "s", 1) for k in range(3)] + [(700, prose(77) + " mail me@mail.example.com", "en", "s", 1), (None, prose(800), "en", "s", 1), (701, None, "en", "s", 1)]
    rows += [(800 + k, "###!! " * 60 + str(r.random()), "en", "s", 1) for k in range(40)]
    labels = [(k, 1, 0) for k in range(100)] + [(800 + k, 0, 0) for k in range(30)]
    for name, frame in (("documents", spark.createDataFrame(rows, DOCS)), ("labels", spark.createDataFrame(labels, LABELS)), ("benchmark", spark.createDataFrame([(1, prose(900))], ITEMS))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert not any((k or 0) >= 800 for k in kept[names[0]]) and {*range(120), None} <= set(kept[names[0]])
    assert set(kept[names[1]]) == set(kept[names[0]]) - set(range(500, 510)) - {700}  # 700 is near 77
    assert set(kept[names[2]]) == set(kept[names[1]]) - {600, 601, 602}
    assert kept[names[3]] == kept[names[2]]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == set(kept[names[3]])
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def _smallest_reachable(edges):
    """Brute force: labels pass over edges until none changes."""
    label = {v: v for e in edges for v in e}
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("edges", [
    [],
    [(5, k) for k in range(6, 30)],  # a star from the outset
    [(k, 0) for k in range(1, 20)] + [(k + 40, 60) for k in range(10)],  # the hub is not the smallest
    [(k, k + 1) for k in range(50)],  # a chain
    [(random.Random(k).randrange(300), random.Random(-k - 1).randrange(300)) for k in range(220)],
])
def test_components_equal_brute_force(spark, edges):
    edges = [e for e in edges if e[0] != e[1]]
    odd = [(7, 7), (None, 3), (3, None), (None, None), *edges[:2]]  # loops, null ends and repeated edges
    out = components(spark.createDataFrame(edges + odd, "a long, b long")).collect()
    assert len(out) == len({r.id for r in out}) and {r.id: r.component for r in out} == _smallest_reachable(edges)


def test_encoder_remembers_runs_not_pieces():
    texts = ["Word, word. word! (word) word12 x×y a÷b İstanbul don't 'tis <|x|> ÄRGER, ärger²", None, "", "<", "|x '", "word́ été\x00été, ǆ ½ ß ſ"]
    made = TextEncoder(VOCABULARY)
    ids, bounds = made.encode(pa.array(texts))
    for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        assert ids[a:b].tolist() == made.library.encode(text or "", add_special_tokens=False).ids
    marked = pa.array([" ".join(f"plain{a}{b}" for a in "!?.,;" for b in "()[]:")])
    before = len(made.known)
    made.encode(marked)
    assert len(made.known) - before == 26
