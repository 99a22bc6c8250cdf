"""The conversation trie, ranked search and page extraction against brute force and pages whose article is known."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxmill.llm import _dom, _layouts, html_extract, prefix_trie, ranked_search

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"
CLASHING = "key base lead ids words node digit depth query term block shard score rank id url x some all above seqs sha n".split()
NODE = [c.split()[0] for c in prefix_trie.NODE.split(", ")]


def _trie(rows):
    """Nodes by the definition: every prefix of every rebuilt conversation."""
    own = defaultdict(list)
    for conv, *turn in rows:
        if conv is not None:
            own[conv].append((turn[0] is not None, turn[0] or 0, turn[1] or "", turn[2] or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        turns = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * words
            leaves[p[:d]] += not children[p]
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in members.items())


def _nodes(turns, local):
    conv = F.col("conv_id")
    dictionary, nodes = prefix_trie.conversation_trie(turns.withColumns({c: F.lit("clash") for c in CLASHING}), local, base=conv - conv % 20, lead=F.crc32(conv.cast("string")) % 4)
    return dictionary, sorted(tuple(-1 if v is None else v for v in (r[c] for c in NODE)) for r in nodes.collect())


@pytest.mark.parametrize("local", [30, 1 << 20])
def test_trie(spark, local):
    r = random.Random(3)
    rows = [(r.choice([None, *range(-50, 60)]), r.choice([None, 0, 1, 2, 3]), r.choice([None, "u", "a"]), r.choice([None, "", "x", "y  z\t"])) for _ in range(500)]
    rows += [(100, k, "u", f"w{k}") for k in range(8)] * 2 + [(c, k, "u", "same") for c in range(200, 260) for k in range(4)]
    dictionary, got = _nodes(spark.createDataFrame(rows, TURNS), local)
    assert got == _trie(rows)
    said = dictionary.orderBy("turn_id").select("role", "text").collect()
    assert [tuple(x) for x in said] == sorted({(x[2] or "", x[3] or "") for x in rows if x[0] is not None})


def test_trie_of_nothing_of_long_conversations_and_of_empty_ones(spark):
    assert _nodes(spark.createDataFrame([], TURNS), 10)[1] == [] and _nodes(spark.createDataFrame([(None, 1, "u", "x")], TURNS), 10)[1] == []
    long = [(c, k, "u", f"{k % 7} " * 50) for c in (1, 2) for k in range(120)]
    # Conversation 7 has no turn past the first h and its base none at all: it ends at the root.
    bare = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 > 0)
    rows = [*long, (bare, 1, None, None)]
    assert _nodes(spark.createDataFrame(rows, TURNS), 10_000)[1] == _trie(rows)
    assert _nodes(spark.createDataFrame([(bare, 1, None, None)], TURNS), 1)[1] == [(bare, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(bare).encode()).hexdigest())]


def test_distinct_sequences_do_not_depend_on_chunks(spark, monkeypatch):
    rows = [(c, 0, "u", "x") for c in range(3000)]
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 400)
    _, encoded = prefix_trie.encode_turns(spark.createDataFrame(rows, TURNS))
    (row,) = prefix_trie.distinct_sequences(prefix_trie.sequences(encoded)).collect()
    assert (row.conv_id, row.n, row.sha) == (0, 3000, hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest())


def _terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def _ranked(docs, items, k):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // max(total, 1)
            score = sum(n * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t, n in Counter(_terms(text)).items() if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -score) for rank, (score, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_bytes", [300, 1 << 24])
def test_ranked_search(spark, tmp_path, shard_bytes):
    r = random.Random(5)
    vocabulary = ["the"] * 30 + [f"w{k}" for k in range(60)] + ["Élan", "x9", "naïve", "ß"]
    docs = [(k, r.choice([" ", "-", "\n"]).join(r.choices(vocabulary, k=r.randint(0, 40)))) for k in range(120)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (300, None), (301, ""), (302, "!?"), (303, "the " * 5000), (304, docs[7][1]), (305, docs[7][1])]
    items = [(k, " ".join(r.choices(vocabulary, k=6))) for k in range(12)] + [(3, "w1 W1 w1"), (None, "w2"), (20, None), (21, ""), (22, "unheard")]
    clash = {c: F.lit("clash") for c in CLASHING}
    ranked_search.build_index(spark.createDataFrame(docs, DOCS).withColumns(clash), f"{tmp_path}/index", shard_bytes=shard_bytes)
    for k in (1, 7):
        got = ranked_search.search(spark, f"{tmp_path}/index", spark.createDataFrame(items, ITEMS).withColumns(clash), k).collect()
        assert sorted((tuple(x) for x in got), key=str) == _ranked(docs, items, k)


def test_search_without_documents_or_queries(spark, tmp_path):
    ranked_search.build_index(spark.createDataFrame([], DOCS), f"{tmp_path}/none")
    assert ranked_search.search(spark, f"{tmp_path}/none", spark.createDataFrame([(1, "a")], ITEMS)).count() == 0
    ranked_search.build_index(spark.createDataFrame([(1, "a")], DOCS), f"{tmp_path}/one")
    assert ranked_search.search(spark, f"{tmp_path}/one", spark.createDataFrame([], ITEMS)).count() == 0


def test_scoring_stops_early_with_the_same_best_rows():
    r = np.random.default_rng(1)
    for n, k in ((3000, 5), (3000, 20), (10, 20)):
        lists, scores = ([], [], []), np.zeros(n, np.int64)
        weights = r.integers(1, 9000, 12).tolist()
        for weight in weights:
            docs = r.choice(n, r.integers(1, n // 3), replace=False)
            impact = np.sort(r.integers(1, 1_000_000, len(docs)))[::-1]
            values, counts = np.unique(-impact, return_counts=True)
            np.add.at(scores, docs, impact * weight)
            for part, x in zip(lists, (-values, counts.astype(np.int32), docs.astype(np.int32)), strict=True):
                part.append(x)
        order = np.lexsort((np.arange(n), -scores))
        best, found = ranked_search.best_rows(*lists, weights, n, k)
        wanted = [d for d in order if scores[d] > 0][:k]
        assert best.tolist() == wanted and found.tolist() == scores[wanted].tolist()


@pytest.fixture(scope="module")
def models(spark):
    words = [(k, " ".join(random.Random(k).choices(["Lorem", "ipsum,", "dolor", "sit.", "amet", "und", "élan"], k=300))) for k in range(250)]
    return html_extract.train(spark.createDataFrame(words, "page_id long, html string"))


def _extracted(spark, models, *pages):
    rows = [(k, f"u{k}", p) for k, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASHING if c != "url"})
    got = {r.page_id: r for r in html_extract.extract(frame, models).collect()}
    assert all(got[k].url == f"u{k}" and got[k].n_chars == len(got[k].text) for k in range(len(pages)))
    return [got[k].text for k in range(len(pages))]


PROSE = "The quick brown fox jumps over the lazy dog, and then it sleeps for an hour. It wakes up late. "


def test_pages_with_a_known_article(spark, models):
    whole = f"""<!DOCTYPE html><html><head><title>No</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a href="/a">no</a></li><li><a href="/b">no two</a></li></ul></nav>
    <div class="ad">No, buy this now.</div><article><h1>A &amp; B</h1><p><b>{PROSE}</b>co<i>lour</i>&eacute;&#33;<br><p>{PROSE}</p><p>Short.</p></article>
    <section id="comments"><div class="comment"><p>{PROSE}</p></div><div class="comment"><p>No {PROSE}</p></div></section><footer>&copy; no &middot; No such thing.</footer></body></html>"""
    prose = PROSE.strip()
    wanted = f"A & B {prose} colouré! {prose} Short."
    assert _extracted(spark, models, whole, whole[:-12], whole, None, "", "<div></div>", "<!-- only -->", "<a href='x") == [wanted] * 3 + [""] * 5


def test_a_long_deep_page(spark, models):
    deep = "<div>" * 400 + f"<article><h1>T</h1>{f'<p>{PROSE}</p>' * 800}</article>" + "</div>" * 400
    assert _extracted(spark, models, deep) == [" ".join(["T", *[PROSE.strip()] * 800])]


def test_pages_of_unseen_layouts(models):
    right = wrong = lost = 0
    for seed in range(300):
        nodes = _dom.Nodes()
        nodes.parse(_layouts.Layout([f"unseen{k}" for k in range(300)], 50_000 + seed).page())
        main = np.array([t.startswith(_layouts.MARK) for t in nodes.text])
        nodes.text = [t.replace(_layouts.MARK, "") for t in nodes.text]
        rows = _dom.features(nodes)
        assert rows.shape[1] == _dom.N_FEATURES
        kept = html_extract.decode(nodes, *(m.logit(rows) for m in models))
        chars = np.array([len(t) for t in nodes.text])
        right, wrong, lost = right + chars[main & kept].sum(), wrong + chars[kept & ~main].sum(), lost + chars[main & ~kept].sum()
    assert right / (right + wrong) > 0.93 and right / (right + lost) > 0.95


def test_decoding_allows_no_contradiction():
    r = np.random.default_rng(2)
    nodes = _dom.Nodes()
    nodes.parse("<div><section><p>a</p><p>b</p></section><section><p>c</p><div>d<b>e</b></div></section></div>")
    parts = defaultdict(list)
    for k, p in enumerate(nodes.parent):
        parts[p].append(k)
    log = lambda x: -np.logaddexp(0, -x)

    def best(k, state, some, whole):
        """(score, texts) of node k in a state: all, none or mixed."""
        if nodes.text[k]:
            return (log(some[k]), {k}) if state == "all" else (log(-some[k]), set())
        score = {"all": log(whole[k]), "none": log(-some[k]), "mixed": log(some[k]) + log(-whole[k])}[state] if k else 0
        found = set()
        for part in parts[k]:
            states = [state] if state != "mixed" else ["all", "none"] + ["mixed"] * (not nodes.text[part])
            more, texts = max((best(part, s, some, whole) for s in states), key=lambda x: x[0])
            score, found = score + more, found | texts
        return score, found

    for _ in range(200):
        some, whole = r.normal(0, 3, len(nodes.tag)), r.normal(0, 3, len(nodes.tag))
        assert set(np.flatnonzero(html_extract.decode(nodes, some, whole)).tolist()) == best(0, "mixed", some, whole)[1]
