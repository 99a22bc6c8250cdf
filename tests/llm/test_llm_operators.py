"""Each operator against brute force, an exact round trip or held-out cases, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxmill.llm import chat, decontaminate, embeddings, jaccard, packing, passages, pii, quality, token_codes, warc

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"
_WORDS = [f"w{k}" for k in range(400)]


def _prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(_WORDS) for _ in range(n))


def _changed(text, places, seed):
    words, r = text.split(), random.Random(seed)
    for p in r.sample(range(len(words)), places):
        words[p] = f"new{seed}x{p}"
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    base = [_prose(120, k) for k in range(12)]
    out = [(k, t) for k, t in enumerate(base)]
    out += [(20, base[0]), (21, _changed(base[1], 2, 1)), (22, _changed(base[2], 40, 2)), (23, _prose(30, 90) + " " + " ".join(base[3].split()[20:85]) + " " + _prose(30, 91))]
    return out + [(30, None), (31, ""), (32, "one two"), (33, "ONE two"), (34, _prose(3000, 5)), (None, base[4]), (20, base[0])]


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _shingles(text):
    w = _words(text)
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_token_codes_round_trip(spark, rows, tmp_path):
    library = Tokenizer.from_file(VOCABULARY)
    token_codes.write_codes(spark.createDataFrame(rows, DOCS), f"{tmp_path}/codes", VOCABULARY)
    got = token_codes.read_documents(spark, f"{tmp_path}/codes").orderBy("start").collect()
    wanted = [(d, library.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))]
    assert [(r.doc_id, np.frombuffer(r.tokens, "<u4").tolist()) for r in got] == wanted
    assert [r.start for r in got] == np.cumsum([0] + [len(t) for _, t in wanted])[:-1].tolist()
    flat = [t for _, ts in wanted for t in ts]
    asked = spark.createDataFrame([(0,), (5,), (len(flat) - 1,)], "position long")
    assert {r.position: r.token for r in token_codes.read_tokens(spark, f"{tmp_path}/codes", asked).collect()} == {k: flat[k] for k in (0, 5, len(flat) - 1)}


def test_codes_of_wide_ids():
    ids = np.array([0, 255, 256, 70_000, 2**31, 1] * 400, np.uint32)
    codes = token_codes.Codes(token_codes.encode(ids))
    assert [codes[i] for i in (0, 3, 4, 2399)] == [0, 70_000, 2**31, 1] and (codes.slice(7, 1300) == ids[7:1300]).all()


def test_perspectives(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, None, "x"), (2, 0, "system", "alone"), (None, 1, "ann", "y")]
    out = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert Counter((r.conv_id, r.perspective) for r in out) == {(1, "ann"): 4, (1, "bob"): 4, (1, "unknown"): 4, (None, "ann"): 1}
    ann = sorted((r for r in out if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.start)
    whole = "".join(r.text for r in ann)
    assert [r.role for r in ann] == ["system", "assistant", "user", "user"] and [r.name for r in ann] == [None, None, "bob", "unknown"]
    assert [whole[r.loss_start : r.loss_end] for r in ann if r.loss_start is not None] == ["hi<|end|>\n"]


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "u1", big), (2, "u2", big), (3, None, "small"), (4, "u4", None), (5, "u\n5", "small")]
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), f"{tmp_path}/warc")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.captures(spark, f"{tmp_path}/warc").collect()}
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    assert got == {p: (len((h or "").encode()), sha(h), "revisit" if p == 1 else "response", 2 if p == 1 else None) for p, _, h in pages}


def test_pii(spark):
    said = [
        (1, "a.b@mail.example.com rang +1 (523) 555-1055 with 4539578763621486 from 10.1.22.255, 1234567890123456"),
        (2, "A.B@mail.example.com rang +1-523-555-1055"), (3, None), (4, ""), (5, "plain"), (6, "Mrs. Mary Smith, Анна Иванова"),
    ]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(said, DOCS), "key").collect()}
    assert [out[k].n_entities for k in range(1, 7)] == [4, 2, 0, 0, 0, 2]
    assert out[3].text is None and out[4].text == "" and out[5].text == "plain" and "1234567890123456" in out[1].text
    old, new = re.findall(r"\d+", said[0][1].split(" with")[0]), re.findall(r"\d+", out[1].text.split(" with")[0])
    assert [len(x) for x in old] == [len(x) for x in new] and old[1:] != new[1:]
    assert out[2].text.lower().split()[0] == out[1].text.split()[0] and out[2].text.split()[0][0].isupper()
    assert re.findall(r"\d", out[2].text) == re.findall(r"\d", out[1].text.split(" with")[0])
    card = re.search(r"with (\d{16})", out[1].text)[1]
    assert card != "4539578763621486" and card[0] == "4" and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(card))) % 10 == 0
    assert out[6].text.startswith("Mrs. ") and out[6].text.split()[1] in pii.GIVEN[("latin", "f")] and out[6].text.split()[3] in pii.GIVEN[("cyrillic", "f")]
    assert pii.pseudonymise(spark.createDataFrame([], DOCS), "key").count() == 0


def test_names_of_one_person_stay_together(spark):
    said = [(1, "Mrs Mary Smith met Mary Smith, MRS. SMITH and Smith; Smithson stays"), (2, "Анна Иванова и Иван Иванов"), (3, "my name is Zed Ploon. Ploon")]
    out = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(said, DOCS), "key").collect()}
    title, given, family = re.match(r"(Mrs) (\w+) (\w+) met", out[1]).groups()
    assert out[1] == f"Mrs {given} {family} met {given} {family}, MRS. {family.upper()} and {family}; Smithson stays" and given in pii.GIVEN["latin", "f"]
    woman, man = re.findall(r"\w+", out[2])[1], re.findall(r"\w+", out[2])[-1]
    assert woman == man + "а" and "Иванов" not in out[2]
    assert re.fullmatch(r"my name is \w+ (\w+)\. \1", out[3]) and "Ploon" not in out[3] and "Zed" not in out[3]
    with pytest.raises(ValueError):
        pii.pseudonymise(spark.createDataFrame(said, DOCS), "")


def test_more_addresses_than_surrogates_of_their_format(spark):
    letters = "abcdefghijklmnopqrst"
    rows = [(k, f"{a}@{b}.co") for k, (a, b) in enumerate((a, b) for a in letters for b in letters)]
    out = [r.text for r in pii.pseudonymise(spark.createDataFrame(rows, DOCS), "k").collect()]
    assert len(set(out)) == 400 and not set(out) & {t for _, t in rows} and all(re.fullmatch(r"\w+@\w\.co", t) for t in out)


def test_pii_surrogates_stay_distinct(spark):
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("from "), F.col("id").cast("string"), F.lit("@b.co")).alias("text")).where("doc_id < 10")
    out = [r.text for r in pii.pseudonymise(many.withColumn("text", F.concat(F.lit("x "), F.col("doc_id").cast("string"), F.lit("@b.co"))), "k").collect()]
    assert len(set(out)) == 10 and not set(out) & {f"x {k}@b.co" for k in range(10)}


def test_pii_formats_with_few_surrogates_get_wider(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"Mr X{a}{b}{c}" for a in letters for b in letters for c in letters[:4]]  # more than 16 * 8 * 16
    octets = [f"{k // 1000}.{k // 100 % 10}.{k // 10 % 10}.{k % 10}" for k in range(9000)]  # all but 1,000 of one digit
    mails = [f"{a}@{b}.co" for a in letters for b in letters]
    phones = [f"+1 {k:02d} {j:02d}" for k in range(60) for j in range(100)]
    rows = [(k, t) for k, t in enumerate([*names, *octets, *mails, *phones])]
    out = pii.pseudonymise(spark.createDataFrame(rows, DOCS).repartition(8), "k").collect()
    new = [r.text for r in out]
    assert len(new) == len(rows) == len(set(new)) and not set(new) & {t for _, t in rows} and all(r.n_entities == 1 for r in out)
    kinds = Counter(next(k for k, p in (("mail", r"\w+@\w+\.co"), ("ip", r"\d+(\.\d+){3}"), ("phone", r"\+1 \d\d \d+"), ("name", r"Mr [A-Z][a-z]+")) if re.fullmatch(p, t)) for t in new)
    assert kinds == {"name": len(names), "ip": len(octets), "mail": len(mails), "phone": len(phones)}


def test_embedding_links(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 8))
    x = np.vstack([x, x[:20] + 0.02 * r.normal(size=(20, 8)), x[:5], 3 * x[5:8]])
    rows = [(i, [float(v) for v in np.float32(row)], i % 2) for i, row in enumerate(x)]
    rows += [(200, [0.0] * 8, 1), (201, None, 1), (202, rows[0][1], None), (203, [float("nan")] * 8, 0), (204, rows[0][1][:4], 0)]
    got = {g.vec_id: g for g in embeddings.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), per_list=8, tile=16).collect()}
    links = {i: set() for i, _, _ in rows}
    for i, a, l in rows[:88]:
        for j, b, m in rows[:88]:
            if i != j and l == m and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.98:
                links[i].add(j)
    part = {i: i for i in links}
    for _ in links:
        for i, js in links.items():
            part[i] = min([part[i], *(part[j] for j in js)])
    assert {i: (g.n_links, g.component_id, g.kept) for i, g in got.items()} == {i: (len(js), part[i], part[i] == i) for i, js in links.items()}


def test_classifier_learns_and_keeps_clean(spark):
    docs = [(k, _prose(60, k) + (" idiot" if k % 5 == 0 else "") if k % 4 else "###!! " * 60, "en", "s", 100) for k in range(400)]
    labels = [(k, int(k % 4 > 0), int(k % 5 == 0 and k % 4 > 0)) for k in range(300)] + [(1, None, 0), (None, 1, 1)]
    frame = spark.createDataFrame(docs + [(900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in quality.score_documents(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    fresh = range(300, 400)  # without labels
    assert len(out) == 401 and sum(out[k].kept == (k % 4 > 0 and k % 5 > 0) for k in fresh) >= 97
    none = quality.score_documents(frame, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("kept").count() == 401


def test_passages(spark, rows):
    out = passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id for r in out} == {0, 20, 1, 21, 3, 23, 5, 34}  # 34 starts as 5 does
    shared = next(r for r in out if r.doc_id == 23)
    assert abs(shared.start - 30) <= 1 and 63 <= shared.n_words <= 67 and shared.partner_id == 3
    assert passages.repeated_passages(spark.createDataFrame([], DOCS)).count() == 0


def _edited(text, edits, r):
    words = text.split()
    for edit in edits:
        at = r.randrange(len(words))
        words[at : at + 1] = {"change": ["zz"], "insert": [words[at], "zz"], "drop": []}[edit]
    return " ".join(words)


def test_passage_windows_equal_brute_force():
    r = random.Random(4)
    for k in range(60):
        one = _prose(r.randrange(50, 91), 700 + k)
        two = _edited(one, [r.choice(("change", "insert", "drop")) for _ in range(1 + k % 2)], r)
        head, tail = _prose(r.randrange(12), 900 + k), _prose(r.randrange(12), 1100 + k)
        a, b = _shingles(f"{head} {one} {tail}"), _shingles(f"{head[::-1]} {two} {tail[::-1]}")
        n = min(len(a), len(b))
        wanted = [(s, s + w) for w in range(46, n + 1) for s in range(n - w + 1) if 4 * len({*a[s : s + w]} & {*b[s : s + w]}) >= 3 * len({*a[s : s + w]} | {*b[s : s + w]})]
        names = {x: i for i, x in enumerate({*a, *b})}
        got = passages.runs(*(np.array([names[x] for x in t[:n]], np.uint64) for t in (a, b)))
        covered = {p for s, e in got for p in range(s, e)}
        assert bool(got) == bool(wanted)
        assert {p for s, e in wanted for p in range(s, e) if a[p] in b[:n] and b[p] in a[:n]} <= covered <= {p for s, e in wanted for p in range(s, e)}


def test_passages_equal_brute_force_end_to_end(spark):
    """Every passage with a run of 18 shared tokens on its diagonal, over documents with copies, edits and a common line."""
    r, line = random.Random(21), _prose(30, 77)
    rows = []
    for k in range(24):
        one = _prose(r.randrange(50, 120), 800 + k)
        two = _edited(one, [r.choice(("change", "insert", "drop")) for _ in range(1 + k % 2)], r)
        rows += [(3 * k, f"{_prose(40, 2000 + k)} {one} {line}"), (3 * k + 1, f"{line} {_prose(25, 2100 + k)} {two} {_prose(15, 2200 + k)}"), (3 * k + 2, f"{_prose(60, 2300 + k)} {line}")]
    for group in (passages.GROUP, 4):
        found = passages.repeated_passages(spark.createDataFrame(rows, DOCS), group=group).collect()
        if group == 4:
            assert {(x.doc_id, x.start, x.n_words) for x in found} == first
        first = {(x.doc_id, x.start, x.n_words) for x in found}
    sets = {d: _shingles(t) for d, t in rows}
    names = {x: i for i, x in enumerate({x for s in sets.values() for x in s})}
    tokens = {d: np.array([names[x] for x in s], np.uint64) for d, s in sets.items()}
    wanted = {}
    for a in tokens:
        for b in tokens:
            for diagonal in range(-len(tokens[b]) + 46, len(tokens[a]) - 45) if a < b else ():
                low, high = max(0, diagonal), min(len(tokens[a]), len(tokens[b]) + diagonal)
                x, y = tokens[a][low:high], tokens[b][low - diagonal : high - diagonal]
                if np.count_nonzero(x == y) >= 18:
                    for s, e in passages.runs(x, y):
                        wanted.setdefault(a, set()).update(range(low + s, low + e))
                        wanted.setdefault(b, set()).update(range(low - diagonal + s, low - diagonal + e))
    got = {}
    for x in found:
        got.setdefault(x.doc_id, set()).update(range(x.start, x.start + x.n_words - 4))
    assert set(got) == set(wanted)
    assert sum(len(got[d] & wanted[d]) for d in wanted) >= 0.98 * sum(map(len, wanted.values()))


@pytest.mark.parametrize("edit", ["change", "insert", "drop"])
def test_short_passages_with_an_edit_in_the_middle(spark, edit):
    rows = []
    for k in range(20):
        words = _prose(60, 300 + k).split()
        instead = {"change": ["zz"], "insert": [words[30], "zz"], "drop": []}[edit]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:30] + instead + words[31:]))]
    out = passages.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r.doc_id, r.partner_id) for r in out} == {(k, k ^ 1) for k in range(40)}
    assert all(r.similarity >= 0.75 and r.n_words >= 50 for r in out)


def test_compact_windows():
    r = np.random.default_rng(2)
    h, bounds = r.integers(0, 1 << 63, 300, np.uint64), np.array([0, 120, 120, 150, 300])
    found = set(zip(*(x.tolist() for x in passages.compact_windows(h, bounds, 20)), strict=True))
    wanted = set()
    for t, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        for c in range(a, b):
            left, right = c, c
            while left > a and h[left - 1] > h[c]:
                left -= 1
            while right < b - 1 and h[right + 1] > h[c]:
                right += 1
            if right - left + 1 >= 20:
                wanted.add((t, left, c, right))
    assert found == wanted


def test_leaks(spark, rows):
    items = [(1, " ".join(rows[5][1].split()[10:50])), (2, _changed(" ".join(rows[6][1].split()[0:60]), 1, 7)), (3, "one two"), (4, None), (5, _prose(40, 500))]
    out = decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string"), item_shingles=200).collect()
    wanted = set()
    for d, text in rows:
        s, n = _shingles(text), len(_words(text))
        for i, t in items:
            bag = Counter(_shingles(t))
            size = len(_words(t))
            if size and size < 5:
                w = _words(text)
                if any(w[k : k + size] == _words(t) for k in range(n - size + 1)):
                    wanted.add((d, i))
            elif bag:
                have = max(min(size, n) - 4, 1)
                for k in range(len(s) - have + 1):
                    window = Counter(s[k : k + have])
                    both = sum((window & bag).values())
                    if both / (have + sum(bag.values()) - both) >= 0.75:
                        wanted.add((d, i))
    assert {(r.doc_id, r.item_id) for r in out} == wanted and {(5, 1), (6, 2), (32, 3)} <= wanted


def test_leaks_of_items_that_repeat_words(spark):
    items, docs = [], []
    for k in range(60):
        passage = _prose(150, 3000 + k)
        items.append((k, passage + " so" * 24))
        docs.append((k, _prose(20, 4000 + k) + " " + passage + " " + _prose(40, 5000 + k)))
    out = decontaminate.find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(k, k) for k in range(60)} and all(r.similarity >= 0.75 for r in out)


def test_window_sums_tell_repeats_apart():
    found = np.random.default_rng(8).integers(0, 6, 60).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = decontaminate.window_sums(found, 17)
    for i in range(60 - 17 + 1):
        part = found[i : i + 17]
        assert (got[i] == decontaminate.signs(decontaminate.told_apart(part, decontaminate.occurrences(part))).sum(axis=0)).all()


@pytest.mark.parametrize("bounds", [{}, {"block_docs": 3, "block_shingles": 200}])
def test_jaccard_groups(spark, rows, bounds):
    got = jaccard.link_documents(spark.createDataFrame(rows, DOCS), **bounds).collect()
    sets = [(d, set(_shingles(t))) for d, t in rows]
    part = {d: d for d, _ in sets if d is not None}
    for _ in range(4):
        for a, s in sets:
            for b, t in sets:
                if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                    part[a] = part[b] = min(part[a], part[b])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((d, len(s), part.get(d)) for d, s in sets), key=str)


def test_packing(spark, rows):
    out = packing.pack_documents(spark.createDataFrame(rows, DOCS), VOCABULARY, capacity=256).collect()
    library = Tokenizer.from_file(VOCABULARY)
    wanted = Counter()
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 256):
            wanted[(d, k // 256, k, zlib.crc32(np.array(ids[k : k + 256], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, zlib.crc32(r.tokens)) for r in out) == wanted
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0] + [n for _, n in held])[:-1].tolist() and sum(held[-1]) <= 256
    # two pieces over half a sequence never share one
    assert len(places) <= max(-(-sum(r.length for r in out) // 256), sum(r.length > 128 for r in out)) + 1


def test_swaps_empty_bins():
    packed = packing.Packing([6, 5, 5, 4, 4, 3, 3], 10)
    assert len(packed.bins) == 3 and sorted(i for b in packed.bins for i in b) == list(range(7))
