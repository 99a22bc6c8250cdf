"""Blocks of many tiles: documents that share a passage, with more and less of their own, against brute force."""

import random

import pytest

from voxmill.llm import jaccard


def _rows():
    r = random.Random(8)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(70):
        own = [f"o{k}x{j}" for j in range(r.randint(0, 22))]
        at = r.randint(0, len(own))
        rows.append((k, " ".join(own[:at] + passage + own[at:])))
    for k in range(70, 90):
        words = rows[r.randrange(70)][1].split()
        words[r.randrange(len(words))] = f"new{k}"
        rows.append((k, " ".join(words)))
    return rows


def _classes(rows):
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    part = {d: d for d in sets}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {d: root(d) for d in sets}


@pytest.mark.parametrize("few", [0, 8])
def test_many_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(jaccard, "FEW_TILES", few)
    monkeypatch.setattr(jaccard, "_PIVOTS", 1)
    rows = _rows()
    wanted = _classes(rows)
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=4).collect()}
    assert got == wanted and 3 < len(set(wanted.values())) < 80


def test_no_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    rows = _rows()
    got = {r.doc_id: r.component_id for r in jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), block_docs=4).collect()}
    assert got == _classes(rows)
