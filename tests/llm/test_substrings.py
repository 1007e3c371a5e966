"""Repeated substrings against a byte-by-byte search."""

import collections
import random

import numpy as np
import pytest
from messy import ROWS, documents, empty

from tidewheel.llm import substrings as S
from tidewheel.llm.common import Scratch


def brute(texts, length=400):
    seen = collections.Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((len(t), int(gone.sum()), int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))[: len(t)]).sum()) if len(t) else 0, kept))
    return out


def planted(seed=6):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcdé \n") for _ in range(n))
    passage, edge = text(900), text(400)
    rows = [text(1500) for _ in range(12)]
    rows += [text(300) + passage + text(200), passage[:450] + text(30), text(7) + passage[200:700], text(50) + edge + text(10), edge + text(420), text(399)]
    rows += ["ab" * 500, "x" * 399, "x" * 400, "x" * 401, rows[0], rows[0], rows[1][:800] + "!" + rows[1][801:], text(600) + rows[2][100:499], rows[3] + rows[3]]
    rows += [text(20) + edge[:390] + text(draw.randint(20, 500)) for _ in range(8)]
    return rows


@pytest.mark.parametrize(("crowd", "limit"), [(4096, 10**6), (1, 0)])
def test_planted_repeats(spark, monkeypatch, crowd, limit):
    """Whole or dealt out by fingerprint, and with lists broadcast or shuffled."""
    monkeypatch.setattr(S, "CROWD", crowd)
    monkeypatch.setattr(S, "BROADCAST_ENTRIES", limit)
    monkeypatch.setattr(S, "BROADCAST_RUNS", limit)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in S.without_repeats(docs).collect()}
    assert got == dict(enumerate(brute([t.encode() for t in texts])))


def test_messy_documents_and_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(S, "BUFFER", 1 << 12)
    texts = [(r[1] or "").encode() for r in ROWS]
    rows = S.without_repeats(documents(spark)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows), key=key) == sorted(((r[0], *b) for r, b in zip(ROWS, brute(texts))), key=key)


def test_empty_table(spark):
    assert S.without_repeats(empty(spark)).count() == 0


def naive(heads, suffixes, new, length):
    windows = [[(h + s)[k : k + length] for k in range(len(h) + len(s) - length + 1)] for h, s in zip(heads, suffixes)]
    return [
        {k for k, w in enumerate(own) if any(j != i and (new[i] or new[j]) and len(heads[j]) - len(heads[i]) + k in range(len(windows[j])) and windows[j][len(heads[j]) - len(heads[i]) + k] == w for j in range(len(heads)))}
        for i, own in enumerate(windows)
    ]


@pytest.mark.parametrize("seed", range(40))
def test_matches_of_an_anchor_against_all_pairs(monkeypatch, seed):
    """Entries that share parts of their heads and suffixes; equal hashes of different grams would look the same."""
    monkeypatch.setattr(S, "GRAM", 4)
    draw = random.Random(seed)
    bytes_of = lambda n: bytes(draw.choice(b"ab") for _ in range(n))
    left, right = [bytes_of(10) for _ in range(3)], [bytes_of(14) for _ in range(3)]
    entries = []
    for _ in range(draw.choice([2, 5, 30])):
        a, b = draw.randint(0, 10), draw.randint(0, 10)
        suffix = draw.choice(right)[: 4 + b] + bytes_of(10 - b)
        entries.append(((bytes_of(10 - a) + draw.choice(left)[10 - a :])[draw.randint(0, 6) :], suffix))
    entries = sorted(set(entries), key=lambda e: e[1])
    heads, suffixes = map(list, zip(*entries))
    new = [draw.random() < 0.7 for _ in heads]
    windows = lambda found: [{k for a, b in runs for k in range(a, b)} for runs in found]
    every = naive(heads, suffixes, [True] * len(heads), 14)
    assert windows(S.matches(heads, suffixes, [True] * len(heads), 14)) == every
    # what an earlier scan has found among the old entries, and what this one adds
    old = [i for i, n in enumerate(new) if not n]
    before = dict(zip(old, windows(S.matches([heads[i] for i in old], [suffixes[i] for i in old], [True] * len(old), 14))))
    added = windows(S.matches(heads, suffixes, new, 14))
    assert [a | before.get(i, set()) for i, a in enumerate(added)] == every


def test_levels_grow_geometrically_and_every_batch_meets_them(spark):
    draw = random.Random(3)
    text = lambda n: bytes(draw.choice(b"abcdefgh") for _ in range(n))
    shared, family, seen, found = text(500), S.SuffixFamily(Scratch(spark, "t"), 400), 0, set()
    for k in range(9):
        rows = [(1, k, 0, 1, bytes([65 + k]) * 20 + shared[:100], shared[100:]), (2 + k, k, 1, 1, text(100), text(400))]
        out = family.add(spark.createDataFrame(rows, "anchor long, around long, around2 long, n long, head binary, suffix binary")).collect()
        seen += len(rows)
        found |= {r.around for r in out}
        assert found == (set(range(k + 1)) if k else set())
        assert all((r.start, r.end) == (20, 121) for r in out)
        sizes = [n for n, _ in family.levels]
        assert sum(sizes) == seen and sizes == sorted(sizes, reverse=True) and len(set(sizes)) == len(sizes) == bin(k + 1).count("1")
        assert [t.count() for _, t in family.levels] == sizes


def test_equal_windows_have_equal_anchors():
    draw = random.Random(8)
    block = bytes(draw.choice(b"abc ") for _ in range(600))
    one, two = S.Hasher(), bytes(draw.choice(b"abc ") for _ in range(333)) + block
    found = []
    for text in (block, two):
        one.load(text)
        found.append(S.window_anchors(one.every(S.GRAM), 400 - S.GRAM + 1))
    assert (found[0] + 333 == found[1][333:]).all()
