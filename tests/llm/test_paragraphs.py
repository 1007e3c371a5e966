"""Paragraph classes against all pairs of shingle sets, and planted passages."""

import collections
import random

import numpy as np
import pytest
from messy import ROWS, documents, empty, words
from pyspark.sql import functions as F

from tidewheel.llm import paragraphs as P
from tidewheel.llm.common import marked, marks_of


def natural(text, least=25):
    """(first, last word + 1) of lines with enough words, and of shorter lines that stand together."""
    found, held, at = [], None, 0
    lines = (text or "").encode().lower().split(b"\n")
    for line in [*lines, b""]:
        n = len(line.split())
        if held and (n == 0 or n >= least):
            if at - held[0] >= least:
                found.append((held[0], at))
            held = None
        if n >= least:
            found.append((at, at + n))
        elif n and not held:
            held = (at,)
        at += n
    return found


def passages(text):
    """(first, last word + 1) where a shingle is the lowest of some window in the text."""
    made = P.Paragraphs(25, 1)
    w = (text or "").encode().lower().split()
    made.load([b" ".join(w)])
    low, n = made.shingles.tolist(), len(w) - P.PASSAGE + 1
    chosen = set()
    for k in range(max(1, n - P.WINDOW + 1) if n > 0 else 0):
        window = low[k : min(k + P.WINDOW, n)]
        chosen |= {k + j for j, v in enumerate(window) if v == min(window)}
    out, before = [], None
    for k in sorted(chosen):
        if w[k : k + P.PASSAGE] != before:
            out.append((k, k + P.PASSAGE))
        before = w[k : k + P.PASSAGE]
    return out


def brute(rows, similarity=0.8):
    found = []
    for n, (doc_id, text) in enumerate(rows):
        w = (text or "").encode().lower().split()
        own = sorted([(a, e - a, False) for a, e in natural(text)] + [(a, e - a, True) for a, e in passages(text)])
        for k, (a, size, passage) in enumerate(own):
            part = w[a : a + size]
            found.append(((n, doc_id, k, size, passage), tuple(part) if passage else {tuple(part[i : i + 5]) for i in range(size - 4)}))
    parent = list(range(len(found)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (key, a) in enumerate(found):
        for j in range(i):
            b = found[j][1]
            if key[4] == found[j][0][4] and (a == b if key[4] else len(a & b) >= similarity * len(a | b)):
                parent[root(i)] = root(j)
    classes = collections.defaultdict(list)
    for i, (key, _) in enumerate(found):
        classes[root(i)].append(key[1:])
    return sorted(sorted(c, key=str) for c in classes.values() if len(c) > 1)


def got(out):
    classes = collections.defaultdict(list)
    for r in out.collect():
        classes[r.class_doc_id, r.class_paragraph, r.passage].append(r)
    for (doc, paragraph, _), own in classes.items():
        assert {r.class_size for r in own} == {len(own)} and sum(r.kept for r in own) == 1
        assert [(r.doc_id, r.paragraph) for r in own if r.kept] == [min((r.doc_id, r.paragraph) for r in own)] == [(doc, paragraph)]
    return sorted(sorted(((r.doc_id, r.paragraph, r.n_words, r.passage) for r in own), key=str) for own in classes.values())


def changed(text, n, seed):
    draw, w = random.Random(seed), text.split()
    for k in draw.sample(range(len(w)), n):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


def table(spark, rows):
    return documents(spark, [(d, t, None, None, None) for d, t in rows])


def test_against_all_pairs(spark):
    passage = words(70, 50)
    rows = [(k, f"{words(30, 100 + k)}\n{passage if k % 3 else changed(passage, 1, k)}\n{words(40, 200 + k)}\nshort line") for k in range(14)]
    rows += [(100 + k, changed(words(200, 7), 3, k)) for k in range(8)] + [(200, words(200, 7)), (201, words(200, 7).upper() + "\r"), (202, changed(words(200, 7), 60, 3))]
    short = [words(6, 300 + k) for k in range(12)]
    rows += [(300 + k, "\n".join([words(30 + k, 400 + k), "\r\n", *short, words(4, 500 + k)])) for k in range(5)]
    rows += [(400 + k, words(37 + k, 600 + k) + " " + words(50, 77) + " " + words(31, 700 + k)) for k in range(3)] + [(500, None), (501, "")]
    want = brute(rows)
    assert got(P.paragraph_classes(table(spark, rows))) == want
    assert max(map(len, want)) >= 11 and {m[3] for c in want for m in c} == {True, False}


def test_messy_documents(spark):
    rows = [(100 + k, r[1]) for k, r in enumerate(ROWS)]
    assert got(P.paragraph_classes(table(spark, rows))) == brute(rows)
    assert P.paragraph_classes(documents(spark)).count() == sum(map(len, brute(rows)))


def test_empty_table(spark):
    assert P.paragraph_classes(empty(spark)).count() == 0


def test_places_are_bytes_of_the_text(spark):
    text = "  " + words(30, 1) + " \n" + words(30, 1)
    rows = P.paragraph_classes(table(spark, [(1, text)])).where("not passage").collect()
    assert [text.encode()[r.start : r.end].decode() for r in rows] == [words(30, 1), words(30, 1)]


def test_tuned_bands():
    b = P.tuned_bands(0.8, 0.998)
    assert 1 - (1 - 0.8**3) ** b >= 0.998 > 1 - (1 - 0.8**3) ** (b - 1)


@pytest.mark.parametrize("shape", ["inside a line", "short lines"])
def test_every_passage_of_over_fifty_words_is_found(spark, shape):
    """Whatever stands before and after it, and however long that is."""
    rows = []
    for p in range(30):
        passage = words(51 + p, 50 + p)
        for k in range(3):
            lead, tail = words(3 + 7 * p + 11 * k, 1000 + 10 * p + k), words(9 + 5 * k, 2000 + 10 * p + k)
            if shape == "short lines":
                w = passage.split()
                passage_lines = "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))
                rows.append((3 * p + k, f"{lead}\n{words(2 + k, 7 * p + k)}\n{passage_lines}\n{tail}"))
            else:
                rows.append((3 * p + k, f"{lead} {passage} {tail}"))
    clean = [(1000 + k, words(150, 5000 + k)) for k in range(50)]
    found = P.paragraph_classes(table(spark, rows + clean)).select("doc_id", "class_doc_id").distinct().collect()
    assert {r.doc_id for r in found} == set(range(90))  # recall 1, and clean documents are left alone
    assert all(r.doc_id // 3 == r.class_doc_id // 3 for r in found)


def test_recall_of_nearly_equal_lines(spark):
    rows = []
    for p in range(60):
        line = words(90, 50 + p)
        rows += [(10 * p + k, f"{words(30, 9000 + 10 * p + k)}\n{changed(line, k % 2, 10 * p + k)}\n{words(26, 7000 + 10 * p + k)}") for k in range(4)]
    found = {(r.doc_id, r.class_doc_id) for r in P.paragraph_classes(table(spark, rows)).where("not passage").select("doc_id", "class_doc_id").collect()}
    assert len({d for d, _ in found}) >= 0.99 * len(rows)


def test_a_common_passage_brings_no_pairs_about(spark):
    """Lines that share half of their shingles lie in common buckets; those without a rare shingle in common are not paired."""
    counts = []
    for n in (60, 300):
        passage = words(60, 50)
        rows = [(k, f"{words(50, 100 + k)} {passage}") for k in range(n)] + [(10_000 + k, f"{words(49, 100 + k)} once {passage}") for k in range(0, n, 10)]
        made = P.Paragraphs(25, 1)
        made.load([t.encode() for _, t in rows])
        lines = np.flatnonzero(~made.passage)
        sets = [(int(made.node[k].view(np.int64)), made.shingle_set(k).view(np.int64).tolist()) for k in lines]
        sets = spark.createDataFrame(sets, "node long, shingles array<long>")
        pairs = P._pairs_by_rare_shingles(sets.select("node", F.col("node").alias("part")), sets, 0.8).collect()
        counts.append(len(pairs))
        assert P._verified(spark.createDataFrame(pairs), sets, 0.8).count() == n // 10
        assert P.paragraph_classes(table(spark, rows)).where("not passage").count() == 2 * (n // 10)
    assert counts[1] <= 6 * counts[0]


def test_marks_hold_every_node(spark):
    nodes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    marks = marks_of(spark.createDataFrame([(int(n),) for n in nodes], "node long"), "node")
    assert marked(nodes.view(np.uint64), marks).all() and marks.nbytes == 8 << 20
    others = np.random.default_rng(2).integers(0, 2**63 - 1, 5000).view(np.uint64)
    assert marked(others, marks).mean() < 0.01
    assert not marks_of(spark.createDataFrame([], "node long"), "node").any()


def test_components_of_pairs_across_parts(spark):
    """Two near lines whose buckets' commonest lines are others still meet."""
    line = words(80, 3)
    rows = [(k, line) for k in range(3)] + [(10 + k, changed(line, 2, 1)) for k in range(2)] + [(20, " ".join(changed(line, 2, 1).split()[:-1] + ["end"]))]
    assert got(P.paragraph_classes(table(spark, rows)).where("not passage")) == [c for c in brute(rows) if not c[0][3]]
