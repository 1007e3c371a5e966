"""Fingerprints by plain loops, links against all pairs, and components against union-find."""

import random

import numpy as np
import pytest
import xxhash
from messy import ROWS, documents, empty
from pyspark.sql import functions as F

from tidewheel.llm import simhash as S
from tidewheel.llm.common import Scratch
from tidewheel.llm.graph import components


def fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


class Union(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def test_messy_documents(spark):
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(documents(spark)).collect()), key=str)
    fps = [(r[0], fingerprint(r[1] or "")) for r in ROWS]
    union = Union()
    for a, x in fps:
        for b, y in fps:
            if (x ^ y).bit_count() <= 3:
                union.join(x, y)
    least = {}
    for d, x in fps:
        if d is not None:
            least[union.find(x)] = min(d, least.get(union.find(x), d))
    assert got == sorted(((d, x, least.get(union.find(x))) for d, x in fps), key=str)


def test_empty_table(spark):
    assert S.near_duplicates(empty(spark)).count() == 0 and S.one_of_each(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_all_pairs(spark, seed):
    """Crowds around a few centres, chains of 3 bits, and far fingerprints."""
    draw = random.Random(seed)
    fps = {draw.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        centre = draw.getrandbits(64)
        fps |= {centre} | {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 6))) for _ in range(150)}
    chain = draw.getrandbits(64)
    for _ in range(30):
        fps.add(chain)
        chain ^= sum(1 << b for b in draw.sample(range(64), 3))
    fps = sorted(fps)
    union = Union({x: x for x in fps})
    for k, x in enumerate(fps):
        for y in fps[k + 1 :]:
            if (x ^ y).bit_count() <= 3:
                union.join(x, y)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    counted = spark.createDataFrame([(x, 1 + k % 4) for k, x in enumerate(signed)], "fp long, n long")
    got = {r.node: r.component for r in S.linked(spark, counted, Scratch(spark, "t")).collect()}
    groups, mine = {}, {}
    for x, s in zip(fps, signed):
        groups.setdefault(union.find(x), set()).add(s)
        mine.setdefault(got[s], set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_the_bound_is_a_lower_bound(spark):
    draw = random.Random(4)
    rows = [(int(np.uint64(draw.getrandbits(64)).astype(np.int64)), int(np.uint64(draw.getrandbits(64)).astype(np.int64))) for _ in range(200)] + [(-(2**63), 2**63 - 1), (-1, 0)]
    df = spark.createDataFrame(rows, "fp long, g long")
    a = S._embedded(df)
    b = S._embedded(df.select(F.col("g").alias("fp"), F.col("fp").alias("g"))).select(F.col("g").alias("f"), F.col("low").alias("l"), F.col("high").alias("h"))
    out = a.join(b, a.fp == b.f).select((S._manhattan(F.col("low"), F.col("l")) + S._manhattan(F.col("high"), F.col("h"))).alias("m"), F.bit_count(F.col("fp").bitwiseXOR(F.col("g"))).alias("d"), "fp", "g").collect()
    for r in out:
        pairs = [((r.fp >> k) & 3, (r.g >> k) & 3) for k in range(0, 64, 2)]
        assert r.m == sum(abs(x.bit_count() - y.bit_count()) for x, y in pairs) <= r.d


def test_components_against_union_find(spark):
    draw = random.Random(9)
    edges = [(draw.randint(0, 300), draw.randint(0, 300)) for _ in range(180)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(60)] + [(7, 7)]
    union = Union()
    for a, b in edges:
        if a != b:
            union.join(a, b)
    got = dict(tuple(r) for r in components(spark, spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {x: union.find(x) for x in list(union)}


def test_one_document_of_each_group_stays(spark):
    docs = documents(spark)
    out = S.one_of_each(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    groups = {r.component_id for r in S.near_duplicates(docs).collect()}
    assert kept == sorted(g for g in groups if g is not None)


def test_each_group_keeps_a_document_whatever_its_id(spark):
    from messy import words

    rows = [(None, words(50, k)) for k in range(6)] + [(7, words(50, 10)), (7, words(50, 11)), (8, words(50, 12)), (None, words(50, 12)), (None, words(50, 0)), (3, words(50, 11))]
    out = S.one_of_each(documents(spark, [(d, t, None, None, None) for d, t in rows])).collect()
    want = [(None, words(50, k)) for k in range(6)] + [(7, words(50, 10)), (8, words(50, 12)), (3, words(50, 11))]
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted(want, key=str)
