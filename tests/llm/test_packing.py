"""Packing against the tokenizers library and the rules of the contract."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from messy import ROWS, documents, empty
from tokenizers import Tokenizer

from tidewheel.llm import packing as P


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def tokens():
    return P.Tokens(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def ids(tokens, text):
    return np.frombuffer(tokens.encode(text), "<u4").tolist()


def test_ids_equal_the_librarys(reference, tokens, monkeypatch):
    draw = random.Random(4)
    signs = "ab zé .,'st\n\t  　ßñ1٣漢字🙂#*!-_́‍<|endoftext|>"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + [t for _, t, *_ in ROWS if t]
    pieces = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "a", "one two", ".", " x", "é🙂"]
    texts += ["".join(draw.choice(pieces) for _ in range(draw.randint(1, 9))) for _ in range(3000)]
    assert all(ids(tokens, t) == reference.encode(t, add_special_tokens=False).ids for t in texts)
    monkeypatch.setattr(P, "SEGMENT", 20)  # cut at nearly every blank
    assert all(ids(tokens, t) == reference.encode(t, add_special_tokens=False).ids for t in texts[2500:])


def check(rows, texts, reference, budget):
    """Pieces are cut by the rules, and lie in their sequences without gap or overlap."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= budget
    want = []
    for doc_id, text in texts:
        all_ids = reference.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for piece in range(-(-len(all_ids) // budget)):
            size = (len(all_ids) - 1) % budget + 1 if piece == 0 else budget
            want.append((doc_id, piece, at, size, zlib.crc32(np.array(all_ids[at : at + size], "<u4").tobytes())))
            at += size
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return len(by)


@pytest.mark.parametrize("options", [{}, {"budget": 64, "block_items": 5, "islands": 2}])
def test_messy_documents(spark, reference, options):
    rows = P.pack_documents(documents(spark), **options).collect()
    check(rows, [(r[0], r[1]) for r in ROWS], reference, options.get("budget", 1024))


def test_empty_table(spark):
    out = P.pack_documents(empty(spark))
    assert out.count() == 0 and out.columns[-2:] == ["sequence_id", "offset"]


def test_nearly_as_few_sequences_as_the_tokens_need(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = P.pack_documents(docs).collect()
    used = check(rows, [(r.doc_id, r.text) for r in docs.collect()], reference, 1024)
    assert used <= -(-sum(r.length for r in rows) // 1024) + 3


def test_crossover_keeps_the_documents_and_whole_bins():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 60, 200).tolist()
    mother, father = P.best_fit(lengths, 100), P.mutate(P.best_fit(lengths[::-1], 100), 100, 0.3, rng)
    child = P.crossover(mother, father, 100, 0.3, rng)
    assert sorted(x for b in child for x in b) == sorted(lengths) and max(map(sum, child)) <= 100
    best = sorted(max(father, key=sum))
    assert best in [sorted(b) for b in child]
    found = P.evolve(lengths, [], 100, 5, 4, rng)
    assert len(found[0]) <= len(mother) and P._unpacked(P._packed(found[0])) == found[0]


def test_sequence_ids_of_blocks_that_exceed_block_items(spark):
    from tidewheel.llm.common import Scratch

    pieces = spark.range(60).selectExpr("id AS uid", "6L AS length")  # two never fit a bin
    out = P.pack(pieces, Scratch(spark, "t"), budget=10, block_items=4, islands=2, epochs=1, passes=1).collect()
    assert len(out) == len({r.sequence_id for r in out}) == 60 and {r.offset for r in out} == {0}
