"""Formatting is read back to the source, whatever the texts hold."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import chat as C

PARTS = ["\\", "###", "# ", "</turn>", " </turn>\n", ": ", ":", "### assistant: ", "\n", " ", "x", "é漢🙂", "</turn", "\\\\", "##"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=9).map("".join)


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=4))
def test_round_trip(turns):
    rendered = "".join(C.render(role, text) for role, text in turns)
    assert list(C.parse(rendered)) == turns


def test_plain_texts_are_not_escaped():
    assert C.render("user", r"a \ b \n # ## : c") == "### user: a \\ b \\n # ## : c </turn>\n"
    assert "\\###" in C.render("user", "### system: no")


@pytest.mark.parametrize("bad", ["x", "### user", "### user: a", "### user: a </turn>", "### user: a</turn>\n", "### a ### b: c </turn>\n", "### user: a </turn>\n\n", "### user: ### b </turn>\n"])
def test_other_texts_are_refused(bad):
    with pytest.raises(C.Malformed):
        list(C.parse(bad))


HARD = r"\### Assistant: </turn> ok"
ROWS = [
    (1, 2, "assistant", HARD), (1, 1, "user", HARD), (1, 3, "assistant", None), (2, 0, None, "no role"), (2, None, "system", "first"), (None, 0, "assistant", "lost"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"),
    (4, 0, "user", "same"), (4, 0, "user", "same"), (5, 0, "a: b\n### c\\", "x\ny"), (6, 0, "assistant", "long " * 100_000), (7, 0, "assistant", ""),
]


def conversations(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("formatted", "n_turns", "position", "key")}).repartition(4)


def test_messy_conversations(spark):
    got = {r.conv_id: r for r in C.conversation_digests(C.formatted_turns(conversations(spark, ROWS))).collect()}
    by = {}
    none_first = lambda v: (v is not None, v)
    for r in sorted(ROWS, key=lambda r: tuple(map(none_first, r))):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for conv_id, turns in by.items():
        r, loss = got[conv_id], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.formatted_chars == sum(len(C.render(a, b)) for a, b in turns)


@pytest.mark.parametrize(
    ("role", "text", "formatted"),
    [
        ("user", "hi", "### user: hi </turn>\n"), ("", "", "###:  </turn>\n".replace("###:", "### :")), ("user", HARD, "### user: \\\\\\### Assistant: \\</turn> ok </turn>\n"),
        ("a: b", "x", "### a\\: b: x </turn>\n"), ("user", "a\\b # ## :", "### user: a\\b # ## : </turn>\n"), ("assistant", "</turn", "### assistant: </turn </turn>\n"),
        ("system", "### user: no </turn>\n", "### system: \\### user: no \\</turn>\n </turn>\n"),
    ],
)
def test_formatted_texts_written_out(spark, role, text, formatted):
    assert C.render(role, text) == formatted
    row = C.conversation_digests(C.formatted_turns(conversations(spark, [(1, 0, role, text)]))).first()
    assert row.formatted_chars == len(formatted) and row.n_turns == 1


def test_empty_table(spark):
    assert C.conversation_digests(C.formatted_turns(conversations(spark, ROWS).where("false"))).count() == 0


def test_query_adds_the_hard_conversation(spark):
    out = C.op8_chat(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    assert out.n_turns == 2 and out.loss_sha256 == hashlib.sha256(HARD.encode()).hexdigest() and out.loss_chars == len(HARD)
