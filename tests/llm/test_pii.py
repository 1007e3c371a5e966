"""Spans against Python's own matcher, and what the corpus adds."""

import re

import pytest
from messy import ROWS, documents, empty

from tidewheel.llm import pii as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


HARD = [
    "a@b.c_x@y.z d.e@f-g.h.i. @no.pe a@b", "x@y.z@w.v..u@t.s", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3", "4111 1111-1111 1111 4111111111111112 41111111111111111111 4111  1111",
    "+1 (743) 555-3824 +12345678 +1-2-3-4-5-6-7-8-9. ++44 20 7946 0958) +1", "ü🙂 mail: é.a@b.co, +49 30 901820 漢4111111111111111字", "9" * 4000, "a" * 20000 + "@", "1 " * 3000, "+" * 500 + "1" * 30,
    "x@y.zz " * 400, "1.1.1.1" * 200, "0.0.0.0 00000000000000.1.1.1",
]


def spans(out):
    return sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in out.collect()), key=str)


def test_base_spans(spark):
    rows = [(k, t, None, None, None) for k, t in enumerate(HARD)] + ROWS
    got = spans(P.find_spans(documents(spark, rows), contexts=10**6))
    assert got == sorted(((r[0], brute(r[1] or "")) for r in rows), key=str)


def test_empty_table(spark):
    assert P.find_spans(empty(spark)).count() == 0 and P.redact(empty(spark)).count() == 0


REVEALING = [(k, f"{a} Zorblax {b} likes z@w.example.com so much", None, None, None) for k, (a, b) in enumerate([("hear", "surely"), ("there", "often"), ("today", "never"), ("again", "rather")])]
OTHERS = [(100 + k, f"some {w} words of{' Common' * 3} kind reach c{k}@w.example.com here", None, None, None) for k, w in enumerate("abcdefghijklmnopqrstuvwxyz" * 3)]


@pytest.mark.parametrize("limit", [100_000, 0])
def test_revealing_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(P, "BROADCAST_TERMS", limit)
    docs = documents(spark, REVEALING + OTHERS)
    for doc_id, found in spans(P.find_spans(docs)):
        text = dict((r[0], r[1]) for r in REVEALING + OTHERS)[doc_id]
        terms = {text[a:b] for k, a, b in found if k == 4}
        assert ("Zorblax" in terms) == (doc_id < 100) and "Common" not in terms and len([s for s in found if s[0] < 4]) == 1
    copies = [(k, REVEALING[0][1], None, None, None) for k in range(5)]  # one context, however often
    assert all(len(found) == 1 for _, found in spans(P.find_spans(documents(spark, copies + OTHERS))))


def test_redaction(spark):
    docs = documents(spark, REVEALING + OTHERS + [(500, HARD[5], "en", "s", 1), (501, None, None, None, None), (502, "4111111111111112 stays", None, None, None)])
    out = P.redact(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text == "hear [TERM] surely [TERM] [EMAIL] so much".replace("surely [TERM]", "surely likes") or "Zorblax" not in rows[0].text
    assert "[EMAIL]" in rows[0].text and "@" not in rows[0].text
    assert rows[500].text == "ü🙂 mail: é[EMAIL], [PHONE] 漢[CARD]字" and rows[500].n_chars == len(rows[500].text)
    assert rows[501].text is None and rows[502].text == "4111111111111112 stays"


def test_no_python_on_the_main_path(spark):
    for df in (P.find_spans(documents(spark)), P.redact(documents(spark))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def terms_of(docs, rows):
    texts = {r[0]: r[1] for r in rows}
    return {doc_id: [texts[doc_id][a:b] for k, a, b in found if k == 4] for doc_id, found in spans(P.find_spans(docs))}


def test_a_term_beside_several_mentions(spark):
    rows = [(k, f"{w} is a@b.io Quillfeather 10.0.0.1 +1 555 123 4567 {w}", None, None, None) for k, w in enumerate(["hear", "there", "today", "again"])] + OTHERS
    found = terms_of(documents(spark, rows), rows)
    assert all(("Quillfeather" in found[k]) == (k < 4) for k in found)


def test_a_frequent_entity(spark):
    """It holds over a third of all mentions, in a small table and in a larger one."""
    hot = [(k, f"{a} Zorblax {b} z@w.example.com so {a}", None, None, None) for k, (a, b) in enumerate(zip("abcdefghijkl" * 4, "mnopqrstuvwx" * 4))]
    hot = [(k, f"{r[1]} {k}", None, None, None) for k, r in enumerate(hot)]
    for n in (5, 40):
        rows = hot[:n] + OTHERS[: 2 * n - 2]
        found = terms_of(documents(spark, rows), rows)
        assert all(("Zorblax" in found[k]) == (k < 100) and "Common" not in found[k] for k in found)


def test_a_term_far_from_the_mention_and_elsewhere(spark):
    from messy import words

    rows = [(k, f"Dear Quillfeather {words(30, k)} call +1 555 123 4567", None, None, None) for k in range(8)]
    rows += [(50, "I met Quillfeather, QUILLFEATHER and others", None, None, None)] + OTHERS
    found = terms_of(documents(spark, rows), rows)
    assert all("Quillfeather" in found[k] for k in range(8)) and found[50] == ["Quillfeather", "QUILLFEATHER"]
    assert all("Common" not in found[k] for k in found)


def test_redaction_of_kinds_that_overlap(spark):
    """A phone number that holds an address, a card beside one, an address inside an email: all of each goes."""
    texts = [
        ("call +49 10.0.0.1 555123 now", "call [IP] now"), ("call +49 192.168.10.1 5551234 now", "call +49 [IP] 5551234 now"), ("to a@10.0.0.1, 4111 1111 1111 1111 x", "to [EMAIL], [CARD] x"),
        ("+1 4111111111111111 y", "+1 4111111111111111 y"), ("x 1.2.3.4.5.6.7.8 y", "x [IP].[IP] y"), ("b@c.d+49 30 901820 z", "[EMAIL][PHONE] z"), ("a.b@c.d4111111111111111 w", "[EMAIL] w"),
    ]
    out = {r.doc_id: r.text for r in P.redact(documents(spark, [(k, t, None, None, None) for k, (t, _) in enumerate(texts)])).collect()}
    for k, (text, want) in enumerate(texts):
        assert out[k] == want, (text, out[k])
        spans = sorted((a, b) for _, a, b in brute(text))
        assert not any(text[a:b] in out[k] for a, b in spans)


def test_redaction_of_a_term_inside_an_email(spark):
    rows = [(k, f"{w} is Quillfeather jo@quillfeather.io +1 555 123 4567 {w}", None, None, None) for k, w in enumerate(["hear", "there", "today", "again"])] + OTHERS
    out = {r.doc_id: r.text for r in P.redact(documents(spark, rows)).collect()}
    assert [out[k].split()[2:5] for k in range(4)] == [["[TERM]", "[EMAIL]", "[PHONE]"]] * 4
    assert not any("@" in text or "uillfeather" in text for text in out.values())
