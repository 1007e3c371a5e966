"""Mixing: targets, budgets, reruns and edge cases."""

import re

import pytest
from messy import ROWS, documents, empty

from tidewheel.llm import mixing as M
from tidewheel.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, share=1.5, weights=(5, 2, 1)):
    """Caps and shares by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def test_messy_documents(spark):
    rows = M.mix(documents(spark)).collect()
    assert len(rows) == len(ROWS)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((r[0] or -1, len(WORD.findall(r[1] or ""))) for r in ROWS)
    sizes = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    want = targets(sizes)
    for source, target in want.items():
        own = [r for r in rows if r.source == source]
        assert all(r.target == pytest.approx(target) and r.source_size == sizes[source] for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2 + len(own)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(str, M.mix(documents(spark)).collect())) == sorted(map(str, rows))


def test_empty_and_wordless_tables(spark):
    assert M.mix(empty(spark)).count() == 0 and M.mixed_documents(empty(spark)).count() == 0
    assert [(r.target, r.taken) for r in M.mix(documents(spark, [(1, None, None, "a", None), (2, " ", None, None, None)])).collect()] == [(0.0, 0), (0.0, 0)]


def test_a_hot_source_and_repeated_rows(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", "hot" if k % 3 else f"s{k % 5}", None) for k in range(600)] + [(1000, "w w w w", "en", "s0", None)] * 300
    out = M.mix(documents(spark, rows)).collect()
    for source in {r.source for r in out}:
        own = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(1, sum(r.doc_id == 1000 for r in own))


def test_mixed_documents_come_whole_and_with_all_columns(spark):
    docs = documents(spark)
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r.doc_id, r.text] = taken.get((r.doc_id, r.text), 0) + 1
    assert max(taken.values()) <= 4 and taken[4, ROWS[4][1]] <= 2


def test_query_agrees_with_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    mine = sorted(map(tuple, QUERIES["op3_mixing"](spark, "/root/testdata/sf0.001").select(*columns).collect()))
    assert mine == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op3_mixing']})").fetchall())


def test_no_python_on_the_main_path(spark):
    plan = M.mix(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
