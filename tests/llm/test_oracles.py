"""Every registered operator with SQL agrees with DuckDB."""

import duckdb
import pytest

from tidewheel.llm import registry

DATA = "/root/testdata"


def compared(arrow):
    names = sorted(arrow.column_names)
    return names, sorted(zip(*(map(repr, arrow[n].to_pylist()) for n in names)))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_agrees_with_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    theirs = con.execute(registry.ORACLES[name]).to_arrow_table()
    assert compared(registry.QUERIES[name](spark, f"{DATA}/{sf}").toArrow()) == compared(theirs)


def test_the_chat_sql_on_hard_turns(spark):
    from test_chat import HARD, ROWS, conversations

    from tidewheel.llm import chat

    parts = ["\\", "###", "</turn>", ": ", ":", "a", "\\\\", " ", "#"]
    rows = ROWS + [(100 + i, 0, a + b, c + d) for i, (a, b, c, d) in enumerate((a, b, c, d) for a in parts for b in parts[:5] for c in parts[:5] for d in parts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    theirs = con.execute(registry.ORACLES["op8_chat"]).to_arrow_table()
    mine = chat.conversation_digests(chat.formatted_turns(conversations(spark, rows + [(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)]))).toArrow()
    assert compared(mine) == compared(theirs)
