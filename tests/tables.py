"""Independent SQL over the same tables, and comparable rows."""

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def table(arrow) -> tuple[list[str], list[tuple]]:
    """Column names with types, and rows as comparable text, both sorted."""
    names = sorted(arrow.column_names)
    columns = [arrow[n].to_pylist() for n in names]
    text = lambda v: "~" if v is None else repr(v) if isinstance(v, float) else str(v).removesuffix(" 00:00:00")
    return [f"{n}:{arrow.schema.field(n).type}" for n in names], sorted(tuple(map(text, row)) for row in zip(*columns))
