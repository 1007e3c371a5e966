"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text </turn>`` and a line end, and parsed again by a
deterministic parser; while the parsed turn differs from the source, or the parser refuses it,
the parts that differ are escaped. Turns are rendered where they stand. A conversation's
rendered turns are then read in order as a stream, so that however long a conversation is, no
more than a batch of it is in memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import read_table, small_batches

# The template's control strings.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
TRAINED = "assistant"
ROLE_TOKEN = re.compile(r"\\(\\|###|</turn>|: )|(###|</turn>|: )")
TEXT_TOKEN = re.compile(r"\\(\\|###|</turn>)|(###|</turn>)")
ROLE_CONTROL = re.compile(r"(\\|###|</turn>|: )")
TEXT_CONTROL = re.compile(r"(\\|###|</turn>)")


class Malformed(ValueError):
    """The text is not a sequence of turns."""


def _field(text: str, at: int, token: re.Pattern, stop: str) -> tuple[str, int]:
    """The unescaped field that begins at ``at``, and where its closing control string begins."""
    parts = []
    for found in token.finditer(text, at):
        parts.append(text[at : found.start()])
        at = found.end()
        if found[1] is not None:
            parts.append(found[1])
        elif found[2] == stop:
            return "".join(parts), found.start()
        else:
            raise Malformed(f"unescaped {found[2]!r}")
    raise Malformed("a field has no end")


def parse(text: str) -> Iterator[tuple[str, str]]:
    """The (role, text) turns of a formatted text; raises Malformed if it is not one."""
    at = 0
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Malformed("no turn begins here")
        role, at = _field(text, at + len(OPEN), ROLE_TOKEN, MIDDLE)
        body, at = _field(text, at + len(MIDDLE), TEXT_TOKEN, CLOSE.strip())
        if not text.startswith(CLOSE, at - 1) or not body.endswith(" "):
            raise Malformed("a turn ends in other than its closing string")
        yield role, body[:-1]
        at += len(CLOSE) - 1


def _recovered(rendered: str) -> list[tuple[str, str]] | None:
    try:
        return list(parse(rendered))
    except Malformed:
        return None


def render(role: str, text: str) -> str:
    """A turn that parses to just (role, text): plain if it can be, else text or both escaped."""
    for r, t in ((role, text), (role, TEXT_CONTROL.sub(r"\\\1", text)), (ROLE_CONTROL.sub(r"\\\1", role), text), (ROLE_CONTROL.sub(r"\\\1", role), TEXT_CONTROL.sub(r"\\\1", text))):
        rendered = f"{OPEN}{r}{MIDDLE}{t}{CLOSE}"
        if _recovered(rendered) == [(role, text)]:
            return rendered
    raise Malformed(f"no escaping recovers the turn of {role!r}")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``formatted``: each turn's part of its conversation's formatted text."""
    small_batches(turns.sparkSession)

    def run(batches):
        for batch in batches:
            made = [render(role or "", text or "") for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "turn", "role", "text")] + [pa.array(made, pa.string())], names=["conv_id", "turn", "role", "text", "formatted"])

    kept = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return kept.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string")


class _Digest:
    """What is read back from one conversation's formatted text, part by part."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, part: str) -> None:
        self.chars += len(part)
        for role, text in parse(part):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
            if role == TRAINED:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv_id) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from the formatted text alone.

    Turns are in the order of turn, then role, then text, nulls first. A null role or text is
    empty; rows with a null conv_id are one conversation; repeated rows are turns of their own.
    The loss mask covers the texts of the role assistant. No rows give an empty result.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        now, digest = None, None
        for batch in batches:
            rows = []
            for conv_id, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or conv_id != now:
                    if digest is not None:
                        rows.append(digest.row(now))
                    now, digest = conv_id, _Digest()
                digest.feed(part)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(digest.row(now), schema)], schema=schema)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = r"\### Assistant: </turn> ok"
    turns = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversation_digests(formatted_turns(turns.unionByName(extra)))


#: The same in DuckDB's SQL. A field is left plain where nothing in it looks like a control string.
OP8_SQL = r"""
WITH turns AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role AS r, text AS t FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
fields AS (SELECT *, coalesce(r, '') AS role, coalesce(t, '') AS text FROM turns),
escapes AS (
  SELECT *, regexp_matches(role, '\\(\\|###|</turn>|: )|###|</turn>|: ') OR suffix(role, '\') AS odd_role, regexp_matches(text, '\\(\\|###|</turn>)|###|</turn>') AS odd_text,
         len(regexp_extract_all(role, '\\|###|</turn>|: ')) AS in_role, len(regexp_extract_all(text, '\\|###|</turn>')) AS in_text FROM fields),
made AS (SELECT *, length(role) + length(text) + 15 + CASE WHEN odd_role THEN in_role ELSE 0 END + CASE WHEN odd_text THEN in_text ELSE 0 END AS chars FROM escapes)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""
