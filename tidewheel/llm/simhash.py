"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A fingerprint's 64 bits are cut into 32 segments of 2 bits; the popcounts of the segments
(each 0, 1 or 2) are its embedding. The Manhattan distance of two embeddings is a lower bound
of the Hamming distance of the fingerprints. At most 3 differing bits mean a Manhattan distance
of at most 3, hence of at most 1 in one half of the segments: the grid's cells are the halves'
popcounts, each fingerprint sits in two cells and looks into the cells one step up, and a
pair's bound and exact distance are checked inside the join. The rows grow with the number of
distinct fingerprints (34 a fingerprint), and groups of near copies are joined by a star before.
What one cell holds is compared with what looks into it: two random halves share a cell with a
chance of about (3/8)^16, 1.5e-7, so comparisons (not rows) of unlike fingerprints grow with the
square of their number once cells, 43 million a half, hold several each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, read_table, small_batches, whole_row
from tidewheel.llm.graph import components

#: Shingles whose bits are counted at once.
CHUNK = 1 << 16
#: Rows that go, up to which their list (24 bytes each) is broadcast, more of them joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """Signed 64-bit SimHash of a UTF-8 text; 0 for a text without words."""
    found = text.lower().split()  # on bytes both mean ASCII only
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        n = len(found) - words + 1
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, apart: bool = False) -> DataFrame:
    """(doc_id, text_hash, other, fp) for every row of ``docs``; a null text counts as empty.

    ``apart``: ``other`` is a hash of all columns, which tells rows apart that have an id and a
    text in common; without it no column but those two is read, and it is 0.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = [fingerprint_of(t or b"", words) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps, pa.int64())], names=["doc_id", "text_hash", "other", "fp"])

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), (_all_columns(docs) if apart else F.lit(0).cast("long")).alias("other"), F.col("text").cast("binary").alias("text"))
    return keyed.mapInArrow(run, "doc_id long, text_hash long, other long, fp long")


def _all_columns(docs: DataFrame) -> Column:
    """A hash of a row; what cannot be hashed, such as a map, is hashed as JSON."""
    plain = lambda kind: "map<" not in kind and "variant" not in kind
    return F.xxhash64(*(F.col(f"`{c}`") if plain(kind) else F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c, kind in docs.dtypes if c != "text"))


def _embedded(fps: DataFrame) -> DataFrame:
    """Adds the popcounts of both halves, 16 fields of 2 bits each."""
    half = lambda c: c - F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(0x55555555))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    return fps.withColumn("low", half(low)).withColumn("high", half(high))


def _manhattan(x, y):
    """Manhattan distance of two half embeddings: set bits of the unary codes' difference."""
    unary = lambda c: c.bitwiseOR(F.shiftrightunsigned(c, 1).bitwiseAND(F.lit(0x55555555)))  # noqa: E731  0, 1, 2 become 00, 01, 11
    return F.bit_count(unary(x).bitwiseXOR(unary(y)))


def _cells(embedded: DataFrame) -> DataFrame:
    """One row for each fingerprint and half: the cell it sits in."""
    return embedded.select("*", F.explode(F.array(F.col("low"), F.col("high").bitwiseOR(F.lit(1 << 32)))).alias("cell"))


def _probes(cells: DataFrame) -> DataFrame:
    """Each cell row itself (up = false) and a row for each cell that is one step up in one segment."""
    steps = [F.when(F.shiftright("cell", 2 * i).bitwiseAND(F.lit(3)) < 2, F.col("cell") + F.lit(1 << 2 * i)) for i in range(16)]
    every = F.array(F.struct(F.col("cell").alias("k"), F.lit(False).alias("up")), *(F.struct(s.alias("k"), F.lit(True).alias("up")) for s in steps))
    return cells.withColumn("at", F.explode(F.filter(every, lambda x: x.k.isNotNull()))).drop("cell").select("*", F.col("at.k").alias("cell"), F.col("at.up").alias("up")).drop("at")


def linked(spark: SparkSession, counted: DataFrame, scratch: Scratch, distance: int = 3) -> DataFrame:
    """(node, component) over distinct fingerprints; ``counted`` has fp and n, its documents.

    First each cell links its fingerprints to the commonest one there, if they are near enough:
    that joins groups of near copies by as many links as they have members. Then only cells
    that still hold more than one component are range-joined, and only pairs from different
    components are looked at.
    """
    if distance > 3:
        raise ValueError("two halves, one step each way, cover at most 3 differing bits")
    bits = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    embedded = _embedded(counted)
    cells = _cells(embedded)
    centre = cells.groupBy("cell").agg(F.max_by("fp", F.struct("n", "fp")).alias("b"), F.count("*").alias("many")).where("many > 1").drop("many")
    first = cells.select(F.col("fp").alias("a"), "cell").join(centre, "cell").where((F.col("a") != F.col("b")) & (bits("a", "b") <= distance)).select("a", "b")
    known = scratch.write(components(spark, first, scratch))
    named = counted.join(known, counted.fp == known.node, "left").select("fp", F.coalesce("component", "fp").alias("part"))
    named = scratch.write(named)
    cells = _cells(_embedded(named))
    probes = _probes(cells)
    mixed = probes.groupBy("cell").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.min("up").alias("all_up")).where("x <> y and not all_up").select("cell")
    left = cells.join(mixed, "cell", "left_semi").select("cell", *(F.col(c).alias(f"l_{c}") for c in ("fp", "part", "low", "high")))
    right = probes.join(mixed, "cell", "left_semi")
    near = (
        (F.col("l_part") != F.col("part"))
        & (F.col("up") | (F.col("l_fp") < F.col("fp")))
        & (_manhattan(F.col("l_low"), F.col("low")) + _manhattan(F.col("l_high"), F.col("high")) <= distance)
        & (bits("l_fp", "fp") <= distance)
    )
    left, right = left.withColumnRenamed("cell", "l_cell"), right
    second = left.join(right, (F.col("l_cell") == F.col("cell")) & near).select(F.col("l_part").alias("a"), F.col("part").alias("b"))
    over = components(spark, second, scratch)
    return named.join(over, named.part == over.node, "left").select(F.col("fp").alias("node"), F.coalesce("component", "part").alias("component"))


def _components(docs: DataFrame, words: int, distance: int, apart: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, other, fp) of every row, and (fp, first, component) of every fingerprint."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprints(docs, words, apart))
    counted = scratch.write(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")))
    parts = scratch.write(linked(spark, counted.select("fp", "n"), scratch, distance))
    scratch.only(fps, counted, parts)
    return fps, counted.join(parts, counted.fp == parts.node).select("fp", "first", "component")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): documents linked by fingerprints that differ in few bits.

    A null or wordless text has fingerprint 0 and links like any other. component_id is the
    smallest doc_id of the group (null only if the whole group's ids are null). Rows with one
    doc_id each keep their own fingerprint. An empty table gives an empty result.
    """
    fps, owners = _components(docs, words, distance)
    least = owners.groupBy("component").agg(F.min("first").alias("component_id"))
    named = owners.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """Keeps one document of each group, the first by id and text hash, and all columns of ``docs``.

    Null ids come last. Rows of one id with different texts are documents of their own; of rows
    with one id and text that differ elsewhere one is kept, the same in every run, and of rows
    that are alike in all columns any one. What goes is decided on ids and hashes; texts move
    only if more than ``BROADCAST_ROWS`` rows go. Jobs run while the result is planned.
    """
    scratch = Scratch(docs.sparkSession, "one-of-each")
    fps, owners = _components(docs, words, distance, apart=True)
    key = ["doc_id", "text_hash", "other"]
    single = fps.groupBy(*key, "fp").agg(F.count("*").alias("n")).withColumn("own", F.struct(F.col("doc_id").isNull().alias("no_id"), *key))
    # the first of each fingerprint, then of each group
    first = single.groupBy("fp").agg(F.min("own").alias("own")).join(owners.select("fp", "component"), "fp")
    lead = first.groupBy("component").agg(F.min("own").alias("lead"))
    of_fp = owners.select("fp", "component").join(lead, "component").select("fp", "lead")
    judged = single.join(of_fp, "fp").withColumn("stays", F.col("own") == F.col("lead"))
    acted = scratch.write(judged.where("not stays or n > 1").select(*(F.col(c).alias(f"{c}_") for c in key), "stays"))
    size, again = acted.agg(F.count("*"), F.count(F.when(F.col("stays"), 1))).first()
    right = F.broadcast(acted) if size <= BROADCAST_ROWS else acted
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), _all_columns(docs).alias("other"))
    on = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_")) & (F.col("other") == F.col("other_"))
    kept = rows.join(right, on, "left_anti").select("row.*")
    if again:  # rows that are alike in all columns, of which one stays
        alike = rows.join(F.broadcast(acted.where("stays")) if size <= BROADCAST_ROWS else acted.where("stays"), on, "left_semi")
        kept = kept.unionByName(alike.groupBy(*key).agg(F.first("row").alias("row")).select("row.*"))
    return kept


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
