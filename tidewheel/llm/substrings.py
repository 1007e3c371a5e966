"""Exact removal of repeated substrings by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere. Each such
string (a window) holds an anchor: the position whose next ``GRAM`` bytes hash lowest. Equal
windows have equal anchors, so only suffixes that begin at anchors are indexed, together with
the bytes before them: an entry is an anchor with its surroundings, the bytes that its windows
cover. Equal surroundings are one entry that says how many there are.

The corpus comes in batches. A batch gets its suffix array, a table in the order of its
suffixes; it is merge-scanned against the levels that are there, and levels that are no larger
than what comes merge with it, so that their sizes grow geometrically. A scan reads the suffixes
of an anchor in their order. Neighbours' common prefixes give the tree of matches to the right;
as it is climbed, each suffix is put in its place among those of its subtree by the bytes to
their left, read backwards, where its neighbours give the longest matches to the left. All
matches are of bytes compared. An anchor with very many entries is dealt out by the fingerprints
of its windows instead.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, marked, marks_of, read_table, small_batches

GRAM = 128
#: Bytes that are hashed at once; a position in them takes POSITION_BITS of a window's minimum.
BUFFER, POSITION_BITS = 1 << 21, 24
#: Batches in which the index takes the entries in.
BATCHES = 4
#: Entries of one anchor that a task holds at most (about 3 MB); those of an anchor with more are dealt out by fingerprint.
CROWD = 4096
#: Entries to extract (72 bytes each), and runs to cut (16 bytes and a key), up to which their lists are broadcast, more of them joined by a shuffle.
BROADCAST_ENTRIES, BROADCAST_RUNS = 1_000_000, 500_000
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit values, so that high and low bits are alike."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Polynomial hashes (modulo 2^64) of any substring of a buffer, from prefix sums."""

    def __init__(self, size: int = BUFFER + (1 << 16), which: int = 0):
        self.multiplier = MULTIPLIERS[which]
        self.values = np.random.default_rng(20 + which).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.powers = self.inverses = np.zeros(0, np.uint64)
        self.grow(size)

    def grow(self, size: int) -> None:
        if len(self.powers) < size:
            for name, base in (("powers", self.multiplier), ("inverses", pow(self.multiplier, -1, 1 << 64))):
                run = np.full(size, base, np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))

    def load(self, data: bytes) -> None:
        n = len(data)
        self.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[np.frombuffer(data, np.uint8)] * self.powers[:n], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """The hash of each substring of one size."""
        at = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:at]) * self.inverses[:at])

    def some(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))


def window_anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` neighbouring positions, the one whose hash is lowest (the first of equals)."""
    low = np.uint64((1 << POSITION_BITS) - 1)
    now = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    n, width = len(hashes) - span + 1, 1
    while 2 * width <= span:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    return (np.minimum(now[:n], now[span - width : span - width + n]) & low).astype(np.int64)


def _buffers(texts: list[bytes], length: int):
    """(row, offset of the piece in its text, start and end in the buffer) lists and their buffer.

    Texts of a buffer are laid end to end; one that is longer than a buffer comes in pieces that
    overlap by length - 1 bytes, so that each window is in just one piece.
    """
    places, parts, size = [], [], 0
    for row, text in enumerate(texts):
        if len(text) < length:
            continue
        step = max(length, BUFFER - length + 1)
        for at in range(0, len(text) - length + 1, step):
            piece = text[at : at + step + length - 1]
            if size and size + len(piece) > BUFFER:
                yield places, b"".join(parts)
                places, parts, size = [], [], 0
            places.append((row, at, size, size + len(piece)))
            parts.append(piece)
            size += len(piece)
    if places:
        yield places, b"".join(parts)


class Anchors:
    """The anchors of many texts at once: row, first window, end of windows, place and hash of each.

    The windows of an anchor are those whose lowest position it is.
    """

    def __init__(self):
        self.hashers = (Hasher(), Hasher(which=1))

    def of(self, texts: list[bytes], length: int):
        """(row, offset of its piece, first, last, place, hash) arrays for each buffer, whose hashes stay loaded; first, last and place are in the buffer."""
        for places, buffer in _buffers(texts, length):
            self.hashers[0].load(buffer)
            self.buffer = buffer
            grams = self.hashers[0].every(GRAM)
            anchors = window_anchors(grams, length - GRAM + 1)
            first, last, row, offset = [], [], [], []
            for r, shift, start, end in places:
                own = anchors[start : end - length + 1]
                cuts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]))
                first.append(cuts[:-1] + start)
                last.append(cuts[1:] + start)
                row.append(np.full(len(cuts) - 1, r))
                offset.append(np.full(len(cuts) - 1, shift - start))
            first, last, row, offset = map(np.concatenate, (first, last, row, offset))
            place = anchors[first]
            yield row, offset, first, last, place, grams[place]

    def around(self, first: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each of the surroundings (bytes of the buffer, and the anchor's place in them)."""
        self.hashers[1].load(self.buffer)
        return tuple(h.some(first, end) ^ _mixed(at.astype(np.uint64)) for h in self.hashers)


KEY = ("doc_id", "text_hash")
ENTRY = ("anchor", "around", "around2")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _repeated_anchors(keyed: DataFrame, length: int) -> DataFrame:
    """(anchor), those that occur more than once."""
    out = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(batches):
        anchors = Anchors()
        for batch in batches:
            found = [hashes for *_, hashes in anchors.of(batch.column(0).to_pylist(), length)]
            if found:
                own, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(n.astype(np.int64))], schema=out)

    counts = keyed.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return counts.where("n > 1").select("anchor")


def _occurrences(keyed: DataFrame, length: int, marks: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, first, last, at, anchor, around, around2) of the anchors whose hashes are marked."""
    held = keyed.sparkSession.sparkContext.broadcast(marks)
    names = ("first", "last", "at", "anchor", "around", "around2")

    def run(batches):
        anchors = Anchors()
        for batch in batches:
            for row, offset, first, last, place, hashes in anchors.of(batch.column(2).to_pylist(), length):
                keep = marked(hashes, held.value)
                if not keep.any():
                    continue
                row, offset, first, last, place, hashes = (x[keep] for x in (row, offset, first, last, place, hashes))
                one, two = anchors.around(first, last + (length - 1), place - first)
                take = pa.array(row)
                columns = [first + offset, last + offset, place - first, hashes.view(np.int64), one.view(np.int64), two.view(np.int64)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *map(pa.array, columns)], names=[*KEY, *names])

    return keyed.mapInArrow(run, ", ".join(f"{n} long" for n in (*KEY, *names)))


def _extracted(keyed: DataFrame, entries: DataFrame, n_entries: int, length: int, scratch: Scratch) -> DataFrame:
    """Adds ``head`` and ``suffix`` to the entries: their bytes before the anchor, and from it on."""
    kept = [c for c in entries.columns if c not in KEY]
    lists = scratch.write(entries.groupBy(*KEY).agg(F.collect_list(F.struct(*kept)).alias("wanted")))
    right = lists.withColumnsRenamed({c: f"{c}_" for c in KEY})
    # texts are not sorted for the join: the lists are its hashed side
    right = F.broadcast(right) if n_entries <= BROADCAST_ENTRIES else right.hint("shuffle_hash")
    on = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_"))
    cut = lambda a, b: F.substring("text", (a + 1).cast("int"), (b - a).cast("int"))
    whole = lambda w: F.struct(*(w[c].alias(c) for c in kept), cut(w["first"], w["first"] + w["at"]).alias("head"), cut(w["first"] + w["at"], w["last"] + (length - 1)).alias("suffix"))
    rows = scratch.write(keyed.join(right, on).select(F.explode(F.transform("wanted", whole)).alias("w")).select("w.*"))
    # of rows that repeat a document, each gives the entry
    return rows if rows.count() == n_entries else scratch.write(rows.dropDuplicates(list(ENTRY)))


def _common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def matches(heads: list[bytes], suffixes: list[bytes], new: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """Runs (first, end) of the windows of each entry that another entry has too.

    The entries are of one anchor, in the order of their suffixes. Window k of an entry begins k
    bytes into its head. Only pairs with a new entry are looked for.
    """
    n = len(heads)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    back = [h[::-1] for h in heads]
    # neighbours in suffix order, those with the longest common prefix first: the tree from below
    joins = sorted(((_common(suffixes[i], suffixes[i + 1]), i) for i in range(n - 1)), reverse=True)
    part = list(range(n))
    members: dict[int, list[tuple[bytes, int]]] = {i: [(back[i], i)] for i in range(n)}

    def root(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    def match(i: int, j: int, right: int) -> None:
        left = _common(back[i], back[j])
        if left + right >= length and (new[i] or new[j]):
            for e in (i, j):
                found[e].append((len(heads[e]) - left, len(heads[e]) + right - length + 1))

    for right, i in joins:
        if right < GRAM:
            break
        a, b = root(i), root(i + 1)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        held = members[a]
        for key in members.pop(b):
            at = bisect_left(held, key)
            if at:
                match(held[at - 1][1], key[1], right)
            if at < len(held):
                match(held[at][1], key[1], right)
            held.insert(at, key)
        part[b] = a
    return found


class SuffixFamily:
    """Levels of suffix arrays on shared storage, whose sizes grow geometrically.

    ``add`` takes the entries of a batch (``ENTRY``, n, head, suffix), scans them against all
    levels, and gives the runs of windows that have a match among what has been added so far.
    """

    def __init__(self, scratch: Scratch, length: int):
        self.scratch, self.length = scratch, length
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """(anchor, around, around2, start, end): window runs, counted from the entry's first window."""
        size = batch.count()
        merging, total = [], size
        while self.levels and self.levels[-1][0] <= total:
            more, level = self.levels.pop()
            merging.append(level)
            total += more
        rows = batch.withColumns({"is_new": F.lit(True), "merges": F.lit(True)})
        for tables, merges in ((merging, True), ([t for _, t in self.levels], False)):
            for t in tables:
                rows = rows.unionByName(t.withColumns({"is_new": F.lit(False), "merges": F.lit(merges)}))
        scanned = self.scratch.write(self._scan(rows))
        self.levels.append((total, scanned.where("start is null").select(*ENTRY, "n", "head", "suffix")))
        return scanned.where("start is not null").select(*ENTRY, "start", "end")

    def _scan(self, rows: DataFrame) -> DataFrame:
        """The merged level, in suffix order, and the matched runs, told apart by a null start."""
        length = self.length
        schema = pa.schema([*((c, pa.int64()) for c in ENTRY), ("n", pa.int64()), ("head", pa.binary()), ("suffix", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])

        def scanned(group: list[dict]):
            runs = matches([r["head"] for r in group], [r["suffix"] for r in group], [r["is_new"] for r in group], length) if len(group) > 1 else [[]]
            for r, own in zip(group, runs):
                name = tuple(r[c] for c in ENTRY)
                if r["is_new"] and r["n"] > 1:
                    own = [(0, len(r["head"]) + len(r["suffix"]) - length + 1)]
                yield from ((*name, None, None, None, a, b) for a, b in set(own))
                if r["merges"]:
                    yield (*name, r["n"], r["head"], r["suffix"], None, None)

        def run(batches):
            group, out = [], []
            for batch in batches:
                for r in batch.to_pylist():
                    if group and group[0]["anchor"] != r["anchor"]:
                        out += scanned(group)
                        group = []
                    group.append(r)
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
            out += scanned(group) if group else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        ordered = rows.select(*ENTRY, "n", "head", "suffix", "is_new", "merges").repartition("anchor").sortWithinPartitions("anchor", "suffix")
        return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in (*ENTRY, "n")) + ", head binary, suffix binary, start long, end long")


def _crowded_runs(entries: DataFrame, length: int) -> DataFrame:
    """(anchor, around, around2, start, end) of the windows of crowded anchors that occur more than once, by 128 bits of each."""
    out = pa.schema([*((c, pa.int64()) for c in ENTRY), ("n", pa.int64()), ("at", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64())])

    def run(batches):
        hashers = (Hasher(1 << 12), Hasher(1 << 12, 1))
        for batch in batches:
            for r in batch.to_pylist():
                for h in hashers:
                    h.load(r["head"] + r["suffix"])
                prints = [h.every(length).view(np.int64) for h in hashers]
                size = len(prints[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(size, r[c])) for c in (*ENTRY, "n")), pa.array(np.arange(size)), *map(pa.array, prints)], schema=out)

    single = entries.select(*ENTRY, "n", "head", "suffix").mapInArrow(run, ", ".join(f"{c} long" for c in (*ENTRY, "n", "at", "p1", "p2")))
    often = single.groupBy("p1", "p2").agg(F.sum("n").alias("times")).where("times > 1").select("p1", "p2")
    return single.join(often, ["p1", "p2"]).select(*ENTRY, F.col("at").alias("start"), (F.col("at") + 1).alias("end"))


def _merged(runs: DataFrame, key: list[Column]) -> DataFrame:
    """The runs (start, end) of each key with those that meet made one."""
    names = [f"k{i}" for i in range(len(key))]
    held = runs.select(*(c.alias(n) for c, n in zip(key, names)), "start", "end")
    by_place = Window.partitionBy(*names).orderBy("start")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    marks = held.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    parts = marks.withColumn("part", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy(*names, "part").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("part")


def repeated_windows(docs: DataFrame, length: int, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """(doc_id, text_hash, start, end): runs of window starts whose windows also start elsewhere."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs)
    # an anchor that occurs once has no match; marks may let some of these in, and leave none out
    found = scratch.write(_occurrences(keyed, length, marks_of(_repeated_anchors(keyed, length), "anchor")))
    place = F.min(F.struct(*KEY, "first", "last")).alias("place")
    entries = found.groupBy(*ENTRY).agg(F.count("*").alias("n"), F.first("at").alias("at"), place).select(*ENTRY, "n", "at", "place.*")
    entries = scratch.write(entries)
    crowds = entries.groupBy("anchor").agg(F.count("*").alias("many")).where(F.col("many") > CROWD).select("anchor", F.lit(True).alias("crowd"))
    batch = F.pmod(F.xxhash64(*KEY), F.lit(batches)).alias("batch")
    wanted = entries.join(crowds, "anchor", "left").select(*ENTRY, "n", "at", *KEY, "first", "last", batch, F.coalesce("crowd", F.lit(False)).alias("crowded"))
    index = _extracted(keyed, wanted, entries.count(), length, scratch)
    family = SuffixFamily(scratch, length)
    runs = [family.add(index.where(f"batch = {k} and not crowded").select(*ENTRY, "n", "head", "suffix")) for k in range(batches)]
    runs.append(_crowded_runs(index.where("crowded"), length))
    every = runs[0]
    for more in runs[1:]:
        every = every.unionByName(more)
    every = _merged(every, [F.col(c) for c in ENTRY]).select(*(F.col(f"k{i}").alias(f"{c}_") for i, c in enumerate(ENTRY)), "start", "end")
    every = scratch.write(every)
    # entries that hold a thousandth of all occurrences each are a thousand at most, and joined where their occurrences stand
    total = found.count()
    often = entries.where((F.col("n") > 1000) & (F.col("n") * 1000 > total)).select(*(F.col(c).alias(f"{c}_") for c in ENTRY))
    hot = F.broadcast(every.join(F.broadcast(often), [f"{c}_" for c in ENTRY], "left_semi"))
    on = [F.col(c) == F.col(f"{c}_") for c in ENTRY]
    rest = found.join(F.broadcast(often), on, "left_anti").join(every, on)
    both = rest.unionByName(found.join(hot, on))
    placed = both.select(*KEY, (F.col("first") + F.col("start")).alias("start"), (F.col("first") + F.col("end")).alias("end"))
    merged = _merged(placed, [F.col(c) for c in KEY])
    return scratch.write(merged.select(F.col("k0").alias("doc_id"), F.col("k1").alias("text_hash"), "start", "end"))


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row for each row of ``docs``.

    ``kept`` are the bytes that are left. A null text counts as empty; a text shorter than
    ``length`` is kept whole; rows that repeat a document are copies, of which nothing long
    enough stays. An empty table gives an empty result. Other columns are not read. Equal
    surroundings, and equal windows of crowded anchors, are told by 128 bits of hashes; all other
    matches are of bytes compared. Jobs run while the result is planned.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    scratch = Scratch(docs.sparkSession, "substrings")
    runs = repeated_windows(docs, length, scratch)
    few = runs.count() <= BROADCAST_RUNS
    scratch.only(runs)
    lists = runs.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")).withColumnsRenamed({c: f"{c}_" for c in KEY})
    lists = F.broadcast(lists) if few else lists.hint("shuffle_hash")
    on = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("text_hash") == F.col("text_hash_"))
    joined = _keyed(docs).join(lists, on, "left").select("doc_id", "text", "runs")
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text, kept, at, spans = row["text"], [], 0, 0
                removed_to = -1
                for r in row["runs"] or ():
                    start, end = r["start"], r["end"] + length - 1
                    if start > removed_to:
                        kept.append(text[at:start])
                        spans += 1
                    removed_to = max(removed_to, end)
                    at = removed_to
                kept.append(text[at:])
                left = b"".join(kept)
                rows.append((row["doc_id"], len(text), len(text) - len(left), spans, left))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, out)], schema=out)

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
