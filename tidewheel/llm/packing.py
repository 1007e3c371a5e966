"""Best-fit packing of documents into fixed token budgets by a grouping genetic algorithm.

Only the remainder of a document (its first piece) needs packing; its other pieces fill a
sequence each. Remainders of one length are interchangeable, so a block of documents is held as
a histogram of lengths. Blocks of bounded size are evolved by several islands, each a task of
its own; after each epoch an island's best packings move on to the next island. Documents get
their places by their rank within block and length. Bins that stay badly filled are dissolved,
and their documents from all blocks are packed together in a further pass.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, once_per_worker, read_table, small_batches

#: The token that ends each document.
END_ID = 2
#: Characters of a text that are encoded at once.
SEGMENT = 1 << 18


class Tokens:
    """Token ids as little-endian uint32 bytes.

    ``ranks`` is a file of the vocabulary of a byte-level BPE tokenizer, and ``vocabulary`` the
    tokenizer's own file, which names the tokens added to it: these are found in a text before
    all else. A blank before a visible character always begins a new token, so long texts are
    cut there.
    """

    def __init__(self, ranks: str, vocabulary: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        with open(vocabulary, encoding="utf-8") as file:
            self.added = {t["content"]: t["id"].to_bytes(4, "little") for t in json.load(file)["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, longest_first))})")
        self.encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.safe = re.compile(r" (?=\S)")

    def encode(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added.get(part) or self.between(part) for part in self.split.split(text) if part)
        return self.between(text)

    def between(self, text: str) -> bytes:
        """The ids of a text without added tokens."""
        parts, at = [], 0
        while at < len(text):
            cut = self.safe.search(text, at + SEGMENT)
            end = cut.start() if cut else len(text)
            parts.append(array("I", self.encoding.encode_ordinary(text[at:end])).tobytes())
            at = end
        return b"".join(parts)


def pieces(docs: DataFrame, ranks: str, vocabulary: str, budget: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and END_ID, cut to the budget."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        tokens = once_per_worker(f"tokens {ranks} {vocabulary}", lambda: Tokens(ranks, vocabulary))
        for batch in batches:
            out = [[] for _ in schema]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview((tokens.encode(text) if text else b"") + END_ID.to_bytes(4, "little"))
                n, at, piece = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - 1) % budget + 1 if piece == 0 else budget
                    for column, value in zip(out, (doc_id, piece, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]))):
                        column.append(value)
                    at, piece = at + size, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths, budget: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Puts each length, longest first, into the fullest bin that has room."""
    bins = [list(b) for b in bins or []]
    room: list[list[int]] = [[] for _ in range(budget + 1)]
    mask = 0
    for k, b in enumerate(bins):
        if left := budget - sum(b):
            room[left].append(k)
            mask |= 1 << left
    for length in sorted(lengths, reverse=True):
        high = mask >> length
        if high:
            left = length + (high & -high).bit_length() - 1
            k = room[left].pop()
            if not room[left]:
                mask ^= 1 << left
            bins[k].append(length)
        else:
            k, left = len(bins), budget
            bins.append([length])
        if left := left - length:
            room[left].append(k)
            mask |= 1 << left
    return bins


def crossover(mother: list[list[int]], father: list[list[int]], budget: int, share: float, rng) -> list[list[int]]:
    """Injects the father's best-filled bins whole; bins of the mother that hold duplicates of
    what was injected are dissolved, and what they displace is best-fitted."""
    ranked = sorted(father, key=lambda b: budget - sum(b) + rng.random())
    injected = ranked[: max(1, int(share * len(ranked)))]
    twice: dict[int, int] = {}
    for b in injected:
        for length in b:
            twice[length] = twice.get(length, 0) + 1
    kept, displaced = [], []
    order = sorted(mother, key=sum)  # the emptiest bins give up their duplicates first
    for b in order:
        if twice and any(twice.get(x) for x in b):
            for x in b:
                if twice.get(x):
                    twice[x] -= 1
                else:
                    displaced.append(x)
        else:
            kept.append(b)
    return best_fit(displaced, budget, injected + kept)


def mutate(bins: list[list[int]], budget: int, share: float, rng) -> list[list[int]]:
    """Dissolves the emptiest bins and some at random, and best-fits their documents."""
    ranked = sorted(bins, key=sum)
    n = max(1, int(share * len(ranked)))
    gone = set(range(n)) | set(rng.choice(len(ranked), size=n, replace=False).tolist())
    loose = [x for k in gone for x in ranked[k]]
    return best_fit(loose, budget, [b for k, b in enumerate(ranked) if k not in gone])


def worth(bins: list[list[int]], budget: int) -> tuple[int, float]:
    """Fewer bins first, then better-filled ones."""
    return len(bins), -sum((sum(b) / budget) ** 2 for b in bins)


def evolve(lengths: list[int], seeds: list[list[list[int]]], budget: int, generations: int, population: int, rng) -> list[list[list[int]]]:
    """The two best packings of one island after some generations; ends early at the lower bound."""
    least = -(-sum(lengths) // budget)
    found = list(seeds) or [best_fit(lengths, budget)]
    found.sort(key=lambda b: worth(b, budget))
    while len(found[0]) > least and len(found) < population:
        found.append(mutate(found[0], budget, 0.1, rng))
    for _ in range(generations):
        found.sort(key=lambda b: worth(b, budget))
        if len(found[0]) <= least:
            break
        a, b = rng.choice(len(found), size=2, replace=False)
        child = crossover(found[min(a, b)], found[max(a, b)], budget, 0.3, rng)
        child = min(child, mutate(child, budget, 0.05, rng), key=lambda x: worth(x, budget))
        found[-1] = min(found[-1], child, key=lambda x: worth(x, budget))
    found.sort(key=lambda b: worth(b, budget))
    return found[:2]


def _packed(bins: list[list[int]]) -> bytes:
    """Lengths of each bin, with 0 after each bin."""
    return np.array([x for b in bins for x in (*b, 0)], dtype="<i4").tobytes()


def _unpacked(raw: bytes) -> list[list[int]]:
    bins, now = [], []
    for x in np.frombuffer(raw, dtype="<i4").tolist():
        if x:
            now.append(x)
        else:
            bins.append(now)
            now = []
    return bins


def _epoch(rows: DataFrame, budget: int, generations: int, population: int, seed: int, tasks: int) -> DataFrame:
    """(block, island, elite: list of packings, bins) from rows of a histogram or of elites.

    The rows are few bytes but much work, so they are dealt to a set number of tasks.
    """

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0]), int(key[1])])
        seeds = [_unpacked(raw) for elite in frame["elite"] if elite is not None for raw in elite]
        if seeds:
            lengths = [x for b in seeds[0] for x in b]
        else:
            lengths = np.repeat(frame["length"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)).tolist()
        found = evolve(lengths, seeds, budget, generations, population, rng)
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "elite": [[_packed(b) for b in found]], "bins": [len(found[0])]})

    return rows.repartition(tasks, "block", "island").groupBy("block", "island").applyInPandas(run, "block long, island int, elite array<binary>, bins int")


def _places(best: DataFrame, budget: int, least_fill: int) -> DataFrame:
    """(block, length, place, bin, offset): for the place-th document of a length, where it goes.

    bin is null where the bin is to be dissolved.
    """

    def run(frames):
        for frame in frames:
            for block, raw in zip(frame["block"], frame["best"]):
                seen: dict[int, int] = {}
                rows = []
                for k, b in enumerate(_unpacked(raw)):
                    at, keep = 0, sum(b) >= least_fill
                    for x in b:
                        seen[x] = seen.get(x, 0) + 1
                        rows.append((block, x, seen[x], k if keep else -1, at))
                        at += x
                yield pd.DataFrame(rows, columns=["block", "length", "place", "bin", "offset"])

    return best.mapInPandas(run, "block long, length long, place int, bin long, offset long")


def pack(pieces: DataFrame, scratch: Scratch, budget: int = 1024, block_items: int = 8192, islands: int = 3, epochs: int = 2, generations: int = 6, population: int = 5, passes: int = 2) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (uid unique, length from 1 to the budget)."""
    whole = pieces.where(F.col("length") == budget).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))
    loose = pieces.where(F.col("length") < budget)
    done, tables = [whole], [pieces]
    default_tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for turn in range(passes):
        count = loose.count()
        if not count:
            break
        blocks = -(-count // block_items)
        tasks = min(blocks * islands, max(default_tasks, blocks * islands // 16))
        items = loose.withColumn("block", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(blocks)))
        counted = items.groupBy("block", "length").agg(F.count("*").alias("n"))
        rows = counted.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).withColumn("elite", F.lit(None).cast("array<binary>"))
        for epoch in range(epochs):
            state = scratch.write(_epoch(rows, budget, generations, population, 1000 * turn + epoch, tasks))
            moved = F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")
            rows = state.select("block", "island", "elite").unionByName(state.select("block", moved.alias("island"), F.slice("elite", 1, 1).alias("elite")))
        best = state.groupBy("block").agg(F.min_by(F.col("elite")[0], F.struct("bins", "island")).alias("best"))
        last = turn == passes - 1
        places = _places(best, budget, 0 if last else int(0.97 * budget))
        ranked = items.withColumn("place", F.row_number().over(Window.partitionBy("block", "length").orderBy("uid")))
        placed = ranked.join(places, ["block", "length", "place"])
        # a block may hold more than block_items, and each may take a bin of its own
        placed = scratch.write(placed.select(*loose.columns, F.when(F.col("bin") >= 0, (F.col("block") * passes + turn) * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset"))
        tables.append(placed)
        done.append(placed.where("sequence_id is not null"))
        loose = placed.where("sequence_id is null").drop("sequence_id", "offset")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    scratch.only(*(t for t in tables if hasattr(t, "_scratch_path")))
    return out


def pack_documents(docs: DataFrame, budget: int = 1024, ranks: str | None = None, vocabulary: str | None = None, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece.

    A null or empty text is the end token alone. Rows that repeat a doc_id are documents of
    their own. An empty table gives an empty result. Other columns are not read. Jobs run while
    the result is planned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    cut = pieces(docs, ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), vocabulary or public_tokenizers.path("byte_bpe_50k.json"), budget)
    cut = scratch.write(cut.withColumn("uid", F.monotonically_increasing_id()))
    return pack(cut, scratch, budget, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
