"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits the space again and again at the median of a random projection; the vectors
nearest to a split go to both sides. The depth follows from the largest label, so leaves stay as
small at any size, and the number of trees from what a tree finds of pairs planted just at the
least cosine. Rules come from a sample, below its resolution from the medians of the sampled
region that they lie in. Vectors of one label are compared within leaves. A pair that shares
several leaves counts in the first only, so links are counted without listing pairs; a leaf
gives each vector's number of links and one edge for it, never a row for each pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, read_table, small_batches
from tidewheel.llm.graph import components

#: Vectors that rules are fitted on, the fewest of them that a rule is fitted on, and the vectors wanted in a leaf.
SAMPLE, FEWEST, LEAF = 8192, 32, 128
#: The share of vectors at a split that go to both sides, and the copies of a vector in a tree at most, on average.
SPILL, COPIES = 0.2, 3.0
#: The share of pairs just at the least cosine that the forest is to find, and its trees at least and at most.
RECALL, LEAST_TREES, MOST_TREES = 0.98, 3, 64
#: Vectors of a leaf that a task compares at most; a leaf with more is compared in blocks. Rows of a tile.
BLOCK, TILE = 8192, 128
#: Crowded leaves and distinct vectors, up to which their tables are broadcast, beyond it joined by a shuffle.
BROADCAST_LEAVES, BROADCAST_VECTORS = 20_000, 500_000


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """An Arrow list column of one length as a matrix."""
    return np.array(column.to_pylist(), dtype=np.float64) if len(column) else np.zeros((0, 1))


@dataclass(frozen=True)
class Tree:
    """Directions by level, thresholds and margins by node (numbered like a heap), and below the
    last fitted level those by last fitted node and level."""

    directions: np.ndarray
    rules: np.ndarray
    deep: np.ndarray

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of each row of ``x`` and leaf that it is in; a row near a split is on both sides."""
        rows, node = np.arange(len(x)), np.ones(len(x), np.int64)
        fitted = len(self.rules).bit_length() - 1
        for level, direction in enumerate(self.directions):
            rule = self.rules[node] if level < fitted else self.deep[(node >> (level - fitted)) - (1 << fitted), level - fitted]
            at = x[rows] @ direction - rule[:, 0]
            low, high = at <= rule[:, 1], at > -rule[:, 1]
            rows, node = np.concatenate((rows[low], rows[high])), np.concatenate((2 * node[low], 2 * node[high] + 1))
        return rows, node


def fit_tree(sample: np.ndarray, depth: int, spill: float, rng) -> Tree:
    """A tree of the depth whose rules are medians of the sample's projections."""
    directions = rng.normal(size=(depth, sample.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    fitted = max(0, min(depth, int(np.log2(max(1, len(sample) // FEWEST)))))
    rules = np.zeros((1 << fitted, 2))
    held = {1: np.arange(len(sample))}

    def rule(at: np.ndarray) -> tuple[float, float]:
        if not len(at):
            return 0.0, 0.0
        middle = float(np.median(at))
        return middle, float(np.quantile(np.abs(at - middle), spill)) if spill else 0.0

    for level in range(fitted):
        below = {}
        for node, rows in held.items():
            at = sample[rows] @ directions[level]
            rules[node] = rule(at)
            low = at <= rules[node, 0]
            below[2 * node], below[2 * node + 1] = rows[low], rows[~low]
        held = below
    deep = np.zeros((1 << fitted, depth - fitted, 2))
    for node, rows in held.items():
        for k in range(depth - fitted):
            deep[node - (1 << fitted), k] = rule(sample[rows] @ directions[fitted + k])
    return Tree(directions, rules, deep)


def found_by(tree: Tree, x: np.ndarray, y: np.ndarray) -> float:
    """The share of the pairs of rows of ``x`` and ``y`` that meet in a leaf."""
    key = lambda found: found[0] * (1 << 40) + found[1]
    a, b = key(tree.leaves(x)), key(tree.leaves(y))
    return len(np.unique(np.intersect1d(a, b) >> 40)) / max(1, len(x))


def fit_forest(sample: np.ndarray, depth: int, least: float, seed: int) -> list[Tree]:
    """As many trees as find ``RECALL`` of pairs at the least cosine, planted beside the sample's vectors."""
    spill = min(SPILL, COPIES ** (1 / depth) - 1) if depth else 0.0
    rng = np.random.default_rng([seed, sample.shape[1]])
    near = sample[: min(len(sample), 2000)]
    off = rng.normal(size=near.shape)
    off -= (off * near).sum(axis=1, keepdims=True) * near
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
    planted = least * near + np.sqrt(1 - least**2) * off
    trees, missed = [], 1.0
    while len(trees) < (LEAST_TREES if depth else 1) or (1 - missed < RECALL and len(trees) < MOST_TREES):
        trees.append(fit_tree(sample, depth, spill, rng))
        missed *= 1 - found_by(trees[-1], near, planted)
    return trees


def _valid(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _meet_earlier(i: np.ndarray, j: np.ndarray, held: list[np.ndarray]) -> np.ndarray:
    """Whether rows i and j share one of the leaves that ``held`` lists by tree, padded by -1."""
    met = np.zeros(len(i), bool)
    for leaves in held:
        todo = np.flatnonzero(~met)
        a, b = leaves[i[todo]], leaves[j[todo]]
        hit = np.zeros(len(todo), bool)
        for k in range(leaves.shape[1]):
            hit |= ((a[:, k : k + 1] == b) & (b >= 0)).any(axis=1)
        met[todo[hit]] = True
    return met


def _padded(rows: np.ndarray, leaf: np.ndarray, n: int) -> np.ndarray:
    """The leaves of each of n rows, side by side."""
    order = np.argsort(rows, kind="stable")
    rows, leaf = rows[order], leaf[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    out = np.full((n, int(place.max(initial=0)) + 1), -1, np.int64)
    out[rows, place] = leaf
    return out


def leaf_links(x: np.ndarray, copies: np.ndarray, side: np.ndarray | None, earlier: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that are first met in this leaf, and the first row of each row's component (its own, if none).

    ``side``: only rows of different sides are compared. Similarities are made a tile at a time.
    """
    n = len(x)
    links, label = np.zeros(n, np.int64), np.arange(n)
    for at in range(0, n, TILE):
        i, j = np.nonzero(x[at : at + TILE] @ x[at:].T >= least)
        i, j = i + at, j + at
        keep = i < j
        if side is not None:
            keep &= side[i] != side[j]
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        while True:  # hook the higher label to the lower one until nothing moves
            a, b = label[i], label[j]
            if (a == b).all():
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        first = ~_meet_earlier(i, j, earlier)
        i, j = i[first], j[first]
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
    return links, label


def _dealt(single: DataFrame, forests: dict[int, list[Tree]], vectors: bool) -> DataFrame:
    """(label, dims, tree, leaf) of each vector and leaf that it is in; with uid, copies and embedding if asked for."""
    context = single.sparkSession.sparkContext
    held = context.broadcast(forests)
    more = "".join(f", {n} {t}" for n, t in single.select("uid", "copies", "embedding").dtypes) if vectors else ""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                x = _unit(_rows_of(part.column("embedding")))
                for k, tree in enumerate(held.value[int(dims)]):
                    rows, leaf = tree.leaves(x)
                    own = part.take(pa.array(rows))
                    columns = [own.column("label"), pa.array(np.full(len(rows), dims, np.int32)), pa.array(np.full(len(rows), k, np.int32)), pa.array(leaf)]
                    names = ["label", "dims", "tree", "leaf"]
                    if vectors:
                        columns, names = [*columns, own.column("uid"), own.column("copies"), own.column("embedding")], [*names, "uid", "copies", "embedding"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(single.sparkSession)
    return single.select("label", F.size("embedding").alias("dims"), "uid", "copies", "embedding").mapInArrow(run, f"label string, dims int, tree int, leaf long{more}")


def _key(label: Column, embedding: Column) -> list[Column]:
    """128 bits that stand for a vector of a label."""
    return [F.xxhash64(label, embedding).alias("k1"), F.xxhash64(embedding, label, F.lit("second")).alias("k2")]


def near_vectors(vectors: DataFrame, least: float = 0.93, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, label, embedding).

    Vectors of equal, non-null labels and equal length link at a cosine of ``least``. A null or
    zero vector, or one with null or non-finite components, or with a null label, links with
    nothing. Equal vectors link with each other and are searched once; a row finds its vector by
    128 bits of hashes. Rows that repeat a vec_id are vectors of their own. A null vec_id keeps a
    null component unless it links with another. The trees are fitted on at most ``SAMPLE``
    vectors; all vectors are indexed. Jobs run while the result is planned.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "forest")
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").withColumn("valid", _valid(F.col("embedding")) & F.col("label").isNotNull())
    single = rows.where("valid").groupBy("label", "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    single = scratch.write(single.withColumn("uid", F.monotonically_increasing_id()))
    sample = single.orderBy(F.xxhash64("embedding", "label")).limit(SAMPLE).select("embedding").toArrow().column(0)
    sizes = single.groupBy(F.size("embedding").alias("dims"), "label").count().groupBy("dims").agg(F.max("count").alias("most"), F.sum("count").alias("n")).collect()
    lengths = np.array([len(e) for e in sample.to_pylist()], dtype=np.int64)
    forests: dict[int, list[Tree]] = {}
    for dims, most, _ in sizes:
        own = np.flatnonzero(lengths == dims)  # a length too rare for the sample has one leaf
        depth = max(0, int(np.ceil(np.log2(most / LEAF)))) if len(own) else 0
        fitted = _unit(_rows_of(sample.take(pa.array(own)))) if len(own) else np.zeros((1, dims))
        forests[dims] = fit_forest(fitted, depth, least, seed)
    group = ["label", "dims", "tree", "leaf"]
    crowded = scratch.write(_dealt(single, forests, False).groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(*group, F.ceil(2 * F.col("n") / BLOCK).cast("int").alias("blocks")))
    n_crowded = crowded.count()
    members = _dealt(single, forests, True)
    if n_crowded:
        members = members.join(F.broadcast(crowded) if n_crowded <= BROADCAST_LEAVES else crowded, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
        members = members.withColumn("side", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        members = members.withColumn("a", F.least("side", "other")).withColumn("b", F.greatest("side", "other")).drop("blocks", "other")
    else:
        members = members.withColumns({"side": F.lit(0), "a": F.lit(0), "b": F.lit(0)})
    held = spark.sparkContext.broadcast(forests)
    out = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        x = _unit(_rows_of(table.column("embedding")))
        tree, leaf, a, b = (table.column(c)[0].as_py() for c in ("tree", "leaf", "a", "b"))
        forest = held.value[x.shape[1]]
        earlier = [_padded(*t.leaves(x), len(x)) for t in forest[:tree]]
        rows, leaves = forest[tree].leaves(x)
        before = leaves < leaf
        if before.any():
            earlier.append(_padded(rows[before], leaves[before], len(x)))
        side = None if a == b else table.column("side").to_numpy()
        links, label = leaf_links(x, table.column("copies").to_numpy(), side, earlier, least)
        uid = table.column("uid").to_numpy()
        joined = np.zeros(len(x), bool)
        joined[label[label != np.arange(len(x))]] = True
        joined |= (label != np.arange(len(x))) | (links > 0)
        return pa.Table.from_arrays([pa.array(uid[joined]), pa.array(links[joined]), pa.array(uid[label[joined]])], schema=out)

    found = scratch.write(members.groupBy(*group, "a", "b").applyInArrow(compare, "uid long, links long, root long"))
    links = found.groupBy("uid").agg(F.sum("links").alias("links"))
    parts = scratch.write(components(spark, found.select(F.col("uid").alias("a"), F.col("root").alias("b")), scratch))
    named = single.join(links, "uid", "left").join(parts, single.uid == parts.node, "left").withColumn("component", F.coalesce("component", "uid"))
    least_id = named.groupBy("component").agg(F.min("first").alias("component_id"))
    known = scratch.write(named.join(least_id, "component").select(*_key(F.col("label"), F.col("embedding")), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    scratch.only(known)
    known = F.broadcast(known) if sum(r.n for r in sizes) <= BROADCAST_VECTORS else known
    k1, k2 = _key(F.col("label"), F.col("embedding"))
    # the rows travel without their vectors; a null key joins with nothing
    out_rows = rows.select("vec_id", "valid", F.when(F.col("valid"), k1).alias("r1"), F.when(F.col("valid"), k2).alias("r2"))
    joined = out_rows.join(known, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")), "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op5_forest(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: All pairs in DuckDB's SQL: the query's result where a label has one leaf, as in small tables.
OP5_SQL = """
WITH RECURSIVE
vectors AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
usable AS (
  SELECT * FROM vectors
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM vectors UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(other) FROM reach r WHERE r.vec_id = v.vec_id) AS kept
FROM vectors v
"""
