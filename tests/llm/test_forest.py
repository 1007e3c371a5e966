"""Vector links against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import forest as R


def brute(rows, least=0.93):
    good = [k for k, (_, label, e) in enumerate(rows) if label is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                a, b = (np.array(rows[k][2]) / np.abs(rows[k][2]).max() for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].add(j)
    out = []
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        least_id = min(rows[j][0] for j in seen)
        out.append((rows[k][0], len(links[k]), least_id, least_id == rows[k][0]))
    return sorted(out)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    return df.withColumns({c: F.lit("x") for c in ("uid", "leaf", "links", "copies", "first", "dims", "component")})


def got(df):
    return sorted(map(tuple, R.near_vectors(df).collect()))


def test_messy_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0, [1.0, 0.0]), (2, 0, [2.0, 0.1]), (3, 1, [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, 0, None), (6, 0, [0.0, 0.0]), (7, 0, [nan, 1.0]), (8, 0, [inf, 1.0]),
        (9, 0, [1.0, None]), (10, 0, []), (11, 0, [1.0, 0.0]), (11, 0, [1.0, 0.0]), (12, 0, [1.0, 0.0, 0.0]), (13, 0, [1e200, 1e199]), (14, 0, [-1.0, 0.0]), (15, 0, [1e-310, 0.0]),
    ]
    assert got(vectors(spark, rows)) == brute(rows)


def test_empty_table(spark):
    assert got(vectors(spark, [(1, 1, [1.0])]).where("false")) == []


def planted(rng, n, near, dims, label=0):
    """Vectors and partners of some at a cosine from 0.93 to 0.97."""
    base = rng.normal(size=(n, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(near, dims))
    off -= (off * base[:near]).sum(axis=1, keepdims=True) * base[:near]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.97, size=(near, 1))
    both = np.concatenate([base, cosine * base[:near] + np.sqrt(1 - cosine**2) * off])
    return [(k, label, v) for k, v in enumerate(both.tolist())]


@pytest.mark.parametrize("block", [8192, 40])
def test_recall_with_crowds_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "LEAF", 40)
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1, None):
        base = rng.normal(size=(250, 16))
        crowd = base[0] + 0.12 * rng.normal(size=(120, 16))
        pairs = base[1:60] + 0.25 * rng.normal(size=(59, 16))
        for v in np.concatenate([base, crowd, pairs, np.repeat(base[5:6], 70, axis=0)]):
            rows.append((n, label, v.tolist()))
            n += 1
    mine, want = got(vectors(spark, rows)), brute(rows)
    found, true = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert true > 10_000 and all(a[1] <= b[1] for a, b in zip(mine, want))
    assert found >= 0.97 * true, found / true
    assert np.mean([a[2] == b[2] for a, b in zip(mine, want)]) > 0.97


def test_recall_at_the_shipped_parameters(spark):
    """64 dimensions, trees of 6 levels, links just above the least cosine."""
    rows = planted(np.random.default_rng(3), 5000, 1500, 64)
    assert int(np.ceil(np.log2(len(rows) / R.LEAF))) > 4
    x = np.array([r[2] for r in rows])
    near = np.triu(x @ x.T >= 0.93, 1)
    mine = got(vectors(spark, rows))
    links = {r[0]: r[1] for r in mine}
    want = near.sum(axis=0) + near.sum(axis=1)
    assert near.sum() >= 1500 and all(links[k] <= want[k] for k in links)
    assert sum(links.values()) >= 0.95 * want.sum(), sum(links.values()) / want.sum()


def test_depth_grows_and_rows_stay_in_proportion(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    shares, leaves = [], []
    for n in (10_000, 50_000):
        x = np.random.default_rng(n).normal(size=(n, 64)).astype(np.float32)
        pq.write_table(pa.table({"uid": np.arange(n), "label": ["a"] * n, "copies": np.ones(n, np.int64), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), 64).cast(pa.list_(pa.float32()))}), tmp_path / str(n))
        forest = R.fit_forest(R._unit(x[: R.SAMPLE]), int(np.ceil(np.log2(n / R.LEAF))), 0.93, 7)
        dealt = R._dealt(spark.read.parquet(str(tmp_path / str(n))), {64: forest}, False)
        shares.append(dealt.count() / n)
        leaves.append(dealt.groupBy("tree", "leaf").count().agg(F.avg("count")).first()[0])
    assert shares[1] < 1.5 * shares[0], shares  # copies of a vector grow with the depth's share of spill, not with the leaf
    assert leaves[1] < 1.5 * leaves[0] < 6 * R.LEAF, leaves


def test_trees_spill_at_the_margin():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plain, wide = (R.fit_tree(x, 3, spill, np.random.default_rng(0)) for spill in (0.0, 0.2))
    rows, leaf = plain.leaves(x)
    assert sorted(rows) == list(range(400)) and set(leaf) == set(range(8, 16)) and max(np.bincount(leaf)) < 60
    more_rows, more_leaf = wide.leaves(x)
    assert 1.5 * 400 < len(more_rows) < 2.0 * 400 and set(zip(rows, leaf)) <= set(zip(more_rows, more_leaf))


def test_trees_go_deeper_than_their_sample():
    x = R._unit(np.random.default_rng(4).normal(size=(20_000, 16)))
    tree = R.fit_tree(x[:256], 8, 0.0, np.random.default_rng(0))  # three levels are fitted
    assert len(tree.rules) == 8 and len(np.unique(tree.leaves(x)[1])) > 200 and np.bincount(tree.leaves(x)[1]).max() < 600


@pytest.mark.parametrize("depth", [0, 2, 12])
def test_equal_vectors_do_not_split(depth):
    x = np.ones((50, 3)) / np.sqrt(3)
    assert all(len(t.leaves(x)[0]) == 50 and len(set(t.leaves(x)[1])) == 1 for t in R.fit_forest(x, depth, 0.93, 1))


@pytest.mark.parametrize("seed", range(5))
def test_links_of_a_leaf(monkeypatch, seed):
    monkeypatch.setattr(R, "TILE", 7)
    rng = np.random.default_rng(seed)
    x = R._unit(np.concatenate([rng.normal(size=(40, 4)), rng.normal(size=(1, 4)) + 0.2 * rng.normal(size=(30, 4))]))
    copies, side = rng.integers(1, 4, 70), rng.integers(0, 2, 70)
    earlier = [R._padded(np.arange(70), rng.integers(0, 5, 70), 70)]
    for sides in (None, side):
        links, label = R.leaf_links(x, copies, sides, earlier, 0.93)
        near = x @ x.T >= 0.93
        np.fill_diagonal(near, False)
        if sides is not None:
            near &= side[:, None] != side[None, :]
        first = near & (earlier[0] != earlier[0].T)
        assert (links == first @ copies).all()
        want = np.arange(70)
        for _ in range(70):
            want = np.minimum(want, np.where(near, want[None, :], 70).min(axis=1))
        assert (label == want).all()
