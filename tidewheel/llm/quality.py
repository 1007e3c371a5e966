"""Quality by compression: zstandard dictionaries of good and of bad text.

A text is compressed block by block with either dictionary. The normalised difference of the
sizes says which kind it is nearer to; with the compressed share and the length it becomes a
calibrated score. Dictionaries and calibration come from bounded samples of labelled rows;
every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import read_table, small_batches, whole_row

#: Labelled rows of each class for the dictionaries, of both for calibration, and the longest of them in bytes.
DICTIONARY_ROWS, CALIBRATION_ROWS, TRAIN_BYTES = 400, 3000, 32_768
#: Bytes of a dictionary, of a block, blocks of a row that a dictionary sees, and the level.
DICTIONARY, BLOCK, BLOCKS, LEVEL = 32_768, 2048, 8, 3
FOLDS, THRESHOLD = 5, 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries and weights; without enough labels, a constant prior."""

    good: bytes = b""
    bad: bytes = b""
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def scorer(self):
        return _Scorer(self)


def _blocks(text: bytes) -> list[bytes]:
    return [text[k : k + BLOCK] for k in range(0, len(text), BLOCK)] or [b""]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    table = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_AUTO)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=table, write_content_size=False, write_checksum=False, write_dict_id=False)


def _expanded(x: np.ndarray) -> np.ndarray:
    """An intercept, the features, and their squares and products."""
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.column_stack([np.ones(len(x)), x, *pairs])


class _Features:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = _compressor(good), _compressor(bad)

    def of(self, text: bytes) -> tuple[float, float, float]:
        """The normalised difference, the compressed share, and the log of the length."""
        blocks = _blocks(text)
        good = sum(len(self.good.compress(b)) for b in blocks)
        bad = sum(len(self.bad.compress(b)) for b in blocks)
        return (bad - good) / (bad + good), min(good, bad) / (len(text) + 16), float(np.log1p(len(text)))


class _Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.features = _Features(model.good, model.bad) if model.weights else None

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.features is None or not texts:
            return np.full(len(texts), self.model.prior)
        x = (np.array([self.features.of(t) for t in texts]) - self.model.mean) / self.model.scale
        return 1 / (1 + np.exp(-np.clip(_expanded(np.clip(x, -6, 6)) @ self.model.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps, halved until the loss falls."""
    w = np.zeros(x.shape[1])
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + ridge * w @ w / 2)
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        last, now = now, loss(w)
        if last - now < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled rows outside the held-out fold.

    Rows are drawn by a hash of their id: up to ``DICTIONARY_ROWS`` of each class for the
    dictionaries and ``CALIBRATION_ROWS`` others, as they come, for the calibration; texts over
    ``TRAIN_BYTES`` are not drawn, and a dictionary is trained on the first ``BLOCKS`` blocks of
    each of its rows. These bounds hold at every size of the corpus: at most 7,600 rows of 32 KB,
    250 MB, come to the driver. Jobs run when this is called.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    order, half = F.xxhash64("doc_id", F.lit(10)), F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))
    # one half of the ids is for the dictionaries, the other for the calibration; more are drawn
    # than are wanted, for those whose text is missing or too long
    drawn = [usable.where((half == 0) & (F.col("quality") == q)).orderBy(order, "doc_id").limit(2 * DICTIONARY_ROWS) for q in (0, 1)]
    drawn.append(usable.where(half == 1).orderBy(order, "doc_id").limit(2 * CALIBRATION_ROWS))
    sample = drawn[0].unionByName(drawn[1]).unionByName(drawn[2]).withColumns({"rank": order, "half": half})
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).where(F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES))
    found = text.join(F.broadcast(sample), "doc_id").orderBy("rank", "doc_id", "quality", "text")  # at most 4 x 400 + 2 x 3000 ids
    rows = [(r["half"], r["quality"], bytes(r["text"])) for r in found.toLocalIterator()]
    chosen = {q: [t for half, quality, t in rows if half == 0 and quality == q][:DICTIONARY_ROWS] for q in (0, 1)}
    others = [(quality, t) for half, quality, t in rows if half == 1][:CALIBRATION_ROWS]
    y = np.array([quality for quality, _ in others], dtype=np.float64)
    prior = float((y.sum() + 1) / (len(y) + 2))
    if len(y) < 20 or y.min() == y.max() or not chosen[0] or not chosen[1]:
        return Model(prior=prior)
    good, bad = _dictionary(chosen[1]), _dictionary(chosen[0])
    features = _Features(good, bad)
    x = np.array([features.of(t) for _, t in others])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    weights = _logistic(_expanded(np.clip((x - mean) / scale, -6, 6)), y)
    return Model(good, bad, tuple(mean), tuple(scale), tuple(weights), prior)


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the texts' own bytes where they are too few to train on."""
    blocks = [b for t in texts for b in _blocks(t)[:BLOCKS] if len(b) >= 8]
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY:].rjust(8)


def held_out(column: str = "doc_id"):
    """Whether a row is in the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def with_score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good; a null text counts as empty."""
    small_batches(docs.sparkSession)
    held: list = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(model.scorer())
        return pa.array(held[0].score([t or b"" for t in texts.to_pylist()]), pa.float64())

    return docs.withColumn(out, score(F.col("text").cast("binary")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns kept."""
    held = docs.select(whole_row(docs).alias("row"), "text")
    return with_score(held, train(docs, labels)).where(F.col("score") >= threshold).select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), train(docs, read_table(spark, sf_dir, "labels")))
    return scored.select(F.col("doc_id"), held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
