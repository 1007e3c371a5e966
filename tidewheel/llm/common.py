"""Tables, scratch storage and batch limits that the training-data operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: a Python worker holds one batch of whole texts at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
#: Bits of a table of marks: 8 MB, whatever is marked.
MARK_BITS = 26


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, by rows and by bytes.

    Plans are run after an operator has returned, so the session keeps these limits; a limit
    that is tighter already stays as it is.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and all of Spark runs
    in one process, as in tests, a temporary folder is made and set as the context's checkpoint
    folder; on a cluster that is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    own = spark.sparkContext.getCheckpointDir()
    if not own and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not own:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewheel-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


class Scratch:
    """Intermediate tables, written as Parquet into the shared folder.

    A written table cuts lineage: a lost executor costs the tasks that read it, not the jobs
    that made it. ``drop`` removes tables that later steps no longer read.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/scratch/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _delete(self, path: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.remove(path)

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._scratch_path)

    def only(self, *tables: DataFrame) -> None:
        """Removes all tables but these, which what is returned still reads."""
        kept = {df._scratch_path for df in tables}
        for path in [p for p in self.paths if p not in kept]:
            self._delete(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, apart from whatever an operator adds."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns))


def once_per_worker(key: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a Python worker and kept for its later tasks."""
    held = sys.modules.setdefault("tidewheel_worker", types.ModuleType("tidewheel_worker"))
    if key not in held.__dict__:
        held.__dict__[key] = make()
    return held.__dict__[key]


def marks_of(keys: DataFrame, column: str) -> np.ndarray:
    """A bit for the low bits of each 64-bit key: a table of fixed size, gathered as its words.

    What tasks drop by it has no key in the table. It may let other rows pass, more of them as
    it fills up with the corpus; these go to the joins that follow, and no result changes.
    """
    own = keys.select(F.expr(f"({column} & {(1 << MARK_BITS) - 1}) >> 6").alias("word"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("bit"))
    found = own.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def marked(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Whether each key (unsigned) is marked."""
    low = keys & np.uint64((1 << MARK_BITS) - 1)
    return (marks[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)
