"""Gapped sliding-window cross-validation over calendar dates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Sizes:
    outer_train: int
    outer_test: int
    inner_train: int
    inner_test: int


def cv_sizes(n_dates: int, horizon: int, n_outer: int, n_inner: int) -> Sizes:
    """Window lengths, in dates, of nested folds that use up all ``n_dates`` dates."""
    outer = n_dates - horizon * (n_outer + 1)
    inner = outer - horizon * (n_inner + 1)
    if inner <= 0:
        raise ValueError(f"{n_dates} dates are too few for {n_outer} x {n_inner} folds of {horizon}")
    return Sizes(outer, horizon, inner, horizon)


class TimeSeriesCV:
    """Folds that slide by the test length; the last ends on the last date.

    Positions count sorted distinct dates of the whole table, whichever entity has them.
    """

    def __init__(self, n_splits: int, train: int, test: int, gap: int, date_col: str = "date"):
        self.n_splits, self.train, self.test, self.gap, self.date_col = n_splits, train, test, gap, date_col

    def get_n_splits(self) -> int:
        return self.n_splits

    def positions(self, n_dates: int) -> list[tuple[int, int, int, int, int]]:
        """(fold, train_start, train_end, test_start, test_end), inclusive, from 0; folds from 1."""
        out = []
        for fold in range(1, self.n_splits + 1):
            test_end = n_dates - 1 - (self.n_splits - fold) * self.test
            test_start = test_end - self.test + 1
            train_end = test_start - self.gap - 1
            train_start = train_end - self.train + 1
            if train_start < 0:
                raise ValueError(f"fold {fold} would begin {-train_start} dates before the first")
            out.append((fold, train_start, train_end, test_start, test_end))
        return out

    def folds(self, df: DataFrame) -> DataFrame:
        """A row for each fold with its four boundary dates.

        Distinct dates are few whatever the table's size; only they are numbered.
        """
        dates = df.select(self.date_col).distinct()
        n = dates.count()
        spark: SparkSession = df.sparkSession
        numbered = dates.withColumn("at", F.row_number().over(Window.orderBy(self.date_col)) - 1)
        names = ("train_start", "train_end", "test_start", "test_end")
        table = spark.createDataFrame(self.positions(n), "fold int, train_start int, train_end int, test_start int, test_end int")
        long = table.select("fold", F.explode(F.array(*(F.struct(F.lit(k).alias("edge"), F.col(k).alias("at")) for k in names))).alias("x")).select("fold", "x.edge", "x.at")
        joined = long.join(numbered, "at")
        return joined.groupBy("fold").agg(*(F.max(F.when(F.col("edge") == k, F.col(self.date_col))).alias(k) for k in names))

    def fold_rows(self, df: DataFrame, folds: DataFrame | None = None) -> DataFrame:
        """``df`` once for each fold that a row belongs to, with fold and part ('train' or 'test')."""
        folds = folds if folds is not None else self.folds(df)
        day = F.col(self.date_col)
        inside = lambda a, b: (day >= F.col(a)) & (day <= F.col(b))
        part = F.when(inside("train_start", "train_end"), "train").when(inside("test_start", "test_end"), "test")
        folds = F.broadcast(folds)  # n_splits rows
        joined = df.join(folds, inside("train_start", "train_end") | inside("test_start", "test_end"))
        return joined.withColumn("part", part).drop("train_start", "train_end", "test_start", "test_end")

    def split(self, df: DataFrame):
        """(train, test) tables, fold by fold."""
        rows = sorted(self.folds(df).collect(), key=lambda r: r.fold)
        for r in rows:
            yield df.where(F.col(self.date_col).between(r.train_start, r.train_end)), df.where(F.col(self.date_col).between(r.test_start, r.test_end))
