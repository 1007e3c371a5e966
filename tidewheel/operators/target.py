"""The reversible log-difference target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidewheel.functions.scalars import libm
from tidewheel.operators.series import DAY, at_offset, series, with_day


class TargetTransformer:
    """y = log1p(value at day + horizon) - log1p(value), per entity; inverted by an anchor column."""

    def __init__(self, horizon: int, value_col: str = "sales", date_col: str = "date", entity: tuple[str, ...] = ("store",)):
        if horizon < 0:
            raise ValueError("the horizon must not be negative")
        self.horizon, self.value_col, self.date_col, self.entity = horizon, value_col, date_col, entity
        self.anchor_col: str | None = None

    def _check(self, df: DataFrame) -> None:
        kinds = dict(df.dtypes)
        if kinds.get(self.date_col) != "date":
            raise ValueError(f"{self.date_col} must be a date column")
        if missing := [c for c in self.entity if c not in kinds]:
            raise ValueError(f"no entity column {missing[0]}")

    def fit(self, df: DataFrame, anchor_col: str | None = None) -> TargetTransformer:
        """Names the anchor (log1p of the value on the same row) that ``inverse_transform`` uses."""
        self._check(df)
        if anchor_col is not None and anchor_col not in df.columns:
            raise ValueError(f"no anchor column {anchor_col}")
        self.anchor_col = anchor_col or "anchor"
        return self

    def column(self, logged: Column, w: WindowSpec) -> Column:
        """The target over ``w``, from a column with the log of the value + 1."""
        return at_offset(logged, self.horizon, w) - logged

    def transform(self, df: DataFrame, out: str = "y") -> DataFrame:
        """Adds the target and the anchor, and drops rows whose day + horizon is absent."""
        self._check(df)
        held = with_day(df, self.date_col) if DAY not in df.columns else df
        held = held.withColumn("_logged", libm("log", F.col(self.value_col) + 1))
        held = held.withColumn(out, self.column(F.col("_logged"), series(*self.entity)))
        if self.anchor_col == "anchor":
            held = held.withColumn("anchor", F.col("_logged"))
        return held.where(F.col(out).isNotNull()).select(*df.columns, *(["anchor"] if self.anchor_col == "anchor" else []), out)

    def inverse_transform(self, df: DataFrame, prediction: str = "y", out: str = "predicted", value: str | None = None) -> DataFrame:
        """exp(anchor + prediction) - 1, rounded half to even, with the date moved to day + horizon.

        ``value`` names the column that the anchor is the log of, where the table has it: what
        is forecast is then reckoned from the value itself, so that a prediction of 0 gives just
        that value, and halves stay halves until they are rounded.
        """
        if self.anchor_col is None:
            raise ValueError("fit first")
        if value is None:
            ahead = libm("exp", F.col(self.anchor_col) + F.col(prediction)) - 1
        else:
            ahead = F.col(value) + (F.col(value) + 1) * F.expm1(prediction)
        return df.withColumn(out, F.bround(ahead, 0).cast("long")).withColumn(self.date_col, F.date_add(self.date_col, self.horizon))
