"""Which subdivision's holidays an entity keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.sources.holidays import STATES


def infer_subdivision(df: DataFrame, calendar: DataFrame, holiday: str = "is_holiday", entity: tuple[str, ...] = ("store",), date_col: str = "date") -> DataFrame:
    """(entity, subdivision): the one whose holidays agree with the observed flags on most rows.

    Rows that agree are rows - (observed + kept - 2 * both), so only the rows on calendar days
    are joined, and the states are set against each entity once, after aggregation. Ties go to
    the first state in order.
    """
    seen = F.col(holiday).cast("int")
    totals = df.groupBy(*entity).agg(F.sum(seen).alias("observed"))
    kept = df.select(*entity, F.col(date_col).alias("_day"), seen.alias("_seen")).join(F.broadcast(calendar.select(F.col("date").alias("_day"), "subdiv")), "_day")
    kept = kept.groupBy(*entity, "subdiv").agg(F.count("*").alias("kept"), F.sum("_seen").alias("both"))
    states = F.array(*(F.struct(F.lit(-k).alias("order"), F.lit(s).alias("subdiv")) for k, s in enumerate(STATES)))
    every = totals.select(*entity, "observed", F.explode(states).alias("s")).select(*entity, "observed", "s.order", "s.subdiv")
    apart = every.join(kept, [*entity, "subdiv"], "left").withColumn("score", -(F.col("observed") + F.coalesce("kept", F.lit(0)) - 2 * F.coalesce("both", F.lit(0))))
    return apart.groupBy(*entity).agg(F.max_by("subdiv", F.struct("score", "order")).alias("subdivision"))


def holiday_matrix(calendar: DataFrame) -> DataFrame:
    """A row per date, a boolean column per state."""
    return calendar.groupBy("date").pivot("subdiv", list(STATES)).agg(F.count("name") > 0).na.fill(False)
