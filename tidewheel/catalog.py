"""Registered queries over the test tables, and their SQL for an independent check.

Every float is rounded at the outermost select, on both sides alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions import scalars as S
from tidewheel.operators import cv as CV
from tidewheel.operators import metrics as M
from tidewheel.operators import series as W
from tidewheel.operators.geo import holiday_matrix, infer_subdivision
from tidewheel.operators.target import TargetTransformer
from tidewheel.plans import features as P
from tidewheel.plans.settings import SPACE, Features, Range, Tuning
from tidewheel.sources.holidays import STATES, holiday_calendar
from tidewheel.sources.panel import PANEL_SQL, daily_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

H = 30
CFG = Features()
#: Calendar years of the ship days and 30 days on, for the SQL side.
YEARS = (1995, 2001)
KEYS = ("store", "date")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def r6(column) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(r6(F.col(f"`{c}`")).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in (keep or df.columns)))


def pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.positive(P.preprocess(daily_panel(spark, sf_dir)))


def w():
    return W.series("store")


def back():
    return W.series_backwards("store")


def with_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rounded(df.select(*KEYS, *(c.alias(n) for n, c in columns.items())))


# ------------------------------------------------------------------ SQL parts
PANEL = PANEL_SQL.format(lineitem="lineitem", supplier="supplier")
ISO = "CAST(make_date({y}, 1, 4) - CAST(isodow(make_date({y}, 1, 4)) - 1 AS INT) + CAST(({w} - 1) * 7 AS INT) AS DATE)"
BASE = f"""
WITH panel AS ({PANEL}),
pos AS (
  SELECT *, ln(1 + sales) AS v, CAST(date - DATE '1970-01-01' AS BIGINT) AS n, state_holiday <> '0' AS hol,
         {ISO.format(y="competition_year", w="competition_month")} AS competition_start
  FROM panel WHERE sales > 0)"""
# Fixed values, written down apart from the generator: the holidays of the years 1995 to 2001 by
# day or by days after Easter Sunday, with the states that keep them ('*': all of them). Easter
# is reckoned by another of the published rules, and Repentance Day as 11 days before the
# first Sunday of Advent.
CALENDAR = f"""
years(y) AS (SELECT * FROM range({YEARS[0]}, {YEARS[1] + 1})),
golden AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM years),
epact AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM golden),
sunday AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM epact),
moon AS (SELECT y, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS n FROM sunday),
easter AS (SELECT y, make_date(y, n // 31, n % 31 + 1) AS day FROM moon),
kept(k, name, m, d, after, subdivs) AS (VALUES
  (1, 'New Year''s Day', 1, 1, NULL, '*'), (2, 'Epiphany', 1, 6, NULL, 'BW BY ST'), (3, 'Labor Day', 5, 1, NULL, '*'), (4, 'Assumption Day', 8, 15, NULL, 'SL'),
  (5, 'German Unity Day', 10, 3, NULL, '*'), (6, 'Reformation Day', 10, 31, NULL, 'BB MV SN ST TH'), (7, 'All Saints'' Day', 11, 1, NULL, 'BW BY NW RP SL'),
  (8, 'Christmas Day', 12, 25, NULL, '*'), (9, 'Second Day of Christmas', 12, 26, NULL, '*'),
  (10, 'Good Friday', NULL, NULL, -2, '*'), (11, 'Easter Sunday', NULL, NULL, 0, 'BB'), (12, 'Easter Monday', NULL, NULL, 1, '*'), (13, 'Ascension Day', NULL, NULL, 39, '*'),
  (14, 'Whit Sunday', NULL, NULL, 49, 'BB'), (15, 'Whit Monday', NULL, NULL, 50, '*'), (16, 'Corpus Christi', NULL, NULL, 60, 'BW BY HE NW RP SL')),
held AS (
  SELECT k, name, subdivs, coalesce(make_date(y, m, d), day + CAST(after AS INT)) AS date FROM easter CROSS JOIN kept
  UNION ALL SELECT 17, 'Repentance and Prayer Day', 'SN', make_date(y, 12, 24) - CAST(isodow(make_date(y, 12, 24)) % 7 AS INT) - 32 FROM years),
keepers AS (SELECT unnest(string_split('{' '.join(STATES)}', ' ')) AS subdiv),
calendar AS (
  SELECT CAST(date AS DATE) AS date, string_agg(name, '; ' ORDER BY k) AS name, subdiv FROM held JOIN keepers ON subdivs = '*' OR list_contains(string_split(subdivs, ' '), subdiv)
  GROUP BY date, subdiv)"""
ORDERED = "states(subdiv, k) AS (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(STATES)) + ")"
SUBDIVISION = f"""
{CALENDAR}, {ORDERED},
scores AS (
  SELECT p.store, s.subdiv, s.k, sum(CASE WHEN p.hol = (c.date IS NOT NULL) THEN 1 ELSE 0 END) AS score
  FROM pos p CROSS JOIN states s LEFT JOIN calendar c ON c.date = p.date AND c.subdiv = s.subdiv GROUP BY ALL),
located AS (SELECT store, arg_max(subdiv, score * 100 - k) AS subdivision FROM scores GROUP BY store)"""
RANGE = "OVER (PARTITION BY store ORDER BY n RANGE BETWEEN {a} AND {b})"


def sql6(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"


def at(days: int, value: str = "v") -> str:
    a = f"{-days} PRECEDING" if days <= 0 else f"{days} FOLLOWING"
    return f"max({value}) " + RANGE.format(a=a, b=a)


def lag_sql(offsets) -> str:
    return ", ".join(sql6(at(-n * W.UNIT_DAYS[u]), f"lag_{u}_{n}") for u, n in offsets)


def month_sql(offsets, source: str = "pos") -> tuple[str, str, str]:
    """CTEs, joins and columns of month and year lags."""
    ctes, joins, columns = [], [], []
    for u, n in offsets:
        m = n * W.UNIT_MONTHS[u]
        name = f"lag_{u}_{n}"
        ctes.append(f"m{m} AS (SELECT store, CAST(date + INTERVAL {m} MONTH AS DATE) AS dt, arg_max(v, date) AS v FROM {source} GROUP BY 1, 2)")
        joins.append(f"LEFT JOIN m{m} ON m{m}.store = p.store AND m{m}.dt = p.date")
        columns.append(sql6(f"m{m}.v", name))
    return ", ".join(ctes), " ".join(joins), ", ".join(columns)


def diff_sql(offsets) -> str:
    return ", ".join(sql6(f"v - ({at(-n * W.UNIT_DAYS[u])})", f"diff_{u}_{n}") for u, n in offsets)


def rolling_sql(windows, agg: str = "avg", label: str = "mean") -> str:
    return ", ".join(sql6(f"{agg}(v) " + RANGE.format(a=f"{int(k[:-1]) - 1} PRECEDING", b="CURRENT ROW"), f"rolling_{label}_{k}") for k in windows)


def short(offsets, *units: str):
    return [(u, n) for u, n in offsets if u in units]


# ------------------------------------------------------------------ panel and scalars
@query(f"SELECT store, date, {sql6('sales', 'sales')}, promo, state_holiday, school_holiday, store_type, assortment, promo2, competition_year, competition_month, promo2_year, promo2_week FROM ({PANEL})")
def daily_panel_query(spark, sf_dir):
    return rounded(daily_panel(spark, sf_dir))


QUERIES["daily_panel"] = QUERIES.pop("daily_panel_query")
ORACLES["daily_panel"] = ORACLES.pop("daily_panel_query")


@query(f"{BASE} SELECT store, date, {sql6('sales', 'sales')}, {sql6('v', 'v')} FROM pos")
def positive_sales_filter(spark, sf_dir):
    return rounded(pos(spark, sf_dir), "store", "date", "sales", "v")


@query(
    """SELECT o.o_custkey AS store, CAST(o.o_orderdate AS DATE) AS date, round(o.o_totalprice, 2) AS sales, c.c_mktsegment AS store_type
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""
)
def store_join(spark, sf_dir):
    sales = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("Store"), F.to_date("o_orderdate").alias("Date"), F.round("o_totalprice", 2).alias("Sales"))
    stores = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("Store"), F.col("c_mktsegment").alias("StoreType"))
    from tidewheel.sources.panel import store_join as joined

    return joined(sales, stores)


@query(f"WITH panel AS ({PANEL}) SELECT store, date, {ISO.format(y='promo2_year', w='promo2_week')} AS promo2_since, {ISO.format(y='competition_year', w='competition_month')} AS competition_start FROM panel")
def iso_week_date(spark, sf_dir):
    return P.preprocess(daily_panel(spark, sf_dir)).select(*KEYS, "promo2_since", "competition_start")


@query(
    f"""WITH panel AS ({PANEL}) SELECT store, date, CASE WHEN state_holiday IS NULL OR trim(state_holiday) = '0' THEN 'NoHoliday' ELSE state_holiday END AS state_holiday,
        NOT (state_holiday IS NULL OR trim(state_holiday) = '0') AS is_state_holiday, coalesce(school_holiday <> 0, true) AS is_school_holiday FROM panel"""
)
def state_holiday_flag(spark, sf_dir):
    raw = F.col("state_holiday")
    return daily_panel(spark, sf_dir).select(*KEYS, S.state_holiday(raw).alias("state_holiday"), S.is_state_holiday(raw).alias("is_state_holiday"), S.is_school_holiday(F.col("school_holiday")).alias("is_school_holiday"))


@query(f"WITH panel AS ({PANEL}) SELECT store, date, {sql6('ln(1 + sales)', 'logged')}, round(CAST(exp(ln(1 + sales)) - 1 AS DOUBLE), 4) + 0.0::DOUBLE AS restored FROM panel")
def log1p_expm1(spark, sf_dir):
    logged = S.log_sales(F.col("sales"))
    return daily_panel(spark, sf_dir).select(*KEYS, r6(logged).alias("logged"), (F.round(F.expm1(logged), 4) + F.lit(0.0)).alias("restored"))


PARTS_SQL = """CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, CAST(day(d) // 7 + 1 AS INT) AS week_of_month,
  CAST(isodow(d) - 1 AS INT) AS day_of_week, day(d) = 1 AS is_month_start, isodow(d) >= 6 AS is_weekend, isodow(d) < 6 AS is_weekday, d = last_day(d) AS is_month_end"""


@query(f"{BASE}, moved AS (SELECT store, date, CAST(date + INTERVAL {H} DAY AS DATE) AS d FROM pos) SELECT store, date, {PARTS_SQL} FROM moved")
def calendar_features(spark, sf_dir):
    parts = S.calendar_columns(F.date_add("date", H))
    return pos(spark, sf_dir).select(*KEYS, *(c.alias(n) for n, c in parts.items()))


COMPETITION_SQL = f"CAST(CASE WHEN (date + {H}) - competition_start >= 0 THEN (date + {H}) - competition_start END AS INT)"


@query(f"{BASE} SELECT store, date, {COMPETITION_SQL} AS competition_days_since_start FROM pos")
def competition_days(spark, sf_dir):
    return pos(spark, sf_dir).select(*KEYS, S.competition_days(F.col("competition_start"), F.col("date"), H).alias("competition_days_since_start"))


# ------------------------------------------------------------------ lags, differences, rolling
@query(f"{BASE} SELECT store, date, {lag_sql(short(CFG.lags, 'days'))} FROM pos")
def lag_days(spark, sf_dir):
    return with_columns(pos(spark, sf_dir), W.lag_columns(F.col("v"), short(CFG.lags, "days"), w()))


@query(f"{BASE} SELECT store, date, {lag_sql(short(CFG.lags, 'weeks'))} FROM pos")
def lag_weeks(spark, sf_dir):
    return with_columns(pos(spark, sf_dir), W.lag_columns(F.col("v"), short(CFG.lags, "weeks"), w()))


def _month_lags(spark, sf_dir, unit):
    offsets = short(CFG.lags, unit)
    df = pos(spark, sf_dir).select(*KEYS, "v")
    return rounded(W.with_month_lags(df, "v", offsets, ("store",)), *KEYS, *(f"lag_{u}_{n}" for u, n in offsets))


def _month_oracle(unit):
    ctes, joins, columns = month_sql(short(CFG.lags, unit))
    return f"{BASE}, {ctes} SELECT p.store, p.date, {columns} FROM pos p {joins}"


@query(_month_oracle("months"))
def lag_months(spark, sf_dir):
    return _month_lags(spark, sf_dir, "months")


@query(_month_oracle("years"))
def lag_years(spark, sf_dir):
    return _month_lags(spark, sf_dir, "years")


@query(f"{BASE} SELECT store, date, {diff_sql(CFG.diffs)} FROM pos")
def diff_days(spark, sf_dir):
    return with_columns(pos(spark, sf_dir), W.diff_columns(F.col("v"), CFG.diffs, w()))


@query(f"{BASE} SELECT store, date, {rolling_sql(CFG.windows)} FROM pos")
def rolling_mean(spark, sf_dir):
    return with_columns(pos(spark, sf_dir), W.rolling_columns(F.col("v"), CFG.windows, w()))


OTHERS = ("min", "max", "sum", "count", "std")


@query(f"{BASE} SELECT store, date, " + ", ".join(rolling_sql(("14D",), {"std": "stddev_samp"}.get(a, a), a) for a in OTHERS).replace("round(CAST(count(v) " + RANGE.format(a="13 PRECEDING", b="CURRENT ROW") + " AS DOUBLE), 6) + 0.0::DOUBLE", "count(v) " + RANGE.format(a="13 PRECEDING", b="CURRENT ROW")) + " FROM pos")
def rolling_minmaxsum(spark, sf_dir):
    made: dict[str, Column] = {}
    for agg in OTHERS:
        made |= W.rolling_columns(F.col("v"), ("14D",), w(), agg)
    return with_columns(pos(spark, sf_dir), made)


@query(
    f"""{BASE}, framed AS (SELECT store, date, count(v) OVER f AS c, avg(v) OVER f AS m FROM pos WINDOW f AS (PARTITION BY store ORDER BY n ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
        SELECT store, date, {sql6('CASE WHEN c = 7 THEN m END', 'rolling_mean_7')} FROM framed"""
)
def rolling_rows(spark, sf_dir):
    return with_columns(pos(spark, sf_dir), W.rolling_columns(F.col("v"), (7,), w()))


# ------------------------------------------------------------------ events
def run_sql(flag: str, out: str, source: str = "pos") -> str:
    """CTEs ending in a table with the run length of ``flag`` as ``out``."""
    off = f"max(CASE WHEN {flag} <> 1 THEN rn END) OVER (PARTITION BY store ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{out}_n AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY n) AS rn FROM {source}),
{out}_r AS (SELECT * EXCLUDE (rn), rn - coalesce({off}, 0) AS {out} FROM {out}_n)"""


def _run(spark, sf_dir, flag, out):
    df = W.run_length(pos(spark, sf_dir), flag, "run", w())
    return df.select(*KEYS, F.col("run").alias(f"{out}_run_now"), W.at_offset(F.col("run"), H, w()).alias(out))


def _run_oracle(flag, out):
    return f"{BASE}, {run_sql(flag, 'run')} SELECT store, date, CAST(run AS INT) AS {out}_run_now, CAST({at(H, 'run')} AS INT) AS {out} FROM run_r"


@query(_run_oracle("promo", "Promo"))
def promo_run_length(spark, sf_dir):
    return _run(spark, sf_dir, "promo", "Promo")


@query(_run_oracle("promo2", "Promo2"))
def promo2_run_length(spark, sf_dir):
    return _run(spark, sf_dir, "promo2", "Promo2")


NEXT_SQL = f"CAST(min(CASE WHEN hol THEN n END) {RANGE.format(a=f'{H} FOLLOWING', b='UNBOUNDED FOLLOWING')} - (n + {H}) AS INT)"
SINCE_SQL = f"CAST((n + {H}) - max(CASE WHEN hol THEN n END) {RANGE.format(a='UNBOUNDED PRECEDING', b=f'{H} FOLLOWING')} AS INT)"


def event() -> Column:
    return F.col("is_state_holiday")


@query(f"{BASE} SELECT store, date, {NEXT_SQL} AS next_holiday_days FROM pos")
def next_holiday_days(spark, sf_dir):
    return pos(spark, sf_dir).select(*KEYS, W.next_event_days(event(), H, back()).alias("next_holiday_days"))


@query(f"{BASE} SELECT store, date, {SINCE_SQL} AS prev_holiday_days FROM pos")
def prev_holiday_days(spark, sf_dir):
    return pos(spark, sf_dir).select(*KEYS, W.since_event_days(event(), H, w()).alias("prev_holiday_days"))


def wave_sql(days: str) -> str:
    value = f"exp(-CAST({days} AS DOUBLE) * {days} / (2.0::DOUBLE * {CFG.sigma}::DOUBLE * {CFG.sigma}::DOUBLE))"
    return f"CASE WHEN {value} < {W.WAVE_EPS!r}::DOUBLE THEN 0.0::DOUBLE ELSE {value} END"


def with_waves(df: DataFrame) -> DataFrame:
    df = df.withColumn("_next", W.next_event_days(event(), H, back())).withColumn("_since", W.since_event_days(event(), H, w()))
    return df.withColumn("pre_holiday_wave", W.wave(F.col("_next"), CFG.sigma)).withColumn("post_holiday_wave", W.wave(F.col("_since"), CFG.sigma))


WAVES_SQL = f"""days AS (SELECT *, {NEXT_SQL} AS nd, {SINCE_SQL} AS sd FROM pos),
waves AS (SELECT *, {wave_sql('nd')} AS pre, {wave_sql('sd')} AS post FROM days)"""


@query(f"{BASE}, {WAVES_SQL} SELECT store, date, {sql6('pre', 'pre_holiday_wave')}, {sql6('post', 'post_holiday_wave')} FROM waves")
def holiday_waves(spark, sf_dir):
    return rounded(with_waves(pos(spark, sf_dir)), *KEYS, "pre_holiday_wave", "post_holiday_wave")


# ------------------------------------------------------------------ holidays and subdivisions
def located(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    df = pos(spark, sf_dir)
    calendar = P.calendar_for(df, H)
    return df.join(infer_subdivision(df, calendar, "is_state_holiday"), "store"), calendar


@query(f"{BASE}, {SUBDIVISION} SELECT store, subdivision FROM located")
def subdivision_infer(spark, sf_dir):
    df = pos(spark, sf_dir)
    return infer_subdivision(df, P.calendar_for(df, H), "is_state_holiday")


NAMES_SQL = f"named AS (SELECT p.store, p.date, l.subdivision, c.name FROM pos p JOIN located l USING (store) LEFT JOIN calendar c ON c.date = p.date + {H} AND c.subdiv = l.subdivision)"


@query(f"{BASE}, {SUBDIVISION}, {NAMES_SQL} SELECT store, date, subdivision, name FROM named")
def holiday_names(spark, sf_dir):
    df, calendar = located(spark, sf_dir)
    return P.with_holiday_name(df, calendar, H).select(*KEYS, "subdivision", "name")


EXTENDED_SQL = f"""filled AS (
  SELECT store, date, w.pre, w.post, first_value(name IGNORE NULLS) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS following,
         last_value(name IGNORE NULLS) OVER (PARTITION BY store ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS previous
  FROM named JOIN waves w USING (store, date)),
extended AS (SELECT store, date, CASE WHEN pre >= 0.011108996538242306::DOUBLE OR post >= 0.011108996538242306::DOUBLE THEN CASE WHEN pre >= post THEN following ELSE previous END END AS holiday_name FROM filled)"""


@query(f"{BASE}, {SUBDIVISION}, {NAMES_SQL}, {WAVES_SQL}, {EXTENDED_SQL} SELECT store, date, holiday_name FROM extended")
def holiday_name_extended(spark, sf_dir):
    df, calendar = located(spark, sf_dir)
    df = P.with_holiday_name(with_waves(df), calendar, H)
    return df.select(*KEYS, W.extended_name(F.col("name"), F.col("pre_holiday_wave"), F.col("post_holiday_wave"), CFG.extension_devs, w(), back()).alias("holiday_name"))


@query(f"WITH {CALENDAR} SELECT date, " + ", ".join(f"coalesce(bool_or(subdiv = '{s}'), false) AS \"{s}\"" for s in STATES) + " FROM calendar GROUP BY date")
def holiday_pivot(spark, sf_dir):
    return holiday_matrix(holiday_calendar(spark, *YEARS))


@query(f"{BASE}, {CALENDAR} SELECT p.store, p.date, count(c.subdiv) AS states_on_holiday, bool_or(coalesce(c.subdiv = 'BY', false)) AS \"BY\" FROM pos p LEFT JOIN calendar c ON c.date = p.date GROUP BY ALL")
def holiday_attach(spark, sf_dir):
    df = pos(spark, sf_dir)
    matrix = holiday_matrix(P.calendar_for(df, H))
    flags = [F.coalesce(F.col(s), F.lit(False)) for s in STATES]
    count = sum((f.cast("long") for f in flags[1:]), flags[0].cast("long"))
    return df.join(F.broadcast(matrix), "date", "left").select(*KEYS, count.alias("states_on_holiday"), F.coalesce(F.col("BY"), F.lit(False)).alias("BY"))


# ------------------------------------------------------------------ dataset and target
def _matrix_oracle(target: bool) -> str:
    months = short(CFG.lags, "months", "years")
    ctes, joins, month_columns = month_sql(months)
    days = lag_sql(short(CFG.lags, "days", "weeks"))
    y = f", {sql6(f'({at(H)}) - v', 'y')}" if target else ""
    both = run_sql("promo", "run1", "pos") + ", " + run_sql("promo2", "run2", "run1_r")
    own = f"""own AS (SELECT store, date, {days}, {diff_sql(CFG.diffs)}, {rolling_sql(CFG.windows)}, {COMPETITION_SQL} AS competition_days_since_start,
      CAST({at(H, 'run1')} AS INT) AS "Promo", CAST({at(H, 'run2')} AS INT) AS "Promo2", store_type AS "StoreType", assortment AS "Assortment", CAST(date + INTERVAL {H} DAY AS DATE) AS d{y} FROM run2_r)"""
    return f"""{BASE}, {SUBDIVISION}, {NAMES_SQL}, {WAVES_SQL}, {EXTENDED_SQL}, {both}, {ctes}, {own}
SELECT p.store, p.date, p.* EXCLUDE (store, date, d), {month_columns}, {PARTS_SQL.replace('(d)', '(p.d)').replace(', d =', ', p.d =')},
       {sql6('w.pre', 'pre_holiday_wave')}, {sql6('w.post', 'post_holiday_wave')}, e.holiday_name, l.subdivision
FROM own p JOIN waves w USING (store, date) JOIN extended e USING (store, date) JOIN located l USING (store) {joins}""" + (" WHERE p.y IS NOT NULL" if target else "")


@query(_matrix_oracle(False))
def feature_matrix(spark, sf_dir):
    return rounded(P.feature_matrix(daily_panel(spark, sf_dir), CFG, H))


@query(_matrix_oracle(True))
def dataset(spark, sf_dir):
    return rounded(P.dataset(daily_panel(spark, sf_dir), CFG, H))


@query(f"{BASE}, t AS (SELECT store, date, ({at(H)}) - v AS y FROM pos) SELECT store, date, {sql6('y', 'y')} FROM t WHERE y IS NOT NULL")
def target_diff(spark, sf_dir):
    return rounded(TargetTransformer(H).transform(pos(spark, sf_dir)), *KEYS, "y")


INVERSE_SQL = f"t AS (SELECT store, date, sales, v, ({at(H)}) - v AS y, {at(H, 'sales')} AS ahead FROM pos)"


@query(f"{BASE}, {INVERSE_SQL} SELECT store, CAST(date + INTERVAL {H} DAY AS DATE) AS date, CAST(round_even(CAST(exp(v + y) - 1 AS DOUBLE), 0) AS BIGINT) AS predicted FROM t WHERE y IS NOT NULL")
def target_inverse(spark, sf_dir):
    t = TargetTransformer(H).fit(df := pos(spark, sf_dir))
    return t.inverse_transform(t.transform(df)).select(*KEYS, "predicted")


@query(f"{BASE} SELECT store, date, CAST(dense_rank() OVER (ORDER BY store_type) - 1 AS INT) AS store_type_index, CAST(dense_rank() OVER (ORDER BY assortment) - 1 AS INT) AS assortment_index FROM pos")
def category_index(spark, sf_dir):
    return P.category_index(pos(spark, sf_dir), ["store_type", "assortment"]).select(*KEYS, "store_type_index", "assortment_index")


# ------------------------------------------------------------------ cross-validation
def anchors(spark, sf_dir) -> DataFrame:
    """Rows that have a target; their dates are what folds are cut from."""
    return TargetTransformer(H).transform(pos(spark, sf_dir))


ANCHORS_SQL = f"{INVERSE_SQL}, anchors AS (SELECT * FROM t WHERE y IS NOT NULL), dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k, count(*) OVER () AS nd FROM (SELECT DISTINCT date FROM anchors))"
SPLITS = 3


def _folds_sql(inner: bool) -> str:
    span = "nd" if not inner else f"nd - {H} * 2"  # inner folds end where the first outer training window ends
    last = f"({span} - 1)" if not inner else f"(nd - {H} * {SPLITS + 1} - 1)"
    train = f"(nd - {H} * {SPLITS + 1})" if not inner else f"(nd - {H} * {2 * SPLITS + 2})"
    return f"""ends AS (SELECT f AS fold, {last} - ({SPLITS} - f) * {H} AS te, {train} AS tr FROM (SELECT DISTINCT nd FROM dates), range(1, {SPLITS + 1}) r(f)),
folds AS (SELECT CAST(fold AS INT) AS fold, te - 2 * {H} - tr + 1 AS a, te - 2 * {H} AS b, te - {H} + 1 AS c, te AS d FROM ends),
edges AS (SELECT f.fold, w.date AS train_start, x.date AS train_end, y.date AS test_start, z.date AS test_end
  FROM folds f JOIN dates w ON w.k = f.a JOIN dates x ON x.k = f.b JOIN dates y ON y.k = f.c JOIN dates z ON z.k = f.d)"""


def outer_cv(df: DataFrame) -> CV.TimeSeriesCV:
    n = df.select(F.count_distinct("date")).first()[0]
    sizes = CV.cv_sizes(n, H, SPLITS, SPLITS)
    return CV.TimeSeriesCV(SPLITS, sizes.outer_train, sizes.outer_test, H)


EDGES = "fold, train_start, train_end, test_start, test_end"


@query(f"{BASE}, {ANCHORS_SQL}, {_folds_sql(False)} SELECT {EDGES} FROM edges")
def cv_outer_folds(spark, sf_dir):
    df = anchors(spark, sf_dir).select("date")
    return outer_cv(df).folds(df).select(*EDGES.split(", "))


@query(f"{BASE}, {ANCHORS_SQL}, {_folds_sql(True)} SELECT {EDGES} FROM edges")
def cv_inner_folds(spark, sf_dir):
    df = anchors(spark, sf_dir).select("date").distinct()
    n = df.count()
    sizes = CV.cv_sizes(n, H, SPLITS, SPLITS)
    first = next(iter(outer_cv(df).split(df)))[0]
    return CV.TimeSeriesCV(SPLITS, sizes.inner_train, sizes.inner_test, H).folds(first).select(*EDGES.split(", "))


@query(
    f"""{BASE}, {ANCHORS_SQL}, {_folds_sql(False)}
        SELECT e.fold, CASE WHEN a.date BETWEEN e.train_start AND e.train_end THEN 'train' ELSE 'test' END AS part, count(*) AS n_rows, count(DISTINCT a.date) AS n_dates, {sql6('sum(a.y)', 'sum_y')}
        FROM anchors a JOIN edges e ON a.date BETWEEN e.train_start AND e.train_end OR a.date BETWEEN e.test_start AND e.test_end GROUP BY 1, 2"""
)
def cv_fold_rows(spark, sf_dir):
    df = anchors(spark, sf_dir)
    rows = outer_cv(df).fold_rows(df)
    return rows.groupBy("fold", "part").agg(F.count("*").alias("n_rows"), F.count_distinct("date").alias("n_dates"), r6(F.sum("y")).alias("sum_y"))


# ------------------------------------------------------------------ forecast analytics
def naive(df: DataFrame) -> DataFrame:
    """The forecast that nothing changes: y = 0 for each anchor row, at its target day."""
    t = TargetTransformer(H).fit(df)
    return t.inverse_transform(t.transform(df).withColumn("y", F.lit(0.0)), out="sales", value="sales").select(*KEYS, "sales")


@query(
    f"""{BASE}, {ANCHORS_SQL}, {_folds_sql(False)} SELECT a.store, CAST(a.date + INTERVAL {H} DAY AS DATE) AS date, CAST(round_even(CAST(a.sales AS DOUBLE), 0) AS BIGINT) AS sales
        FROM anchors a JOIN edges e ON a.date BETWEEN e.test_start AND e.test_end"""
)
def fold_union(spark, sf_dir):
    df = pos(spark, sf_dir)
    t = TargetTransformer(H).fit(df)
    rows = t.transform(df)
    cut = outer_cv(rows)
    parts = [t.inverse_transform(test.withColumn("y", F.lit(0.0)), out="sales", value="sales").select(*KEYS, "sales") for _, test in cut.split(rows)]
    return M.union_folds([p for p in parts])


def results(spark, sf_dir) -> DataFrame:
    df = pos(spark, sf_dir)
    return M.mask_closed(M.join_predictions(df, naive(df)))


RESULTS_SQL = f"""{INVERSE_SQL},
results AS (SELECT store, CAST(date + INTERVAL {H} DAY AS DATE) AS date, ahead AS sales_actual, CASE WHEN ahead = 0 THEN 0 ELSE CAST(round_even(CAST(sales AS DOUBLE), 0) AS BIGINT) END AS sales_predicted FROM t WHERE y IS NOT NULL),
errors AS (SELECT *, abs(sales_actual - sales_predicted) AS e FROM results),
by_store AS (SELECT store, avg(e) AS mae FROM errors GROUP BY store),
by_day AS (SELECT date, avg(e) AS mean_mae, quantile_cont(e, 0.05) AS p05, quantile_cont(e, 0.95) AS p95 FROM errors GROUP BY date)"""


def r4(column) -> Column:
    return F.round(column, 4) + F.lit(0.0)


def rounded4(df: DataFrame) -> DataFrame:
    return df.select(*(r4(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql4(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4) + 0.0::DOUBLE AS {name}"


@query(f"{BASE}, {RESULTS_SQL} SELECT store, date, {sql4('sales_actual', 'sales_actual')}, sales_predicted FROM results ORDER BY store, date")
def forecast_join_closed_mask(spark, sf_dir):
    return rounded4(results(spark, sf_dir)).orderBy("store", "date")


@query(
    f"""{BASE}, {RESULTS_SQL} SELECT {sql4('avg(e)', 'mae')}, {sql4('sqrt(avg(e * e))', 'rmse')}, {sql4('avg(e / greatest(abs(sales_actual), 2.220446049250313e-16::DOUBLE)) * 100', 'mape')},
        {sql4('min(sales_actual)', 'min_actual')}, {sql4('max(sales_actual)', 'max_actual')} FROM errors"""
)
def metrics_global(spark, sf_dir):
    return rounded4(M.global_metrics(results(spark, sf_dir)))


@query(f"{BASE}, {RESULTS_SQL} SELECT store, {sql4('mae', 'mae')} FROM by_store")
def mae_per_store(spark, sf_dir):
    return rounded4(M.mae_by(results(spark, sf_dir), "store"))


@query(f"{BASE}, {RESULTS_SQL} SELECT {sql4('avg(mae)', 'macro_mae')} FROM by_store")
def macro_mae(spark, sf_dir):
    return rounded4(M.macro_mae(results(spark, sf_dir), "store"))


@query(f"{BASE}, {RESULTS_SQL} SELECT store, {sql4('mae', 'mae')} FROM (SELECT * FROM by_store ORDER BY mae DESC, store LIMIT 10)")
def top10_store_mae(spark, sf_dir):
    return rounded4(M.extreme_stores(results(spark, sf_dir), 10))


@query(f"{BASE}, {RESULTS_SQL} SELECT store, {sql4('mae', 'mae')} FROM (SELECT * FROM by_store ORDER BY mae, store LIMIT 10)")
def bottom10_store_mae(spark, sf_dir):
    return rounded4(M.extreme_stores(results(spark, sf_dir), 10, best=True))


@query(f"{BASE}, {RESULTS_SQL} SELECT store, date, {sql4('sales_actual', 'sales_actual')}, sales_predicted FROM results WHERE store IN (SELECT store FROM by_store ORDER BY mae DESC, store LIMIT 3)")
def top3_store_series(spark, sf_dir):
    found = results(spark, sf_dir)
    return rounded4(M.series_of(found, M.extreme_stores(found, 3)).select("store", "date", "sales_actual", "sales_predicted"))


@query(f"{BASE}, {RESULTS_SQL} SELECT store, date, {sql4('sales_actual', 'sales_actual')}, sales_predicted FROM results WHERE store = 7")
def store_series(spark, sf_dir):
    return rounded4(results(spark, sf_dir).where("store = 7"))


@query(f"{BASE}, {RESULTS_SQL} SELECT date, {sql6('mean_mae', 'mean_mae')}, {sql6('p05', 'p05')}, {sql6('p95', 'p95')} FROM by_day")
def daily_error_band(spark, sf_dir):
    return rounded(M.daily_band(results(spark, sf_dir)))


@query(f"{BASE}, {RESULTS_SQL} SELECT date, {sql6('mean_mae', 'mean_mae')}, {sql6('p05', 'p05')}, {sql6('p95', 'p95')} FROM (SELECT * FROM by_day ORDER BY mean_mae DESC, date LIMIT 10)")
def top10_error_dates(spark, sf_dir):
    return rounded(M.worst_days(results(spark, sf_dir)))


# ------------------------------------------------------------------ training and search
#: A stand-in curve: the naive forecast's error by month number, as rounds.
CURVE_SQL = "curve AS (SELECT CAST(month(date) - 1 AS INT) AS round, round(avg(e), 4) AS mean, round(stddev_pop(e), 4) AS std FROM errors GROUP BY 1)"


@query(
    f"""{BASE}, {RESULTS_SQL}, {CURVE_SQL} SELECT {sql4('min(mean)', 'best_loss')}, CAST(arg_min(round, (mean, round)) + 1 AS INT) AS best_n_rounds,
        {sql4('arg_max(mean, round)', 'final_mean')}, {sql4('arg_max(std, round)', 'final_std')} FROM curve"""
)
def cv_curve_argmin(spark, sf_dir):
    e = F.abs(M.error())
    curve = results(spark, sf_dir).groupBy((F.month("date") - 1).cast("int").alias("round")).agg(F.round(F.avg(e), 4).alias("mean"), F.round(F.stddev_pop(e), 4).alias("std"))
    return rounded4(M.curve_summary(curve))


TRIALS_SQL = """trials AS (SELECT CAST(event_id AS INT) AS trial, CASE WHEN event_id % 5 = 0 THEN 'PRUNED' WHEN event_id % 7 = 0 THEN 'FAIL' ELSE 'COMPLETE' END AS state,
  CASE WHEN event_id % 5 <> 0 THEN round(value, 3) END AS value, CAST(event_id % 90 AS DOUBLE) / 4 AS seconds FROM events)"""


@query(
    f"""WITH {TRIALS_SQL}, c AS (SELECT * FROM trials WHERE state = 'COMPLETE')
SELECT count(*) AS n_trials, CAST(count(*) FILTER (state = 'COMPLETE') AS BIGINT) AS n_complete, CAST(count(*) FILTER (state = 'PRUNED') AS BIGINT) AS n_pruned,
  round(count(*) FILTER (state = 'PRUNED') * 100.0::DOUBLE / count(*), 1) AS pct_pruned, round(sum(seconds), 1) AS total_seconds, round(avg(seconds), 2) AS mean_seconds, round(max(seconds), 2) AS max_seconds,
  (SELECT round(min(value), 6) FROM c) AS best_value, (SELECT round(max(value), 6) FROM c) AS worst_value, (SELECT round(median(value), 6) FROM c) AS median_value,
  (SELECT arg_min(trial, (value, trial)) FROM c) AS best_trial FROM trials"""
)
def study_summary(spark, sf_dir):
    event = F.col("event_id")
    state = F.when(event % 5 == 0, "PRUNED").when(event % 7 == 0, "FAIL").otherwise("COMPLETE")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    trials = events.select(event.cast("int").alias("trial"), state.alias("state"), F.when(event % 5 != 0, F.round("value", 3)).alias("value"), ((event % 90).cast("double") / 4).alias("seconds"))
    return M.study_summary(trials)


@query(f"WITH {TRIALS_SQL} SELECT count(*) FILTER (state IN ('PRUNED', 'COMPLETE')) AS finished, 20000000 - count(*) FILTER (state IN ('PRUNED', 'COMPLETE')) AS remaining FROM trials")
def study_remaining(spark, sf_dir):
    event = F.col("event_id")
    done = F.when((event % 5 == 0) | (event % 7 != 0), 1)
    return spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count(done).alias("finished"), (F.lit(20000000).cast("long") - F.count(done)).alias("remaining"))


@query()
def boosted_trees_forecast(spark, sf_dir):
    """Trees on the outer folds' training windows; the forecasts of their test windows."""
    from tidewheel.plans import model as T

    rows = P.dataset(daily_panel(spark, sf_dir), CFG, H).persist()
    cut = outer_cv(rows)
    params = {"max_depth": 4, "learning_rate": 0.1, "subsample": 0.8, "min_child_weight": 5}
    t = TargetTransformer(H).fit(rows.withColumn("sales", F.expm1("lag_days_0")))
    t.anchor_col = "anchor"
    parts = []
    for train, test in cut.split(rows):
        parts.append(t.inverse_transform(T.predict(T.fit(train, params, 10), test), out="sales").select(*KEYS, "sales"))
    rows.unpersist()  # the forecasts read their windows again
    return M.mask_closed(M.join_predictions(pos(spark, sf_dir), M.union_folds(parts)))


@query()
def random_search_study(spark, sf_dir):
    """A short study over inner folds; its trials as a table."""
    import tempfile

    from tidewheel.plans import model as T
    from tidewheel.plans.search import Journal, Study

    rows = P.dataset(daily_panel(spark, sf_dir), Features(lags=(("days", 0), ("days", 7)), diffs=(("days", 7),), windows=("30D",)), H).persist()
    n = rows.select(F.count_distinct("date")).first()[0]
    sizes = CV.cv_sizes(n, H, 1, 1)
    cut = CV.TimeSeriesCV(1, sizes.inner_train, sizes.inner_test, H)
    space = {"max_depth": Range("suggest_int", 2, 4), "learning_rate": SPACE["learning_rate"]}

    def objective(params, report):
        curve = T.cv_curve(rows, cut, params, 3, report=report)
        k, best, _ = min(curve, key=lambda c: c[1])
        return best, {"best_n_rounds": k + 1}

    with tempfile.TemporaryDirectory() as folder:  # the driver alone writes and reads the journal
        study = Study(Journal(folder, "study"), space, Tuning(num_trials=3, num_jobs=1))
        study.optimize(objective)
        found = study.table(spark)
    rows.unpersist()
    return found
