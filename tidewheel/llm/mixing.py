"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

DataFrame operations only. A document's key is an exponential variate over its quality weight;
sorted by key within a source, sizes are prefix-summed up to the source's budget. No source is
ever sorted whole: two histograms of the keys narrow the place of the cut to one narrow bin, and
only that bin's documents are sorted. The result of all this is one row for each source (whole
epochs, and the key, id and words of the document at the cut), against which every document is
judged where it stands, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, read_table, text_or_empty, whole_row

WORD = r"[^\x20\x09-\x0D]+"
#: Characters that speak against a text; their share lowers its quality weight.
SYMBOLS = "#*%&$|!~^@<>{}"
LEAST_QUALITY = 0.05
#: Keys are whole numbers of 2 ** -40; the histograms' bins are 2 ** -6 and 2 ** -20 wide.
KEY_BITS, COARSE, FINE = 40, 34, 20
#: Up to this number of sources the table of sources is broadcast, beyond it joined by a shuffle.
BROADCAST_SOURCES = 20_000


def word_count() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def quality_weight() -> Column:
    """1 less the share of symbols in the text, 0.05 at least; 1 for an empty text."""
    n = F.length("text")
    plain = F.length(F.translate("text", SYMBOLS, ""))
    return F.when(n > 0, F.greatest(F.lit(LEAST_QUALITY), plain / n)).otherwise(F.lit(1.0))


def sample_key(quality: Column) -> Column:
    """-ln(u) / quality in units of 2 ** -40, where u in (0, 1) is drawn from the document's id."""
    drawn = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double")
    return F.floor(-F.log((drawn + 0.5) / float(1 << 52)) / quality * float(1 << KEY_BITS)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(sid, source, source_size, target): water-filling of the shared words under the caps."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    ranked = totals.withColumn("sid", rank).withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(order), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    level = ranked.withColumn("level", left / open_weight)
    # of the levels at which all before are capped, the first that caps nobody further
    chosen = F.min(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.struct(F.col("most") / F.col("weight"), "sid", "level"))).over(every)
    target = F.least("most", F.coalesce(F.col("weight") * F.col("chosen.level"), F.col("most")))
    return level.withColumn("chosen", chosen).select("sid", "source", "source_size", target.alias("target"))


def _bin_of_cut(sums: DataFrame, by: str) -> DataFrame:
    """For each source the bin in which its budget ends, and the words before that bin."""
    run = F.sum("words").over(Window.partitionBy("sid").orderBy(by))
    return sums.withColumn("to", run).where((F.col("to") >= F.col("budget")) & (F.col("to") - F.col("words") < F.col("budget"))).select("sid", by, (F.col("budget") - F.col("to") + F.col("words")).alias("budget"))


def plan_mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """The documents' (doc_id, source, size, key), and the plan: a row for each source.

    The plan has sid, source, source_size, target, epochs, and the cut: key and id of the
    document at which the budget ends, and the words that each row of that document gives.
    """
    sized = scratch.write(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), sample_key(quality_weight()).alias("key")))
    targets = scratch.write(source_targets(sized, weights, share, cap))
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("floor(target + 0.5) div source_size")).otherwise(F.lit(0)).cast("long")
    budgets = targets.withColumn("epochs", epochs).withColumn("budget", words - F.col("epochs") * F.col("source_size"))
    open_ = with_sources(sized, budgets.where("budget > 0").select("sid", "source", "budget"))
    coarse = open_.groupBy("sid", "budget", F.shiftright("key", COARSE).alias("b1")).agg(F.sum("size").alias("words"))
    first = scratch.write(_bin_of_cut(coarse, "b1"))
    inside = with_plan(open_.drop("budget"), first).where(F.shiftright("key", COARSE) == F.col("b1"))
    fine = inside.groupBy("sid", "budget", F.shiftright("key", FINE).alias("b2")).agg(F.sum("size").alias("words"))
    second = scratch.write(_bin_of_cut(fine, "b2"))
    near = with_plan(open_.drop("budget"), second).where(F.shiftright("key", FINE) == F.col("b2"))
    alike = near.groupBy("sid", "budget", "key", "doc_id").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    run = F.sum("words").over(Window.partitionBy("sid").orderBy("key", F.col("doc_id").asc_nulls_first()))
    cut = alike.withColumn("to", run).where((F.col("to") >= F.col("budget")) & (F.col("to") - F.col("words") < F.col("budget")))
    given = F.floor((F.col("budget") - F.col("to") + F.col("words")) / F.col("n")).cast("long")
    cut = cut.select(F.col("sid").alias("cut_sid"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), given.alias("cut_words"))
    plan = budgets.drop("budget").join(cut, F.col("sid") == F.col("cut_sid"), "left").drop("cut_sid")
    plan = scratch.write(plan)
    scratch.only(sized, plan)
    return sized, plan


def _small(plan: DataFrame) -> DataFrame:
    return F.broadcast(plan) if plan.count() <= BROADCAST_SOURCES else plan


def with_sources(docs: DataFrame, plan: DataFrame) -> DataFrame:
    plan = _small(plan).withColumnRenamed("source", "plan_source")
    return docs.join(plan, docs["source"].eqNullSafe(F.col("plan_source"))).drop("plan_source")


def with_plan(docs: DataFrame, plan: DataFrame) -> DataFrame:
    return docs.join(_small(plan), "sid")


def extra_words(size: Column, key: Column) -> Column:
    """Words a row gives to its source's fractional part: all before the cut, some at it, none after."""
    id_, cut_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), F.coalesce(F.col("cut_id"), F.lit(-(2**63)))
    before = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (id_ < cut_id))
    return F.when(F.col("cut_key").isNull(), F.lit(0)).when(before, size).when((key == F.col("cut_key")) & (id_ == cut_id), F.least(size, F.col("cut_words"))).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), a row for each row of ``docs``.

    ``taken`` counts the words of whole epochs and of the fractional part. The document at a
    source's cut gives just the words that are missing; rows that repeat its id share them
    evenly. A null or wordless text has size 0 and gives nothing; null sources are one source,
    the last; a null id is drawn like an id of its own. No rows give an empty result.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mixing")
    sized, plan = plan_mix(docs, scratch, **options)
    taken = F.col("epochs") * F.col("size") + extra_words(F.col("size"), F.col("key"))
    return with_sources(sized, plan).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Documents are taken whole here: the one at the cut counts if at least half of it is wanted.
    Wordless documents, which no budget counts, come as often as their source's whole epochs.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    _, plan = plan_mix(docs, scratch, **options)
    scratch.only(plan)
    held = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count().alias("size"), sample_key(quality_weight()).alias("key"))
    out = with_sources(held, plan)
    extra = F.when(F.col("size") > 0, (2 * extra_words(F.col("size"), F.col("key")) >= F.col("size")).cast("long")).otherwise(F.lit(0))
    out = out.withColumn("times", F.col("epochs") + extra).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("source")


#: The same in DuckDB's SQL.
OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN length(text) > 0 THEN greatest(0.05::DOUBLE, length(translate(text, '#*%&$|!~^@<>{}', ''))::DOUBLE / length(text)::DOUBLE) ELSE 1.0::DOUBLE END AS quality,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE AS drawn
  FROM documents),
keyed AS (SELECT *, floor(-ln((drawn + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / quality * 1099511627776::DOUBLE)::BIGINT AS key FROM sized),
totals AS (SELECT source, sum(size)::DOUBLE AS s FROM keyed GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM totals),
levels AS (
  SELECT *, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(2 * s) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM ranked WINDOW before AS (ORDER BY 2 * s / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, (2 * s / w, sid)) AS level FROM levels WHERE level <= 2 * s / w),
targets AS (SELECT r.source, r.s, least(2 * r.s, r.w * c.level) AS target FROM ranked r, chosen c),
budgets AS (
  SELECT *, CASE WHEN s > 0 THEN floor(target + 0.5)::BIGINT // s::BIGINT ELSE 0 END AS epochs FROM targets),
running AS (
  SELECT k.doc_id, k.size, b.s, b.target, b.epochs, floor(b.target + 0.5)::BIGINT - b.epochs * b.s::BIGINT AS budget,
         coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, s::BIGINT AS source_size, target, CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM running
"""
