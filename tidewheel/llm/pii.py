"""Personal data: base patterns, and terms that reveal the entities they stand beside.

DataFrame operations only. A kind's matches and the gaps between them come from one regular
expression, and a running sum of their lengths gives positions. Co-occurrence over the corpus
then tells how strongly a term reveals an entity: the share of the term's occurrences that stand
beside the entity, or in documents that mention it, against the entity's own share, in bits. Terms
over the thresholds are generalised wherever they stand, together with the entity itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, read_table, text_or_empty, whole_row

# The base kinds in order. Possessive quantifiers and the guards on where a match
# may begin change no match; they keep the matcher linear and free of recursion on long texts.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without a match of its gate has no match of the kind either.
GATES = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"\p{L}{3,}"
#: Code points beside a mention in which terms are looked for.
BESIDE = 48
#: Terms up to this number are looked up by broadcast, more of them by a shuffle.
BROADCAST_TERMS = 100_000
#: Texts up to this number are looked up by broadcast, more of them by a shuffle.
BROADCAST_TEXTS = 200_000


def _luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes Luhn's check."""
    back = F.reverse(digits)
    twice = F.translate(back, "0123456789", "0246813579")
    terms = [F.coalesce(F.when(F.length(digits) > i, F.substring(twice if i % 2 else back, i + 1, 1).cast("int")), F.lit(0)) for i in range(19)]
    return reduce(lambda a, b: a + b, terms) % 10 == 0


def _holds(kind: Column, match: Column) -> Column:
    """Whether a match of a kind passes that kind's check."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, match.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(kind == 2, n.between(13, 19) & _luhn(F.when(n <= 19, digits).otherwise("")))
        .otherwise(n.between(9, 15))
    )


def _entry(kind: int):
    sides = lambda x: (F.right(x["g"], F.lit(BESIDE + 1)).alias("before"), F.left(x["h"], F.lit(BESIDE + 1)).alias("after"))
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["m"].alias("m"), F.length(x["g"]).alias("gap"), *sides(x))


def _is_kind(kind: int):
    return lambda x: x["kind"] == kind


def _matches(text: Column) -> Column:
    """Array of (kind, match, gap before it, text just before, text just after) by kind and place."""
    every = []
    for k, kind in enumerate(KINDS):
        gaps = F.split(text, PATTERNS[kind], -1)
        zipped = F.arrays_zip(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("m"), gaps.alias("g"), F.slice(gaps, 2, F.size(gaps)).alias("h"))
        found = F.transform(F.filter(zipped, lambda x: x["m"].isNotNull()), _entry(k))
        none = F.array().cast("array<struct<kind:int,m:string,gap:int,before:string,after:string>>")
        every.append(F.when(text.rlike(GATES[kind]), found).otherwise(none))
    return F.concat(*every)


def _mentions(found: DataFrame) -> DataFrame:
    """A row for each base span, (uid, text_hash, kind, start, end, entity, before, after)."""
    rows = found.where(F.size("found") > 0).select("uid", "text_hash", F.posexplode("found").alias("pos", "x")).select("uid", "text_hash", "pos", "x.*")
    length = F.length("m")
    run = F.sum(F.col("gap") + length).over(Window.partitionBy("uid", "kind").orderBy("pos"))
    entity = F.concat_ws(":", F.col("kind").cast("string"), F.when(F.col("kind") < 2, F.lower("m")).otherwise(F.regexp_replace("m", "[^0-9]", "")))
    return rows.withColumn("end", run.cast("long")).where(_holds(F.col("kind"), F.col("m"))).select("uid", "text_hash", "kind", (F.col("end") - length).alias("start"), "end", F.xxhash64(entity).alias("entity"), "before", "after")


def _terms_beside(mentions: DataFrame) -> DataFrame:
    """(uid, entity, term, start, end, context): the terms in the text beside each mention."""
    rows = []
    for side in ("before", "after"):
        text = F.col(side)
        cut = F.length(text) > BESIDE  # the outermost word may be cut; it is left out
        body = F.when(cut, F.regexp_replace(text, r"^\p{L}+" if side == "before" else r"\p{L}+$", "")).otherwise(text)
        at = F.col("start") - F.length("body") if side == "before" else F.col("end")
        gaps = F.split("body", TERM, -1)
        zipped = F.arrays_zip(F.regexp_extract_all("body", F.lit(TERM), F.lit(0)).alias("m"), gaps.alias("g"))
        one = mentions.withColumn("body", body).withColumn("z", F.filter(zipped, lambda x: x["m"].isNotNull())).withColumn("base", at)
        sums = F.transform("z", lambda x, i: F.struct(x["m"].alias("m"), F.aggregate(F.slice(F.col("z"), 1, i + 1), F.lit(0), lambda s, y: s + F.length(y["g"]) + F.length(y["m"])).alias("to")))
        rows.append(
            one.select("uid", "entity", F.xxhash64("before", "after").alias("context"), "base", F.explode(sums).alias("w")).select(
                "uid", "entity", "context", F.lower("w.m").alias("term"), (F.col("base") + F.col("w.to") - F.length("w.m")).alias("start"), (F.col("base") + F.col("w.to")).alias("end")
            )
        )
    return rows[0].unionByName(rows[1])


def _terms(docs: DataFrame) -> DataFrame:
    """(text_hash, term): every term of every text, as often as it occurs."""
    return docs.select(F.xxhash64("text").alias("text_hash"), F.explode(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(TERM), F.lit(0))).alias("term"))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text) of the rows whose text hash is wanted."""
    right = wanted.select(F.col("text_hash").alias("wanted"))
    right = F.broadcast(right) if right.count() <= BROADCAST_TEXTS else right
    return docs.select("text", F.xxhash64("text").alias("own")).join(right, F.col("own") == F.col("wanted"), "left_semi").select("text")


def _in_documents(docs: DataFrame, mentions: DataFrame, counts: DataFrame, scratch: Scratch, bits: float, share: float, contexts: int) -> DataFrame | None:
    """(term): terms that reveal an entity by the documents they occur in, or None.

    An entity has one context a text, what surrounds its first mention. Besides the share and the
    odds, the contexts must be ``bits`` bits less likely by chance than one among all terms tried.
    """
    first = mentions.groupBy("text_hash", "entity").agg(F.min_by(F.xxhash64("before", "after"), F.struct("start", "kind")).alias("context"))
    able = first.groupBy("entity").agg(F.count_distinct("context").alias("n")).where(F.col("n") >= contexts).select("entity")
    pairs = scratch.write(first.join(able, "entity", "left_semi"))
    texts = scratch.write(pairs.select("text_hash").distinct())
    inside = scratch.write(_terms(_texts(docs, texts)).groupBy("text_hash", "term").agg(F.count("*").alias("n")))
    # what falls short of the share among all of these texts, or of the contexts, is no candidate
    tried = inside.groupBy("term").agg(F.sum("n").alias("n_inside"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= contexts).join(counts, "term")
    tried = scratch.write(tried.where(F.col("n_inside") >= share * F.col("n_term")).select("term", "n_term"))
    n_tried = tried.count()
    if not n_tried:
        return None
    together = inside.join(tried, "term").join(pairs, "text_hash").groupBy("term", "entity").agg(F.sum("n").alias("both"), F.first("n_term").alias("n_term"), F.count_distinct("context").alias("contexts"))
    entities = mentions.groupBy("entity").agg(F.count_distinct("uid").alias("n_docs"))
    total = docs.count()
    given, chance = F.col("both") / F.col("n_term"), F.col("n_docs") / F.lit(float(total))
    bits_each = given * F.log2(given / chance) + F.when(given < 1, (1 - given) * F.log2((1 - given) / (1 - chance))).otherwise(0.0)
    likely = (given * (1 - chance) >= 2.0**bits * (1 - given) * chance) & (F.col("contexts") * bits_each >= bits + math.log2(n_tried))
    return together.where(F.col("contexts") >= contexts).join(entities, "entity").where((given >= share) & (chance < 1) & likely).select("term")


def _places_of(docs: DataFrame, terms: DataFrame, scratch: Scratch) -> DataFrame:
    """(text_hash, start, end) of every occurrence of the terms in the corpus.

    A text that has some is cut at just their forms in it, so no rows come of its other words.
    """
    right = F.broadcast(terms) if terms.count() <= BROADCAST_TERMS else terms
    held = _terms(docs).join(right, "term", "left_semi").groupBy("text_hash").agg(F.collect_set("term").alias("terms")).withColumnRenamed("text_hash", "held_hash")
    held = scratch.write(held)
    size = held.agg(F.sum(F.size("terms"))).first()[0] or 0
    held = F.broadcast(held) if size <= BROADCAST_TEXTS else held
    inside = docs.select("text", F.xxhash64("text").alias("text_hash")).join(held, F.col("text_hash") == F.col("held_hash"))
    forms = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), lambda x: F.array_contains(F.col("terms"), F.lower(x)))
    inside = inside.withColumn("forms", F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})")))
    cut = F.arrays_zip(F.transform(F.regexp_extract_all("text", F.col("forms"), F.lit(0)), lambda x: F.length(x)).alias("m"), F.transform(F.split("text", F.col("forms"), -1), lambda x: F.length(x)).alias("g"))
    once = inside.select("text_hash", F.filter(cut, lambda x: x["m"].isNotNull()).alias("cut")).dropDuplicates(["text_hash"])
    rows = once.select("text_hash", F.posexplode("cut").alias("pos", "z"))
    run = F.sum(F.col("z.g") + F.col("z.m")).over(Window.partitionBy("text_hash").orderBy("pos"))
    return rows.select("text_hash", (run - F.col("z.m")).cast("long").alias("start"), run.cast("long").alias("end"))


def revealing_terms(docs: DataFrame, mentions: DataFrame, scratch: Scratch, bits: float = 4.0, share: float = 0.5, contexts: int = 3) -> DataFrame:
    """(text_hash, start, end): every occurrence in the corpus of the terms that reveal an entity.

    A term reveals an entity if they occur together in at least ``contexts`` different contexts
    (so copies of one text are no evidence), if at least ``share`` of the term's occurrences in
    the whole corpus do, and if the odds of that are ``bits`` bits above the entity's own odds.
    Together means in one document, or within ``BESIDE`` code points of a mention. For the
    latter, an entity so frequent among the mentions that no term could reach the odds at half of
    its occurrences is judged by the share alone.
    """
    named = mentions.groupBy("entity").agg(F.count("*").alias("n_entity"), F.count_distinct(F.xxhash64("before", "after")).alias("n"))
    entities = scratch.write(named.where(F.col("n") >= contexts).drop("n"))  # others have too few contexts for any term
    if not entities.limit(1).count():
        return mentions.where("false").select("text_hash", "start", "end")
    counts = scratch.write(_terms(docs).groupBy("term").agg(F.count("*").alias("n_term")))
    beside = _terms_beside(mentions.join(entities, "entity", "left_semi"))
    together = beside.groupBy("term", "entity").agg(F.count_distinct("uid", "start").alias("both"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= contexts)
    total = mentions.count()
    given = F.col("both") / F.col("n_term")
    odds, others = 2.0**bits * F.col("n_entity"), F.lit(total) - F.col("n_entity")
    known = (
        together.join(counts, "term").join(entities, "entity")
        .where((given >= share) & ((others < odds) | (given * others >= (1 - given) * odds)))
        .select("term")
    )
    wide = _in_documents(docs, mentions, counts, scratch, bits, share, contexts)
    known = scratch.write((known if wide is None else known.unionByName(wide)).distinct())
    return _places_of(docs, known, scratch)


def find_spans(docs: DataFrame, scratch: Scratch | None = None, **thresholds) -> DataFrame:
    """(doc_id, text_hash, spans): for every row, its spans (kind, start, end), kinds in order.

    Positions are code points, ends exclusive. kind is 0 to 3 for the base kinds and 4 for a
    revealing term, wherever it stands. A null text counts as empty. Rows that repeat an id stay
    rows of their own. An empty table gives an empty result. Other columns are not read.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    found = scratch.write(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), _matches(text_or_empty()).alias("found")).withColumn("uid", F.monotonically_increasing_id()))
    mentions = scratch.write(_mentions(found))
    terms = scratch.write(revealing_terms(docs, mentions, scratch, **thresholds))
    scratch.only(found, mentions, terms)
    listed = lambda kind: F.sort_array(F.collect_list(F.struct(kind.cast("int").alias("kind"), "start", "end")))
    base = mentions.groupBy("uid").agg(listed(F.col("kind")).alias("base"))
    more = terms.groupBy("text_hash").agg(listed(F.lit(len(KINDS))).alias("more"))
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    rows = found.select("uid", "doc_id", "text_hash").join(base, "uid", "left").join(more, "text_hash", "left")
    return rows.select("doc_id", "text_hash", F.concat(F.coalesce("base", none), F.coalesce("more", none)).alias("spans"))


def redact(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with base spans replaced by [EMAIL], [IP], [CARD] or [PHONE], and revealing terms by [TERM].

    All spans are those that ``find_spans`` gives on the text as it is; overlapping ones are
    replaced as one, by the label of the first kind among them, so no part of any of them stays.
    n_chars, where there is such a column, is counted anew. A null text stays null. All rows and
    columns are kept. Jobs run while the result is planned.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "redact")
    found = find_spans(docs, scratch, **thresholds).where(F.size("spans") > 0).dropDuplicates(["text_hash"])
    each = found.select("text_hash", F.explode("spans").alias("x")).select("text_hash", "x.*")
    by_place = Window.partitionBy("text_hash").orderBy("start", "end", "kind")
    reached = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(F.col("start") < reached, 0).otherwise(1)).withColumn("part", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    merged = each.groupBy("text_hash", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("kind").alias("kind"))
    cuts = scratch.write(merged.groupBy("text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")).withColumnRenamed("text_hash", "cut_hash"))
    scratch.only(cuts)
    n_cuts = cuts.count()
    out = docs.select(whole_row(docs).alias("row"), "text")
    if n_cuts:
        right = F.broadcast(cuts) if n_cuts <= BROADCAST_TEXTS else cuts
        out = out.join(right, F.xxhash64("text") == F.col("cut_hash"), "left")
        labels = F.array(*(F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")))
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda x: x["end"]))
        cut = lambda a, x: F.concat(
            F.substring(F.col("text"), a.cast("int") + 1, F.coalesce(x["start"], F.length("text").cast("long")).cast("int") - a.cast("int")),
            F.when(x["kind"].isNull(), "").otherwise(F.element_at(labels, F.coalesce(x["kind"], F.lit(0)) + 1)),
        )
        out = out.withColumn("text", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(F.array_join(F.zip_with(ends, "cuts", cut), "")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in (*KINDS, "term")))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(KINDS))
    counts = [F.size(F.filter("spans", _is_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
