"""Near-duplicate paragraphs by MinHash banding, verified and clustered.

There are two kinds of paragraphs. Natural ones are lines, or short lines that stand together;
they link at the similarity asked for, by bands tuned to that similarity. Passages are short
runs of words inside them that begin where the words themselves choose, so that words which
repeat are found again whatever stands around them; they link when they are equal, the
similarity at which a band of all their words is enough.
One exchange meets all paragraphs in their buckets. Each member of a bucket is compared with
the commonest one there, which joins a group of copies by as many comparisons as it has
members. What lies in buckets that still hold several components is compared where it shares
one of its rarest shingles, in a prefix so long that no pair at the similarity is missed, and
whose place in both prefixes leaves enough shingles to share: text that many paragraphs have in
common has no rare shingles, so it brings no pairs about. Each comparison is of whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.common import Scratch, marked, marks_of, read_table, small_batches
from tidewheel.llm.graph import components
from tidewheel.llm.substrings import Hasher, _mixed

MIN_WORDS, SHINGLE, SIMILARITY, RECALL = 25, 5, 0.8, 0.998
#: Words of a passage, and how many words one after another hold the beginning of one at least:
#: of PASSAGE + WINDOW - 1 words that repeat, some passage repeats.
PASSAGE, WINDOW = 20, 31
#: Bytes of text whose words are hashed at once.
BUFFER = 1 << 21
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def tuned_bands(similarity: float, recall: float, rows: int = 3) -> int:
    """The fewest bands of so many rows in which a pair at the similarity collides with the recall."""
    bands = 1
    while 1 - (1 - similarity**rows) ** bands < recall:
        bands += 1
    return bands


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers first, first + 1, ... of each range one after another, and where each range begins."""
    cut = np.concatenate(([0], np.cumsum(count)))[:-1].astype(np.int64)
    return np.arange(int(count.sum())) + np.repeat(first - cut, count), cut


def _lowest(values: np.ndarray, span: int) -> np.ndarray:
    """The lowest of each ``span`` values one after another."""
    n, width = len(values) - span + 1, 1
    while 2 * width <= span:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[:n], values[span - width : span - width + n])


def _chosen(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each range of values the places that are the lowest of some ``WINDOW`` in it (or of all, if it has fewer)."""
    slots = np.maximum(count, WINDOW)
    place, at = _spread(first, count)
    starts = np.concatenate(([0], np.cumsum(slots)))[:-1].astype(np.int64)
    laid = np.full(int(slots.sum()), TOP)
    source = np.full(len(laid), -1, np.int64)
    to = place - np.repeat(first - starts, count)
    laid[to], source[to] = values[place], place
    low = _lowest(laid, WINDOW)
    whole = np.zeros(len(low), bool)  # windows that do not reach into the next range
    whole[_spread(starts, slots - WINDOW + 1)[0]] = True
    edge = np.zeros(WINDOW - 1, np.uint64)
    high = ~_lowest(~np.concatenate((edge, np.where(whole, low, np.uint64(0)), edge)), WINDOW)
    return source[(high == laid) & (source >= 0)]


class Paragraphs:
    """Words, shingles, nodes and signatures of the paragraphs of many texts at once.

    ``load`` fills row, first word, count, node and passage (a flag) of each paragraph, in the
    order of their places; equal words give equal nodes.
    """

    def __init__(self, min_words: int, bands: int, rows: int = 3):
        self.min_words, self.bands, self.rows = min_words, bands, rows
        self.hasher = Hasher()
        draw = np.random.default_rng(77)
        self.factors = draw.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = draw.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        white = np.zeros(256, bool)
        white[[9, 10, 11, 12, 13, 32]] = True
        self.white = white

    def _natural(self, data: np.ndarray, starts: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line with enough of them, and of each run of shorter lines that has."""
        line = np.searchsorted(np.flatnonzero(data == 10), starts)
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        size = np.diff(np.concatenate((first, [len(starts)])))
        enough = size >= self.min_words
        # a blank line, another text and a line that is long enough end a run
        new = np.concatenate(([True], enough[1:] | enough[:-1] | (line[first][1:] != line[first][:-1] + 1) | (text[first][1:] != text[first][:-1])))
        first = first[new]
        count = np.diff(np.concatenate((first, [len(starts)])))
        return first[count >= self.min_words], count[count >= self.min_words]

    def load(self, texts: list[bytes]) -> None:
        buffer = b"\n".join(t.lower() for t in texts)
        offsets = np.concatenate(([0], np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))))
        self.hasher.load(buffer)
        data = np.frombuffer(buffer, np.uint8)
        blank = np.concatenate(([True], self.white[data], [True]))
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        text = np.searchsorted(offsets, starts, "right") - 1
        words = self.hasher.some(starts, ends)
        shingles = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
        for k in range(SHINGLE):
            shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(shingles)]
        self.shingles = _mixed(shingles)
        none = np.zeros(0, np.int64)
        first, count = self._natural(data, starts, text) if len(starts) else (none, none)
        at, cut = _spread(first, count)
        node = np.add.reduceat(_mixed(words[at] ^ _mixed((at - np.repeat(first, count)).astype(np.uint64))), cut) if len(first) else np.zeros(0, np.uint64)
        # passages begin anywhere in a text, at places that their shingles choose
        room = np.bincount(text, minlength=len(texts)) - PASSAGE + 1
        begin = np.searchsorted(text, np.arange(len(texts)))
        chosen = _chosen(self.shingles, begin[room > 0], room[room > 0]) if (room > 0).any() else none
        inner = np.zeros(len(chosen), np.uint64)
        for k in range(PASSAGE):
            inner = inner * np.uint64(0x9E3779B97F4A7C15) + words[chosen + k]
        inner = _mixed(inner ^ np.uint64(0xA5A5A5A5))
        if len(chosen):  # of equal passages in a row, as in a word that is repeated, the first stands for all
            new = np.concatenate(([True], (inner[1:] != inner[:-1]) | (text[chosen][1:] != text[chosen][:-1])))
            chosen, inner = chosen[new], inner[new]
        self.first = np.concatenate((first, chosen))
        self.count = np.concatenate((count, np.full(len(chosen), PASSAGE, np.int64)))
        self.node = np.concatenate((node, inner))
        self.passage = np.concatenate((np.zeros(len(first), bool), np.ones(len(chosen), bool)))
        order = np.lexsort((self.count, self.first))
        self.first, self.count, self.node, self.passage = self.first[order], self.count[order], self.node[order], self.passage[order]
        self.row = text[self.first]
        self.start = starts[self.first] - offsets[self.row]
        self.end = ends[self.first + self.count - 1] - offsets[self.row]

    def signatures(self, chosen: np.ndarray) -> np.ndarray:
        """A row of band hashes for each chosen paragraph."""
        first, count = self.first[chosen], self.count[chosen] - SHINGLE + 1
        if not len(first):
            return np.zeros((0, self.bands), np.uint64)
        at, cut = _spread(first, count)
        held = self.shingles[at]
        out = np.zeros((len(first), self.bands), np.uint64)
        for k, (factor, shift) in enumerate(zip(self.factors, self.shifts)):
            band = k // self.rows
            out[:, band] = _mixed(out[:, band] + np.minimum.reduceat(held * factor ^ shift, cut) + np.uint64(band + 1))
        return out

    def shingle_set(self, k: int) -> np.ndarray:
        return np.unique(self.shingles[self.first[k] : self.first[k] + self.count[k] - SHINGLE + 1])


def _grouped(texts: list[bytes]):
    """Row ranges of texts that fill a buffer; a long text is a range of its own."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BUFFER:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _bucket_rows(keyed: DataFrame, min_words: int, bands: int) -> DataFrame:
    """(bucket, node, n): each paragraph in the bucket that its node names, and natural ones in one for each band.

    n counts the paragraphs of an Arrow batch that are equal.
    """
    schema = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])

    def run(batches):
        made = Paragraphs(min_words, bands)
        for batch in batches:
            texts, nodes, natural, signs = batch.column(0).to_pylist(), [], [], []
            for a, b in _grouped(texts):
                made.load(texts[a:b])
                own, first, n = np.unique(made.node, return_index=True, return_counts=True)
                nodes.append((own, n))
                lines = first[~made.passage[first]]
                natural.append(made.node[lines])
                signs.append(made.signatures(lines))
            if not nodes:
                continue
            own, back = np.unique(np.concatenate([o for o, _ in nodes]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in nodes]), len(own)).astype(np.int64)
            lines, at = np.unique(np.concatenate(natural), return_index=True)
            sign = np.concatenate(signs)[at]
            often = n[np.searchsorted(own, lines)]
            bucket = np.concatenate((own, sign.reshape(-1)))
            node = np.concatenate((own, np.repeat(lines, bands)))
            count = np.concatenate((n, np.repeat(often, bands)))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(node.view(np.int64)), pa.array(count)], schema=schema)

    return keyed.select("text").mapInArrow(run, "bucket long, node long, n long")


def _places(keyed: DataFrame, min_words: int, wanted: np.ndarray, compared: np.ndarray) -> DataFrame:
    """A row for each paragraph whose node is marked as wanted; with its shingles, once in a buffer, if marked as compared."""
    context = keyed.sparkSession.sparkContext
    wanted, compared = context.broadcast(wanted), context.broadcast(compared)
    out = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("paragraph", pa.int32()), ("passage", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int32()), ("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches):
        made = Paragraphs(min_words, 1)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _grouped(texts):
                made.load(texts[a:b])
                order = np.arange(len(made.row)) - np.searchsorted(made.row, made.row)
                at = np.flatnonzero(marked(made.node, wanted.value))
                if not len(at):
                    continue
                lead = np.zeros(len(made.node), bool)
                lead[np.unique(made.node, return_index=True)[1]] = True
                sets = (made.shingle_set(k).view(np.int64) if give else None for k, give in zip(at.tolist(), (lead & ~made.passage & marked(made.node, compared.value))[at].tolist()))
                take = pa.array(made.row[at] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(order[at].astype(np.int32)), pa.array(made.passage[at]), pa.array(made.start[at]), pa.array(made.end[at]), pa.array(made.count[at].astype(np.int32)), pa.array(made.node[at].view(np.int64)), pa.array(list(sets), out.field(8).type)], schema=out
                )

    return keyed.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(run, "uid long, doc_id long, paragraph int, passage boolean, start long, end long, n_words int, node long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets' Jaccard similarity is high enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(x, "a").join(y, "b").where(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


def _pairs_by_rare_shingles(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members of different parts that can reach the similarity.

    A set's shingles are ordered by how many members have them. Two sets at the similarity share
    a shingle among the first of the shorter's and of the longer's, and their places leave
    enough shingles behind them.
    """
    held = members.join(sets, "node").select("node", "shingles")
    single = held.select("node", F.explode("shingles").alias("shingle"))
    often = single.groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1")  # others are shared with nobody
    shared = single.join(often, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "shingle"))).alias("shared"))
    n = F.size("shingles")
    sized = held.select("node", n.alias("n")).join(shared, "node").join(members, "node")
    part = similarity / (1 + similarity)
    # whole numbers of shingles, free of the fraction's last binary digit
    least = lambda x: F.ceil(x - 1e-9)
    placed = sized.select("node", "part", "n", F.posexplode("shared").alias("k", "s")).select("node", "part", "n", (F.col("n") - F.count("*").over(Window.partitionBy("node")) + F.col("k")).alias("before"), F.col("s.shingle").alias("shingle"))
    short = placed.where(F.col("before") <= F.col("n") - least(2 * part * F.col("n")))
    long = placed.where(F.col("before") <= F.col("n") - least(similarity * F.col("n")))
    short = short.select(*(F.col(c).alias(f"s_{c}") for c in short.columns))
    room = F.least(F.col("s_n") - F.col("s_before"), F.col("n") - F.col("before"))
    able = (F.col("s_n") <= F.col("n")) & (F.col("s_part") != F.col("part")) & (room >= least(part * (F.col("s_n") + F.col("n"))))
    return short.join(long, (F.col("s_shingle") == F.col("shingle")) & able).select(F.least("s_node", "node").alias("a"), F.greatest("s_node", "node").alias("b")).distinct()


def paragraph_classes(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each paragraph that another one equals or nearly equals, in any document.

    (doc_id, paragraph, passage, start, end, n_words, class_doc_id, class_paragraph, class_size,
    kept): places are bytes of the text; a class is a component of linked paragraphs, named by
    its first one (by doc_id, then place; null ids last), the one that is kept. Paragraphs count
    from 0 in their text by place. Natural ones have ``min_words`` words at least; a run of
    shorter lines ends at a blank line. Passages have ``PASSAGE`` words. Null and empty texts
    have none. Rows that repeat a document are documents of their own; no rows give an empty
    result. Other columns are not read. Jobs run while the result is planned.
    """
    if min_words < SHINGLE:
        raise ValueError(f"a paragraph must have {SHINGLE} words at least")
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "paragraphs")
    keyed = _keyed(docs)
    rows = _bucket_rows(keyed, min_words, tuned_bands(similarity, recall)).repartition("bucket").groupBy("bucket", "node").agg(F.sum("n").alias("n"))
    commonest = F.first("node").over(Window.partitionBy("bucket").orderBy(F.desc("n"), "node"))
    met = scratch.write(rows.withColumn("lead", commonest).where("node <> lead or (bucket = node and n > 1)").select("bucket", "node", "lead"))
    edges = met.where("node <> lead")
    compared = edges.select(F.explode(F.array("node", "lead")).alias("node"))
    found = scratch.write(_places(keyed, min_words, marks_of(met.select(F.explode(F.array("node", "lead")).alias("node")), "node"), marks_of(compared, "node")))
    sets = scratch.write(found.where("shingles is not null").groupBy("node").agg(F.first("shingles").alias("shingles")))
    first = _verified(edges.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct(), sets, similarity)
    parts = scratch.write(components(spark, first, scratch))
    part_of = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"{c}_part"))
    named = edges.join(part_of("node"), "node", "left").join(part_of("lead"), "lead", "left")
    named = named.select("bucket", F.explode(F.array(F.struct("node", F.coalesce("node_part", "node").alias("part")), F.struct(F.col("lead").alias("node"), F.coalesce("lead_part", "lead").alias("part")))).alias("m")).select("bucket", "m.*")
    named = scratch.write(named)
    several = named.groupBy("bucket").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("bucket")
    members = scratch.write(named.join(several, "bucket", "left_semi").select("node", "part").distinct())
    second = _verified(_pairs_by_rare_shingles(members, sets, similarity), sets, similarity)
    label = named.select("node", "part").distinct()
    across = second.join(label.withColumnsRenamed({"node": "a", "part": "u"}), "a").join(label.withColumnsRenamed({"node": "b", "part": "v"}), "b")
    over = scratch.write(components(spark, across.select(F.col("u").alias("a"), F.col("v").alias("b")), scratch))
    linked = label.join(over, label.part == over.node, "left").select(label.node, F.coalesce("component", "part").alias("class"))
    # paragraphs that nothing but equal ones are linked to are a class by themselves
    known = linked.unionByName(met.where("node = lead").select("node").join(label, "node", "left_anti").select("node", F.col("node").alias("class")))
    classed = scratch.write(found.drop("shingles").join(known, "node"))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "paragraph", "uid")
    lead = classed.groupBy("class").agg(F.min(place).alias("lead"), F.count("*").alias("class_size")).where("class_size > 1")
    # written, so that the join's large classes can be split
    lead = scratch.write(lead.select("class", "class_size", F.col("lead.doc_id").alias("class_doc_id"), F.col("lead.paragraph").alias("class_paragraph"), F.col("lead.uid").alias("lead_uid")))
    scratch.only(classed, lead)
    kept = (F.col("uid") == F.col("lead_uid")) & (F.col("paragraph") == F.col("class_paragraph"))
    return classed.join(lead, "class").select("doc_id", "paragraph", "passage", "start", "end", "n_words", "class_doc_id", "class_paragraph", "class_size", kept.alias("kept"))


def op7_paragraphs(spark, sf_dir: str) -> DataFrame:
    return paragraph_classes(read_table(spark, sf_dir, "documents"))
