"""The pipeline's stages in order, over messy rows and over a whole table."""

import corpus_pipeline
from messy import documents, empty

SF = "/root/testdata/sf0.01"


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, counts = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == names
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts[name] = docs.count()
    assert counts["quality"] < 1000 and counts["near_duplicates"] < counts["quality"] and counts["privacy"] == counts["near_duplicates"]
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    unique = read("near_duplicates")
    assert unique.select("doc_id").distinct().count() == unique.select("text").distinct().count() == counts["near_duplicates"]
    assert read("privacy").where(r"text rlike '[A-Za-z0-9._%+-]@[A-Za-z0-9-]+[.][A-Za-z]'").count() == 0
    mixed = {r.doc_id: r["count"] for r in read("mixing").groupBy("doc_id").count().collect()}
    assert max(mixed.values()) <= 2
    packed = {r.doc_id: r["count"] for r in read("packing").where("piece = 0").groupBy("doc_id").count().collect()}
    assert packed == mixed


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before has written, by plain loops."""
    import test_pii
    from tokenizers import Tokenizer
    import public_tokenizers
    import test_packing
    import test_simhash

    from tidewheel.llm import mixing, quality

    sf = "/root/testdata/sf0.001"
    docs, given = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    text_of = lambda df: {r.doc_id: r.text for r in df.collect()}
    stages, tables = dict(corpus_pipeline.STAGES), {}
    for name, stage in stages.items():
        tables[name] = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    after = {name: spark.read.parquet(str(tmp_path / name)) for name in stages}
    # quality: what a model trained on the labels scores over the threshold
    scorer = quality.train(tables["quality"], given).scorer()
    before = text_of(tables["quality"])
    scores = dict(zip(before, scorer.score([(t or "").encode() for t in before.values()])))
    assert set(text_of(after["quality"])) == {d for d, s in scores.items() if s >= quality.THRESHOLD}
    # near duplicates: all pairs of fingerprints, the first document of each component
    before = text_of(tables["near_duplicates"])
    prints, union = {d: test_simhash.fingerprint(t or "") for d, t in before.items()}, test_simhash.Union()
    for a, x in prints.items():
        union.find(a)
        for b, y in prints.items():
            if (x ^ y).bit_count() <= 3:
                union.join(a, b)
    assert set(text_of(after["near_duplicates"])) == {union.find(d) for d in prints}
    # privacy: base spans of the input cut once, merged where they overlap; revealing terms besides
    before, out = text_of(tables["privacy"]), text_of(after["privacy"])
    assert set(before) == set(out)
    for d, text in before.items():
        cuts = []
        for kind, a, b in sorted(test_pii.brute(text or ""), key=lambda s: (s[1], s[2])):
            if cuts and a < cuts[-1][1]:
                cuts[-1] = (cuts[-1][0], max(b, cuts[-1][1]), min(kind, cuts[-1][2]))
            else:
                cuts.append((a, b, kind))
        plain, at = [], 0
        for a, b, kind in cuts:
            plain += [text[at:a], ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]")[kind]]
            at = b
        plain = "".join(plain) + (text or "")[at:]
        assert out[d] == plain or "[TERM]" in out[d]
    # mixing: each document as often as the words that the SQL's rules take from it
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(tables["mixing"]).collect()}
    counts = {r.doc_id: r["count"] for r in after["mixing"].groupBy("doc_id").count().collect()}
    assert all(counts.get(d, 0) == (0 if not n else int(t / n + 0.5)) for d, (n, t) in taken.items() if n)
    # packing: the library's tokens, cut by the rules, without gaps
    rows = after["packing"].collect()
    texts = [(r.doc_id, r.text) for r in tables["packing"].collect()]
    test_packing.check(rows, texts, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 1024)


def test_run_gives_the_last_stages_rows(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def test_messy_and_empty_tables(spark, tmp_path):
    for name, docs in (("messy", documents(spark)), ("empty", empty(spark))):
        for stage, f in corpus_pipeline.STAGES:
            out = f(spark, docs, SF)
            out.write.parquet(str(tmp_path / name / stage))
            docs = spark.read.parquet(str(tmp_path / name / stage))
    assert docs.count() == 0
