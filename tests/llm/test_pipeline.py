from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_cases import brute_groups, spans
from tracewell.llm import langid, packing, secrets, toxicity
from tracewell.llm.common import table
from tracewell.llm.entries import vocabulary


def test_stages_keep_columns_and_act(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wide = docs.withColumn("score", F.lit("x")).unionByName(spark.createDataFrame([(-1, None, None, None, None, "x"), (-2, "12 34", None, None, None, "x")], docs.withColumn("score", F.lit("x")).schema))
    (_, lang), (_, tox), (_, near), (_, sec), _ = corpus_pipeline.STAGES
    a = lang(spark, wide, sf_dir).cache()
    assert a.columns == wide.columns and a.count() == docs.count()
    b = tox(spark, a, sf_dir).cache()
    assert b.columns == wide.columns and b.count() <= a.count()
    c = near(spark, b, sf_dir).cache()
    rows = [(r["doc_id"], r["text"]) for r in b.select("doc_id", "text").collect()]
    want = brute_groups(rows, 80)
    assert {r["doc_id"] for r in c.select("doc_id").collect()} == {i for i, _ in rows if want.get(i, i) == i}
    d = sec(spark, c, sf_dir)
    assert d.columns == wide.columns and not any(spans(r["text"]) for r in d.collect())


def test_run_equals_the_stages_one_by_one(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = langid.identified(docs, langid.fit(docs))
    kept = toxicity.accepted(kept, toxicity.fit(kept, table(spark, sf_dir, "labels")))
    rows = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    group = brute_groups(rows, 80)
    first = spark.createDataFrame([r for r in rows if group.get(r[0], r[0]) == r[0]], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(first).collect()}
    path = vocabulary("byte_bpe_50k.json")
    want = {i: len(packing.token_ids(t, path)) for i, t in clean.items()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == want
    assert sum(r["length"] for r in got) == sum(want.values())


def test_language_stage_tells_the_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    rows = {x: [r["text"] for r in docs.where(F.col("lang") == x).orderBy("doc_id").limit(5).collect()] for x in ("en", "de", "fr", "es")}
    odd = [(-1, "Привет как дела", "en", None, None), (-2, rows["de"][0], None, None, None), (-3, rows["fr"][0], "en", None, None), (-4, "日本語", None, None, None), (-5, "12 34", "en", None, None)]
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(spark.createDataFrame(odd, docs.schema)), sf_dir).collect()}
    assert {i: x for i, x in kept.items() if i < 0} == {-2: "de", -3: "fr"}
    assert {i: x for i, x in kept.items() if i >= 0} == {r["doc_id"]: r["lang"] for r in docs.collect()}


def written(spark, folder, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run_over_empty_tables(spark, tmp_path):
    got = corpus_pipeline.run(spark, written(spark, str(tmp_path), [], []))
    assert got.collect() == [] and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns)


def test_run_over_odd_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (2, text, "en", "s", 5), (3, None, "en", "s", 0), (4, "", None, "s", None), (5, "12 34 !", "en", None, 7), (6, long, "en", "s", None), (7, "short text", "en", "s", None), (8, "token = 'abcdefghijklmnop' here", None, None, 1)]
    got = corpus_pipeline.run(spark, written(spark, str(tmp_path), rows, [])).collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert set(tokens) == {1, 6, 7, 8} and tokens[6] > 60_000
    pieces = sum(r["length"] for r in got if r["doc_id"] == 6)
    assert pieces == tokens[6]
    masked = secrets.redacted(spark.createDataFrame([rows[-1]], "doc_id long, text string, lang string, source string, n_chars long")).first()["text"]
    assert tokens[8] == len(packing.token_ids(masked, vocabulary("byte_bpe_50k.json")))
