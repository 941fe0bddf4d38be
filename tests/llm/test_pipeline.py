import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from test_llm_kernels import brute_spans, check_packing  # noqa: F401
from test_native import brute_lines
from test_near_dedup import brute_groups


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert [k for k, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "secrets", "packing"]


def rows(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    junk = docs.limit(1).withColumns({"doc_id": F.lit(10**6).cast("long"), "text": F.lit("1234 !!"), "lang": F.lit(None).cast("string")})
    one = pipeline.identify_language(spark, docs.union(junk), sf_dir).cache()
    assert one.columns == docs.columns and rows(one) == rows(docs.where(F.col("text").rlike(r"\p{L}")))
    two = pipeline.drop_repeated_lines(spark, one, sf_dir).cache()
    assert two.columns == docs.columns
    assert rows(two) == sorted(((d, t) for d, _, _, t in brute_lines(rows(one))), key=repr)
    assert two.where("n_chars != char_length(text)").count() == 0
    three = pipeline.drop_near_duplicates(spark, two, sf_dir).cache()
    stay = {d for d, _, c in brute_groups(rows(two)) if d == c}
    assert three.columns == docs.columns and {d for d, _ in rows(three)} == stay
    four = pipeline.redact_secrets(spark, three, sf_dir).cache()
    assert four.columns == docs.columns and four.count() == three.count()
    before = dict(rows(three))
    for d, t in rows(four):
        assert (t == before[d]) or brute_spans(before[d]) or "[" in t
        for kind, a, b in brute_spans(before[d]):
            assert before[d][a:b] not in t or kind == "hex" and b - a < 24
    five = pipeline.pack_sequences(spark, four, sf_dir)
    check_packing(five, rows(four))


@pytest.mark.parametrize("ids", ["unlabelled", "held out"])
def test_no_training_rows(spark, sf_dir, ids):
    lang = None if ids == "unlabelled" else "en"
    made = [(i, t, lang, "s", 1) for i, t in enumerate(["some words", "Ünïcode", "123 !", "", None] * 20)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    if lang:
        docs = docs.where(pipeline.lang_id.held_out(F.col("doc_id")))
    want = sorted((r.doc_id, r.text) for r in docs.collect() if r.text in ("some words", "Ünïcode"))
    out = pipeline.identify_language(spark, docs, sf_dir)
    assert want and out.columns == docs.columns and rows(out) == sorted(want, key=repr)


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


@pytest.mark.parametrize("name", ["identify_language", "drop_repeated_lines", "drop_near_duplicates", "redact_secrets", "pack_sequences"])
def test_odd_rows(spark, odd, empty, sf_dir, name):
    step = getattr(pipeline, name)
    assert step(spark, odd, sf_dir).count() > 0 and step(spark, empty, sf_dir).count() == 0
