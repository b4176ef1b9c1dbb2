"""The pipeline against its stages done by plain Python."""

import importlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from headwater.llm import bpe, language, pii, registry
from tests.llm.test_near import brute
from tests.llm.test_scans import brute_matches

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in language.identify(docs).collect() if r["lang_pred"] != "und" and r["score"] >= language.LEAST_SCORE}
    assert len(kept) > 0.99 * len(texts)
    kept = {d for d, cls, _, _ in brute([(d, texts[d]) for d in sorted(kept)]) if d == cls}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    kept -= {d for d, _ in brute_matches([(d, texts[d]) for d in kept], items)}
    left = docs.where(docs.doc_id.isin(*kept))
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(left, registry.PII_KEY).collect()}
    enc = bpe.encoding(*registry.tokenizer())
    rows = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"]: (r["n_tokens"], r["n_chars"], r["text"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows}
    assert got == {d: (len(i := enc.encode_ordinary(t)), len(t), t, i) for d, t in new.items()}


def test_all_stages_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_each_stage_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names; and empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    say = "the quick brown fox jumps over the lazy dog near the old river bank today "
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, say, "en", "b", len(say)), (3, say, "en", "b", len(say)), (None, say + "joe@x.org", None, None, None)]
    rows += [(5, " ".join(f"w{i}" for i in range(60_000)), "en", "c", None), (None, "12 .. 34", None, "c", 8), (7, "eine kleine Nachtmusik joe@x.org", "de", None, 32)]
    docs = spark.createDataFrame(rows, schema)
    names = ["_e", "y", "id", "h", "k", "key", "places", "rep", "n_tokens", "ids", "_text", "_near_id", "sig"]
    for c in names:
        docs = docs.withColumn(c, F.lit("clash"))
    left = {"language_id": 5, "ngram_jaccard_join": 8, "benchmark_decontamination": 9, "pii_surrogates": 9, "bpe_tokens": 9}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert len(got) == left[name], name
        if name == "bpe_tokens":
            assert {"text", "lang", "source", "n_chars", "doc_id"} <= set(out.columns) and out.schema["n_tokens"].dataType.simpleString() == "bigint"
        else:
            assert out.columns == docs.columns and all(r[c] == "clash" for r in got for c in names)
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert (None, None) in {(r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[1][1](spark, docs, SF).collect()}


def test_language_stage_uses_the_network(spark):
    """Labels that are missing are filled by prediction, known ones stay, mixtures go though they have letters; nothing goes where nothing can be learned."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    known = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null").collect()}
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang")))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, hidden, SF).collect()}
    filled = [i for i in got if i % 3 == 0 and i in known]
    assert len(filled) > 20 and sum(got[i] == known[i] for i in filled) > 0.9 * len(filled)
    assert all(got[i] == known[i] for i in got if i % 3 and i in known)
    # Words of three languages in turn: letters, but no language of its own.
    texts = {}
    for r in docs.where("lang is not null").orderBy("doc_id").collect():
        texts.setdefault(r["lang"], []).extend(r["text"].split()[:60])
    least = min(map(len, texts.values()))
    mixed = " ".join(w for k in range(min(least, 400)) for w in (texts[lang][k] for lang in sorted(texts)))
    rows = spark.createDataFrame([(-1, mixed, None, "x", len(mixed))], docs.schema)
    score = {r["doc_id"]: r["score"] for r in language.identify(hidden.unionByName(rows)).collect()}
    kept = {r["doc_id"] for r in language.keep_identified(hidden.unionByName(rows), least=max(language.LEAST_SCORE, score[-1] + 1e-6)).collect()}
    letters = {r["doc_id"] for r in hidden.unionByName(rows).where(F.col("text").rlike(r"\p{L}")).collect()}
    assert -1 not in kept and -1 in letters
    assert kept == {i for i, s in score.items() if s >= max(language.LEAST_SCORE, score[-1] + 1e-6)}
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, none, SF).count() == docs.count()


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
