import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_decontamination import brute as brute_hits
from test_near_join import brute as brute_near

from verdigris.llm.bpe import read_ranks
from verdigris.llm.toxicity import THRESHOLD, train

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    rows = [r for r in rows if model.score(r[1]) < THRESHOLD]
    seen, unique = set(), []
    for i, t in rows:
        if (key := re.sub("[\x20\x09-\x0d]+", " ", t)) not in seen:
            seen.add(key)
            unique.append((i, t))
    lead = {c for _, c, _ in brute_near(unique)}
    rows = [r for r in unique if r[0] in lead]
    dirty = {r[0] for r in brute_hits(rows, items) if r[5]}
    ranks = read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {i: whole.encode_ordinary(t) for i, t in rows if i not in dirty} and got
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, and columns whose names the stages use themselves."""
    text = "the quick brown fox jumps over the lazy dog and runs away from here today"
    rows = [
        (1, text, "en", 77, "a"), (2, text, None, None, "b"), (3, text.replace(" ", "  "), "en", 1, None), (3, text, "en", 1, None), (None, None, None, None, None), (4, "", "en", 2, "c"),
        (5, None, "de", 3, "d"), (6, "other words " * 60_000, "en", 4, "e"), (6, "other words " * 60_000, "en", 4, "e"), (7, "one two three four five six seven eight nine ten eleven twelve", "en", 5, "f"), (None, "no identifier but a text", "en", 6, "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, _len int, _sha string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "zero one two three four five six seven eight nine ten"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens > 0) for r in got) == [(False, 1, True), (False, 4, False), (False, 6, True), (True, 0, True)]
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        kept = {(r.doc_id, r._len, r._sha) for r in out.collect()}
        assert kept <= {(r[0], r[3], r[4]) for r in rows}


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
