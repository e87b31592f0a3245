"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    found = c.sql(queries.ORACLE_SQL[name])
    at = [found.columns.index(x) for x in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=str)


def test_toxicity_on_held_out_rows(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.8 * sum(r.toxic for r in rows) and hit >= 0.9 * sum(r.predicted for r in rows)


def test_benchmark_passages_are_found(spark):
    d, b = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = {r.item_id: r.text for r in b.collect()}
    exact = {(r.doc_id, i) for r in d.collect() for i, t in items.items() if t in (r.text or "")}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, DATA).collect()}
    assert exact and exact <= got


def test_pipeline(spark):
    before = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, counts = before, [before.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.materialize(stage(spark, docs, DATA), name)
        counts.append(docs.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    quality = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").select("doc_id")
    stage1 = corpus_pipeline.quality_rules(spark, before, DATA)
    long = before.join(quality, "doc_id").where(F.size(F.split("text", r"\s+")) > 60)
    assert long.join(stage1, "doc_id", "left_anti").count() <= 0.05 * long.count()
    bad = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0")
    assert stage1.join(bad, "doc_id").count() <= 0.1 * bad.count()


def test_encoded_digest(spark):
    import public_tokenizers as P
    import tiktoken

    from plumbline.llm.bpe import read_ranks

    ranks = read_ranks(spark, P.path("byte_bpe_multi_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op3_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = enc.encode_ordinary(r.text or "")
        one = got[r.doc_id]
        assert (one.n_tokens, one.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert one.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_pipeline_of_odd_rows(spark, tmp_path):
    import random

    rnd = random.Random(1)
    text = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(80))
    a, b, c, item = text(), text(), text(), text()
    rows = [(1, a), (2, a), (3, b), (3, b), (None, c), (4, None), (5, ""), (6, f"{text()} {item}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "kept": F.lit("mine"), "component_id": F.lit(7), "f_words": F.lit(0.0)})
    labels, bench = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality long, toxic long"), spark.createDataFrame([(0, item), (None, a), (1, None)], "item_id long, text string")
    for n, (d, q) in enumerate(((docs, labels), (docs.limit(0), labels), (docs, labels.limit(0)))):
        for name, df in (("documents", d), ("labels", q), ("benchmark", bench)):
            df.write.parquet(f"{tmp_path}/{n}/{name}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{n}").collect()
        assert sorted((r.doc_id or 0 for r in out)) == ([] if n == 1 else [0, 1, 3, 3])
        assert all(r.n_tokens == len(r.ids) > 80 for r in out)
