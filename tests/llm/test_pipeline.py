import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from lockstep.llm import ngrams, packing, repeats, toxicity
from lockstep.llm.queries import ORACLES, QUERIES
from tests.llm.plain import SCHEMA, awkward, documents, jaccard_groups, kept_bytes
from workload.check import connect, rows_of

SF_DIR = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


def test_registered():
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()
    numbers = [n[2:].split("_")[0] for n in QUERIES if n != "pipeline"]
    assert numbers == [str(k) for k in range(1, 14)]


@here
@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = connect(SF_DIR)
    assert rows_of(QUERIES[name](spark, SF_DIR).toPandas()) == rows_of(con.execute(ORACLES[name]).df())


@here
def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    scorer = toxicity.Scorer(toxicity.train(docs, labels))
    scores, _ = scorer.scores([t or "" for t in texts.values()])
    clean = {i: t for (i, t), s in zip(texts.items(), scores) if s < toxicity.SCORE}
    first = {i: clean[i] for i, (_, g) in jaccard_groups(clean).items() if g == i}
    left = {i: kept.decode(errors="ignore") for i, *_, kept in kept_bytes(first.items())}
    encoder = packing._encoder(packing.VOCABULARY, packing.public_tokenizers.PATTERN)
    wanted = set()
    for i, t in left.items():
        ids = len(encoder.encode(t)) // 4 + 1
        wanted |= {(i, k, start, size) for k, (start, size) in enumerate(packing.cut(ids, packing.LENGTH))}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got} == wanted and len(got) == len(wanted)


def test_stages_keep_columns(spark):
    df = documents(spark, awkward()).withColumnRenamed("lang", "x").withColumnRenamed("source", "rank")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (toxicity.clean_documents(df, labels), ngrams.one_of_each_group(df), repeats.without_repeats(df)):
        assert out.dtypes == df.dtypes
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "best-fit packing" and len(SCHEMA) > 0 and duckdb
