"""The corpus pipeline, stage by stage, and the registered queries on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sitefold.llm.minhash import near_duplicates

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def test_stages(spark):
    from sitefold.llm.common import staged

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, DATA), "stage")
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == names
        if name == "near duplicates":
            assert near_duplicates(docs).where("not kept").count() == 0
            assert before.join(docs, "doc_id", "left_anti").count() == sizes[-2] - sizes[-1]
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] < sizes[4] <= sizes[5]


ODD = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted long, t_ string, size string, component_id string, bucket int, row string, draws string"


def _odd_rows(spark):
    """Null ids, texts and sources, repeated rows, rows that share an id, and columns named as the stages' own."""
    a, b = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta"))
    own = ("s", 7, "t", "z", "c", 3, "r", "d")
    rows = [(1, a, "en", "x", len(a)), (1, a, "en", "x", len(a)), (2, a, "en", None, len(a)), (3, b, None, "x", len(b)), (3, b + " gamma", None, "x", len(b) + 6)]
    rows += [(None, b[:90], "en", "x", 90), (None, None, None, None, None), (4, None, "de", "y", 0), (5, "", "de", "y", 0), (6, "long " * 200_000, "en", "y", 1_000_000)]
    return spark.createDataFrame([(*r, *own) for r in rows], ODD)


def test_stages_on_odd_rows(spark):
    from sitefold.llm.common import staged

    docs = _odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, DATA), "odd")
        assert docs.schema.simpleString() == spark.createDataFrame([], ODD).schema.simpleString(), name
        assert docs.where("score <> 's' or predicted <> 7 or t_ <> 't' or size <> 'z' or component_id <> 'c' or bucket <> 3 or draws <> 'd'").count() == 0
        ids = sorted((r["doc_id"] for r in docs.select("doc_id").collect()), key=lambda i: (i is None, i or 0))
        if name == "toxicity":
            assert ids == [1, 1, 2, 3, 3, 4, 5, 6, None, None]
        elif name in ("near duplicates", "secrets"):
            assert ids == [1, 3, 4, 6, None, None]
        else:
            assert set(ids) == {1, 3, 6, None}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.where("doc_id is null").count() >= 1 and packed.count() >= 4


def test_of_rows_with_one_id_the_smallest_text_stays(spark):
    docs = _odd_rows(spark)
    for n in (1, 5):
        out = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), DATA)
        assert [r["text"][-6:] for r in out.where("doc_id = 3").collect()] == ["beta59"]


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ODD), DATA).count() == 0


def test_run_covers_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.columns[:4] == ["doc_id", "start", "length", "ids_crc32"]


def test_all_are_registered(spark):
    queries = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in queries) for n in range(1, 11)) and "pipeline" in queries


def test_mixing_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    name = next(q for q in entry.queries() if q.startswith("op4_"))
    want = con.sql(entry.oracle_sql()[name]).df().sort_values("doc_id").reset_index(drop=True)
    got = entry.queries()[name](spark, DATA).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in got.columns:
        assert (got[c] == want[c]).all(), c
