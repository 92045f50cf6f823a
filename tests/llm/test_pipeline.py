"""The pipeline against its operators one by one, and the registered queries against their SQL."""

import corpus_pipeline
import oracle
import pytest

from gradewright.llm import exact_dedup, packing, pii, quality, simhash
from gradewright.llm.queries import ORACLES, QUERIES
from gradewright.llm.tokens import default_path

SF = "/root/testdata/sf0.001"


def test_stages_equal_the_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = docs.where(docs.doc_id.isin(*good))
    whole = {r.doc_id for r in exact_dedup.exact_duplicates(rows).where("kept").collect()}
    rows = rows.where(rows.doc_id.isin(*whole))
    alone = {r.doc_id for r in simhash.near_duplicates(rows).where("doc_id = component_id").collect()}
    rows = rows.where(rows.doc_id.isin(*alone))
    want = packing.pack(packing.pieces(pii.redacted(rows), default_path()))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(None, None, 1, "t"), (1, "", 2, "t"), (2, "Same  text here.", 3, "t"), (3, "Same text here.", 4, "t"), (3, "Same text here.", 4, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row_key int, more string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            assert out.columns == docs.columns and out.count() <= df.count(), name
    assert corpus_pipeline.exact_copies(spark, docs, SF).count() == 2
    assert corpus_pipeline.packed(spark, docs, SF).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, SF), oracle.connect(SF), ORACLES[name]) is None


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
