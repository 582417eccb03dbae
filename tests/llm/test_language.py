import zlib

import numpy as np
import pyarrow as pa
import pytest

from segue.llm import language
from segue.llm._text import runs


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.op8_language_id(spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    right = np.mean([got[r.doc_id].lang_pred == r.lang for r in held])
    assert right > 0.93
    assert all(0 <= g.score <= 1 for g in got.values())


def test_edges(spark, model):
    rows = [(1, None, 1), (2, "", 2), (3, " 12 .,;", 3), (4, "é", 4), (5, "the of and ing " * 40000, 5), (None, "the thing", 6), (5, "a", 7), (5, "a", 7), (6, "日本", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    out = language.identify(df, model).collect()
    assert len(out) == len(rows)
    none = {r.doc_id for r in out if r.lang_pred == "und"}
    assert none == {1, 2, 3}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in out)
    kept = language.accepted(df, model)
    assert kept.columns == df.columns
    assert {r.score for r in kept.collect()} >= {5} and not {1, 2, 3} & {r.score for r in kept.collect()}
    assert language.identify(df.limit(0), model).count() == 0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.fit(df)).first().lang_pred == "und"


def test_subwords_by_hand():
    run = next(iter(runs(pa.array(["ab c", "", "x"], pa.string()))))
    _, owners = language.subwords(run)
    # " ab", "ab ", " c ", and " ab "; then " x "
    assert np.bincount(owners, minlength=3).tolist() == [4, 0, 1]


def test_clean_documents_stay(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language.accepted(docs, model).count() >= 0.995 * docs.count()
