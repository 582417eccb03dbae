import duckdb
import pandas as pd
import pytest

from segue.llm import mixing


def by_hand(sizes, most=3.0):
    """Targets by resharing until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    left, target, free = float(sum(sizes.values())), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def rows():
    out = [(k, "w " * (1 + k * 7 % 50), "big", 0) for k in range(3000)]
    out += [(5000 + k, "x y\tz", f"s{k % 5}", 0) for k in range(100)]
    return out + [(9000, None, None, 0), (9001, "a b", None, 0), (9002, "", "empty", 0), (None, "a", "s1", 0), (9003, "q q", "s2", 0), (9003, "q q", "s2", 0), (9004, "long " * 30000, "s3", 0)]


def test_against_hand(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string, size int")
    out = mixing.mix(df).toPandas()
    assert len(out) == len(rows())
    sizes = {}
    for _, text, source, _ in rows():
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = by_hand(sizes)
    got = out.assign(source=out.source.where(out.source.notna(), None)).groupby("source", dropna=False)
    for source, part in got:
        source = None if pd.isna(source) else source
        assert part.target.iloc[0] == pytest.approx(want[source])
        assert part.source_size.iloc[0] == sizes[source]
        assert abs(part.taken.sum() - want[source]) <= max(60, 3 * part["size"].max())
    assert (out.taken <= 3 * out["size"]).all()
    again = mixing.mix(df).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(str, out[key].values.tolist())) == sorted(map(str, again[key].values.tolist()))


def test_against_sql_and_documents(spark):
    df = spark.createDataFrame([r[:3] for r in rows()], "doc_id long, text string, source string")
    documents = df.toPandas()
    con = duckdb.connect()
    con.register("documents_raw", documents)
    con.sql("create view documents as select cast(doc_id as bigint) doc_id, text, source from documents_raw")
    want = con.sql(mixing.ORACLE["op5_mix_sources"]).df()
    got = mixing.mix(df).toPandas()
    assert got.taken.sum() == want.taken.sum()
    assert sorted(got.target.tolist()) == sorted(want.target.tolist())
    kept = mixing.mixed_documents(df)
    assert kept.columns == df.columns
    assert kept.count() == int(got.copies.sum())


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_documents_are_rows(spark):
    """Rows that share an id, or all columns, and columns of the names that are used inside."""
    same = [(7, f"w{k % 3} " * (5 + k % 3), "a", k, k % 2) for k in range(300)]
    more = [(7, "w0 w0", "a", 0, 0)] * 300 + [(None, None, None, 1, 1), (8, "", "b", 1, 1), (9, "x y z " * 400, "b", 1, 1)]
    df = spark.createDataFrame(same + more, "doc_id long, text string, source string, _mix_id long, rows int")
    kept = mixing.mixed_documents(df)
    assert kept.columns == df.columns
    copies = mixing.mix(df, carry=("_mix_id",))
    assert copies.columns[-1] == "_mix_id"
    want = {(r[0], r[1]): r[2] for r in copies.groupBy("doc_id", "size").sum("copies").collect() if r[2]}
    size = mixing.word_count(mixing.F.col("text")).alias("size")
    assert {(r[0], r[1]): r[2] for r in kept.groupBy("doc_id", size).count().collect()} == want
    most = df.groupBy(*df.columns).count().join(kept.groupBy(*kept.columns).agg(mixing.F.count("*").alias("taken")), df.columns)
    assert all(r.taken <= 3 * r["count"] for r in most.collect())
    assert mixing.mixed_documents(df.limit(0)).count() == 0
