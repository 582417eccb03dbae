"""Operators against plain versions and hand-made cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.ml import clustering as M
from segue.operators import naming, playlists, render, sequencing, sequential, signal
from segue.sources import library as L
from segue.sources.fixtures import Views
from segue.streaming import plays

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF)


def value(spark, expression, **cells):
    row = spark.createDataFrame([Row(**cells)]) if cells else spark.range(1)
    return row.select(expression.alias("x")).first().x


def test_keys(spark):
    fits = [("8A", "8A"), ("8A", "9A"), ("12A", "1A"), ("8A", "8B"), ("8A", "11B"), ("1A", "10B")]
    for a, b in fits:
        assert value(spark, X.harmonic_compatible("a", "b"), a=a, b=b)
    assert not value(spark, X.harmonic_compatible("a", "b"), a="8A", b="10A")
    assert value(spark, X.harmonic_compatible("a", "b"), a="13A", b="8A") is None
    assert [value(spark, X.harmonic_score("a", "b"), a="8A", b=b) for b in ("8A", "8B", "9A", "11B", "2A", "x")] == [2, 1, 2, 2, 0, 0]
    for a in (f"{n}{c}" for n in range(1, 13) for c in "AB"):
        assert sequential.key_score("5A", a) == value(spark, X.harmonic_score("a", "b"), a="5A", b=a)


def test_cue_time(spark):
    for seconds, want in ((0.0, "00:00:00"), (61.5, "01:01:37"), (61.52, "01:01:39"), (6000.0, "100:00:00"), (-3.0, "00:00:00"), (1 / 150, "00:00:00"), (3 / 150, "00:00:02")):
        assert value(spark, X.cue_time(F.col("s")), s=seconds) == want


def test_camelot_leaves_flats_unknown(spark):
    got = [value(spark, X.camelot(F.col("k")), k=k) for k in ("Cm", "G#m", "6A", "6a", "Abm", "Gb", "CM", "", " Am ")]
    assert got == ["5A", "1A", "6A", "6A", "", "", "8B", "", "8A"]


def test_peaks():
    assert signal.peaks([0, 2, 0, 3, 3, 0, 1, 0], 0, 1) == [1, 3, 6]
    assert signal.peaks([0, 2, 0, 3, 3, 0, 1, 0], 2, 1) == [1, 3]
    assert signal.peaks([0, 2, 0, 3, 0, 1, 0], 0, 3) == [3]
    assert signal.peaks([1, 1, 1], 0, 1) == []


@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_peaks_are_apart_and_maximal(values, distance):
    found = signal.peaks(values, 0, distance)
    assert all(b - a >= distance for a, b in zip(found, found[1:], strict=False))
    every = signal.peaks(values, 0, 1)
    assert all(any(abs(p - q) < distance and values[q] >= values[p] for q in found) for p in every)


def test_sequences_are_permutations(views):
    known = views.known.persist()
    n = known.count()
    for name in ("ramp", "build", "descent", "alternating", "bpm_asc", "bpm_desc", "fixed"):
        out = sequencing.sequence(known, name).select("cluster_id", "pos", "seq").toPandas()
        assert len(out) == n and not out.duplicated(["cluster_id", "seq"]).any()
    for out in (sequential.harmonic(known), sequential.timbre(known)):
        out = out.toPandas()
        assert len(out) == n and not out.duplicated("pos").any()
        assert (out.groupby("cluster_id").seq.max() == out.groupby("cluster_id").size()).all()


def test_split_is_the_seeded_shuffle(spark):
    rows = spark.createDataFrame([("a", k) for k in range(7)] + [("b", 90 + k) for k in range(3)], "cluster_id string, pos long")
    got = {}
    for r in sequential.split(rows, 3).orderBy("cluster_id", "seq").collect():
        got.setdefault(r.cluster_id, []).append(r.pos)
    order = list(range(7))
    random.Random(42).shuffle(order)
    assert got == {"a_0": order[:3], "a_1": order[3:6], "a_2": order[6:], "b": [90, 91, 92]}


def test_fill_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("a", 1, 60.0, 0.1), ("a", 2, 100.0, 0.2), ("a", 3, 0.0, 0.3), ("a", 4, 40.0, 0.4), ("a", 5, None, 0.5)], "cluster_id string, pos long, duration double, distance double")
    assert [r.pos for r in sequential.fill(rows, 110).orderBy("seq").collect()] == [1, 4]
    other = spark.createDataFrame([(2, "a", 0.0), (2, "b", 1.0), (7, "a", 9.0), (7, "b", 0.0)], "pos long, cluster_id string, distance double")
    rows = rows.union(spark.createDataFrame([("b", 7, 50.0, 0.1)], rows.schema))
    built = {(r.cluster_id, r.pos) for r in sequential.duration_build(rows, other, 160 / 66).collect()}
    assert built == {("a", 1), ("a", 2), ("b", 7)} or ("b", 2) in built


def test_naming():
    namer = naming.Namer()
    profile = {"dominant_mood": "Dark", "mean_bpm": 125.0}
    names = [namer.name(profile, {}) for _ in range(3)]
    assert names[0] == "Dark Driving Journey"
    assert names[1] == "Shadowed Propulsive Groove"
    assert len(set(names)) == 3
    assert namer.name({"dominant_mood": None, "mean_bpm": 99.0}, {"mean_rms": -2.0, "mean_bpm": 3.0, "mean_brightness": 1.6}).split()[:2] == ["Fast", "Powerful"]
    again = naming.Namer()
    again.used.update({"A Wave", "A Wave II"})
    assert again.unique("A Wave") == "A Wave III"


def test_alternating(spark):
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(5)], "cluster_id string, pos long, rms_energy double")
    assert [r.pos for r in sequencing.alternating(rows).orderBy("seq").collect()] == [4, 0, 3, 1, 2]


def test_blocks_and_arcs(spark):
    energy = spark.createDataFrame([(str(k), k / 10, 10) for k in range(10)], "cluster_id string, energy double, track_count long")
    got = {r.block: r.n_clusters for r in playlists.energy_blocks(energy).collect()}
    assert got == {"warm-up": 2, "build": 3, "peak": 3, "sustain": 1, "wind-down": 1}
    one = playlists.energy_blocks(energy.limit(1)).first()
    assert (one.block, one.target_duration_min) == ("warm-up", 60)
    order = [r.cluster_id for r in playlists.apply_arc(energy, "Warmup").orderBy("seq").collect()]
    assert order == [str(k) for k in range(10)]


def blobs(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.1, (n // 3, 5)) for c in (0, 10, 20)])
    return x, spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "pos long, x array<double>")


def test_kmeans_finds_blobs_and_k(spark):
    x, rows = blobs(spark)
    k, models = M.choose_k(rows, len(x), most=5, restarts=3)
    assert k == 3
    got = M.assign(rows, models[3].centers).orderBy("pos").toPandas().label.to_numpy()
    assert all(len(set(got[i : i + 20])) == 1 for i in (0, 20, 40)) and len(set(got)) == 3
    assert models[2].inertia > models[3].inertia > models[5].inertia * 0.999
    assert M.choose_k(rows.limit(2), 2) == (2, {})


def test_scaling_and_weights(spark):
    rows = spark.createDataFrame([(k, float(k), 5.0) for k in range(4)], "pos long, a double, b double")
    z = np.array([r.z for r in M.zscore(rows, ("a", "b")).orderBy("pos").collect()])
    assert np.allclose(z[:, 0], (np.arange(4) - 1.5) / np.std(np.arange(4))) and (z[:, 1] == 0).all()
    rng = np.random.default_rng(0)
    latent = rng.normal(size=(100, 2))
    m = np.concatenate([latent[:, :1] + rng.normal(0, 0.2, (100, 4)), latent[:, 1:] + rng.normal(0, 0.2, (100, 4))], axis=1)
    m = (m - m.mean(axis=0)) / m.std(axis=0)
    df = spark.createDataFrame([(r.tolist(),) for r in m], "z array<double>")
    weights, width = M.pca_weights(df, boots=50)
    assert weights.sum() == pytest.approx(1) and 0 < width < 0.3
    with M.Points(df, "z") as points:
        n, mean, cov = M.covariance(points, 8)
    assert n == 100 and np.allclose(cov, np.cov(m.T, bias=True)) and np.allclose(mean, 0)
    assert M.valid_weights(dict.fromkeys(M.SPACE, 1 / 8)) and not M.valid_weights(dict.fromkeys(M.SPACE, 0.2))
    assert M.apply_overrides(np.ones(8), {"bpm": 0.5})[0] == 0.5


def test_ewkm_weights_follow_spread(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, [0.1, 2], (50, 2)), rng.normal(6, [2, 0.1], (50, 2))])
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "z array<double>")
    centers, _, weights = M.ewkm(rows, np.array([[0.0, 0.0], [6.0, 6.0]]))
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[0, 0] > weights[0, 1] and weights[1, 1] > weights[1, 0]
    assert np.allclose(centers, [[0, 0], [6, 6]], atol=1)


def test_passes_agree_at_either_size(spark, monkeypatch):
    x, rows = blobs(spark)
    here = M.fit(rows, [2, 3], restarts=2)
    monkeypatch.setattr(M, "IN_MEMORY", 5)
    there = M.fit(rows, [2, 3], restarts=2)
    assert all(np.allclose(here[k].centers, there[k].centers) and here[k].inertia == pytest.approx(there[k].inertia) for k in (2, 3))


def test_constraint():
    assert M.constraint(100, 0, 2, 10, 25, None) == 4
    assert M.constraint(100, 7200, 2, 10, None, 3600.0) == 2
    assert M.constraint(1000, 7200, 2, 10, 25, 3600.0) == 6
    assert M.constraint(10, 10, 2, 10, None, None) is None


def test_rekordbox_file(spark, tmp_path):
    text = """<?xml version="1.0"?><DJ_PLAYLISTS><COLLECTION>
<TRACK TrackID="1" Name="A" Location="file://localhost/m/a.mp3" AverageBpm="128.00" Tonality="6A"><POSITION_MARK Name="x" Start="20.5" Num="0"/><POSITION_MARK Start="1.5" Num="8"/><POSITION_MARK Start="" Num="1"/></TRACK>
<TRACK TrackID="2" Name="B" Location="file:///m/b.mp3" AverageBpm="?" Tonality="Cm"></TRACK><TRACK TrackID="3" Name="C"/></COLLECTION>
<PLAYLISTS><NODE><TRACK Key="1"/></NODE></PLAYLISTS></DJ_PLAYLISTS>"""
    (tmp_path / "c.xml").write_text(text)
    rows = {r.location: r for r in L.rekordbox(spark, str(tmp_path / "c.xml")).collect()}
    assert set(rows) == {"/m/a.mp3", "/m/b.mp3"}
    a = rows["/m/a.mp3"]
    assert (a.bpm, a.key) == (128.0, "6A") and [(c.position_ms, c.type) for c in a.cue_points] == [(1.5, "memory_cue"), (20.5, "hot_cue")]
    assert rows["/m/b.mp3"].bpm is None and rows["/m/b.mp3"].key == "5A"


def test_scan_and_json(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name in ("a.MP3", "d/b.flac", "d/c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert L.scan(spark, str(tmp_path)).count() == 2
    assert L.scan(spark, str(tmp_path), str(tmp_path / "d")).count() == 3
    (tmp_path / "t.json").write_text('{"p1": ["a", "b"], "p2": []}')
    (tmp_path / "bad.json").write_text("{oops")
    assert {r.path: list(r.entry) for r in L.json_store(spark, str(tmp_path / "t.json"), "array<string>").collect()} == {"p1": ["a", "b"], "p2": []}
    assert L.json_store(spark, str(tmp_path / "bad.json"), "array<string>").count() == 0


def test_written_playlists(views, tmp_path):
    render.write(render.m3u(render.numbered(views.tracks)), str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("cluster_id=*/part-*"))
    assert len(files) == views.tracks.select("cluster_id").distinct().count()
    assert all(f.read_text().startswith("#EXTM3U\n#EXTINF:") for f in files)


def test_stream_equals_batch(spark, views, tmp_path):
    events = views.table("events").select(F.col("user_id").cast("string").alias("path"), "ts")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = plays.to_memory(plays.history(stream), "history_test")
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("history_test").collect()}
    assert got == {tuple(r) for r in plays.history(events).collect()}


def test_orders_are_edited(spark):
    order = spark.createDataFrame([("a", 10 + k, k) for k in range(1, 6)] + [("b", 99, 1)], "cluster_id string, pos long, seq int")
    a = lambda df: [r.pos for r in df.where("cluster_id = 'a'").orderBy("seq").collect()]
    assert a(sequencing.move(order, "a", 2, 4)) == [11, 13, 14, 12, 15]
    assert a(sequencing.move(order, "a", 5, 1)) == [15, 11, 12, 13, 14]
    assert a(sequencing.remove(order, "a", 13)) == [11, 12, 14, 15]
    more = spark.createDataFrame([(30,), (11,), (20,)], "pos long")
    assert a(sequencing.append(order, "a", more)) == [11, 12, 13, 14, 15, 20, 30]
    assert sequencing.move(order, "a", 2, 4).where("cluster_id = 'b'").first().seq == 1
    with pytest.raises(ValueError, match="missing features for track 99"):
        sequencing.require(order, order.where("pos < 90"))


def test_harmonic_pairs_cover_all_tracks(spark, monkeypatch):
    """Every track has a row, with the key of the one before, also where ranges meet and past position 2000."""
    from segue.plans import scalar_plans
    from segue.sources.fixtures import Views

    monkeypatch.setattr(scalar_plans, "RANGE", 100)
    sf = "/root/testdata/sf0.1"
    keys = [(r.pos, r.camelot_key) for r in Views(spark, sf).features.select("pos", "camelot_key").orderBy("pos").collect()]
    want = [(pos, a, before) for (pos, a), before in zip(keys, [None, *(k for _, k in keys)], strict=False)]
    assert keys[-1][0] > 2000
    got = scalar_plans.CATALOGUE.queries["harmonic_score"](spark, sf).orderBy("pos").collect()
    assert [(r.pos, r.a, r.b) for r in got] == want
    pairs = scalar_plans.CATALOGUE.queries["harmonic_bool"](spark, sf).select("pos").orderBy("pos").collect()
    assert [r.pos for r in pairs] == [pos for pos, a, b in want if a is not None and b is not None]


def test_row_draws_are_the_rows_own():
    x = np.random.default_rng(0).normal(size=(5000, 3))
    one = np.ones(5000)
    whole = M.row_draws(x, one, 20, 1)
    assert np.array_equal(whole, np.concatenate([M.row_draws(x[:77], one[:77], 20, 1), M.row_draws(x[77:], one[77:], 20, 1)], axis=1))
    assert abs(whole.mean() - 1) < 0.02 and abs(whole.var() - 1) < 0.05 and abs(np.corrcoef(whole[0], whole[1])[0, 1]) < 0.05


def test_ewkm_ends_where_labels_stay(spark):
    """Labels that the first turn keeps end it: they are made with even weights."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.1, (50, 2)), rng.normal(9, 0.1, (50, 2))])
    rows = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "pos long, z array<double>")
    centers, used, after = M.ewkm(rows, np.array([[0.0, 0.0], [9.0, 9.0]]), start=np.array([0.5, 0.5]))
    assert np.array_equal(centers, [[0, 0], [9, 9]]) and np.allclose(used, 0.5) and not np.allclose(after, 0.5, atol=1e-12)


def test_strategies_and_sorts(spark):
    from segue.operators import sequencing as S

    rows = spark.createDataFrame([(1, "b", 120.0, "x"), (2, "A", None, "x"), (3, None, 99.0, "y"), (4, "a", 120.0, "y")], "pos long, title string, bpm double, cluster_id string")
    with pytest.raises(ValueError, match="ramp"):
        S.sequence(rows, "no such")
    with pytest.raises(ValueError, match="title"):
        S.sort_by(rows, "size")
    order = lambda df: [r.pos for r in df.orderBy("seq").collect()]
    assert order(S.sort_by(rows, "title")) == [3, 2, 4, 1]
    assert order(S.sort_by(rows, "bpm", descending=True)) == [1, 4, 3, 2]
    assert order(S.sort_by(rows, "bpm", within="cluster_id").where("cluster_id = 'x'")) == [2, 1]


def test_freshness_of_blank_and_unused(spark):
    rows = spark.createDataFrame([(None, None), (0, "2024-01-30"), (3, ""), (3, "no date"), (0, None)], "n int, d string")
    got = [r[0] for r in rows.select(X.freshness("n", "d", F.lit("2024-01-31").cast("date"))).collect()]
    assert got[0] == got[2] == got[4] == 1 and abs(got[1] - 1 / 30) < 1e-9 and 0 < got[3] < 1


def test_chapters():
    from segue.operators.chapters import Chapters, default_chapters

    c = Chapters()
    a, b, d = c.create(), c.create("Peak"), c.create()
    assert (a.id, a.name, b.name, d.name) == ("chapter-1", "Chapter 1", "Peak", "Chapter 3")
    assert c.reorder(0, 2) and not c.reorder(1, 1) and not c.reorder(0, 3) and not c.reorder(-1, 0)
    assert [x.id for x in c.all()] == ["chapter-2", "chapter-3", "chapter-1"]
    assert c.rename("chapter-3", "End") and not c.rename("chapter-9", "x") and c.get("chapter-3").name == "End" and c.get("x") is None
    assert c.remove("chapter-2") and not c.remove("chapter-2") and len(c) == 2
    assert c.create().id == "chapter-4"
    c.clear()
    assert len(c) == 0 and c.create().id == "chapter-1"
    assert [(x.id, x.name) for x in default_chapters()] == [("intro", "Intro"), ("build", "Build"), ("peak", "Peak"), ("outro", "Outro")]


def test_tag_edits(spark):
    from segue.operators import tags as T

    store = T.store(spark.createDataFrame([("a", " Dark "), ("a", "dark"), ("b", "Deep"), ("c", " ")], "path string, tag string"))
    one = lambda df: {r.path: list(r.tags) for r in df.collect()}
    assert one(store) == {"a": ["dark"], "b": ["deep"]}
    more = T.add(store, spark.createDataFrame([("a", "Airy"), ("d", "DEEP"), ("d", "")], "path string, tag string"))
    assert one(more) == {"a": ["airy", "dark"], "b": ["deep"], "d": ["deep"]}
    assert one(T.remove(more, spark.createDataFrame([("a", "DARK"), ("b", "deep")], "path string, tag string"))) == {"a": ["airy"], "d": ["deep"]}
    assert one(T.remove_everywhere(more, " Deep")) == {"a": ["airy", "dark"]}
    assert one(T.clear(more, spark.createDataFrame([("a",)], "path string"))) == {"b": ["deep"], "d": ["deep"]}
    assert [r.path for r in T.search(more, "DEEP").orderBy("path").collect()] == ["b", "d"]
    assert [r.tag for r in T.all_tags(more).orderBy("tag").collect()] == ["airy", "dark", "deep"]
