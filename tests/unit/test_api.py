"""The facade and the command line, end to end on small tables."""

import json

from segue import cli
from segue.api import Library
from segue.sources.fixtures import Views

SF = "/root/testdata/sf0.001"


def test_library_chain(spark):
    v = Views(spark, SF)
    lib = Library(v.tracks, v.features).cluster(k=3, restarts=1).split(20).sequence("ramp").name()
    order = lib.order.toPandas()
    assert not order.duplicated("pos").any() and (order.groupby("cluster_id").size() <= 20).all()
    names = lib.names.toPandas()
    assert names.name.is_unique
    first = lib.m3u().where("line_no = 1").toPandas()
    assert set(first.line) == {"#EXTM3U"} and len(first) == order.cluster_id.nunique()
    assert lib.rekordbox().where("line_no = 1").first().line.startswith("<DJ_PLAYLISTS")
    assert lib.arrange("Peak").count() == order.cluster_id.nunique()
    openers, closers = lib.recommendations()
    assert openers.count() and closers.count()


def test_cli(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda *a, **k: spark)
    for name in ("a.mp3", "b.wav", "c.wav", "d.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert cli.main(["info", str(tmp_path), "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out) == {"total": 3, "formats": {".mp3": 1, ".wav": 2}}
    v = Views(spark, SF)
    v.tracks.write.parquet(str(tmp_path / "t"))
    v.features.write.parquet(str(tmp_path / "f"))
    assert cli.main(["scan", str(tmp_path / "t"), str(tmp_path / "f"), "--clusters", "2", "--out", str(tmp_path / "out")]) == 0
    assert "tracks)" in capsys.readouterr().out
    assert list((tmp_path / "out").glob("cluster_id=*"))
