"""Walks against plain versions of themselves."""

import numpy as np
import pandas as pd

from segue.operators import sequential


def test_harmonic_against_a_plain_walk(spark):
    rng = np.random.default_rng(1)
    keys = np.array([*(f"{k}{m}" for k in range(1, 13) for m in "AB"), None, "", "14B"], object)
    n = 900
    rows = pd.DataFrame({"cluster_id": rng.choice(list("abcdefgh"), n), "pos": rng.permutation(n), "camelot_key": rng.choice(keys, n), "rms_energy": rng.integers(0, 12, n) / 8})
    got = sequential.harmonic(spark.createDataFrame(rows, "cluster_id string, pos long, camelot_key string, rms_energy double")).toPandas()
    for cluster, part in rows.groupby("cluster_id"):
        part = part.sort_values("pos").reset_index(drop=True)
        k, e = part.camelot_key.tolist(), part.rms_energy.tolist()
        at, left, path = int(np.argmax(e)), set(range(len(part))), []
        while True:
            path.append(int(part.pos[at]))
            left.discard(at)
            if not left:
                break
            at = min(left, key=lambda j: (-sequential.key_score(k[at], k[j]), abs(e[at] - e[j]), j))
        assert got[got.cluster_id == cluster].sort_values("seq").pos.tolist() == path


def test_timbre_against_a_plain_walk(spark):
    """Ties and repeated tracks too: of equal gaps the first position."""
    rng = np.random.default_rng(2)
    n = 700
    rows = pd.DataFrame({"cluster_id": rng.choice(list("abc"), n), "pos": rng.permutation(n), **{c: rng.integers(0, 6, n) / 5 for c in sequential.X.TIMBRE}})
    kinds = ", ".join(["cluster_id string, pos long", *(f"{c} double" for c in sequential.X.TIMBRE)])
    got = sequential.timbre(spark.createDataFrame(rows, kinds)).toPandas()
    for cluster, part in rows.groupby("cluster_id"):
        part = part.sort_values("pos").reset_index(drop=True)
        x = part[list(sequential.X.TIMBRE)].to_numpy()
        at, left, path = int(part.mfcc_variance.argmax()), list(range(len(part))), []
        while True:
            path.append(int(part.pos[at]))
            left.remove(at)
            if not left:
                break
            at = left[int(np.argmin(np.round(np.sqrt(((x[left] - x[at]) ** 2).sum(axis=1)), 12)))]
        assert got[got.cluster_id == cluster].sort_values("seq").pos.tolist() == path


def test_duration_build_against_one_fold(spark, monkeypatch):
    """Rounds of a few tracks give what one pass over all left-over tracks does."""
    monkeypatch.setattr(sequential, "OFFERED", 7)
    rng = np.random.default_rng(3)
    n, names = 500, list("abcde")
    cluster, duration, gap = rng.choice(names, n), rng.integers(0, 400, n).astype(float), np.round(rng.random((n, 5)), 3)
    rows = spark.createDataFrame([(str(c), k, d, float(gap[k, names.index(c)])) for k, (c, d) in enumerate(zip(cluster, duration.tolist(), strict=True))], "cluster_id string, pos long, duration double, distance double")
    offers = spark.createDataFrame([(k, c, float(gap[k, j])) for k in range(n) for j, c in enumerate(names)], "pos long, cluster_id string, distance double")
    got = sorted((r["pass"], r.cluster_id, r.pos) for r in sequential.duration_build(rows, offers, 60).collect())
    limit, total, want, taken = 60 * 60 * 1.1, dict.fromkeys(names, 0.0), [], set()
    for c in names:
        for k in sorted((k for k in range(n) if cluster[k] == c), key=lambda k: (gap[k, names.index(c)], k)):
            if duration[k] > 0 and total[c] + duration[k] <= limit:
                total[c] += duration[k]
                taken.add(k)
                want.append((1, c, k))
    for k in range(n):
        if k not in taken and duration[k] > 0:
            home = next((c for _, c in sorted((gap[k, j], c) for j, c in enumerate(names)) if total[c] + duration[k] <= limit), None)
            if home:
                total[home] += duration[k]
                want.append((2, home, k))
    assert got == sorted(want) and any(p == 2 for p, _, _ in got)
