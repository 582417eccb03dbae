"""The search for next tracks against all pairs in numpy."""

import numpy as np
import pandas as pd
import pytest

from segue.operators.nexttracks import next_tracks
from segue.operators.sequential import mix_scores

COLUMNS = "pos long, bpm double, camelot_key string, rms_energy double, brightness double"


def by_hand(rows, top):
    keys = rows.camelot_key.tolist()
    out = []
    for i in range(len(rows)):
        scores = mix_scores(rows.bpm.to_numpy(), keys, rows.rms_energy.to_numpy(), rows.brightness.to_numpy(), i)
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-scores[j], rows.pos[j]))[:top]
        out += [(int(rows.pos[i]), r + 1, int(rows.pos[j]), round(float(scores[j]), 9)) for r, j in enumerate(order)]
    return sorted(out)


def library(n, seed):
    rng = np.random.default_rng(seed)
    keys = [*(f"{k}{m}" for k in range(1, 13) for m in "AB"), None, "", "13A"]
    rows = pd.DataFrame({"pos": rng.permutation(n) + 1, "bpm": rng.normal(125, 12, n).round(1), "camelot_key": rng.choice(keys, n), "rms_energy": rng.random(n).round(2), "brightness": rng.random(n).round(2)})
    rows.loc[: n // 3, ["bpm", "rms_energy", "brightness"]] = 128.0, 0.7, 0.4
    rows.loc[: n // 3, "camelot_key"] = "8A"
    rows.loc[n - 3 :, "bpm"] = [900.0, 20.0, 400.0]
    return rows


@pytest.mark.parametrize(("n", "top"), [(700, 5), (60, 2), (4, 5)])
def test_against_all_pairs(spark, n, top):
    rows = library(n, n)
    got = next_tracks(spark.createDataFrame(rows.astype({"camelot_key": object}).where(rows.notna(), None), COLUMNS), top).collect()
    assert sorted((r.pos, r.rank, r.other, round(r.score, 9)) for r in got) == by_hand(rows, top)


def test_edges(spark):
    assert next_tracks(spark.createDataFrame([], COLUMNS)).collect() == []
    lone = spark.createDataFrame([(1, 120.0, "8A", 0.5, 0.5), (2, None, "8A", 0.5, 0.5), (3, 120.0, "8A", float("nan"), 0.5)], COLUMNS)
    assert next_tracks(lone).collect() == []
