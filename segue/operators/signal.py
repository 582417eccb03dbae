"""Analytics over frame series: one row per track and frame, aggregated by track."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import exprs as X

HOP, RATE = 512, 22050
HOP_MS = 1000.0 * HOP / RATE


def energy_flow(frames: DataFrame) -> DataFrame:
    """Dynamic range, gradient and drop density of each track's energy."""
    n = F.count("*")
    limits = frames.groupBy("pos").agg(
        F.max("rms").alias("hi"), F.min("rms").alias("lo"), F.regr_slope("rms", "idx").alias("slope"), F.avg("rms").alias("m"), F.stddev_pop("rms").alias("s"), n.alias("n")
    )
    over = frames.join(limits.select("pos", (F.col("m") + 2 * F.col("s")).alias("limit")), "pos").groupBy("pos").agg(F.sum((F.col("rms") > F.col("limit")).cast("long")).alias("drops"))
    minutes = F.col("n") * HOP / (RATE * 60.0)
    return limits.join(over, "pos").select(
        "pos", X.clip((F.col("hi") - F.col("lo")) / (0.3 + 1e-9)).alias("dynamic_range"),
        F.when(F.col("n") > 1, X.clip(F.coalesce("slope", F.lit(0.0)), -0.001, 0.001) / 0.001).otherwise(0.0).alias("energy_gradient"), X.clip(F.col("drops") / minutes / 10).alias("drop_density"),
    )


def first_over(frames: DataFrame, share: Column | float, of: str) -> DataFrame:
    """(pos, first, last): the first and last frame above a share of the mean or the peak; null if none."""
    base = frames.groupBy("pos").agg((F.avg("rms") if of == "mean" else F.max("rms")).alias("base"))
    hit = F.col("rms") > F.col("base") * share
    return frames.join(base, "pos").groupBy("pos").agg(F.min(F.when(hit, F.col("idx"))).alias("first"), F.max(F.when(hit, F.col("idx"))).alias("last"), F.max("idx").alias("end"))


def intro_length(frames: DataFrame) -> DataFrame:
    return first_over(frames, 0.5, "mean").select("pos", (F.coalesce("first", F.lit(0)) * HOP / RATE).alias("intro_length"))


def structure(frames: DataFrame) -> DataFrame:
    """Where a track's intro ends and its outro begins, in ms, the cue points there, and its breakdowns, of which none are told."""
    out = first_over(frames, 0.2, "peak").select("pos", (F.coalesce("first", F.lit(0)) * HOP_MS).alias("intro_end_ms"), (F.coalesce("last", "end") * HOP_MS).alias("outro_start_ms"))
    return out.withColumn("cues", F.create_map(F.lit("cue_1_ms"), "intro_end_ms", F.lit("cue_2_ms"), "outro_start_ms")).withColumn("breakdowns", F.array().cast("array<double>"))


def brightness(frames: DataFrame, rate: int = RATE) -> DataFrame:
    """Energy-weighted centroid of the frames above the first quartile of energy, of half the rate."""
    gate = frames.groupBy("pos").agg(F.expr("percentile(rms, 0.25)").alias("gate"), F.avg("centroid").alias("plain"))
    loud = F.col("rms") > F.col("gate")
    sums = frames.join(gate, "pos").groupBy("pos").agg(F.sum(F.when(loud, F.col("centroid") * F.col("rms"))).alias("ws"), F.sum(F.when(loud, F.col("rms"))).alias("w"), F.first("plain").alias("plain"))
    return sums.select("pos", X.clip(F.coalesce(F.col("ws") / F.col("w"), F.col("plain")) / (rate / 2.0)).alias("brightness"))


def key_of(chroma: Column) -> Column:
    """Camelot key of the strongest of twelve pitch classes; null where none stands out."""
    mean = F.aggregate(chroma, F.lit(0.0), lambda a, x: a + x) / 12
    var = F.aggregate(chroma, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 12
    top = F.array_max(chroma)
    name = F.element_at(F.array(*map(F.lit, X.CHROMA_CAMELOT)), F.array_position(chroma, top).cast("int"))
    return F.when((F.sqrt(var) >= 0.015) & (top >= mean * 1.5), name)


def mean_pool(vectors: DataFrame, key: str, column: str = "embedding") -> DataFrame:
    """Mean vector of each key, by place."""
    long = vectors.select(key, F.posexplode(column).alias("at", "x"))
    return long.groupBy(key, "at").agg(F.avg("x").alias("x")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("mean"))


def labelled(activations: Column, labels: list[str] | None) -> Column:
    """(tag, conf) structs, the most confident first, equal ones in the labels' order; numbers for labels that don't match in number."""
    number = lambda x, k: F.struct((-x.cast("double")).alias("less"), k.alias("k"))
    name = (lambda k: F.when(F.size(activations) == len(labels), F.get(F.array(*map(F.lit, labels)), k)).otherwise(k.cast("string"))) if labels else (lambda k: k.cast("string"))
    return F.transform(F.array_sort(F.transform(activations, number)), lambda x: F.struct(name(x["k"]).alias("tag"), (-x["less"]).alias("conf")))


def infer_genre(tags: Column) -> Column:
    """The genre of the most confident tag that names one; tags are (tag, conf) structs."""
    ordered = F.array_sort(tags, lambda a, b: F.when(a["conf"] > b["conf"], -1).when(a["conf"] < b["conf"], 1).otherwise(0))
    genres = F.transform(ordered, lambda t: X.lookup(F.lower(t["tag"]), X.TAG_GENRES))
    return F.get(F.array_compact(genres), F.lit(0))


def peaks(values: list[float], height: float, distance: int) -> list[int]:
    """Local maxima of at least a height; of those nearer than a distance the higher stay.

    A flat top counts at its middle; of equal heights the later is kept first.
    """
    found, i, n = [], 1, len(values)
    while i < n - 1:
        if values[i - 1] < values[i]:
            j = i
            while j < n - 1 and values[j + 1] == values[i]:
                j += 1
            if j < n - 1 and values[j + 1] < values[i]:
                found.append((i + j) // 2)
            i = j
        i += 1
    found = [p for p in found if values[p] >= height]
    keep = [True] * len(found)
    for k in sorted(range(len(found)), key=lambda k: (values[found[k]], k), reverse=True):
        if keep[k]:
            for step in (-1, 1):
                m = k + step
                while 0 <= m < len(found) and abs(found[m] - found[k]) < distance:
                    keep[m] = False
                    m += step
    return [p for p, good in zip(found, keep, strict=True) if good]


def drops(frames: DataFrame, distance: int = int(10 * RATE / HOP)) -> DataFrame:
    """(pos, drop_ms): peaks of each track's energy at or above its third quartile."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        found = peaks(rows.rms.tolist(), rows.rms.quantile(0.75), distance)
        return pd.DataFrame({"pos": rows.pos.iloc[0], "drop_ms": [p * HOP_MS for p in found]}, columns=["pos", "drop_ms"])

    return frames.groupBy("pos").applyInPandas(work, "pos long, drop_ms double")


def lag_crossings(samples: DataFrame) -> DataFrame:
    """Zero crossing rate of each track's samples, normalised."""
    order = Window.partitionBy("pos").orderBy("idx")
    turned = (F.col("y") < 0) != (F.lag("y").over(order) < 0)
    return samples.withColumn("turned", F.coalesce(turned, F.lit(False)).cast("double")).groupBy("pos").agg(X.clip(F.avg("turned") / 0.5).alias("zero_crossing_rate"))
