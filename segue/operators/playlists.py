"""Cluster-level operators: summaries, profiles, blocks, arcs and chapters.

Everything keyed by track is one pass with a hash aggregate or a window inside
a cluster; windows without a key stand over clusters, blocks or profiles only,
of which there are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import exprs as X

#: Places on the energy arcs.
ARCS = {
    "Warmup": (0.2, 0.4, 0.6, 0.8, 1.0), "Peak": (0.4, 0.7, 1.0, 1.0, 0.8), "Sunrise": (0.6, 0.4, 0.2, 0.4, 0.8),
    "Deep": (0.5, 0.3, 0.4, 0.6, 0.5), "Closing": (1.0, 0.9, 0.7, 0.5, 0.3),
}

#: Blocks, with the share of clusters at which each ends, and its chapter's name.
BLOCKS = (("warm-up", 0.20, "Intro"), ("build", 0.50, "Build"), ("peak", 0.80, "Peak"), ("sustain", 0.95, "Sustain"), ("wind-down", 1.0, "Outro"))
MINUTES_A_TRACK = 6


def pick_most(rows: DataFrame, key: str, value: str, first: Column) -> DataFrame:
    """(key, value): the most frequent value, of equals the one met first."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select(key, value)


def summary(known: DataFrame) -> DataFrame:
    """Per cluster: tempo mean and population deviation, tracks, duration, feature means and hardness."""
    means = [F.avg(c).alias(f"mean_{c}") for c in X.FEATURES]
    return known.where("bpm IS NOT NULL").groupBy("cluster_id").agg(
        F.avg("bpm").alias("bpm_mean"), F.stddev_pop("bpm").alias("bpm_std"), F.count("*").alias("track_count"),
        F.sum(F.coalesce("duration", F.lit(0.0))).alias("total_duration"), *means, F.avg(X.hardness()).alias("hardness"),
    )


def profiles(known: DataFrame) -> DataFrame:
    """Vibe profiles: five means and the dominant mood of each cluster."""
    means = known.groupBy("cluster_id").agg(
        F.avg("rms_energy").alias("mean_rms"), F.avg("brightness").alias("mean_brightness"), F.avg("percussiveness").alias("mean_percussiveness"),
        F.avg("vocal_presence").alias("mean_vocal_presence"), F.avg("bpm").alias("mean_bpm"), F.count("*").alias("n_tracks"),
    )
    moods = pick_most(known.withColumn("mood", X.mood()), "cluster_id", "mood", F.col("pos"))
    return means.join(moods.withColumnRenamed("mood", "dominant_mood"), "cluster_id")


PROFILE_MEANS = ("mean_rms", "mean_brightness", "mean_percussiveness", "mean_vocal_presence", "mean_bpm")


def salience(profile: DataFrame) -> DataFrame:
    """(cluster_id, feature, z): profile means more than 1.5 deviations off the library's."""
    long = profile.unpivot(["cluster_id"], list(PROFILE_MEANS), "feature", "value")
    whole = Window.partitionBy("feature")
    spread = long.withColumn("m", F.avg("value").over(whole)).withColumn("s", F.stddev_pop("value").over(whole))
    return spread.where("s > 0").withColumn("z", F.round((F.col("value") - F.col("m")) / F.col("s"), 6)).where("abs(z) > 1.5").select("cluster_id", "feature", "z")


def cluster_energy(known: DataFrame) -> DataFrame:
    return known.groupBy("cluster_id").agg(F.avg("rms_energy").alias("energy"), F.count("*").alias("track_count"))


def blocks_of(energy: DataFrame) -> DataFrame:
    """Clusters with their energy block, by rank of energy."""
    n = F.count("*").over(Window.partitionBy())
    ranked = energy.withColumn("n", n).withColumn("i", F.row_number().over(Window.orderBy("energy", "cluster_id")) - 1)
    ends: list[Column] = []
    for k, (_, share, _) in enumerate(BLOCKS[:-1]):
        cut = F.floor(F.col("n") * share)
        ends.append(F.greatest(F.lit(1), cut) if k == 0 else F.greatest(ends[-1] + 1, cut))
    block = F.when(F.col("n") == 1, BLOCKS[0][0])
    for (name, _, _), end in zip(BLOCKS, ends, strict=False):
        block = block.when(F.col("i") < end, name)
    return ranked.withColumn("block", block.otherwise(BLOCKS[-1][0])).drop("n", "i")


def energy_blocks(energy: DataFrame) -> DataFrame:
    return blocks_of(energy).groupBy("block").agg(
        (F.sum("track_count") * MINUTES_A_TRACK).alias("target_duration_min"), F.min("energy").alias("energy_min"), F.max("energy").alias("energy_max"),
        F.count("*").alias("n_clusters"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("energy", "cluster_id"))), lambda x: x["cluster_id"]), ",").alias("cluster_ids"),
    )


def custom_block(energy: DataFrame, name: str, lo: float = 0.0, hi: float = 1.0, minutes: float = 60.0) -> DataFrame:
    """A block of one's own: its length and range of energy as given, and the clusters in the range; none is no fault."""
    inside = energy.where(F.col("energy").between(lo, hi))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("energy", "cluster_id"))), lambda x: x["cluster_id"]), ",")
    return inside.agg(F.count("*").alias("n_clusters"), ids.alias("cluster_ids")).select(
        F.lit(name).alias("block"), F.lit(float(minutes)).alias("target_duration_min"), F.lit(float(lo)).alias("energy_min"), F.lit(float(hi)).alias("energy_max"), "n_clusters", "cluster_ids"
    )


def apply_arc(energy: DataFrame, arc: str) -> DataFrame:
    """Clusters in the order of the arc's places nearest to their energy; places may be shared."""
    e = F.coalesce("energy", F.lit(0.5))
    gaps = F.array(*[F.struct(F.abs(F.lit(p) - e).alias("gap"), F.lit(k).alias("k")) for k, p in enumerate(ARCS[arc])])
    placed = energy.withColumn("place", F.array_min(gaps)["k"])
    return placed.withColumn("seq", F.row_number().over(Window.orderBy("place", e, "cluster_id"))).select("cluster_id", "place", "seq")


def chapters(known: DataFrame, target_min: float = 120.0) -> DataFrame:
    """Tracks that fill each block's chapter, nearest to the block's centroid first.

    The track that crosses the target is in, and so is the first in any case.
    """
    member = blocks_of(cluster_energy(known)).select("cluster_id", "block")
    per = member.groupBy("block").agg(F.count("*").alias("c"))
    share = per.withColumn("target", F.lit(target_min) * 60 * (F.col("c") / F.sum("c").over(Window.partitionBy()))).select("block", "target")
    rows = known.where("bpm IS NOT NULL").join(member, "cluster_id")
    centre = rows.groupBy("block").agg(*[F.avg(c).alias(f"c_{c}") for c in X.FEATURES])
    rows = rows.join(centre, "block").join(share, "block")
    distance = F.sqrt(sum(((F.col(c) - F.col(f"c_{c}")) ** 2 for c in X.FEATURES), F.lit(0.0)))
    rows = rows.withColumn("distance", F.round(distance, 9)).withColumn("d", F.coalesce("duration", F.lit(0.0)))
    order = Window.partitionBy("block").orderBy("distance", "pos")
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("before", F.coalesce(F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return rows.where((F.col("before") < F.col("target")) | (F.col("seq") == 1)).select("block", "seq", "pos", "distance")


def nearest(tracks: DataFrame, centroids: DataFrame, columns: tuple[str, ...] = X.FEATURES) -> DataFrame:
    """(pos, cluster_id, distance): each track's nearest centroid.

    Centroids are one row per cluster, few; they go to every task as one row.
    """
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct(F.col("cluster_id"), *[F.col(c).alias(f"c_{c}") for c in columns]))).alias("centroids"))
    both = tracks.crossJoin(F.broadcast(packed))
    gap = lambda x: F.sqrt(sum(((F.col(c) - x[f"c_{c}"]) ** 2 for c in columns), F.lit(0.0)))
    best = F.array_min(F.transform("centroids", lambda x: F.struct(F.round(gap(x), 9).alias("distance"), x["cluster_id"].alias("cluster_id"))))
    return both.withColumn("best", best).select("pos", "best.cluster_id", "best.distance")


def single_chapter(rows: DataFrame, target_min: float = 120.0) -> DataFrame:
    """One chapter of all tracks, for libraries of fewer tracks than clusters."""
    total = F.sum(F.coalesce("duration", F.lit(0.0))) / 60.0
    return rows.agg(F.lit("Intro").alias("name"), F.least(total, F.lit(0.89 * target_min)).alias("target_duration_min"), total.alias("actual_duration_min"), F.count("*").alias("n_tracks"))
