"""Joins, aggregations, windows and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.operators import playlists as P
from segue.operators import ranges, sequential
from segue.operators import selecting as C
from segue.operators import sequencing as S
from segue.operators import tags as T
from segue.operators.nexttracks import next_tracks
from segue.sources.fixtures import AS_OF, Views

from .base import Catalogue
from .scalar_plans import HARD, MOOD, compat_of, compatible, cue_sql

CATALOGUE = Catalogue()
query = CATALOGUE.add

KNOWN = "known AS (SELECT * FROM tracks JOIN features USING (pos))"
R = 6  # places that means are rounded to


def rounded(df, *columns: str, places: int = R):
    return df.withColumns({c: F.round(c, places) for c in columns})


# -- joins


@query("SELECT pos, path, rms_energy FROM tracks JOIN features USING (pos)")
def features_inner(v: Views):
    return v.tracks.join(v.features, "pos").select("pos", "path", "rms_energy")


@query("SELECT pos, path, coalesce(rms_energy, 0.5::DOUBLE) AS rms_energy, coalesce(camelot_key, '') AS camelot_key FROM tracks LEFT JOIN features USING (pos)")
def features_left_default(v: Views):
    both = v.tracks.join(v.features, "pos", "left")
    return both.select("pos", "path", F.coalesce("rms_energy", F.lit(0.5)).alias("rms_energy"), F.coalesce("camelot_key", F.lit("")).alias("camelot_key"))


@query("SELECT pos, path FROM tracks t WHERE EXISTS (SELECT 1 FROM features f WHERE f.pos = t.pos)")
def features_semi(v: Views):
    return v.tracks.join(v.features, "pos", "left_semi").select("pos", "path")


@query("SELECT pos, path FROM tracks t WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.pos = t.pos)")
def uncached_anti(v: Views):
    return v.tracks.join(v.features, "pos", "left_anti").select("pos", "path")


@query("""WITH overrides AS (SELECT path AS name, 'house' AS g FROM tracks WHERE pos % 50 = 1 UNION ALL SELECT regexp_replace(path, '^/music/', ''), 'dnb' FROM tracks WHERE pos % 50 = 2 UNION ALL SELECT regexp_replace(path, '^.*/', ''), 'ambient' FROM tracks WHERE pos % 50 = 3)
SELECT t.pos, coalesce(a.g, b.g, c.g, CASE WHEN lower(trim(t.genre)) IN ('techno', 'house', 'ambient', 'dnb') THEN lower(trim(t.genre)) END, CASE WHEN t.pos % 7 = 0 THEN 'techno' END, 'unknown') AS genre
FROM tracks t LEFT JOIN overrides a ON a.name = t.path LEFT JOIN overrides b ON b.name = regexp_replace(t.path, '^/music/', '') LEFT JOIN overrides c ON c.name = regexp_replace(t.path, '^.*/', '')""")
def genre_resolve(v: Views):
    """Override by path, by path under the root, by file name; then tags; then inference; else unknown."""
    t, p = v.tracks, F.col("pos")
    below, name = F.regexp_replace("path", "^/music/", ""), F.element_at(F.split("path", "/"), -1)
    some = lambda k, key, g: t.where(p % 50 == k).select(key.alias("name"), F.lit(g).alias("genre"))
    overrides = some(1, F.col("path"), "house").union(some(2, below, "dnb")).union(some(3, name, "ambient"))
    return C.resolve_genre(t, overrides, "/music", F.when(p % 7 == 0, "techno")).select("pos", F.col("resolved").alias("genre"))


_AVG = ", ".join(f"avg({c}) AS c_{c}" for c in X.FEATURES)
_DIST = "sqrt(" + " + ".join(f"(f.{c} - c.c_{c}) ** 2" for c in X.FEATURES) + ")"


@query(f"""WITH {KNOWN}, c AS (SELECT cluster_id, {_AVG} FROM known GROUP BY cluster_id)
SELECT pos, cluster_id, distance FROM (SELECT f.pos, c.cluster_id, round({_DIST}, 9) AS distance, row_number() OVER (PARTITION BY f.pos ORDER BY round({_DIST}, 9), c.cluster_id) AS r FROM features f, c) WHERE r = 1""")
def nearest_centroid(v: Views):
    centroids = v.known.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in X.FEATURES])
    return P.nearest(v.features, centroids)


BLOCK_ROWS = [("low", 0.0, 0.35), ("mid", 0.3, 0.7), ("high", 0.65, 1.0)]


@query("SELECT pos, block FROM (SELECT f.pos, b.block, row_number() OVER (PARTITION BY f.pos ORDER BY b.k) AS r FROM features f JOIN (VALUES (0, 'low', 0.0, 0.35), (1, 'mid', 0.3, 0.7), (2, 'high', 0.65, 1.0)) b(k, block, lo, hi) ON f.rms_energy BETWEEN b.lo AND b.hi) WHERE r = 1")
def block_range_join(v: Views):
    """The first block whose range of energy holds a track."""
    return v.features.select("pos", C.block_of(F.col("rms_energy"), BLOCK_ROWS).alias("block")).where("block IS NOT NULL")


@query(f"""WITH {KNOWN}, good AS (SELECT * FROM known WHERE bpm > 0)
SELECT a AS pos, b AS other, rank, score FROM (SELECT x.pos AS a, y.pos AS b, round({compat_of('x', 'y')}, 9) AS score, CAST(row_number() OVER (PARTITION BY x.pos ORDER BY round({compat_of('x', 'y')}, 9) DESC, y.pos) AS INT) AS rank
FROM good x JOIN good y ON x.pos <> y.pos) WHERE rank <= 5""")
def compat_pairs_topn(v: Views):
    """The five best next tracks of each track, over the whole library."""
    return next_tracks(v.known.where("bpm > 0"))


# -- aggregations


@query(f"""WITH {KNOWN}, e AS (SELECT cluster_id, avg(rms_energy) AS energy FROM known GROUP BY cluster_id)
SELECT 'Custom' AS block, 45.0::DOUBLE AS target_duration_min, 0.48::DOUBLE AS energy_min, 0.52::DOUBLE AS energy_max, count(*) AS n_clusters, coalesce(string_agg(cluster_id, ',' ORDER BY energy, cluster_id), '') AS cluster_ids FROM e WHERE energy BETWEEN 0.48::DOUBLE AND 0.52::DOUBLE""")
def custom_block(v: Views):
    return P.custom_block(P.cluster_energy(v.known), "Custom", 0.48, 0.52, 45)


_MEANS = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in X.FEATURES)


@query(f"""SELECT cluster_id, round(avg(bpm), 6) AS bpm_mean, round(stddev_pop(bpm), 6) AS bpm_std, count(*) AS track_count, sum(coalesce(duration, 0)) AS total_duration, {_MEANS}, round(avg({HARD}), 6) AS hardness
FROM tracks JOIN features USING (pos) WHERE bpm IS NOT NULL GROUP BY cluster_id""")
def cluster_summary(v: Views):
    return rounded(P.summary(v.known), "bpm_mean", "bpm_std", "hardness", *(f"mean_{c}" for c in X.FEATURES))


@query("""SELECT CAST(0 AS BIGINT) AS cluster_id, round(avg(bpm), 6) AS bpm_mean, round(stddev_pop(bpm), 6) AS bpm_std, count(*) AS track_count, sum(coalesce(duration, 0)) AS total_duration FROM tracks WHERE bpm IS NOT NULL""")
def single_cluster(v: Views):
    """All tracks with a tempo as one cluster."""
    out = v.tracks.where("bpm IS NOT NULL").agg(F.avg("bpm").alias("bpm_mean"), F.stddev_pop("bpm").alias("bpm_std"), F.count("*").alias("track_count"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("total_duration"))
    return rounded(out.withColumn("cluster_id", F.lit(0).cast("long")), "bpm_mean", "bpm_std")


_COL = "CASE feature " + " ".join(f"WHEN '{c}' THEN c_{c}" for c in X.FEATURES) + " END"


@query(f"""WITH {KNOWN}, c AS (SELECT cluster_id, {_AVG} FROM known GROUP BY cluster_id), long AS (SELECT feature, {_COL} AS x FROM c, (SELECT unnest({list(X.FEATURES)!r}) AS feature)), vars AS (SELECT feature, var_pop(x) AS va FROM long GROUP BY feature)
SELECT feature, round(CASE WHEN sum(va) OVER () > 0 THEN va / sum(va) OVER () ELSE 1.0 / count(*) OVER () END, 6) AS importance FROM vars""")
def feature_importance(v: Views):
    """Share of the centroids' variance that lies in each feature."""
    centroids = v.known.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in X.FEATURES])
    long = centroids.unpivot(["cluster_id"], list(X.FEATURES), "feature", "x").groupBy("feature").agg(F.var_pop("x").alias("va"))
    whole = Window.partitionBy()
    total = F.sum("va").over(whole)
    return long.select("feature", F.round(F.when(total > 0, F.col("va") / total).otherwise(1.0 / F.count("*").over(whole)), 6).alias("importance"))


_PROFILE = f"""{KNOWN}, moods AS (SELECT cluster_id, mood, count(*) AS n, min(pos) AS first FROM (SELECT *, {MOOD} AS mood FROM known) GROUP BY cluster_id, mood),
profiles AS (SELECT cluster_id, avg(rms_energy) AS mean_rms, avg(brightness) AS mean_brightness, avg(percussiveness) AS mean_percussiveness, avg(vocal_presence) AS mean_vocal_presence, avg(bpm) AS mean_bpm, count(*) AS n_tracks FROM known GROUP BY cluster_id)"""


@query(f"""WITH {_PROFILE} SELECT cluster_id, round(mean_rms, 6) AS mean_rms, round(mean_brightness, 6) AS mean_brightness, round(mean_percussiveness, 6) AS mean_percussiveness, round(mean_vocal_presence, 6) AS mean_vocal_presence, round(mean_bpm, 6) AS mean_bpm, n_tracks, mood AS dominant_mood
FROM profiles JOIN (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, first) AS r FROM moods) USING (cluster_id) WHERE r = 1""")
def vibe_profile(v: Views):
    return rounded(P.profiles(v.known), *P.PROFILE_MEANS)


@query(f"WITH {_PROFILE} SELECT cluster_id, mood, n, round(n / n_tracks, 6) AS share FROM moods JOIN profiles USING (cluster_id)")
def mood_distribution(v: Views):
    counts = v.known.withColumn("mood", X.mood()).groupBy("cluster_id", "mood").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("cluster_id")), 6))


@query(f"""WITH {_PROFILE}, long AS (SELECT cluster_id, feature, CASE feature WHEN 'mean_rms' THEN mean_rms WHEN 'mean_brightness' THEN mean_brightness WHEN 'mean_percussiveness' THEN mean_percussiveness WHEN 'mean_vocal_presence' THEN mean_vocal_presence ELSE mean_bpm END AS x
 FROM profiles, (SELECT unnest({list(P.PROFILE_MEANS)!r}) AS feature)), z AS (SELECT cluster_id, feature, round((x - avg(x) OVER (PARTITION BY feature)) / nullif(stddev_pop(x) OVER (PARTITION BY feature), 0), 6) AS z FROM long)
SELECT cluster_id, feature, z FROM z WHERE abs(z) > 1.5""")
def salience(v: Views):
    return P.salience(P.profiles(v.known))


@query("""WITH votes AS (SELECT cluster_id, lower(trim(genre)) AS genre, count(*) AS n FROM tracks WHERE genre IS NOT NULL GROUP BY 1, 2)
SELECT cluster_id, genre, n FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, genre) AS r FROM votes) WHERE r = 1""")
def genre_vote(v: Views):
    return C.genre_vote(v.tracks)


@query("""SELECT cluster_id, count(*) AS track_count, sum(coalesce(duration, 0)) AS total_duration, coalesce(min(rms_energy), 0.0::DOUBLE) AS energy_min, coalesce(max(rms_energy), 1.0::DOUBLE) AS energy_max,
 CASE WHEN CAST(sum(coalesce(duration, 0)) AS BIGINT) >= 3600 THEN concat(CAST(CAST(sum(coalesce(duration, 0)) AS BIGINT) // 3600 AS VARCHAR), ':', lpad(CAST(CAST(sum(coalesce(duration, 0)) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(CAST(sum(coalesce(duration, 0)) AS BIGINT) % 60 AS VARCHAR), 2, '0'))
 ELSE concat(CAST(CAST(sum(coalesce(duration, 0)) AS BIGINT) // 60 AS VARCHAR), ':', lpad(CAST(CAST(sum(coalesce(duration, 0)) AS BIGINT) % 60 AS VARCHAR), 2, '0')) END AS duration_str
FROM tracks LEFT JOIN features USING (pos) GROUP BY cluster_id""")
def chapter_summary(v: Views):
    return C.chapter_summary(v.tracks, v.features)


@query("SELECT user_id AS pos, count(*) AS times_used, strftime(CAST(max(ts) AS DATE), '%Y-%m-%d') AS last_used FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def play_counts(v: Views):
    plays = v.table("events").where("event_type = 'purchase'")
    return plays.groupBy(F.col("user_id").alias("pos")).agg(F.count("*").alias("times_used"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_used"))


@query("SELECT DISTINCT lower(trim(tag)) AS tag FROM tags")
def distinct_tags(v: Views):
    return v.tags.select(F.lower(F.trim("tag")).alias("tag")).distinct()


@query("SELECT pos, string_agg(t, ',' ORDER BY t) AS tags FROM (SELECT DISTINCT pos, lower(trim(tag)) AS t FROM tags) GROUP BY pos")
def tag_store(v: Views):
    """The tags of each track, normalised, each once, in order."""
    return v.tags.groupBy("pos").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("tag")))), ",").alias("tags"))


@query("""WITH named AS (SELECT DISTINCT pos, lower(trim(tag)) AS t FROM (SELECT pos, tag FROM tags UNION ALL SELECT pos, genre FROM tracks WHERE genre IS NOT NULL))
SELECT pos, string_agg(t, ',' ORDER BY t) AS tags FROM named WHERE t <> '' AND t <> 'house' AND NOT (pos % 5 = 0) AND NOT EXISTS (SELECT 1 FROM tags g WHERE g.pos = named.pos AND lower(trim(g.tag)) = named.t AND length(named.t) > 6) GROUP BY pos""")
def tag_edits(v: Views):
    """A tag store after each track's genre was added, long tags taken away, one tag everywhere, and some tracks' tags cleared."""
    store = T.add(T.store(v.tags, "pos"), v.tracks.select("pos", F.col("genre").alias("tag")), "pos")
    store = T.remove(store, v.tags.where(F.length(F.trim("tag")) > 6), "pos")
    store = T.clear(T.remove_everywhere(store, "House"), v.tracks.where("pos % 5 = 0"), "pos")
    return store.select("pos", F.array_join("tags", ",").alias("tags"))


@query("SELECT pos, row_number() OVER (ORDER BY lower(coalesce(title, '')), pos) AS seq FROM tracks")
def library_sort(v: Views):
    """The whole library by title."""
    return S.sort_by(v.tracks, "title").select("pos", "seq")


@query("SELECT cluster_id, pos, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY coalesce(bpm, 0) DESC, pos) AS INT) AS seq FROM tracks")
def playlist_sort(v: Views):
    """Each playlist by tempo, fastest first."""
    return S.sort_by(v.tracks, "bpm", descending=True, within="cluster_id").select("cluster_id", "pos", "seq")


@query("""SELECT cluster_id, sum(coalesce(duration, 0)) AS total_duration, round(avg(nullif(bpm, 0)), 6) AS avg_bpm, round(avg(rms_energy), 6) AS avg_energy FROM tracks LEFT JOIN features USING (pos) GROUP BY cluster_id""")
def timeline_footer(v: Views):
    rows = v.tracks.join(v.features, "pos", "left").groupBy("cluster_id")
    out = rows.agg(F.sum(F.coalesce("duration", F.lit(0.0))).alias("total_duration"), F.avg(F.nullif("bpm", F.lit(0.0))).alias("avg_bpm"), F.avg("rms_energy").alias("avg_energy"))
    return rounded(out, "avg_bpm", "avg_energy")


_STATS = f"""{KNOWN}, stats AS (SELECT cluster_id, round(avg(bpm), 6) AS bpm_mean, round(stddev_pop(bpm), 6) AS bpm_std, round(avg(rms_energy), 6) AS intensity, round(avg({HARD}), 6) AS hard, count(*) AS track_count, sum(coalesce(duration, 0)) AS total FROM known WHERE bpm IS NOT NULL GROUP BY cluster_id),
ranges AS (SELECT *, greatest(1.0::DOUBLE, bpm_mean - bpm_std) AS bpm_min, greatest(greatest(1.0::DOUBLE, bpm_mean - bpm_std) + 1, bpm_mean + bpm_std) AS bpm_max FROM stats)"""


@query(f"""WITH {_STATS} SELECT cluster_id, round(bpm_min, 6) AS bpm_min, round(bpm_max, 6) AS bpm_max, CASE WHEN intensity >= 0.85 THEN 'Very High' WHEN intensity >= 0.66 THEN 'High' WHEN intensity >= 0.33 THEN 'Medium' ELSE 'Low' END AS intensity_label,
 concat(repeat('█', CAST(round_even(hard * 10, 0) AS INT)), repeat('░', 10 - CAST(round_even(hard * 10, 0) AS INT))) AS hardness_bars, concat(CAST(track_count AS VARCHAR), CASE WHEN track_count = 1 THEN ' track' ELSE ' tracks' END) AS track_count_str,
 CASE WHEN total >= 3600 THEN concat(CAST(CAST(total AS BIGINT) // 3600 AS VARCHAR), 'h ', CAST(CAST(total AS BIGINT) % 3600 // 60 AS VARCHAR), 'm') ELSE concat(CAST(CAST(total AS BIGINT) // 60 AS VARCHAR), 'm') END AS duration_str FROM ranges""")
def cluster_stats(v: Views):
    return _stats(v).select("cluster_id", F.round("bpm_min", 6).alias("bpm_min"), F.round("bpm_max", 6).alias("bpm_max"), "intensity_label", "hardness_bars", "track_count_str", "duration_str")


def _stats(v: Views):
    s = v.known.where("bpm IS NOT NULL").groupBy("cluster_id").agg(
        F.round(F.avg("bpm"), 6).alias("bpm_mean"), F.round(F.stddev_pop("bpm"), 6).alias("bpm_std"), F.round(F.avg("rms_energy"), 6).alias("intensity"),
        F.round(F.avg(X.hardness()), 6).alias("hard"), F.count("*").alias("track_count"), F.sum(F.coalesce("duration", F.lit(0.0))).alias("total"),
    )
    low = F.greatest(F.lit(1.0), F.col("bpm_mean") - F.col("bpm_std"))
    secs = F.col("total").cast("bigint")
    hours, minutes = F.floor(secs / 3600).cast("string"), F.floor(secs % 3600 / 60).cast("string")
    return s.withColumns({
        "bpm_min": low, "bpm_max": F.greatest(low + 1, F.col("bpm_mean") + F.col("bpm_std")), "intensity_label": X.intensity_label(F.col("intensity")), "hardness_bars": X.bars(F.col("hard"), 10),
        "track_count_str": F.concat(F.col("track_count").cast("string"), F.when(F.col("track_count") == 1, " track").otherwise(" tracks")),
        "duration_str": F.when(secs >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m"))).otherwise(F.concat(F.floor(secs / 60).cast("string"), F.lit("m"))),
    })


@query(f"WITH {_STATS}, g AS (SELECT min(bpm_min) AS lo, max(bpm_max) AS hi FROM ranges) SELECT cluster_id, round(CASE WHEN hi - lo <= 0 THEN 0 ELSE greatest(0, least(1, (bpm_mean - lo) / (hi - lo))) END, 6) AS fraction FROM ranges, g")
def bpm_range_fraction(v: Views):
    whole = Window.partitionBy()
    lo, hi = F.min("bpm_min").over(whole), F.max("bpm_max").over(whole)
    fraction = F.when(hi - lo <= 0, 0.0).otherwise(X.clip((F.col("bpm_mean") - lo) / (hi - lo)))
    return _stats(v).select("cluster_id", F.round(fraction, 6).alias("fraction"))


@query("SELECT cluster_id, round(CASE WHEN max(e) OVER () > min(e) OVER () THEN (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) ELSE 0 END, 6) AS level FROM (SELECT cluster_id, avg(rms_energy) AS e FROM tracks JOIN features USING (pos) GROUP BY cluster_id)")
def arc_levels(v: Views):
    whole = Window.partitionBy()
    lo, hi = F.min("energy").over(whole), F.max("energy").over(whole)
    return P.cluster_energy(v.known).select("cluster_id", F.round(F.when(hi > lo, (F.col("energy") - lo) / (hi - lo)).otherwise(0.0), 6).alias("level"))


# -- orders


def _order_query(name: str, sql_order: str):
    sql = f"WITH {KNOWN} SELECT cluster_id, pos, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {sql_order}, pos) AS INT) AS seq FROM known"

    def run(v: Views):
        return S.sequence(v.known, name).select("cluster_id", "pos", "seq")

    run.__name__ = "seq_intro" if name == "intro_asc" else f"seq_{name}"
    query(sql)(run)


for _name, _sql in {"ramp": "rms_energy", "build": "energy_gradient DESC", "descent": "rms_energy DESC", "bpm_asc": "coalesce(bpm, 0)", "bpm_desc": "coalesce(bpm, 0) DESC", "intro_asc": "intro_length_secs", "intro_desc": "intro_length_secs DESC"}.items():
    _order_query(_name, _sql)


@query(f"""WITH {KNOWN}, r AS (SELECT cluster_id, pos, row_number() OVER (PARTITION BY cluster_id ORDER BY rms_energy, pos) - 1 AS i, count(*) OVER (PARTITION BY cluster_id) AS n FROM known),
low AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY i) AS k FROM r WHERE i < n // 2), high AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY i DESC) AS k FROM r WHERE i >= n // 2)
SELECT cluster_id, pos, CAST(2 * k - 1 AS INT) AS seq FROM high UNION ALL SELECT cluster_id, pos, CAST(2 * k AS INT) FROM low""")
def seq_alternating(v: Views):
    return S.alternating(v.known).select("cluster_id", "pos", "seq")


_DUR = "coalesce(duration, 0)"
_OPEN = f"round(least(1.0::DOUBLE, 0.4::DOUBLE * (1 - onset_strength) + 0.3::DOUBLE * (1 - percussiveness) + 0.2::DOUBLE * (1 - kick_energy) + 0.1::DOUBLE * (1 - rms_energy) + CASE WHEN {_DUR} >= 300 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END), 4)"
_ENERGETIC = "(0.4::DOUBLE * rms_energy + 0.35::DOUBLE * onset_strength + 0.25::DOUBLE * kick_energy)"
_FADE = f"(0.4::DOUBLE * (1 - onset_strength) + 0.3::DOUBLE * (1 - rms_energy) + CASE WHEN {_DUR} >= 360 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END)"
_CLOSE = f"round(least(1.0::DOUBLE, greatest({_ENERGETIC}, {_FADE})), 4)"
_OPEN_WHY = f"CASE WHEN concat_ws(' + ', CASE WHEN onset_strength < 0.4 THEN 'low onset' END, CASE WHEN rms_energy < 0.4 THEN 'quiet start' END, CASE WHEN kick_energy < 0.4 THEN 'low kick energy' END, CASE WHEN {_DUR} >= 300 THEN 'long track (likely intro)' END) = '' THEN 'moderate opener qualities' ELSE concat_ws(' + ', CASE WHEN onset_strength < 0.4 THEN 'low onset' END, CASE WHEN rms_energy < 0.4 THEN 'quiet start' END, CASE WHEN kick_energy < 0.4 THEN 'low kick energy' END, CASE WHEN {_DUR} >= 300 THEN 'long track (likely intro)' END) END"
_CLOSE_WHY = f"CASE WHEN {_ENERGETIC} >= {_FADE} THEN 'energetic closer' ELSE 'smooth fade-out' END"


def _ranked_sql(score: str, why: str) -> str:
    return f"""SELECT cluster_id, CAST(rank AS INT) AS rank, pos, score, reason FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, pos) AS rank FROM
 (SELECT cluster_id, pos, CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN rms_energy IS NULL THEN -1.0::DOUBLE ELSE {score} END AS score, CASE WHEN n = 1 THEN 'only track in cluster' WHEN rms_energy IS NULL THEN 'missing intensity data' ELSE {why} END AS reason
 FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM tracks LEFT JOIN features USING (pos)))) WHERE rank <= 5"""


@query(_ranked_sql(_OPEN, _OPEN_WHY))
def opener_topn(v: Views):
    return S.ranked(v.tracks, v.features, opener=True)


@query(_ranked_sql(_CLOSE, _CLOSE_WHY))
def closer_topn(v: Views):
    return S.ranked(v.tracks, v.features, opener=False)


@query(f"""WITH {KNOWN}, o AS (SELECT cluster_id, pos, row_number() OVER (PARTITION BY cluster_id ORDER BY {_OPEN} DESC, pos) AS r FROM known), c AS (SELECT cluster_id, pos, row_number() OVER (PARTITION BY cluster_id ORDER BY {_CLOSE} DESC, pos) AS r FROM known),
ends AS (SELECT o.cluster_id, o.pos AS opener, CASE WHEN c1.pos <> o.pos THEN c1.pos ELSE c2.pos END AS closer FROM o JOIN c c1 ON c1.cluster_id = o.cluster_id AND c1.r = 1 LEFT JOIN c c2 ON c2.cluster_id = o.cluster_id AND c2.r = 2 WHERE o.r = 1)
SELECT cluster_id, pos, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN n <= 2 THEN 0 WHEN pos = opener THEN 0 WHEN pos = closer THEN 2 ELSE 1 END, CASE WHEN n <= 2 THEN 0 ELSE {HARD} END, pos) AS INT) AS seq
FROM (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM known) JOIN ends USING (cluster_id)""")
def seq_anchored_ramp(v: Views):
    """The best opener first and the best closer last; where they are one track, the second closer."""
    known = v.known
    tracks = known.select(*v.tracks.columns)
    opener = S.ranked(tracks, v.features, opener=True, top=1)
    closer = S.ranked(tracks, v.features, opener=False, top=2).join(opener.select("cluster_id", F.col("pos").alias("o")), "cluster_id").where("pos <> o")
    closer = closer.groupBy("cluster_id").agg(F.min_by("pos", "rank").alias("pos"))
    return S.anchored(known, opener, closer).select("cluster_id", "pos", "seq")


@query(f"""WITH {KNOWN}, fresh AS (SELECT k.*, CASE WHEN h.times_used IS NULL OR h.last_used IS NULL THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - ln(h.times_used + 1) / ln(31.0::DOUBLE)) * least(1.0::DOUBLE, date_diff('day', h.last_used, DATE '{AS_OF}') / 30.0::DOUBLE) END AS f FROM known k LEFT JOIN history h USING (pos))
SELECT cluster_id, pos, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY round(f * rms_energy, 9) DESC, pos) AS INT) AS seq FROM fresh WHERE f >= 0.1""")
def seq_fresh(v: Views):
    return S.fresh(v.known, v.history, F.lit(AS_OF).cast("date")).select("cluster_id", "pos", "seq")


_PHASE = "CASE WHEN bpm IS NULL OR bpm <= 0 THEN 'lyrical' WHEN bpm > 135 OR rms_energy > 0.75 THEN 'chaos' WHEN bpm < 85 OR rms_energy < 0.25 THEN 'stillness' WHEN bpm < 115 AND rms_energy < 0.5 THEN 'flowing' WHEN bpm >= 115 AND bpm < 135 AND rms_energy >= 0.4 AND rms_energy < 0.7 THEN 'staccato' ELSE 'lyrical' END"


@query(f"""WITH {KNOWN}, p AS (SELECT *, {_PHASE} AS phase FROM known) SELECT cluster_id, pos, phase, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY CASE phase WHEN 'flowing' THEN 0 WHEN 'staccato' THEN 1 WHEN 'chaos' THEN 2 WHEN 'lyrical' THEN 3 ELSE 4 END, rms_energy, pos) AS INT) AS seq FROM p""")
def seq_five_rhythms(v: Views):
    return S.five_rhythms(v.known).select("cluster_id", "pos", "phase", "seq")


@query("SELECT cluster_id, pos, coalesce(sum(coalesce(duration, 0)) OVER (PARTITION BY cluster_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM tracks")
def cumulative_offsets(v: Views):
    return S.offsets(v.tracks).select("cluster_id", "pos", F.col("offset").alias("start"))


@query(f"""WITH {KNOWN}, n AS (SELECT *, lead(pos) OVER (PARTITION BY cluster_id ORDER BY pos) AS nxt FROM known), s AS (SELECT x.cluster_id, x.pos, CASE WHEN x.bpm IS NOT NULL AND y.bpm IS NOT NULL THEN round({compat_of('x', 'y')}, 9) END AS score FROM n x LEFT JOIN known y ON y.pos = x.nxt)
SELECT cluster_id, pos, score, CASE WHEN score IS NULL THEN 'gray' WHEN score >= 0.8 THEN 'green' WHEN score >= 0.5 THEN 'amber' ELSE 'red' END AS color FROM s""")
def transition_scores(v: Views):
    """Mix score with the next track, and its colour."""
    return C.transitions(v.known)


@query(f"""WITH {KNOWN}, p AS (SELECT cluster_id, pos, camelot_key AS a, lag(camelot_key) OVER (PARTITION BY cluster_id ORDER BY pos) AS b FROM known)
SELECT cluster_id, pos, CASE WHEN a IS NULL OR b IS NULL THEN 'gray' WHEN {compatible('a', 'b')} THEN CASE WHEN left(a, length(a) - 1) = left(b, length(b) - 1) AND right(a, 1) <> right(b, 1) THEN 'amber' ELSE 'green' END ELSE 'red' END AS dot FROM p""")
def adjacent_key_dot(v: Views):
    return C.key_dots(v.known)


_ENERGY = f"{KNOWN}, e AS (SELECT cluster_id, avg(rms_energy) AS energy, count(*) AS track_count FROM known GROUP BY cluster_id)"
_CUT = "w AS (SELECT count(*) AS n, greatest(1, CAST(floor(count(*) * 0.2) AS INT)) AS a FROM e), w2 AS (SELECT *, greatest(a + 1, CAST(floor(n * 0.5) AS INT)) AS b FROM w), w3 AS (SELECT *, greatest(b + 1, CAST(floor(n * 0.8) AS INT)) AS c FROM w2), w4 AS (SELECT *, greatest(c + 1, CAST(floor(n * 0.95) AS INT)) AS d FROM w3), blocks AS (SELECT cluster_id, energy, track_count, CASE WHEN n = 1 OR i < a THEN 'warm-up' WHEN i < b THEN 'build' WHEN i < c THEN 'peak' WHEN i < d THEN 'sustain' ELSE 'wind-down' END AS block FROM (SELECT *, row_number() OVER (ORDER BY energy, cluster_id) - 1 AS i FROM e), w4)"


@query(f"WITH {_ENERGY}, {_CUT} SELECT block, CAST(sum(track_count) * 6 AS BIGINT) AS target_duration_min, round(min(energy), 6) AS energy_min, round(max(energy), 6) AS energy_max, count(*) AS n_clusters, string_agg(cluster_id, ',' ORDER BY energy, cluster_id) AS cluster_ids FROM blocks GROUP BY block")
def energy_blocks(v: Views):
    return rounded(P.energy_blocks(P.cluster_energy(v.known)), "energy_min", "energy_max")


@query(f"WITH {_ENERGY}, {_CUT} SELECT round(min(energy), 6) AS energy_min, round(max(energy), 6) AS energy_max FROM blocks")
def block_energy_range(v: Views):
    out = P.energy_blocks(P.cluster_energy(v.known)).agg(F.coalesce(F.min("energy_min"), F.lit(0.0)).alias("energy_min"), F.coalesce(F.max("energy_max"), F.lit(1.0)).alias("energy_max"))
    return rounded(out, "energy_min", "energy_max")


@query(f"WITH {_ENERGY}, {_CUT} SELECT block, round(120.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS target_min FROM blocks GROUP BY block")
def block_durations(v: Views):
    per = P.blocks_of(P.cluster_energy(v.known)).groupBy("block").agg(F.count("*").alias("c"))
    return per.select("block", F.round(120.0 * F.col("c") / F.sum("c").over(Window.partitionBy()), 6).alias("target_min"))


_ARC = " UNION ALL ".join(f"SELECT '{a}' AS arc, {k} AS k, {p}::DOUBLE AS p" for a, ps in P.ARCS.items() for k, p in enumerate(ps))


@query(f"""WITH {_ENERGY}, arcs AS ({_ARC}), best AS (SELECT arc, cluster_id, energy, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY arc, cluster_id ORDER BY abs(p - energy), k) AS r FROM e, arcs) WHERE r = 1)
SELECT arc, cluster_id, CAST(place AS INT) AS place, CAST(row_number() OVER (PARTITION BY arc ORDER BY place, energy, cluster_id) AS INT) AS seq FROM best""")
def arc_apply(v: Views):
    energy = P.cluster_energy(v.known)
    from functools import reduce

    return reduce(lambda a, b: a.union(b), [P.apply_arc(energy, a).select(F.lit(a).alias("arc"), "cluster_id", "place", "seq") for a in P.ARCS])


_CD = "sqrt(" + " + ".join(f"({c} - c_{c}) ** 2" for c in X.FEATURES) + ")"


@query(f"""WITH {_ENERGY}, {_CUT}, share AS (SELECT block, 120.0::DOUBLE * 60 * (count(*) / sum(count(*)) OVER ()) AS target FROM blocks GROUP BY block), rws AS (SELECT k.*, b.block FROM known k JOIN blocks b USING (cluster_id) WHERE k.bpm IS NOT NULL), centre AS (SELECT block, {_AVG} FROM rws GROUP BY block),
d AS (SELECT block, pos, coalesce(duration, 0) AS dur, target, round({_CD}, 9) AS distance FROM rws JOIN centre USING (block) JOIN share USING (block)),
f AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY distance, pos) AS seq, coalesce(sum(dur) OVER (PARTITION BY block ORDER BY distance, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d)
SELECT block, CAST(seq AS INT) AS seq, pos, distance FROM f WHERE before < target OR seq = 1""")
def chapter_fill(v: Views):
    return P.chapters(v.known)


@query(f"""WITH {KNOWN} SELECT pos, cluster_id, {cue_sql("coalesce(sum(coalesce(duration, 0)) OVER (PARTITION BY cluster_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")} AS index_time FROM tracks""")
def cue_index_times(v: Views):
    return S.offsets(v.tracks).select("pos", "cluster_id", X.cue_time(F.col("offset")).alias("index_time"))


_ORDER = "CASE block " + " ".join(f"WHEN '{name}' THEN {k}" for k, (name, _, _) in enumerate(P.BLOCKS)) + " END"


@query(f"WITH {_ENERGY}, {_CUT}, spans AS (SELECT {_ORDER} AS o, round(min(energy), 6) AS lo, round(max(energy), 6) AS hi FROM blocks GROUP BY block) SELECT f.pos, CAST(min(s.o) AS BIGINT) AS block_no FROM features f LEFT JOIN spans s ON f.rms_energy BETWEEN s.lo AND s.hi GROUP BY f.pos")
def block_range_join(v: Views):
    """The first block whose range of energy holds each track's."""
    blocks = rounded(P.energy_blocks(P.cluster_energy(v.known)), "energy_min", "energy_max")
    numbers = F.create_map(*[x for k, (name, _, _) in enumerate(P.BLOCKS) for x in (F.lit(name), F.lit(k).cast("long"))])
    return ranges.first_range(v.features.select("pos", "rms_energy"), "rms_energy", blocks.withColumn("o", numbers[F.col("block")]), "energy_min", "energy_max", "o", "block_no").drop("rms_energy")


@query("SELECT t.pos, min(l.id) AS first_id FROM tracks t LEFT JOIN library l ON t.bpm BETWEEN l.bpm AND l.bpm + CAST(l.id % 5 AS DOUBLE) / 10 GROUP BY t.pos")
def tempo_range_join(v: Views):
    """The first library row whose range of tempi, which overlap as they like, holds each track's."""
    spans = v.library.select("id", "bpm", (F.col("bpm") + (F.col("id") % 5).cast("double") / 10).alias("upto"))
    return ranges.first_range(v.tracks.select("pos", "bpm"), "bpm", spans, "bpm", "upto", "id", "first_id").drop("bpm")


@query(f"WITH {KNOWN}, c AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1 AS place FROM known), spans AS (SELECT CAST(p_partkey AS BIGINT) AS chapter, CAST(p_partkey % 40 AS DOUBLE) AS lo, CAST(p_partkey % 40 + p_partkey % 7 AS DOUBLE) AS hi FROM part WHERE p_partkey <= 100) SELECT c.pos, min(s.chapter) AS chapter FROM c LEFT JOIN spans s ON c.place BETWEEN s.lo AND s.hi GROUP BY c.pos")
def chapter_index_ranges(v: Views):
    """The first chapter whose range of places, ends included, holds a track's place in its playlist."""
    places = v.known.select("pos", (F.row_number().over(Window.partitionBy("cluster_id").orderBy("pos")) - 1).cast("double").alias("place"))
    p = F.col("p_partkey").cast("long")
    spans = v.table("part").where("p_partkey <= 100").select(p.alias("chapter"), (p % 40).cast("double").alias("lo"), (p % 40 + p % 7).cast("double").alias("hi"))
    return ranges.first_range(places, "place", spans, "lo", "hi", "chapter", "chapter").drop("place")


_WISHES = {"intro": "intro_length_secs DESC", "strategy": "rms_energy DESC", "unknown": "pos"}


@query(f"WITH {KNOWN} " + " UNION ALL ".join(f"SELECT '{w}' AS wish, cluster_id, pos, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {o}, pos) AS INT) AS seq FROM known" for w, o in _WISHES.items()))
def playlist_order(v: Views):
    """What comes of several wishes: intros go before a strategy, and a strategy that isn't known changes nothing."""
    wishes = {"intro": {"intro": "long", "strategy": "ramp"}, "strategy": {"strategy": "descent"}, "unknown": {"strategy": "by moon"}}
    parts = [sequential.arranged(v.known, **options).select(F.lit(w).alias("wish"), "cluster_id", "pos", "seq") for w, options in wishes.items()]
    return parts[0].union(parts[1]).union(parts[2])
