"""Clustering steps and whole clusterings as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.ml import clustering as M
from segue.operators import selecting
from segue.sources.fixtures import Views

from .base import Catalogue
from .table_plans import KNOWN

CATALOGUE = Catalogue()
query = CATALOGUE.add

GOOD = f"{KNOWN}, good AS (SELECT * FROM known WHERE bpm IS NOT NULL)"
_Z = ", ".join(f"round((g.{c} - s.m_{c}) / CASE WHEN s.s_{c} > 0 THEN s.s_{c} ELSE 1 END, 6) AS z_{c}" for c in M.SPACE)
_S = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in M.SPACE)


def _zs(v: Views):
    return M.zscore(v.known.where("bpm IS NOT NULL").select("pos", "cluster_id", "genre", *M.SPACE))


@query(f"WITH {GOOD}, s AS (SELECT {_S} FROM good) SELECT pos, {_Z} FROM good g, s")
def zscore_features(v: Views):
    return _zs(v).select("pos", *[F.round(F.get("z", F.lit(j)), 6).alias(f"z_{c}") for j, c in enumerate(M.SPACE)])


@query(f"""WITH {GOOD}, s AS (SELECT avg(bpm) AS m, stddev_pop(bpm) AS d FROM good)
SELECT pos, round((bpm - m) / d * (120.0::DOUBLE / CASE lower(trim(genre)) WHEN 'techno' THEN 125 WHEN 'house' THEN 120 WHEN 'ambient' THEN 100 WHEN 'dnb' THEN 170 ELSE 120 END), 6) AS z_bpm FROM good, s""")
def mixed_genre_scale(v: Views):
    rows = _zs(v).withColumn("resolved", F.lower(F.trim("genre")))
    return rows.join(M.genre_scale(rows), "pos").select("pos", F.round(F.get("z", F.lit(0)) * F.col("factor"), 6).alias("z_bpm"))


_DISP = ", ".join(f"avg((k.{c} - c.c_{c}) ** 2) AS d_{c}" for c in X.FEATURES)
_CENTRE = "cent AS (SELECT cluster_id, " + ", ".join(f"avg({c}) AS c_{c}" for c in X.FEATURES) + " FROM known GROUP BY cluster_id)"
_MAX = "greatest(" + ", ".join(f"-d_{c}" for c in X.FEATURES) + ")"
_SOFT = ", ".join(f"round(exp(-d_{c} - top) / (" + " + ".join(f"exp(-d_{x} - top)" for x in X.FEATURES) + f"), 6) AS w_{c}" for c in X.FEATURES)


@query(f"WITH {KNOWN}, {_CENTRE}, disp AS (SELECT k.cluster_id, {_DISP} FROM known k JOIN cent c USING (cluster_id) GROUP BY k.cluster_id), t AS (SELECT *, {_MAX} AS top FROM disp) SELECT cluster_id, {_SOFT} FROM t")
def ewkm_weight_step(v: Views):
    """One weight update: softmax of the negative spread of each feature inside a cluster."""
    spread = v.known.groupBy("cluster_id").agg(*[F.var_pop(c).alias(f"d_{c}") for c in X.FEATURES])
    top = F.greatest(*[-F.col(f"d_{c}") for c in X.FEATURES])
    soft = {c: F.exp(-F.col(f"d_{c}") - top) for c in X.FEATURES}
    whole = sum(soft.values(), F.lit(0.0))
    return spread.select("cluster_id", *[F.round(s / whole, 6).alias(f"w_{c}") for c, s in soft.items()])


_WEIGHTS = (0.3, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1)
_WD = "round(" + " + ".join(f"{w}::DOUBLE * (f.{c} - c.c_{c}) ** 2" for w, c in zip(_WEIGHTS, X.FEATURES, strict=True)) + ", 9)"


@query(f"WITH {KNOWN}, {_CENTRE} SELECT pos, cluster_id FROM (SELECT f.pos, c.cluster_id, row_number() OVER (PARTITION BY f.pos ORDER BY {_WD}, c.cluster_id) AS r FROM features f, cent c) WHERE r = 1")
def ewkm_assign_step(v: Views):
    """One assignment by weighted squared distance."""
    centre = v.known.groupBy("cluster_id").agg(*[F.avg(c).alias(f"c_{c}") for c in X.FEATURES])
    packed = centre.agg(F.collect_list(F.struct("cluster_id", *[f"c_{c}" for c in X.FEATURES])).alias("all"))
    gap = lambda x: sum((F.lit(w) * (F.col(c) - x[f"c_{c}"]) ** 2 for w, c in zip(_WEIGHTS, X.FEATURES, strict=True)), F.lit(0.0))
    best = F.array_min(F.transform("all", lambda x: F.struct(F.round(gap(x), 9).alias("d"), x["cluster_id"].alias("c"))))
    return v.features.crossJoin(F.broadcast(packed)).select("pos", best["c"].alias("cluster_id"))


_PD = "round(sqrt(" + " + ".join(f"(k.{c} - c.c_{c}) ** 2" for c in X.FEATURES) + "), 9)"


@query(f"WITH {KNOWN}, {_CENTRE}, near AS (SELECT pos, cluster_id FROM (SELECT k.pos, c.cluster_id, row_number() OVER (PARTITION BY k.pos ORDER BY {_PD}, c.cluster_id) AS r FROM known k, cent c) WHERE r = 1) SELECT k.cluster_id, k.pos FROM known k JOIN near USING (pos, cluster_id)")
def cluster_dedup(v: Views):
    """Tracks that are nearest to their own cluster's centroid."""
    from segue.operators.playlists import nearest

    centroids = v.known.groupBy("cluster_id").agg(*[F.avg(c).alias(c) for c in X.FEATURES])
    near = nearest(v.features, centroids).select("pos", F.col("cluster_id").alias("home"))
    return v.known.join(near, "pos").where("home = cluster_id").select("cluster_id", "pos")


@query(f"WITH {KNOWN}, sliders AS (SELECT cluster_id, round(avg(brightness), 6) AS slider FROM known GROUP BY cluster_id) SELECT cluster_id, feature, CASE WHEN feature = 'brightness' AND slider > 0 THEN 1.0 + 2.0 * slider ELSE 0.125::DOUBLE END AS weight FROM sliders, (SELECT unnest(['bpm', 'rms_energy', 'brightness', 'sub_bass_energy', 'kick_energy', 'bass_harmonics', 'percussiveness', 'onset_strength']) AS feature)")
def timbre_weights(v: Views):
    """Equal weights under a timbre slider that stands where each cluster's mean brightness does."""
    sliders = v.known.groupBy("cluster_id").agg(F.round(F.avg("brightness"), 6).alias("slider"))
    return M.slider_weights(sliders, F.col("slider")).select("cluster_id", "feature", "weight")


# -- clusterings whose right answer is planted: three blobs of tracks, told by the position


def _planted(v: Views):
    """Known tracks whose tempo and features stand in three blobs far apart."""
    blob, p = F.col("pos") % 3, F.col("pos")
    at = {c: F.element_at(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8)), (F.pmod(blob + j, F.lit(3)) + 1).cast("int")) + (p * (7 + j) % 13) / 200 for j, c in enumerate(X.FEATURES)}
    tempo = F.when(F.col("bpm").isNotNull(), 90 + blob * 40 + (p * 37 % 11) / 10)
    return v.known.withColumns({**at, "bpm": tempo, "resolved": F.when(p % 2 == 0, "techno").otherwise("house")})


def _led(labelled):
    """(pos, leader): the least position of each track's cluster, as labels have no order."""
    return labelled.select("pos", F.min("pos").over(Window.partitionBy("cluster_id")).alias("leader"))


_LED = f"WITH {KNOWN} SELECT pos, min(pos) OVER (PARTITION BY pos % 3) AS leader FROM known WHERE bpm IS NOT NULL"


@query(_LED)
def kmeans_planted(v: Views):
    """k-means with chosen weights and refinement; what is relabelled would be missing."""
    return _led(M.cluster(_planted(v), k=3, restarts=3).labelled)


@query(_LED)
def auto_k_planted(v: Views):
    """The number of clusters found too."""
    return _led(M.cluster(_planted(v), most=6, restarts=3).labelled)


@query(_LED)
def mixed_genre_planted(v: Views):
    known = _planted(v)
    return _led(M.cluster(known, k=3, restarts=3, bpm_scale=M.genre_scale(known)).labelled)


@query(f"WITH {KNOWN} SELECT pos, min(pos) OVER (PARTITION BY pos % 2, pos % 3) AS leader FROM known WHERE bpm IS NOT NULL")
def per_genre_planted(v: Views):
    return _led(M.per_genre(_planted(v), k=3, restarts=3))


@query(_LED)
def block_pca_planted(v: Views):
    """Embeddings in the same blobs: a place of one of three axes."""
    known = _planted(v)
    near = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda j: F.when(j == F.col("pos") % 3, 5.0).otherwise((F.col("pos") * (j + 3) % 17) / 100))
    return _led(M.cluster(known, k=3, restarts=3, extra=M.embedding_block(known.select("pos", near.alias("embedding")), 2)).labelled)


@query("SELECT pos, min(pos) OVER (PARTITION BY pos % 3) AS leader FROM tracks WHERE bpm IS NOT NULL")
def bpm_kmeans_planted(v: Views):
    tempo = 90 + F.col("pos") % 3 * 40 + (F.col("pos") * 37 % 11) / 10
    rows = M.zscore(v.tracks.where("bpm IS NOT NULL").select("pos", tempo.alias("bpm")), ("bpm",)).withColumn("x", F.col("z"))
    return _led(M.assign(rows, M.fit(rows, [3], restarts=3)[3].centers).withColumn("cluster_id", F.col("label").cast("string")))


@query("SELECT pos, min(pos) OVER (PARTITION BY pos % 3) AS leader FROM tracks WHERE bpm IS NOT NULL")
def bpm_kmeans_repeated(v: Views):
    """Three tempi, each of a third of all tracks: seeds see rows, not values that happen to come first."""
    tempo = (F.col("pos") % 3 * 10 + 118).cast("double")
    rows = M.zscore(v.tracks.where("bpm IS NOT NULL").select("pos", tempo.alias("bpm")), ("bpm",)).withColumn("x", F.col("z"))
    return _led(M.assign(rows, M.fit(rows, [3], restarts=3)[3].centers).withColumn("cluster_id", F.col("label").cast("string")))


def _one_feature(v: Views, useful: str):
    """Tracks that one feature alone parts, among noise of the others."""
    p = F.col("pos")
    noise = {c: F.pmod(F.xxhash64(p, F.lit(j)), F.lit(1000)) / 1000.0 for j, c in enumerate(X.FEATURES)}
    tempo = F.when(F.col("bpm").isNotNull(), 120 + F.pmod(F.xxhash64(p, F.lit(99)), F.lit(100)) / 100.0)
    return v.known.withColumns({**noise, useful: p % 2 * 0.8 + F.pmod(F.xxhash64(p, F.lit(7)), F.lit(100)) / 1000.0, "bpm": tempo})


@query(f"WITH {KNOWN} SELECT pos, min(pos) OVER (PARTITION BY pos % 2) AS leader FROM known WHERE bpm IS NOT NULL")
def weights_decide_planted(v: Views):
    """Weights that stand on the one useful feature part the tracks by it; equal ones would follow the noise."""
    light = {c: 0.001 for c in M.SPACE}
    return _led(M.cluster(_one_feature(v, "kick_energy"), k=2, restarts=3, overrides={**light, "kick_energy": 5.0}, use_ewkm=False).labelled)


@query(f"WITH {KNOWN} SELECT pos, min(pos) OVER (PARTITION BY pos % 2) AS leader FROM known WHERE bpm IS NOT NULL")
def ewkm_relabels_planted(v: Views):
    """Refinement from labels that are a third wrong: weights move to the useful feature, and the labels with them."""
    rows = M.zscore(_one_feature(v, "brightness").where("bpm IS NOT NULL").select("pos", *M.SPACE))
    given = rows.withColumn("g", F.when(F.col("pos") % 3 == 0, 1 - F.col("pos") % 2).otherwise(F.col("pos") % 2))
    first = given.groupBy("g").agg(*[F.avg(F.get("z", F.lit(j))).alias(f"m{j}") for j in range(len(M.SPACE))]).orderBy("g").collect()
    centers, used, _ = M.ewkm(rows, M.np.array([[r[f"m{j}"] for j in range(len(M.SPACE))] for r in first]))
    return _led(M.assign(rows, centers, "z", used).withColumn("cluster_id", F.col("label").cast("string")))


_MOODS = "moods AS (SELECT pos, tag AS label, CAST(pos * 7 % 10 + 1 AS DOUBLE) / 10 AS prob FROM tags)"


@query(f"""WITH {_MOODS}, n AS (SELECT count(*) AS n FROM tracks), s AS (SELECT label, sum(prob) / any_value(n) AS m, sqrt(sum(prob * prob) / any_value(n) - (sum(prob) / any_value(n)) ** 2) AS d FROM moods, n GROUP BY label)
SELECT t.pos, s.label, round((coalesce(o.prob, 0) - s.m) / s.d, 6) AS z FROM tracks t CROSS JOIN s LEFT JOIN moods o ON o.pos = t.pos AND o.label = s.label""")
def mood_block(v: Views):
    """Scaled probabilities of every tag for every track."""
    moods = v.tags.select("pos", F.col("tag").alias("label"), ((F.col("pos") * 7 % 10 + 1).cast("double") / 10).alias("prob"))
    names = v.tags.agg(F.array_sort(F.collect_set("tag")).alias("names"))
    rows = M.mood_block(moods, v.tracks.select("pos")).crossJoin(F.broadcast(names))
    return rows.select("pos", F.inline(F.arrays_zip(F.col("names").alias("label"), F.col("block").alias("z")))).select("pos", "label", F.round("z", 6).alias("z"))


@query(_LED)
def moods_planted(v: Views):
    """Sound that says nothing and moods that tell: three kinds of tracks by their moods alone."""
    known = v.known.withColumns({c: F.pmod(F.xxhash64("pos", F.lit(j)), F.lit(1000)) / 1000.0 for j, c in enumerate(X.FEATURES)})
    known = known.withColumn("bpm", F.when(F.col("bpm").isNotNull(), 120 + F.pmod(F.xxhash64("pos"), F.lit(9)) / 10.0))
    mood = F.element_at(F.array(*[F.array(*map(F.lit, m)) for m in (("dark", "raw", "slow", "cold", "dry"), ("warm", "soft", "light", "sweet", "calm"), ("wild", "loud", "fast", "hot", "hard"))]), (F.col("pos") % 3 + 1).cast("int"))
    moods = known.select("pos", F.explode(mood).alias("label")).withColumn("prob", 0.9 - F.col("pos") % 5 / 100)
    return _led(M.cluster(known, k=3, restarts=5, extra=M.mood_block(moods, known.select("pos"))).labelled)


@query()
def pca_weights(v: Views):
    weights, width = M.pca_weights(_zs(v))
    return v.spark.createDataFrame([(c, float(w), float(width)) for c, w in zip(M.SPACE, weights, strict=True)], "feature string, weight double, ci_width double")


@query()
def kmeans_features(v: Views):
    return M.cluster(v.known, k=5, restarts=3).labelled.select("pos", "cluster_id")


@query()
def bpm_kmeans(v: Views):
    """Clusters by tempo alone."""
    rows = M.zscore(v.tracks.where("bpm IS NOT NULL").select("pos", "bpm"), ("bpm",)).withColumn("x", F.col("z"))
    model = M.fit(rows, [4], restarts=3)[4]
    return M.assign(rows, model.centers).select("pos", F.col("label").cast("string").alias("cluster_id"))


@query()
def auto_k(v: Views):
    rows = M.weighted(_zs(v), M.np.full(len(M.SPACE), 1 / len(M.SPACE))).persist()
    k, models = M.choose_k(rows, rows.count(), most=6, restarts=2)
    return v.spark.createDataFrame([(c, m.inertia, c == k) for c, m in models.items()], "k int, inertia double, chosen boolean")


@query()
def block_pca(v: Views):
    return M.cluster(v.known, k=4, restarts=2, extra=M.embedding_block(v.chroma)).labelled.select("pos", "cluster_id")


@query()
def per_genre(v: Views):
    genre = F.lower(F.trim("genre"))
    known = v.known.withColumn("resolved", F.when(genre.isin(*X.KNOWN_GENRES), genre).otherwise("unknown"))
    return M.per_genre(known, k=3, restarts=2)


@query()
def mixed_genre(v: Views):
    known = v.known.withColumn("resolved", F.coalesce(F.lower(F.trim("genre")), F.lit("unknown")))
    return M.cluster(known, k=4, restarts=2, bpm_scale=M.genre_scale(known)).labelled.select("pos", "cluster_id")


@query("SELECT cluster_id, n, dur, CASE WHEN n > 25 OR dur > 25 * 60 THEN greatest(1, CAST(trunc(25 * 60 / (dur / n)) AS INT)) END AS split_size FROM (SELECT cluster_id, count(*) AS n, sum(coalesce(duration, 0)) AS dur FROM tracks GROUP BY cluster_id)")
def split_rule(v: Views):
    """The part size of clusters that are over 25 tracks or 25 minutes."""
    return selecting.split_sizes(v.tracks)
