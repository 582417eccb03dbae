"""Frame series, embeddings and sequential operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.operators import naming, playlists, sequential, signal
from segue.sources.fixtures import Views

from .base import Catalogue
from .scalar_plans import compat_of, score_of
from .table_plans import KNOWN

CATALOGUE = Catalogue()
query = CATALOGUE.add


@query("""WITH lim AS (SELECT pos, max(rms) AS hi, min(rms) AS lo, regr_slope(rms, idx) AS slope, avg(rms) AS m, stddev_pop(rms) AS s, count(*) AS n FROM frames GROUP BY pos), d AS (SELECT f.pos, count(*) FILTER (f.rms > m + 2 * s) AS drops FROM frames f JOIN lim USING (pos) GROUP BY f.pos)
SELECT pos, round(least(greatest((hi - lo) / (0.3::DOUBLE + 1e-9), 0), 1), 6) AS dynamic_range, round(CASE WHEN n > 1 THEN least(greatest(coalesce(slope, 0), -0.001), 0.001) / 0.001::DOUBLE ELSE 0 END, 6) AS energy_gradient, round(least(drops / (n * 512 / (22050 * 60.0::DOUBLE)) / 10, 1), 6) AS drop_density FROM lim JOIN d USING (pos)""")
def energy_flow(v: Views):
    out = signal.energy_flow(v.frames)
    return out.select("pos", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("WITH m AS (SELECT pos, avg(rms) AS m FROM frames GROUP BY pos) SELECT f.pos, round(coalesce(min(idx) FILTER (rms > 0.5 * m), 0) * 512 / 22050.0::DOUBLE, 9) AS intro_length FROM frames f JOIN m USING (pos) GROUP BY f.pos")
def intro_length(v: Views):
    return signal.intro_length(v.frames).select("pos", F.round("intro_length", 9).alias("intro_length"))


@query("WITH m AS (SELECT pos, max(rms) AS m FROM frames GROUP BY pos) SELECT f.pos, round(coalesce(min(idx) FILTER (rms > 0.2::DOUBLE * m), 0) * (512000.0::DOUBLE / 22050), 6) AS intro_end_ms, round(coalesce(max(idx) FILTER (rms > 0.2::DOUBLE * m), max(idx)) * (512000.0::DOUBLE / 22050), 6) AS outro_start_ms FROM frames f JOIN m USING (pos) GROUP BY f.pos")
def structure_bounds(v: Views):
    return signal.structure(v.frames).select("pos", F.round("intro_end_ms", 6).alias("intro_end_ms"), F.round("outro_start_ms", 6).alias("outro_start_ms"))


@query("WITH m AS (SELECT pos, max(rms) AS m FROM frames GROUP BY pos) SELECT f.pos, round(coalesce(min(idx) FILTER (rms > 0.2::DOUBLE * m), 0) * (512000.0::DOUBLE / 22050), 6) AS cue_1_ms, round(coalesce(max(idx) FILTER (rms > 0.2::DOUBLE * m), max(idx)) * (512000.0::DOUBLE / 22050), 6) AS cue_2_ms, 0 AS n_breakdowns FROM frames f JOIN m USING (pos) GROUP BY f.pos")
def structure_cues(v: Views):
    out = signal.structure(v.frames)
    return out.select("pos", *[F.round(F.col("cues")[c], 6).alias(c) for c in ("cue_1_ms", "cue_2_ms")], F.size("breakdowns").alias("n_breakdowns"))


@query("SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY conf DESC, k) AS INT) AS rank, CAST(k AS VARCHAR) AS tag, conf FROM (SELECT pos, CAST(unnest(embedding) AS DOUBLE) AS conf, generate_subscripts(embedding, 1) - 1 AS k FROM chroma)")
def top_tags(v: Views):
    """Activations by size, under numbers, as no labels match them."""
    tags = v.chroma.select("pos", F.posexplode(signal.labelled(F.col("embedding"), ["techno", "house"])).alias("k", "t"))
    return tags.select("pos", (F.col("k") + 1).cast("int").alias("rank"), "t.tag", "t.conf")


@query("WITH a AS (SELECT pos, unnest([rms_energy, brightness, onset_strength]) AS prob, unnest(['calm', 'dark', 'warm']) AS mood, generate_subscripts([1, 2, 3], 1) AS k FROM features) SELECT pos, CAST(row_number() OVER (PARTITION BY pos ORDER BY prob DESC, k) AS INT) AS rank, mood, prob FROM a")
def moods_build(v: Views):
    moods = v.features.select("pos", F.posexplode(signal.labelled(F.array("rms_energy", "brightness", "onset_strength"), ["calm", "dark", "warm"])).alias("k", "t"))
    return moods.select("pos", (F.col("k") + 1).cast("int").alias("rank"), F.col("t.tag").alias("mood"), F.col("t.conf").alias("prob"))


@query("WITH c AS (SELECT *, 1000.0::DOUBLE + (idx * 37 % 50) * 100 AS centroid FROM frames), g AS (SELECT pos, quantile_cont(rms, 0.25) AS gate, avg(centroid) AS plain FROM c GROUP BY pos) SELECT c.pos, round(least(greatest(coalesce(sum(centroid * rms) FILTER (rms > gate) / sum(rms) FILTER (rms > gate), any_value(plain)) / 11025.0::DOUBLE, 0), 1), 6) AS brightness FROM c JOIN g USING (pos) GROUP BY c.pos")
def brightness_weighted(v: Views):
    frames = v.frames.withColumn("centroid", 1000.0 + (F.col("idx") * 37 % 50) * 100)
    return signal.brightness(frames).select("pos", F.round("brightness", 6).alias("brightness"))


_C12 = "list_transform(embedding[1:12], lambda x: abs(CAST(x AS DOUBLE)))"
_CAMELOT = repr(list(X.CHROMA_CAMELOT))


@query(f"WITH c AS (SELECT pos, {_C12} AS c FROM chroma), s AS (SELECT *, list_sum(c) / 12 AS m, list_max(c) AS top FROM c) SELECT pos, CASE WHEN sqrt(list_sum(list_transform(c, lambda x: (x - m) * (x - m))) / 12) >= 0.015 AND top >= m * 1.5 THEN {_CAMELOT}[list_position(c, top)] END AS camelot_key FROM s")
def key_detect(v: Views):
    chroma = F.transform(F.slice("embedding", 1, 12), lambda x: F.abs(x.cast("double")))
    return v.chroma.select("pos", signal.key_of(chroma).alias("camelot_key"))


@query("SELECT label, list(round(m, 6) ORDER BY i) AS mean FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label")
def embedding_meanpool(v: Views):
    rows = v.table("embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return signal.mean_pool(rows, "label").select("label", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))


_TAGS = ["techno", "rock", "Deep House", "jungle", "ambient", "pop"]


@query(f"""WITH t AS (SELECT pos, {_TAGS!r}[CAST((pos + k * 5) % 6 AS INT) + 1] AS tag, ((pos * 7 + k * 31) % 101) / 101.0::DOUBLE AS conf, k FROM features, (VALUES (0), (1), (2)) v(k)),
g AS (SELECT pos, conf, k, CASE lower(tag) WHEN 'techno' THEN 'techno' WHEN 'deep house' THEN 'house' WHEN 'jungle' THEN 'dnb' WHEN 'ambient' THEN 'ambient' END AS genre FROM t)
SELECT f.pos, b.genre FROM features f LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY conf DESC, k) AS r FROM g WHERE genre IS NOT NULL) b ON b.pos = f.pos AND b.r = 1""")
def infer_genre(v: Views):
    p = F.col("pos")
    tag = lambda k: F.struct(F.element_at(F.array(*map(F.lit, _TAGS)), ((p + k * 5) % 6).cast("int") + 1).alias("tag"), (((p * 7 + k * 31) % 101) / 101.0).alias("conf"))
    return v.features.select("pos", signal.infer_genre(F.array(*[tag(k) for k in range(3)])).alias("genre"))


def recursive(sql: str):
    """Records a query whose text is recursive."""

    def put(f):
        query(sql)(f)
        CATALOGUE.oracle[f.__name__] = "WITH RECURSIVE" + CATALOGUE.oracle[f.__name__].removeprefix("WITH")
        return f

    return put


@recursive("""WITH steps AS (SELECT *, lag(rms) OVER (PARTITION BY pos ORDER BY idx) AS before FROM frames), flat AS (SELECT *, count(*) FILTER (before IS NULL OR before <> rms) OVER (PARTITION BY pos ORDER BY idx) AS run FROM steps),
runs AS (SELECT pos, run, min(idx) AS lo, max(idx) AS hi, any_value(rms) AS rms FROM flat GROUP BY pos, run), sided AS (SELECT *, lag(rms) OVER w AS l, lead(rms) OVER w AS r FROM runs WINDOW w AS (PARTITION BY pos ORDER BY run)),
high AS (SELECT pos, quantile_cont(rms, 0.75) AS height FROM frames GROUP BY pos), tops AS (SELECT pos, (lo + hi) // 2 AS p, row_number() OVER (PARTITION BY pos ORDER BY rms DESC, lo DESC) AS i FROM sided JOIN high USING (pos) WHERE l < rms AND r < rms AND rms >= height),
kept AS (SELECT pos, i, [p] AS ps FROM tops WHERE i = 1 UNION ALL SELECT t.pos, t.i, CASE WHEN len(list_filter(k.ps, lambda q: abs(q - t.p) < 5)) = 0 THEN list_append(k.ps, t.p) ELSE k.ps END FROM kept k JOIN tops t ON t.pos = k.pos AND t.i = k.i + 1)
SELECT pos, round(unnest(ps) * (512000.0::DOUBLE / 22050), 6) AS drop_ms FROM (SELECT pos, arg_max(ps, i) AS ps FROM kept GROUP BY pos)""")
def drops_peaks(v: Views):
    return signal.drops(v.frames, distance=5).select("pos", F.round("drop_ms", 6).alias("drop_ms"))


_WALK = """WITH RECURSIVE {known}, walk AS (SELECT cluster_id, pos, {cols}, [pos] AS used, 1 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY {start}, pos) AS r0 FROM pool) WHERE r0 = 1
UNION ALL SELECT cluster_id, pos, {cols}, used, seq FROM (SELECT k.cluster_id, k.pos, {kcols}, list_append(w.used, k.pos) AS used, w.seq + 1 AS seq, row_number() OVER (PARTITION BY w.cluster_id ORDER BY {step}, k.pos) AS r FROM walk w JOIN pool k ON k.cluster_id = w.cluster_id AND NOT list_contains(w.used, k.pos){more}) WHERE r = 1)
SELECT cluster_id, pos, CAST(seq AS INT) AS seq FROM walk"""


def _walk_sql(cols: str, start: str, step: str, pool: str = "SELECT * FROM known", more: str = "") -> str:
    kcols = ", ".join(f"k.{c.strip()}" for c in cols.split(","))
    text = _WALK.format(known=f"{KNOWN}, pool AS ({pool})", cols=cols, kcols=kcols, start=start, step=step, more=more)
    return text.replace("WITH RECURSIVE ", "WITH ", 1)


@recursive(_walk_sql("camelot_key, rms_energy", "rms_energy DESC", f"{score_of('w.camelot_key', 'k.camelot_key')} DESC, abs(w.rms_energy - k.rms_energy)"))
def seq_harmonic(v: Views):
    return sequential.harmonic(v.known)


_GAP = "round(sqrt(" + " + ".join(f"(w.{c} - k.{c}) ** 2" for c in X.TIMBRE) + "), 12)"


@recursive(_walk_sql(", ".join(X.TIMBRE), "mfcc_variance DESC", _GAP))
def seq_timbre(v: Views):
    return sequential.timbre(v.known)


@recursive(_walk_sql("bpm, camelot_key, rms_energy, brightness", "pos", f"round({compat_of('w', 'k')}, 9) DESC", "SELECT * FROM known WHERE bpm > 0", " AND w.seq < 20"))
def autofill(v: Views):
    return sequential.autofill(v.known)


_DIST = "round(sqrt(" + " + ".join(f"(k.{c} - c.c_{c}) ** 2" for c in X.FEATURES) + "), 9)"
_CENTRE = "cent AS (SELECT cluster_id, " + ", ".join(f"avg({c}) AS c_{c}" for c in X.FEATURES) + " FROM known GROUP BY cluster_id)"


def _with_distance(v: Views):
    centroids = v.known.groupBy("cluster_id").agg(*[F.avg(c).alias(f"c_{c}") for c in X.FEATURES])
    rows = v.known.join(centroids, "cluster_id")
    gap = F.sqrt(sum(((F.col(c) - F.col(f"c_{c}")) ** 2 for c in X.FEATURES), F.lit(0.0)))
    return rows.select("cluster_id", "pos", "duration", F.round(gap, 9).alias("distance")), centroids


_PHASE1 = f"""{KNOWN}, {_CENTRE}, d AS (SELECT k.cluster_id, k.pos, coalesce(k.duration, 0) AS d, row_number() OVER (PARTITION BY k.cluster_id ORDER BY {_DIST}, k.pos) AS i FROM known k JOIN cent c USING (cluster_id)),
f AS (SELECT cluster_id, pos, i, d > 0 AND d <= 1980 AS taken, CASE WHEN d > 0 AND d <= 1980 THEN d ELSE 0 END AS total FROM d WHERE i = 1 UNION ALL SELECT d.cluster_id, d.pos, d.i, d.d > 0 AND f.total + d.d <= 1980, CASE WHEN d.d > 0 AND f.total + d.d <= 1980 THEN f.total + d.d ELSE f.total END FROM f JOIN d ON d.cluster_id = f.cluster_id AND d.i = f.i + 1)"""


@recursive(f"""WITH {_PHASE1}
SELECT cluster_id, pos, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY i) AS INT) AS seq FROM f WHERE taken""")
def duration_fill_phase1(v: Views):
    return sequential.fill(_with_distance(v)[0], 30 * 60 * 1.1)


_OFFER = "round(sqrt(" + " + ".join(f"(x.{c} - c.c_{c}) ** 2" for c in X.FEATURES) + "), 9)"


@recursive(f"""WITH {_PHASE1}, used AS (SELECT list(coalesce(u, 0) ORDER BY cluster_id) AS u FROM (SELECT DISTINCT cluster_id FROM known) LEFT JOIN (SELECT cluster_id, max(total) AS u FROM f GROUP BY cluster_id) USING (cluster_id)),
homes AS (SELECT list(cluster_id ORDER BY cluster_id) AS names FROM cent), rest AS (SELECT k.pos, k.duration AS d, row_number() OVER (ORDER BY k.pos) AS i FROM known k WHERE k.duration > 0 AND k.pos NOT IN (SELECT pos FROM f WHERE taken)),
offers AS MATERIALIZED (SELECT r.pos, r.d, r.i, list(list_position(h.names, c.cluster_id) ORDER BY {_OFFER}, c.cluster_id) AS o FROM rest r JOIN features x USING (pos), cent c, homes h GROUP BY r.pos, r.d, r.i),
dealt AS (SELECT CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS i, u, CAST(NULL AS BIGINT) AS home FROM used UNION ALL SELECT pos, i, list_transform(u, lambda x, k: CASE WHEN k = home THEN x + d ELSE x END), home FROM (SELECT o.pos, o.i, o.d, z.u, CAST(list_filter(o.o, lambda c: z.u[c] + o.d <= 1980)[1] AS BIGINT) AS home FROM dealt z JOIN offers o ON o.i = z.i + 1))
SELECT cluster_id, pos, 1 AS pass FROM f WHERE taken UNION ALL SELECT names[home], pos, 2 FROM dealt, homes WHERE home IS NOT NULL""")
def duration_build(v: Views):
    rows, centroids = _with_distance(v)
    packed = centroids.agg(F.collect_list(F.struct("cluster_id", *[f"c_{c}" for c in X.FEATURES])).alias("all"))
    every = v.features.crossJoin(F.broadcast(packed)).select("pos", *X.FEATURES, F.explode("all").alias("c"))
    gap = F.sqrt(sum(((F.col(c) - F.col(f"c.c_{c}")) ** 2 for c in X.FEATURES), F.lit(0.0)))
    return sequential.duration_build(rows, every.select("pos", F.col("c.cluster_id").alias("cluster_id"), gap.alias("distance")), 30)


#: Sizes of clusters whose order the SQL of ``split_clusters`` knows.
_SIZES = range(26, 141)
_DEALT = ", ".join(f"({n}, {sequential.shuffled(n, 42)})" for n in _SIZES)


@query(f"""WITH dealt(n, places) AS (VALUES {_DEALT}), c AS (SELECT cluster_id, list(pos ORDER BY pos) AS ps, CAST(count(*) AS INT) AS n FROM tracks GROUP BY cluster_id),
p AS (SELECT c.cluster_id, c.n, c.ps, coalesce(d.places, range(c.n)) AS places FROM c LEFT JOIN dealt d ON d.n = c.n), x AS (SELECT cluster_id, n, ps, places, unnest(range(n)) AS k FROM p)
SELECT CASE WHEN n > 25 THEN concat(cluster_id, '_', CAST(k // 25 AS VARCHAR)) ELSE cluster_id END AS cluster_id, ps[places[k + 1] + 1] AS pos, CAST(CASE WHEN n > 25 THEN k % 25 ELSE k END + 1 AS INT) AS seq FROM x""")
def split_clusters(v: Views):
    return sequential.split(v.tracks, 25)


@query()
def name_clusters(v: Views):
    profile = playlists.profiles(v.known)
    return naming.name_clusters(profile, playlists.salience(profile))
