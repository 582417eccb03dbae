"""Projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from segue.functions import exprs as X
from segue.operators import selecting as C
from segue.functions.words import ADJECTIVE_RANK
from segue.sources.fixtures import AS_OF, Views

from .base import Catalogue

CATALOGUE = Catalogue()
query = CATALOGUE.add

HARD = "least(greatest(0.4::DOUBLE * brightness + 0.2::DOUBLE * rms_energy + 0.2::DOUBLE * percussiveness + 0.2::DOUBLE * onset_strength, 0), 1)"
MOOD = """CASE WHEN brightness < 0.3 AND vocal_presence < 0.3 THEN 'Dark' WHEN rms_energy > 0.7 AND brightness > 0.6 THEN 'Euphoric'
 WHEN rms_energy < 0.3 AND vocal_presence > 0.5 THEN 'Melancholic' WHEN percussiveness > 0.7 AND onset_strength > 0.6 THEN 'Aggressive'
 WHEN rms_energy > 0.11 AND percussiveness > 0.505 AND brightness > 0.54 THEN 'Energetic' WHEN percussiveness < 0.3 AND brightness > 0.5 THEN 'Dreamy'
 WHEN rms_energy BETWEEN 0.3 AND 0.6 AND dynamic_range < 0.3 THEN 'Hypnotic' WHEN percussiveness > 0.5 AND rms_energy BETWEEN 0.4 AND 0.7 THEN 'Groovy' ELSE 'Ethereal' END"""
STEM = "regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]*$', '')"
TITLE = f"coalesce(nullif(title, ''), {STEM})"


def _num(k: str) -> str:
    return f"CAST(left({k}, length({k}) - 1) AS INT)"


def compatible(a: str, b: str) -> str:
    gap, same = f"abs({_num(a)} - {_num(b)})", f"(right({a}, 1) = right({b}, 1))"
    return f"({gap} = 0 OR ({same} AND {gap} IN (1, 11)) OR (NOT {same} AND {gap} IN (3, 9)))"


def score_of(a: str, b: str) -> str:
    gap, same = f"abs({_num(a)} - {_num(b)})", f"(right({a}, 1) = right({b}, 1))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 WHEN ({gap} = 0 AND {same}) OR ({same} AND {gap} IN (1, 11)) OR (NOT {same} AND {gap} IN (3, 9)) THEN 2 WHEN {gap} = 0 THEN 1 ELSE 0 END"


def compat_of(a: str, b: str) -> str:
    """The mix score in SQL, for row aliases."""
    key = f"CASE WHEN coalesce({compatible(a + '.camelot_key', b + '.camelot_key')}, false) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return (
        f"(0.3::DOUBLE * greatest(0.0::DOUBLE, 1 - abs({a}.bpm - {b}.bpm) / 20) + 0.3::DOUBLE * {key}"
        f" + 0.25::DOUBLE * (1 - abs({a}.rms_energy - {b}.rms_energy)) + 0.15::DOUBLE * (1 - abs({a}.brightness - {b}.brightness)))"
    )


@query(f"SELECT pos, {HARD} AS hardness FROM features")
def hardness(v: Views):
    return v.features.select("pos", X.hardness().alias("hardness"))


@query("SELECT pos, [rms_energy, brightness, sub_bass_energy, kick_energy, bass_harmonics, percussiveness, onset_strength] AS vector FROM features")
def feature_vector(v: Views):
    return v.features.select("pos", X.feature_vector().alias("vector"))


@query(f"SELECT pos, {MOOD} AS mood FROM features")
def mood_class(v: Views):
    return v.features.select("pos", X.mood().alias("mood"))


PAIRS = """WITH keyed AS (SELECT pos, camelot_key AS a, lag(camelot_key) OVER (ORDER BY pos) AS b FROM features)"""


#: Positions in a range that one task orders.
RANGE = 1 << 16


def _pairs(v: Views):
    """Each key with that of the track before, by position; for all tracks.

    Tracks are dealt by ranges of positions; within one the track before is a
    lag, and a range's first track takes the last key of the ranges before.
    """
    from pyspark.sql import Window

    part = F.floor(F.col("pos") / RANGE)
    now = v.features.select("pos", F.col("camelot_key").alias("a"), part.alias("part"))
    last = now.groupBy("part").agg(F.max_by("a", "pos").alias("last"))
    carry = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))
    inside = Window.partitionBy("part").orderBy("pos")
    ranked = now.withColumn("b", F.lag("a").over(inside)).withColumn("r", F.row_number().over(inside))
    return ranked.join(carry, "part").select("pos", "a", F.when(F.col("r") == 1, F.col("last")).otherwise(F.col("b")).alias("b"))


@query(f"{PAIRS} SELECT pos, a, b, {compatible('a', 'b')} AS compatible FROM keyed WHERE a IS NOT NULL AND b IS NOT NULL")
def harmonic_bool(v: Views):
    return _pairs(v).where("a IS NOT NULL AND b IS NOT NULL").withColumn("compatible", X.harmonic_compatible("a", "b"))


@query(f"{PAIRS} SELECT pos, a, b, CAST({score_of('a', 'b')} AS INT) AS score FROM keyed")
def harmonic_score(v: Views):
    return _pairs(v).withColumn("score", F.when(F.col("a").isNull() | F.col("b").isNull(), 0).otherwise(X.harmonic_score("a", "b")))


@query(f"""SELECT x.pos, y.pos AS other, round({compat_of('x', 'y')}, 9) AS score
FROM (SELECT * FROM tracks JOIN features USING (pos)) x JOIN (SELECT * FROM tracks JOIN features USING (pos)) y ON y.pos = x.pos + 1 WHERE x.bpm IS NOT NULL AND y.bpm IS NOT NULL""")
def compat_score(v: Views):
    x, y = v.known.where("bpm IS NOT NULL").alias("x"), v.known.where("bpm IS NOT NULL").alias("y")
    both = x.join(y, F.col("y.pos") == F.col("x.pos") + 1)
    return both.select("x.pos", F.col("y.pos").alias("other"), F.round(X.compatibility("x", "y"), 9).alias("score"))


@query(f"""SELECT t.pos, CASE WHEN h.times_used IS NULL OR h.last_used IS NULL THEN 1.0::DOUBLE
 ELSE round(greatest(0.0::DOUBLE, 1 - ln(h.times_used + 1) / ln(31.0::DOUBLE)) * least(1.0::DOUBLE, date_diff('day', h.last_used, DATE '{AS_OF}') / 30.0::DOUBLE), 9) END AS freshness
FROM tracks t LEFT JOIN history h USING (pos)""")
def freshness(v: Views):
    both = v.tracks.join(v.history, "pos", "left")
    return both.select("pos", F.round(X.freshness("times_used", "last_used", F.lit(AS_OF).cast("date")), 9).alias("freshness"))


@query(f"""SELECT pos, round(least(1.0::DOUBLE, date_diff('day', last_used, DATE '{AS_OF}') / 30.0::DOUBLE) * CASE WHEN pos % 3 = 0 THEN 1 ELSE greatest(0.0::DOUBLE, 1 - ln(times_used + 1) / ln(31.0::DOUBLE)) END, 9) AS freshness FROM history""")
def freshness_unused(v: Views):
    """A third of the history with no use, but a date: only the date counts."""
    rows = v.history.withColumn("times_used", F.when(F.col("pos") % 3 == 0, F.lit(0)).otherwise(F.col("times_used")))
    return rows.select("pos", F.round(X.freshness("times_used", "last_used", F.lit(AS_OF).cast("date")), 9).alias("freshness"))


@query("""SELECT pos, CASE WHEN bpm < 100 THEN 'Slow' WHEN bpm < 120 THEN 'Mid-Tempo' WHEN bpm <= 135 THEN 'Peak Hour' ELSE 'High Energy' END AS bpm_bucket,
 CASE WHEN rms_energy < 0.3 THEN 'Subtle' WHEN rms_energy < 0.5 THEN 'Groovy' WHEN rms_energy <= 0.7 THEN 'Energetic' ELSE 'Intense' END AS energy_bucket
FROM tracks JOIN features USING (pos) WHERE bpm IS NOT NULL""")
def bpm_energy_buckets(v: Views):
    return v.known.where("bpm IS NOT NULL").select("pos", X.bpm_bucket("bpm").alias("bpm_bucket"), X.energy_bucket("rms_energy").alias("energy_bucket"))


CUE = "concat(CASE WHEN {f} < 45000 THEN '0' ELSE '' END, CAST({f} // 4500 AS VARCHAR), ':', lpad(CAST({f} // 75 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST({f} % 75 AS VARCHAR), 2, '0'))"


def cue_sql(seconds: str) -> str:
    return CUE.format(f=f"CAST(round_even(greatest(0.0::DOUBLE, {seconds}) * 75, 0) AS BIGINT)")


@query(f"SELECT pos, idx, {cue_sql('rms * 100')} AS cue FROM frames")
def cue_time(v: Views):
    return v.frames.select("pos", "idx", X.cue_time(F.col("rms") * 100).alias("cue"))


@query(r"""SELECT pos, cue, regexp_matches(cue, '^\d+:\d+:\d+$') AND coalesce(TRY_CAST(split_part(cue, ':', 2) AS BIGINT) <= 59 AND TRY_CAST(split_part(cue, ':', 3) AS BIGINT) <= 74, false) AS valid
FROM (SELECT pos, CASE pos % 7 WHEN 0 THEN 'ab:cd' WHEN 1 THEN concat(CAST(pos AS VARCHAR), ':61:00') ELSE concat(CAST(pos AS VARCHAR), ':', CAST(pos % 60 AS VARCHAR), ':', CAST(pos % 80 AS VARCHAR)) END AS cue FROM tracks)""")
def cue_time_valid(v: Views):
    text = lambda c: c.cast("string")
    p = F.col("pos")
    cue = F.when(p % 7 == 0, "ab:cd").when(p % 7 == 1, F.concat(text(p), F.lit(":61:00"))).otherwise(F.concat_ws(":", text(p), text(p % 60), text(p % 80)))
    return v.tracks.select("pos", cue.alias("cue")).withColumn("valid", X.cue_time_valid(F.col("cue")))


@query("SELECT pos, tag, CASE WHEN upper(left(tag, 1)) IN ('A', 'E', 'I', 'O', 'U') THEN 'an' ELSE 'a' END AS article FROM tags")
def article(v: Views):
    first = F.upper(F.substring("tag", 1, 1))
    return v.tags.withColumn("article", F.when(first.isin(*"AEIOU"), "an").otherwise("a"))


@query("SELECT * FROM tracks WHERE bpm IS NOT NULL")
def bpm_valid(v: Views):
    return v.tracks.where("bpm IS NOT NULL")


@query("""SELECT pos, CASE WHEN bpm IS NULL THEN false ELSE abs(bpm - round_even(bpm, 0)) > 0.001::DOUBLE + 0.00001::DOUBLE * abs(round_even(bpm, 0))
 OR coalesce((contains(lower(genre), 'techno') AND bpm < 110) OR (contains(lower(genre), 'house') AND bpm < 100) OR (contains(lower(genre), 'dnb') AND bpm < 150), false) END AS suspicious FROM tracks""")
def bpm_suspicious(v: Views):
    return v.tracks.select("pos", X.bpm_suspicious("bpm", "genre").alias("suspicious"))


@query("""SELECT pos, CASE WHEN y BETWEEN 1900 AND 2100 THEN y END AS year FROM (SELECT pos, TRY_CAST(left(raw, 4) AS INT) AS y FROM
 (SELECT pos, CASE pos % 5 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(1800 + pos % 400 AS VARCHAR) ELSE concat(CAST(1900 + pos % 250 AS VARCHAR), '-05-01') END AS raw FROM tracks))""")
def year_parse(v: Views):
    p = F.col("pos")
    raw = F.when(p % 5 == 0, "n/a").when(p % 5 == 1, (1800 + p % 400).cast("string")).otherwise(F.concat((1900 + p % 250).cast("string"), F.lit("-05-01")))
    return v.tracks.select("pos", X.parse_year(raw).alias("year"))


@query("""SELECT pos, kind FROM (SELECT pos, unnest(CASE WHEN vocal_presence BETWEEN 0 AND 0.3 THEN ['Any', 'Instrumental'] WHEN vocal_presence BETWEEN 0.6 AND 1.0 THEN ['Any', 'Vocal'] ELSE ['Any'] END) AS kind
 FROM tracks JOIN features USING (pos))""")
def vocal_filter(v: Views):
    kinds = F.array_compact(F.array(*[F.when(C.vocal(k), k) for k in ("Any", *C.VOCAL)]))
    return v.known.select("pos", F.explode(kinds).alias("kind"))


@query(f"SELECT pos FROM tracks WHERE contains(lower({TITLE}), '12') OR contains(lower(artist), '12') OR contains(CAST(CAST(trunc(bpm) AS BIGINT) AS VARCHAR), '12')")
def track_search(v: Views):
    return C.search(v.tracks, "12").select("pos")


@query(f"""SELECT t.pos FROM tracks t WHERE lower(regexp_extract(path, '\\.[^./]+$')) = '.flac' AND (contains(lower({TITLE}), '1') OR contains(lower(coalesce(artist, '')), '1'))
 AND EXISTS (SELECT 1 FROM tags g WHERE g.pos = t.pos AND contains(lower(g.tag), 'a'))""")
def library_filter(v: Views):
    return C.library(v.tracks, v.tags, text="1", suffix=".flac", tag="a").select("pos")


@query(f"SELECT path FROM tracks JOIN tags USING (pos) WHERE lower(trim(tag)) = (SELECT min(lower(trim(tag))) FROM tags)")
def tag_search(v: Views):
    tags = v.tags.select("pos", F.lower(F.trim("tag")).alias("tag"))
    asked = tags.agg(F.min("tag").alias("tag"))
    return tags.join(F.broadcast(asked), "tag").join(v.tracks, "pos").select("path")


@query(f"""SELECT pos, {TITLE} AS display_title, coalesce(artist, '') AS artist, coalesce(bpm, 0.0::DOUBLE) AS bpm,
 concat(CAST(CAST(coalesce(duration, 0) AS BIGINT) // 60 AS VARCHAR), ':', lpad(CAST(CAST(coalesce(duration, 0) AS BIGINT) % 60 AS VARCHAR), 2, '0')) AS duration_str,
 concat(repeat('█', CAST(round_even({HARD} * 5, 0) AS INT)), repeat('░', 5 - CAST(round_even({HARD} * 5, 0) AS INT))) AS bars,
 CASE WHEN energy_gradient > 0.05 THEN '↑' WHEN energy_gradient < -0.05 THEN '↓' ELSE '→' END AS gradient,
 CASE WHEN spectral_flatness < 0.3 THEN 'Tonal' WHEN spectral_flatness <= 0.6 THEN 'Mixed' ELSE 'Noisy' END AS texture,
 concat(CAST(CAST(intro_length_secs AS BIGINT) AS VARCHAR), 's') AS intro
FROM tracks JOIN features USING (pos)""")
def track_view(v: Views):
    g, flat = F.col("energy_gradient"), F.col("spectral_flatness")
    return v.known.select(
        "pos", X.display_title().alias("display_title"), F.coalesce("artist", F.lit("")).alias("artist"), F.coalesce("bpm", F.lit(0.0)).alias("bpm"),
        X.minutes_seconds(F.col("duration")).alias("duration_str"), X.bars(X.hardness(), 5).alias("bars"),
        F.when(g > 0.05, "↑").when(g < -0.05, "↓").otherwise("→").alias("gradient"),
        F.when(flat < 0.3, "Tonal").when(flat <= 0.6, "Mixed").otherwise("Noisy").alias("texture"),
        F.concat(F.col("intro_length_secs").cast("bigint").cast("string"), F.lit("s")).alias("intro"),
    )


_WORDS = list(ADJECTIVE_RANK) + ["Percussive", "Loud", "Vocal"]


@query(
    f"""WITH words AS (SELECT pos, k, {_WORDS!r}[CAST((pos * (7 + 5 * k) + k) % {len(_WORDS)} AS INT) + 1] AS word FROM tracks, (SELECT unnest([0, 1, 2, 3]) AS k)),
ranks AS (SELECT unnest({list(ADJECTIVE_RANK)!r}) AS word, unnest({list(ADJECTIVE_RANK.values())!r}) AS rank)
SELECT pos, string_agg(word, ' ' ORDER BY coalesce(rank, 99), k) AS ordered FROM words LEFT JOIN ranks USING (word) GROUP BY pos"""
)
def royal_order(v: Views):
    """Adjectives by kind; words of no kind come last, in the order given."""
    p = F.col("pos")
    words = [F.element_at(F.array(*map(F.lit, _WORDS)), ((p * (7 + 5 * k) + k) % len(_WORDS)).cast("int") + 1) for k in range(4)]
    ranked = F.array(*[F.struct(X.lookup(w, ADJECTIVE_RANK, 99).alias("rank"), F.lit(k).alias("k"), w.alias("word")) for k, w in enumerate(words)])
    return v.tracks.select("pos", F.array_join(F.transform(F.array_sort(ranked), lambda x: x["word"]), " ").alias("ordered"))


_KEYS = ["6A", "4B", "Cm", "G#m", "8B", "12a", "13A", " am ", "F#", "bbm", "Db", "CM", "EM", "x", "", "C#m", "g", "10B", "Fm", "D#"]


@query(
    f"""WITH named AS (SELECT unnest({list(X.KEY_NAMES)!r}) AS name, unnest({list(X.KEY_NAMES.values())!r}) AS code),
keys AS (SELECT pos, {_KEYS!r}[CAST(pos % {len(_KEYS)} AS INT) + 1] AS key FROM tracks),
normal AS (SELECT pos, key, CASE WHEN length(trim(key)) > 1 AND right(trim(key), 1) = 'm' THEN concat(upper(left(trim(key), length(trim(key)) - 1)), 'm')
 WHEN length(trim(key)) > 1 AND right(trim(key), 1) = 'M' THEN upper(left(trim(key), length(trim(key)) - 1)) ELSE upper(trim(key)) END AS name FROM keys)
SELECT pos, key, CASE WHEN regexp_full_match(name, '([1-9]|1[0-2])[AB]') THEN name ELSE coalesce(code, '') END AS camelot FROM normal LEFT JOIN named USING (name)"""
)
def rekordbox_key_map(v: Views):
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("pos") % len(_KEYS)).cast("int") + 1)
    return v.tracks.select("pos", key.alias("key")).withColumn("camelot", X.camelot(F.col("key")))




@query(
    """SELECT pos, coalesce(CASE WHEN TRY_CAST(trim(a) AS DOUBLE) > 0 AND TRY_CAST(trim(a) AS DOUBLE) < 500 THEN TRY_CAST(trim(a) AS DOUBLE) END, CASE WHEN TRY_CAST(trim(b) AS DOUBLE) > 0 AND TRY_CAST(trim(b) AS DOUBLE) < 500 THEN TRY_CAST(trim(b) AS DOUBLE) END) AS bpm,
 coalesce(nullif(trim(t), ''), nullif(trim(u), '')) AS title
FROM (SELECT pos, CASE pos % 4 WHEN 0 THEN 'fast' WHEN 1 THEN '900' WHEN 2 THEN NULL ELSE CAST(pos % 600 AS VARCHAR) END AS a, CASE WHEN pos % 3 = 0 THEN NULL ELSE concat(' ', CAST(100 + pos % 60 AS VARCHAR), ' ') END AS b,
 CASE WHEN pos % 6 = 0 THEN '  ' ELSE title END AS t, concat('alt ', CAST(pos AS VARCHAR)) AS u FROM tracks)"""
)
def tag_coalesce(v: Views):
    """The first readable of the alternative names of a tag, from a map of tags."""
    p = F.col("pos")
    a = F.when(p % 4 == 0, "fast").when(p % 4 == 1, "900").when(p % 4 == 3, (p % 600).cast("string"))
    b = F.when(p % 3 != 0, F.concat(F.lit(" "), (100 + p % 60).cast("string"), F.lit(" ")))
    tags = F.create_map(
        F.lit("BPM"), a, F.lit("TBPM"), b, F.lit("TIT2"), F.when(p % 6 == 0, "  ").otherwise(F.col("title")), F.lit("TITLE"), F.concat(F.lit("alt "), p.cast("string"))
    )
    read = v.tracks.select("pos", tags.alias("tags"))
    names = ("BPM", "bpm", "TBPM", "tempo", "TEMPO", "tmpo", "fBPM")
    return read.select("pos", X.parse_bpm(*[F.col("tags")[n] for n in names]).alias("bpm"), X.first_text(F.col("tags")["TIT2"], F.col("tags")["TITLE"]).alias("title"))


@query("""SELECT pos, string_agg(CASE WHEN w = '' THEN '' ELSE concat(upper(left(w, 1)), lower(substr(w, 2))) END, '' ORDER BY k) AS titled
FROM (SELECT pos, unnest(regexp_extract_all(s, '([A-Za-z]+|[^A-Za-z]+)')) AS w, generate_subscripts(regexp_extract_all(s, '([A-Za-z]+|[^A-Za-z]+)'), 1) AS k
 FROM (SELECT pos, concat(coalesce(title, 'no title'), ' mid-tempo 2nd o''clock') AS s FROM tracks)) GROUP BY pos""")
def title_case(v: Views):
    text = F.concat(F.coalesce("title", F.lit("no title")), F.lit(" mid-tempo 2nd o'clock"))
    return v.tracks.select("pos", X.title_case(text).alias("titled"))
