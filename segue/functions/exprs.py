"""Scalar expressions over track, feature and key columns.

All are Catalyst expressions, so they stay inside whole-stage code generation
and are pushed with the projections that use them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str

#: The order of the feature space.
FEATURES = ("rms_energy", "brightness", "sub_bass_energy", "kick_energy", "bass_harmonics", "percussiveness", "onset_strength")
TIMBRE = ("spectral_flatness", "mfcc_variance", "zero_crossing_rate", "spectral_rolloff_85")
KNOWN_GENRES = ("techno", "house", "ambient", "dnb")
AUDIO_EXTENSIONS = (".mp3", ".flac", ".wav", ".ogg", ".m4a", ".aac", ".wma", ".aiff", ".aif", ".ape", ".opus")
TAG_GENRES = {
    "techno": "techno", "electronic": "techno", "electronica": "techno", "house": "house", "deep house": "house",
    "ambient": "ambient", "drum and bass": "dnb", "dnb": "dnb", "jungle": "dnb",
}
CHROMA_CAMELOT = ("8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B")
FILE_TYPES = {".mp3": "MP3", ".flac": "WAVE", ".wav": "WAVE", ".aiff": "AIFF", ".aif": "AIFF", ".ogg": "OGG"}


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def lookup(c: Column, table: dict, default=None) -> Column:
    """The table's value for a key, as a map literal."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[c], F.lit(default))


def hardness() -> Column:
    return clip(0.4 * F.col("brightness") + 0.2 * F.col("rms_energy") + 0.2 * F.col("percussiveness") + 0.2 * F.col("onset_strength"))


def feature_vector() -> Column:
    return F.array(*FEATURES)


def mood() -> Column:
    """Nine moods; the first rule that holds."""
    rms, bright, perc, onset, vocal, dyn = (F.col(c) for c in ("rms_energy", "brightness", "percussiveness", "onset_strength", "vocal_presence", "dynamic_range"))
    rules = [
        ("Dark", (bright < 0.3) & (vocal < 0.3)),
        ("Euphoric", (rms > 0.7) & (bright > 0.6)),
        ("Melancholic", (rms < 0.3) & (vocal > 0.5)),
        ("Aggressive", (perc > 0.7) & (onset > 0.6)),
        ("Energetic", (rms > 0.11) & (perc > 0.505) & (bright > 0.54)),
        ("Dreamy", (perc < 0.3) & (bright > 0.5)),
        ("Hypnotic", rms.between(0.3, 0.6) & (dyn < 0.3)),
        ("Groovy", (perc > 0.5) & rms.between(0.4, 0.7)),
    ]
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in rules], F.lit("Ethereal"))


def key_number(key: C) -> Column:
    return F.regexp_extract(col(key), r"^(\d+)[AB]$", 1).try_cast("int")


def key_letter(key: C) -> Column:
    return F.nullif(F.regexp_extract(col(key), r"^\d+([AB])$", 1), F.lit(""))


def _key_gaps(a: C, b: C) -> tuple[Column, Column, Column]:
    na, nb = key_number(a), key_number(b)
    ok = na.between(1, 12) & nb.between(1, 12)
    return F.coalesce(ok, F.lit(False)), F.abs(na - nb), key_letter(a) == key_letter(b)


def harmonic_compatible(a: C, b: C) -> Column:
    """Equal number, a step of one with one letter, or of three with the other; null for keys that aren't any."""
    ok, gap, same = _key_gaps(a, b)
    return F.when(ok, (gap == 0) | (same & gap.isin(1, 11)) | (~same & gap.isin(3, 9)))


def harmonic_score(a: C, b: C) -> Column:
    """2 for an equal key, a step of one, or of three with the other letter; 1 for the other letter alone; else 0."""
    ok, gap, same = _key_gaps(a, b)
    full = ((gap == 0) & same) | (same & gap.isin(1, 11)) | (~same & gap.isin(3, 9))
    return F.when(~ok, 0).when(full, 2).when(gap == 0, 1).otherwise(0)


def mix_score(a: str, b: str, key: Column) -> Column:
    """Mix score of two tracks, given the aliases of their rows and 1 or 0 for keys that fit or don't."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    return (
        0.3 * F.greatest(F.lit(0.0), 1 - F.abs(x("bpm") - y("bpm")) / 20)
        + 0.3 * key
        + 0.25 * (1 - F.abs(x("rms_energy") - y("rms_energy")))
        + 0.15 * (1 - F.abs(x("brightness") - y("brightness")))
    )


def compatibility(a: str, b: str) -> Column:
    """Mix score of two tracks, given the aliases of their rows."""
    fits = F.coalesce(harmonic_compatible(f"{a}.camelot_key", f"{b}.camelot_key"), F.lit(False))
    return mix_score(a, b, F.when(fits, 1.0).otherwise(0.0))


def transition_color(score: Column) -> Column:
    return F.when(score.isNull(), "gray").when(score >= 0.8, "green").when(score >= 0.5, "amber").otherwise("red")


def key_dot(previous: C, current: C) -> Column:
    same_number = key_number(previous) == key_number(current)
    return (
        F.when(col(previous).isNull() | col(current).isNull(), "gray")
        .when(harmonic_compatible(current, previous), F.when(same_number & (key_letter(previous) != key_letter(current)), "amber").otherwise("green"))
        .otherwise("red")
    )


def opener_score(duration: Column) -> Column:
    base = 0.4 * (1 - F.col("onset_strength")) + 0.3 * (1 - F.col("percussiveness")) + 0.2 * (1 - F.col("kick_energy")) + 0.1 * (1 - F.col("rms_energy"))
    return F.round(F.least(F.lit(1.0), base + F.when(duration >= 300, 0.1).otherwise(0.0)), 4)


def opener_reason(duration: Column) -> Column:
    parts = F.concat_ws(
        " + ", F.when(F.col("onset_strength") < 0.4, "low onset"), F.when(F.col("rms_energy") < 0.4, "quiet start"),
        F.when(F.col("kick_energy") < 0.4, "low kick energy"), F.when(duration >= 300, "long track (likely intro)"),
    )
    return F.when(parts == "", "moderate opener qualities").otherwise(parts)


def _closer(duration: Column) -> tuple[Column, Column]:
    energetic = 0.4 * F.col("rms_energy") + 0.35 * F.col("onset_strength") + 0.25 * F.col("kick_energy")
    fade = 0.4 * (1 - F.col("onset_strength")) + 0.3 * (1 - F.col("rms_energy")) + F.when(duration >= 360, 0.15).otherwise(0.0)
    return energetic, fade


def closer_score(duration: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(*_closer(duration))), 4)


def closer_reason(duration: Column) -> Column:
    energetic, fade = _closer(duration)
    return F.when(energetic >= fade, "energetic closer").otherwise("smooth fade-out")


def freshness(times_used: C, last_used: C, as_of: Column) -> Column:
    """1 if never used; else falls with use and recovers over 30 days; an unreadable date counts as long ago."""
    n = F.coalesce(col(times_used), F.lit(0))
    days = F.coalesce(F.datediff(as_of, col(last_used).try_cast("date")), F.lit(30))
    used = F.greatest(F.lit(0.0), 1 - F.log(n + 1) / F.log(F.lit(31.0)))
    return F.when(col(times_used).isNull() | (F.coalesce(col(last_used).cast("string"), F.lit("")) == ""), 1.0).otherwise(used * F.least(F.lit(1.0), days / 30.0))


def bpm_bucket(bpm: C) -> Column:
    b = col(bpm)
    return F.when(b < 100, "Slow").when(b < 120, "Mid-Tempo").when(b <= 135, "Peak Hour").otherwise("High Energy")


def energy_bucket(rms: C) -> Column:
    r = col(rms)
    return F.when(r < 0.3, "Subtle").when(r < 0.5, "Groovy").when(r <= 0.7, "Energetic").otherwise("Intense")


def intensity_label(x: Column) -> Column:
    return F.when(x >= 0.85, "Very High").when(x >= 0.66, "High").when(x >= 0.33, "Medium").otherwise("Low")


def bars(x: Column, width: int) -> Column:
    full = F.rint(clip(x) * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), width - full))


def minutes_seconds(seconds: Column) -> Column:
    s = F.greatest(F.lit(0), F.coalesce(seconds, F.lit(0)).cast("bigint"))
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def cue_time(seconds: Column) -> Column:
    """MM:SS:FF at 75 frames a second, half to even."""
    frames = F.rint(F.greatest(F.lit(0.0), seconds) * 75).cast("bigint")
    part = lambda x: F.when(x < 10, F.concat(F.lit("0"), x.cast("string"))).otherwise(x.cast("string"))
    return F.concat_ws(":", part(F.floor(frames / 4500)), part(F.floor(frames / 75) % 60), part(frames % 75))


def cue_time_valid(text: Column) -> Column:
    field = lambda k: F.regexp_extract(text, r"^(\d+):(\d+):(\d+)$", k).try_cast("bigint")
    return F.coalesce(text.rlike(r"^\d+:\d+:\d+$") & (field(2) <= 59) & (field(3) <= 74), F.lit(False))


def title_case(text: Column) -> Column:
    """Upper case after each character that is no letter, lower case elsewhere."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), "")


def stem(path: C) -> Column:
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def suffix(path: C) -> Column:
    return F.lower(F.regexp_extract(col(path), r"[^/](\.[^./]+)$", 1))


def display_title() -> Column:
    return F.coalesce(F.nullif(F.col("title"), F.lit("")), stem("path"))


def bpm_suspicious(bpm: C, genre: C) -> Column:
    b, g = col(bpm), F.lower(col(genre))
    whole = F.abs(b - F.rint(b)) <= 1e-3 + 1e-5 * F.abs(F.rint(b))
    dnb = reduce(lambda x, y: x | y, [F.contains(g, F.lit(w)) for w in ("dnb", "drum and bass", "drum & bass", "d&b")])
    slow = (F.contains(g, F.lit("techno")) & (b < 110)) | (F.contains(g, F.lit("house")) & (b < 100)) | (dnb & (b < 150))
    return F.when(b.isNull(), False).otherwise(~whole | F.coalesce(slow, F.lit(False)))


def parse_bpm(*tags: Column) -> Column:
    """The first tag that reads as a number between 0 and 500."""
    number = lambda t: F.trim(t).try_cast("double")
    return F.coalesce(*[F.when((number(t) > 0) & (number(t) < 500), number(t)) for t in tags])


def parse_year(text: Column) -> Column:
    year = F.substring(text, 1, 4).try_cast("int")
    return F.when(year.between(1900, 2100), year)


def first_text(*tags: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in tags])


def camelot(key: Column) -> Column:
    """Camelot notation of a key name; empty if unknown. Flats in names of two letters stay unknown."""
    k = F.trim(key)
    head = F.upper(k.substr(F.lit(1), F.length(k) - 1))
    name = F.when((F.length(k) > 1) & k.endswith("m"), F.concat(head, F.lit("m"))).when((F.length(k) > 1) & k.endswith("M"), head).otherwise(F.upper(k))
    return F.when(name.rlike("^([1-9]|1[0-2])[AB]$"), name).otherwise(lookup(name, KEY_NAMES, ""))


#: Names of keys in Camelot notation, minor then major.
KEY_NAMES = {
    "Abm": "1A", "G#m": "1A", "Ebm": "2A", "D#m": "2A", "Bbm": "3A", "A#m": "3A", "Fm": "4A", "Cm": "5A", "Gm": "6A",
    "Dm": "7A", "Am": "8A", "Em": "9A", "Bm": "10A", "F#m": "11A", "Gbm": "11A", "Dbm": "12A", "C#m": "12A",
    "B": "1B", "F#": "2B", "Gb": "2B", "Db": "3B", "C#": "3B", "Ab": "4B", "G#": "4B", "Eb": "5B", "D#": "5B",
    "Bb": "6B", "A#": "6B", "F": "7B", "C": "8B", "G": "9B", "D": "10B", "A": "11B", "E": "12B",
}


def five_rhythms(bpm: Column, rms: Column) -> Column:
    """The phase of a track; without a positive tempo it is lyrical."""
    return (
        F.when(bpm.isNull() | (bpm <= 0), "lyrical")
        .when((bpm > 135) | (rms > 0.75), "chaos")
        .when((bpm < 85) | (rms < 0.25), "stillness")
        .when((bpm >= 85) & (bpm < 115) & (rms < 0.5), "flowing")
        .when((bpm >= 115) & (bpm < 135) & (rms >= 0.4) & (rms < 0.7), "staccato")
        .otherwise("lyrical")
    )
