"""Playlists and collections rendered as ordered text lines, and written as files.

Each renderer gives rows (cluster_id, line_no, line); a playlist's lines are in
the order of line_no. ``write`` puts one file per cluster below a folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import exprs as X

from . import sequencing as S

RANGE = ("bpm_mean", "bpm_std")


def bpm_range(mean: Column, std: Column) -> Column:
    whole = lambda c: c.cast("bigint").cast("string")
    return F.concat(whole(mean), F.lit("-"), whole(mean + std), F.lit("bpm"))


def file_name(prefix: str, number: Column, mean: Column, std: Column, genre: Column, ending: str) -> Column:
    """``Prefix 1 [120-125bpm genre].m3u``"""
    label = F.concat(F.lit(" ["), bpm_range(mean, std), F.coalesce(F.concat(F.lit(" "), genre), F.lit("")), F.lit("]"))
    return F.concat(F.lit(f"{prefix} "), number.cast("string"), label, F.lit(ending))


def extinf(genre: Column | None = None) -> Column:
    """The #EXTINF line of a track."""
    seconds = F.coalesce("duration", F.lit(0.0)).cast("bigint").cast("string")
    artist = F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown"))
    tail = F.lit("") if genre is None else F.coalesce(F.concat(F.lit(" ["), genre, F.lit("]")), F.lit(""))
    return F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), artist, F.lit(" - "), X.display_title(), tail)


def relative(root: str) -> Column:
    """A path below ``root`` without it; any other as it is."""
    return F.when(F.col("path").startswith(F.lit(root)), F.col("path").substr(F.lit(len(root) + 1), F.length("path"))).otherwise(F.col("path"))


def _lines(rows: DataFrame, head: list[Column], body: Column, tail: list[Column] | None = None) -> DataFrame:
    """Head lines, each row's body lines (an array) by seq, and tail lines, numbered for each cluster."""
    clusters = rows.select("cluster_id").distinct()
    parts = [rows.select("cluster_id", F.lit(1).alias("part"), "seq", F.posexplode(body).alias("k", "line"))]
    for part, some in ((0, head), (2, tail or [])):
        if some:
            parts.append(clusters.select("cluster_id", F.lit(part).alias("part"), F.lit(0).alias("seq"), F.posexplode(F.array(*some)).alias("k", "line")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    order = Window.partitionBy("cluster_id").orderBy("part", "seq", "k")
    return whole.where("line IS NOT NULL").select("cluster_id", F.row_number().over(order).alias("line_no"), "line")


def m3u(rows: DataFrame, root: str = "/music/", genre: Column | None = None) -> DataFrame:
    """rows: cluster_id, seq, path, title, artist, duration."""
    return _lines(rows, [F.lit("#EXTM3U")], F.array(extinf(genre), relative(root)))


def m3u_chapters(rows: DataFrame, chapters: DataFrame, root: str = "/music/") -> DataFrame:
    """One flat list with a comment before each chapter's first track; chapters: cluster_id, seq, name."""
    marked = rows.join(chapters, ["cluster_id", "seq"], "left")
    mark = F.when(F.col("name").isNotNull(), F.concat(F.lit("# --- "), "name", F.lit(" ---")))
    return _lines(marked, [F.lit("#EXTM3U")], F.array(mark, extinf(), relative(root)))


def m3u_per_chapter(rows: DataFrame, chapters: DataFrame, root: str = "/music/") -> DataFrame:
    """(file, line_no, line): a file for each chapter, from its first track to the next chapter's."""
    order = Window.partitionBy("cluster_id").orderBy("seq")
    named = chapters.withColumn("number", F.row_number().over(order)).withColumn("until", F.lead("seq").over(order)).withColumnRenamed("seq", "since")
    inside = (F.col("seq") >= F.col("since")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    rows = rows.join(named.withColumnRenamed("cluster_id", "c"), (F.col("cluster_id") == F.col("c")) & inside)
    file = F.concat("cluster_id", F.lit("/"), F.lpad(F.col("number").cast("string"), 2, "0"), F.lit("_"), F.regexp_replace("name", r"[^\p{L}\p{N}_-]", "_"), F.lit(".m3u"))
    rows = rows.withColumn("file", file)
    first = Window.partitionBy("file").orderBy("seq")
    lines = F.array(F.when(F.row_number().over(first) == 1, F.lit("#EXTM3U")), F.when(F.row_number().over(first) == 1, F.concat(F.lit("# "), "name")), extinf(), relative(root))
    each = rows.withColumn("lines", lines).select("file", "seq", F.posexplode("lines").alias("k", "line")).where("line IS NOT NULL")
    return each.select("file", F.row_number().over(Window.partitionBy("file").orderBy("seq", "k")).alias("line_no"), "line")


def cue_sheet(rows: DataFrame, performer: str = "Various Artists", file_ref: str = "playlist.m3u", file_type: str = "MP3") -> DataFrame:
    """A cue sheet per cluster, tracks at the sum of the durations before them."""
    before = Window.partitionBy("cluster_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.coalesce("duration", F.lit(0.0))).over(before), F.lit(0.0)))
    number = F.when(F.col("seq") < 10, F.concat(F.lit("0"), F.col("seq").cast("string"))).otherwise(F.col("seq").cast("string"))
    artist = F.coalesce(F.nullif("artist", F.lit("")), F.lit("Unknown"))
    body = F.array(
        F.concat(F.lit("  TRACK "), number, F.lit(" AUDIO")), F.concat(F.lit('    TITLE "'), X.display_title(), F.lit('"')), F.concat(F.lit('    PERFORMER "'), artist, F.lit('"')),
        F.when(F.col("bpm") > 0, F.concat(F.lit("    REM BPM "), F.rint("bpm").cast("bigint").cast("string"))), F.concat(F.lit("    INDEX 01 "), X.cue_time(F.col("start"))),
    )
    head = [F.lit(f'PERFORMER "{performer}"'), F.concat(F.lit('TITLE "Cluster '), "cluster_id", F.lit('"')), F.lit(f'FILE "{file_ref}" {file_type}')]
    return _lines(rows, head, body)


def cue_per_track(rows: DataFrame, performer: str = "Various Artists") -> DataFrame:
    """A cue sheet for each file: (pos, line_no, line)."""
    artist = F.coalesce(F.nullif("artist", F.lit("")), F.lit(performer))
    name = F.element_at(F.split("path", "/"), -1)
    q = lambda head, c: F.concat(F.lit(f'{head} "'), c, F.lit('"'))
    lines = F.array_compact(F.array(
        q("PERFORMER", artist), q("TITLE", X.display_title()), F.concat(q("FILE", name), F.lit(" "), X.lookup(X.suffix("path"), X.FILE_TYPES, "MP3")), F.lit("  TRACK 01 AUDIO"),
        q("    TITLE", X.display_title()), q("    PERFORMER", artist), F.when(F.col("bpm") > 0, F.concat(F.lit("    REM BPM "), F.rint("bpm").cast("bigint").cast("string"))), F.lit("    INDEX 01 00:00:00"),
    ))
    return rows.select("pos", F.posexplode(lines).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def escape(c: Column) -> Column:
    """Text as an XML attribute or text node."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def two_places(c: Column) -> Column:
    """A number with two decimals, half to even of its exact binary value."""
    return F.call_function("format_number", c, F.lit("0.00"))


def _attrs(**cells: Column) -> Column:
    return F.concat(*[x for k, c in cells.items() for x in (F.lit(f' {k}="'), escape(c), F.lit('"'))])


def rekordbox_xml(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of one collection per cluster; rows also have camelot_key and bpm_mean, names (cluster_id, name)."""
    bpm = two_places(F.coalesce(F.nullif("bpm", F.lit(0.0)), "bpm_mean"))
    seconds = F.coalesce("duration", F.lit(0.0)).cast("bigint").cast("string")
    track = _attrs(
        TrackID=F.col("seq").cast("string"), Name=X.display_title(), Artist=F.coalesce("artist", F.lit("")), TotalTime=seconds, AverageBpm=bpm,
        Tonality=F.coalesce("camelot_key", F.lit("")), Location=F.concat(F.lit("file://localhost"), "path"),
    )
    first = _lines(rows, [F.lit('<DJ_PLAYLISTS Version="1.0.0">'), F.lit("  <COLLECTION>")], F.array(F.concat(F.lit("    <TRACK"), track, F.lit(" />"))))
    head = [F.lit("  </COLLECTION>"), F.lit("  <PLAYLISTS>"), F.lit('    <NODE Type="0" Name="ROOT">')]
    rows = rows.join(names, "cluster_id")
    keys = F.array(
        F.when(F.col("seq") == 1, F.concat(F.lit('      <NODE Type="1"'), _attrs(Name=F.col("name")), F.lit(">"))), F.concat(F.lit('        <TRACK Key="'), F.col("seq").cast("string"), F.lit('" />'))
    )
    second = _lines(rows, head, keys, [F.lit("      </NODE>"), F.lit("    </NODE>"), F.lit("  </PLAYLISTS>"), F.lit("</DJ_PLAYLISTS>")])
    return _after(first, second)


def traktor_nml(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Lines of one NML file per cluster."""
    n = F.count("*").over(Window.partitionBy("cluster_id")).cast("string")
    rows = rows.withColumn("entries", n).join(names, "cluster_id")
    folder, file = F.regexp_extract("path", "^(.*/)[^/]*$", 1), F.element_at(F.split("path", "/"), -1)
    tag = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"      <{name}>"), escape(c), F.lit(f"</{name}>")))
    bpm = two_places(F.coalesce(F.nullif("bpm", F.lit(0.0)), "bpm_mean"))
    body = F.array(
        F.when(F.col("seq") == 1, F.concat(F.lit("  <COLLECTION"), _attrs(ENTRIES=F.col("entries")), F.lit(">"))), F.concat(F.lit("    <ENTRY"), _attrs(PRIMARYKEY=F.col("path")), F.lit(">")), tag("TITLE", F.col("title")), tag("ARTIST", F.col("artist")),
        F.concat(F.lit("      <LOCATION"), _attrs(DIR=folder, FILE=file, VOLUME=F.lit("")), F.lit(" />")), F.concat(F.lit("      <TEMPO"), _attrs(BPM=bpm), F.lit(" />")), tag("KEY", F.col("camelot_key")),
        F.when(F.col("duration") > 0, F.concat(F.lit("      <INFO"), _attrs(PLAYTIME=F.col("duration").cast("bigint").cast("string")), F.lit(" />"))), F.lit("    </ENTRY>"),
    )
    first = _lines(rows, [F.lit('<NML Version="19">')], body, [F.lit("  </COLLECTION>"), F.lit("  <PLAYLISTS>"), F.lit('    <NODE TYPE="FOLDER" NAME="$ROOT">'), F.lit('      <SUBNODES COUNT="1">')])
    keys = F.array(
        F.when(F.col("seq") == 1, F.concat(F.lit('        <NODE TYPE="PLAYLIST"'), _attrs(NAME=F.col("name")), F.lit(">"))), F.when(F.col("seq") == 1, F.concat(F.lit("          <PLAYLIST"), _attrs(ENTRIES=F.col("entries"), TYPE=F.lit("LIST")), F.lit(">"))),
        F.lit("            <ENTRY>"), F.concat(F.lit('              <PRIMARYKEY TYPE="TRACK"'), _attrs(KEY=F.col("path")), F.lit(" />")), F.lit("            </ENTRY>"),
    )
    second = _lines(rows, [], keys, [F.lit(x) for x in ("          </PLAYLIST>", "        </NODE>", "      </SUBNODES>", "    </NODE>", "  </PLAYLISTS>", "</NML>")])
    return _after(first, second)


def _after(first: DataFrame, second: DataFrame) -> DataFrame:
    size = first.groupBy("cluster_id").agg(F.max("line_no").alias("size"))
    return first.union(second.join(size, "cluster_id").select("cluster_id", (F.col("line_no") + F.col("size")).alias("line_no"), "line"))


def write(lines: DataFrame, folder: str, key: str = "cluster_id") -> None:
    """One text file per key below ``folder``; a playlist is one task's rows, in order."""
    rows = lines.repartition(key).sortWithinPartitions(key, "line_no")
    rows.select(key, F.col("line").alias("value")).write.partitionBy(key).mode("overwrite").text(folder)


def numbered(known: DataFrame, order: Column | None = None) -> DataFrame:
    """``seq`` from 1 in each cluster, by position or by an order."""
    return S.ordered(known, *([order] if order is not None else []))
