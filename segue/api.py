"""The library from scan to export, as one chain of DataFrames.

    Library(tracks, features).cluster(k=5).split(25).sequence("ramp").name().m3u()
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segue.ml import clustering as M
from segue.operators import naming, playlists, render, sequencing, sequential
from segue.sources import audio, media


@dataclass(frozen=True)
class Library:
    """tracks: pos, path, bpm, duration, artist, title, genre; features by pos.

    ``order`` has (cluster_id, pos, seq) once the library is clustered.
    """

    tracks: DataFrame
    features: DataFrame
    order: DataFrame | None = None
    names: DataFrame | None = None

    @classmethod
    def from_folders(cls, spark: SparkSession, *folders: str, cache: DataFrame | None = None) -> tuple[Library, DataFrame]:
        """The library of the audio files below some folders, and (path, error) of those that could not be read.

        Tags give what they have; a tempo that they lack is estimated from the
        sound. Positions follow the order of paths. Files without features are
        no part of the library. ``cache`` has feature rows of earlier runs.
        """
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders))
        tags = media.read_tags(spark, *folders).dropDuplicates(["path"]).withColumnRenamed("error", "tag_error")
        heard = audio.analysed(audio.hashed(files).dropDuplicates(["path"]), cache)
        rows = tags.join(heard.drop("file_hash"), "path", "left").persist()
        good = rows.where("error IS NULL AND rms_energy IS NOT NULL").select("path", "bpm")
        blank = files.join(good.where("bpm IS NULL").select("path"), "path", "left_semi")
        beats = audio.tempos_of(blank.dropDuplicates(["path"])).withColumnRenamed("bpm", "heard_bpm")
        placed = rows.join(good.select("path"), "path", "left_semi").join(beats, "path", "left").orderBy("path").withColumn("pos", F.monotonically_increasing_id()).persist()
        where = F.regexp_replace("path", "^file:/+", "/")
        tracks = placed.select("pos", where.alias("path"), F.coalesce("bpm", "heard_bpm").alias("bpm"), "duration", "artist", "title", "album", "genre", "year", "mood")
        features = placed.select("pos", *audio.NAMES, "camelot_key")
        failed = rows.where("error IS NOT NULL OR rms_energy IS NULL").select(where.alias("path"), F.coalesce("error", "tag_error").alias("error"))
        return cls(tracks, features), failed

    @property
    def known(self) -> DataFrame:
        """Tracks with features, in their clusters if there are any."""
        rows = self.tracks.join(self.features, "pos")
        if self.order is None:
            return rows
        return rows.drop("cluster_id").join(self.order.select("cluster_id", "pos"), "pos")

    def cluster(self, **options) -> Library:
        labelled = M.cluster(self.known.drop("cluster_id"), **options).labelled
        return replace(self, order=sequencing.ordered(labelled.select("cluster_id", "pos")))

    def cluster_by_genre(self, **options) -> Library:
        genre = F.lower(F.trim("genre"))
        known = self.known.withColumn("resolved", F.when(genre.isin(*M.GENRE_WEIGHTS), genre).otherwise("unknown"))
        return replace(self, order=sequencing.ordered(M.per_genre(known, **options)))

    def split(self, size: int, seed: int = 42) -> Library:
        return replace(self, order=sequential.split(self.order, size, seed))

    def sequence(self, strategy: str) -> Library:
        """ramp, build, descent, alternating, bpm_asc, bpm_desc, intro_asc, intro_desc, harmonic, timbre, five_rhythms or anchored."""
        known = self.known
        if strategy == "anchored":
            rows = known.select(*self.tracks.drop("cluster_id").columns, "cluster_id")
            opener = sequencing.ranked(rows, self.features, opener=True, top=1)
            closer = sequencing.ranked(rows, self.features, opener=False, top=2).join(opener.select("cluster_id", F.col("pos").alias("o")), "cluster_id").where("pos <> o")
            out = sequencing.anchored(known, opener, closer.groupBy("cluster_id").agg(F.min_by("pos", "rank").alias("pos")))
        elif strategy in ("harmonic", "timbre"):
            out = getattr(sequential, strategy)(known)
        elif strategy == "five_rhythms":
            out = sequencing.five_rhythms(known)
        else:
            out = sequencing.sequence(known, strategy)
        return replace(self, order=out.select("cluster_id", "pos", "seq"))

    def arranged(self, **wishes) -> Library:
        """Several wishes at once, by their precedence; see ``sequential.arranged``."""
        return replace(self, order=sequential.arranged(self.known, **wishes))

    def name(self) -> Library:
        profile = playlists.profiles(self.known)
        return replace(self, names=naming.name_clusters(profile, playlists.salience(profile)))

    def arrange(self, arc: str) -> DataFrame:
        """Clusters in the order of an energy arc."""
        return playlists.apply_arc(playlists.cluster_energy(self.known), arc)

    def summary(self) -> DataFrame:
        return playlists.summary(self.known)

    def recommendations(self, top: int = 5) -> tuple[DataFrame, DataFrame]:
        """The best openers and closers of each cluster."""
        rows = self.tracks.drop("cluster_id").join(self.order.select("cluster_id", "pos"), "pos")
        return sequencing.ranked(rows, self.features, True, top), sequencing.ranked(rows, self.features, False, top)

    def rows(self) -> DataFrame:
        """Tracks in playlist order, with what the renderers need."""
        rows = self.tracks.drop("cluster_id").join(self.order, "pos").join(self.features.select("pos", "camelot_key"), "pos", "left")
        return rows.withColumn("bpm_mean", F.avg("bpm").over(Window.partitionBy("cluster_id")))

    def _names(self) -> DataFrame:
        return self.names if self.names is not None else self.order.select("cluster_id", F.concat(F.lit("Playlist "), "cluster_id").alias("name")).distinct()

    def m3u(self, root: str = "/music/") -> DataFrame:
        return render.m3u(self.rows(), root)

    def cue(self) -> DataFrame:
        return render.cue_sheet(self.rows())

    def rekordbox(self) -> DataFrame:
        return render.rekordbox_xml(self.rows(), self._names())

    def traktor(self) -> DataFrame:
        return render.traktor_nml(self.rows(), self._names())
