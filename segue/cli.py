"""Command line: scan a feature library into playlists, count a folder, import a collection."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from segue.api import Library
from segue.functions import exprs as X
from segue.operators import render
from segue.session import local_session
from segue.sources import audio
from segue.sources import library as L


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="segue")
    sub = out.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan", help="cluster a folder of audio files, or tracks and features (parquet), and write playlists")
    scan.add_argument("folder", help="audio files, or a table of tracks")
    scan.add_argument("features", nargs="?", help="a table of features, if the first is one of tracks")
    scan.add_argument("--cache", help="feature rows of earlier runs (parquet); new ones are added")
    scan.add_argument("--intro", choices=("short", "long"))
    scan.add_argument("--harmonic", action="store_true")
    scan.add_argument("--out")
    size = scan.add_mutually_exclusive_group()
    size.add_argument("--target-tracks", type=int)
    size.add_argument("--target-duration", type=float, help="minutes")
    scan.add_argument("--clusters", type=int)
    scan.add_argument("--by-genre", action="store_true")
    scan.add_argument("--sequence", default="ramp")
    scan.add_argument("--format", choices=("m3u", "cue", "rekordbox", "traktor"), default="m3u")
    scan.add_argument("--dry-run", action="store_true")
    info = sub.add_parser("info", help="count the audio files of a folder by suffix")
    info.add_argument("folder")
    info.add_argument("--format", choices=("text", "json"), default="text")
    load = sub.add_parser("import-rekordbox", help="summarise a collection")
    load.add_argument("file")
    return out


def _library(spark, args) -> Library | None:
    """The tables, or the folder's files, failures told; None where nothing can be analysed."""
    if args.features:
        return Library(spark.read.parquet(args.folder), spark.read.parquet(args.features))
    cache = spark.read.parquet(args.cache) if args.cache and os.path.exists(args.cache) else None
    lib, failed = Library.from_folders(spark, args.folder, cache=cache)
    for r in failed.orderBy("path").toLocalIterator():
        print(f"{r.path}: {r.error or 'not read'}", file=sys.stderr)
    if lib.tracks.isEmpty():
        return None
    if args.cache:
        new = audio.features(spark, args.folder, cache)
        known = new if cache is None else new.join(cache.select("file_hash"), "file_hash", "left_anti")
        known.where("error IS NULL").write.mode("append").parquet(args.cache)
    return lib


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = local_session("segue-cli")
    if args.command == "info":
        counts = L.scan(spark, args.folder).groupBy(X.suffix("path").alias("ext")).agg(F.count("*").alias("n")).orderBy("ext").collect()
        if args.format == "json":
            print(json.dumps({"total": sum(r.n for r in counts), "formats": {r.ext: r.n for r in counts}}))
        else:
            print(f"{sum(r.n for r in counts)} audio files", *(f"  {r.ext}: {r.n}" for r in counts), sep="\n")
    elif args.command == "import-rekordbox":
        rows = L.rekordbox(spark, args.file)
        s = rows.agg(F.count("*").alias("tracks"), F.count("bpm").alias("bpm"), F.sum((F.col("key") != "").cast("int")).alias("keys"), F.sum(F.size("cue_points")).alias("cues")).first()
        print(f"{s.tracks} tracks, {s.bpm} with tempo, {s['keys'] or 0} with key, {s.cues or 0} cue points")
    else:
        lib = _library(spark, args)
        if lib is None:
            print("no audio files that can be analysed", file=sys.stderr)
            return 1
        options = {"k": args.clusters} if args.clusters else {"target_tracks": args.target_tracks or (None if args.target_duration else 25), "target_duration": args.target_duration and args.target_duration * 60}
        lib = lib.cluster_by_genre(**options) if args.by_genre else lib.cluster(**options)
        size = args.target_tracks or 25
        if args.target_duration:
            mean = lib.tracks.agg(F.avg(F.coalesce("duration", F.lit(0.0)))).first()[0] or 1.0
            size = max(1, int(args.target_duration * 60 / max(mean, 1e-9)))
        lib = lib.split(size)
        lib = (lib.arranged(strategy=args.sequence, intro=args.intro, harmonic_order=args.harmonic) if args.intro or args.harmonic else lib.sequence(args.sequence)).name()
        counts = lib.order.groupBy("cluster_id").agg(F.count("*").alias("n")).join(lib.names, "cluster_id", "left").orderBy("cluster_id").collect()
        print(*(f"{r.cluster_id}: {r.name or '-'} ({r.n} tracks)" for r in counts), sep="\n")
        if args.out and not args.dry_run:
            render.write(getattr(lib, args.format)(), args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
