"""Music-library views over the driver's tables, and the same views as SQL.

Each text runs unchanged on Spark and on DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

_F = [
    ("rms_energy", 7919, 62), ("brightness", 6101, 87), ("sub_bass_energy", 4409, 44), ("kick_energy", 3571, 79), ("bass_harmonics", 2741, 25),
    ("percussiveness", 1999, 59), ("onset_strength", 8117, 66), ("dynamic_range", 1301, 40), ("drop_density", 941, 68), ("spectral_flatness", 617, 35),
    ("zero_crossing_rate", 431, 43), ("mfcc_variance", 277, 83), ("spectral_rolloff_85", 151, 54), ("vocal_presence", 5227, 86),
]

VIEWS = {
    "tracks": """
SELECT CAST(p_partkey AS BIGINT) AS pos,
 concat('/music/', p_brand, '/', p_type, '/t', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 0 THEN '.flac' WHEN 1 THEN '.mp3' WHEN 2 THEN '.wav' ELSE '.OGG' END) AS path,
 CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 80 + CAST((p_partkey * 37) % 1000 AS DOUBLE) / 10 END AS bpm,
 CASE WHEN p_partkey % 31 = 0 THEN NULL ELSE CAST(120 + (p_partkey * 53) % 361 AS DOUBLE) END AS duration,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS artist,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS title,
 CASE p_type WHEN 'ECONOMY' THEN 'Techno' WHEN 'SMALL' THEN 'house' WHEN 'MEDIUM' THEN ' ambient ' WHEN 'PROMO' THEN 'DnB' WHEN 'STANDARD' THEN 'Rock' ELSE NULL END AS genre,
 p_brand AS cluster_id FROM part""",
    "features": "SELECT CAST(p_partkey AS BIGINT) AS pos, "
    + ", ".join(f"CAST((p_partkey * {a} + {b}) % 1009 AS DOUBLE) / 1009 AS {name}" for name, a, b in _F)
    + """,
 CAST((p_partkey * 733) % 2001 - 1000 AS DOUBLE) / 1000 AS energy_gradient,
 CAST((p_partkey * 89) % 64 AS DOUBLE) AS intro_length_secs,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat(CAST((p_partkey * 7) % 12 + 1 AS STRING), CASE WHEN p_partkey % 5 < 2 THEN 'A' ELSE 'B' END) END AS camelot_key
 FROM part WHERE p_partkey % 23 <> 0""",
    "history": "SELECT user_id AS pos, count(*) AS times_used, CAST(max(ts) AS DATE) AS last_used FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "frames": "SELECT user_id AS pos, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, value / 1000 AS rms FROM events",
    "tags": "SELECT CAST(p_partkey AS BIGINT) AS pos, split_part(p_name, ' ', 1) AS tag FROM part UNION SELECT CAST(p_partkey AS BIGINT), split_part(p_name, ' ', 2) FROM part",
    "track_locations": "SELECT o_orderkey AS id, concat('/music/o', CAST(o_orderkey AS STRING)) AS location, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS fs_deleted FROM orders",
    "library": "SELECT o_orderkey + 1000000 AS id, o_orderkey AS location, CAST(o_custkey % 6 AS INT) AS rating, CAST(o_custkey % 40 AS INT) AS timesplayed, o_orderdate AS last_played_at, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE 44100 END AS samplerate, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS mixxx_deleted, o_totalprice / 1000 AS bpm FROM orders",
    "cues": "SELECT l_orderkey + 1000000 AS track_id, l_linenumber AS hotcue, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS type, CAST(l_quantity * 44100 AS BIGINT) AS position, l_linestatus AS label FROM lineitem",
    "chroma": "SELECT vec_id AS pos, embedding FROM embeddings",
}

SOURCE = {"tracks": "part", "features": "part", "history": "events", "frames": "events", "tags": "part", "track_locations": "orders", "library": "orders", "cues": "lineitem", "chroma": "embeddings"}

AS_OF = "2024-01-31"


class Views:
    """The views of one data folder, each read when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        text = VIEWS[name].replace(f"FROM {SOURCE[name]}", "FROM {source}")
        return self.spark.sql(text, source=self.table(SOURCE[name]))

    @cached_property
    def known(self) -> DataFrame:
        """Tracks with their features."""
        return self.tracks.join(self.features, "pos")


def with_views(sql: str) -> str:
    """The DuckDB text with the views it names put before it."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body
