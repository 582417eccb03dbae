"""Mixing sources to target weights by systematic sampling (native SQL only).

Every source gets a target number of words: its share by weight of all words,
held at ``most`` times the source's own words, with what is over reshared by
weight. A document's expected copies are target / source size. Within a source
the expected copies are summed in a fixed order and one random offset is added
to the sums; a document comes out once for each integer that its step crosses.

The order puts documents of like size together (quarter octaves of the size),
so the words taken follow the target closely. A source's rows are dealt to
buckets by size class and salt; only bucket totals are summed over a whole
source, so a source with a third of all rows is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, free_names, table

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash48(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """(skey, source, source_size, n_docs, target) from rows of (skey, source, size).

    Weights go round over the sources by code point, null last. A source is
    held at its cap when its cap is under its share of what is left; caps are
    met in the order of cap by weight, so one pass of running sums finds them.
    """
    per = sizes.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(names) - 1, F.lit(len(weights)))
    per = per.withColumn("turn", F.row_number().over(names)).withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    )
    caps = Window.orderBy(F.col("source_size") / F.col("w"), "turn")
    before, after = caps.rowsBetween(Window.unboundedPreceding, -1), caps.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
        .withColumn("left", F.lit(float(share)) * F.sum("source_size").over(whole) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("level", F.col("left") / F.sum("w").over(after))
        .withColumn("open_level", F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")))
        .withColumn("fill", F.first("open_level", ignorenulls=True).over(caps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("fill") * F.col("w"), F.col("cap")))
    return per.select("skey", "source", "source_size", "n_docs", target.cast("double").alias("target"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1, 2, 3),
    most: float = 3.0,
    share: float = 1.0,
    seed: int = 7,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    Null and empty texts have size 0 and take no words; a null source is a
    source of its own. Rows that are repeated are sampled each for itself. A
    source whose texts are all empty has target 0 and no copies. Columns other
    than the three named are not read, so their names cannot clash. An empty
    table gives an empty result. ``seed`` fixes the offsets: reruns agree.
    Columns to ``carry`` come along, under their own names.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
    )
    rows = scratch.keep(rows).withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("~")))
    targets = scratch.keep(source_targets(rows, weights, most, share)).drop("source")

    placed = (
        rows.join(targets, "skey")
        .withColumn("step", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0))
        .withColumn("spot", _hash48(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        .withColumn("size_class", F.floor(F.log2(F.col("size") + 1.5) * 4).cast("int"))
        .withColumn("salt", F.pmod("spot", F.ceil(F.sqrt(F.col("n_docs").cast("double")))).cast("long"))
    )
    bucket = ["skey", "size_class", "salt"]
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("skey").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*bucket, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("ahead"))

    inside = Window.partitionBy(*bucket).orderBy("size", "spot", "doc_id", *[F.col("carried")[c] for c in carry])
    offset = _hash48(F.concat(F.lit(f"{seed}|"), "skey")) % F.lit(1 << 20) / F.lit(float(1 << 20))
    crossed = lambda k: F.floor(k * F.col("step") + F.col("u"))
    out = (
        placed.withColumn("rank", F.row_number().over(inside))
        .join(offsets, bucket)
        .withColumn("k", F.col("ahead") + F.col("rank"))
        .withColumn("u", offset)
        .withColumn("copies", F.least(crossed(F.col("k")) - crossed(F.col("k") - 1), F.ceil(F.lit(float(most)))).cast("long"))
        .select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *[F.col("carried")[c].alias(c) for c in carry])
    )
    return scratch.result(out)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Rows are told apart by all their columns (128 bits), so rows that share an
    id are taken each for itself, and rows that are the same in every column
    together as often as all of them are. Null ids, texts and sources are as in
    ``mix``; column names may be any. An empty table stays empty.
    """
    kinds = dict(docs.dtypes)
    cells = [F.map_entries(c) if kinds[c].startswith("map") else F.col(c) for c in docs.columns]
    low, high, copies, n = free_names(docs.columns, "row_low", "row_high", "copies", "rows")
    keyed = docs.withColumn(low, F.xxhash64(*cells)).withColumn(high, F.xxhash64(F.lit(1), *reversed(cells)))
    chosen = mix(keyed, carry=(low, high), **options).groupBy(low, high).agg(F.sum("copies").alias(copies), F.count("*").alias(n))
    both = keyed.join(chosen.where(F.col(copies) > 0), [low, high])
    once = both.where(F.col(n) == 1).unionByName(both.where(F.col(n) > 1).dropDuplicates([low, high]))
    return once.withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op5_mix_sources": op5_mix_sources}

ORACLE = {
    "op5_mix_sources": r"""
WITH rows AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, source, coalesce('=' || source, '~') AS skey,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
per AS (
  SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs FROM rows GROUP BY skey),
weighed AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) AS turn FROM per),
w AS (SELECT *, CAST((turn - 1) % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM weighed),
run AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - 3.0::DOUBLE * CAST(coalesce(sum(source_size) OVER (ORDER BY source_size / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS left_over,
    sum(w) OVER (ORDER BY source_size / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after FROM w),
lvl AS (SELECT *, left_over / w_after AS level FROM run),
fill AS (SELECT level AS fill FROM lvl WHERE cap >= level * w ORDER BY source_size / w, turn LIMIT 1),
targets AS (SELECT lvl.*, least(cap, coalesce((SELECT fill FROM fill) * w, cap)) AS target FROM lvl),
placed AS (
  SELECT doc_id, rows.source, size, skey, source_size, n_docs, target,
    CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS step,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS spot
  FROM rows JOIN targets USING (skey)),
ordered AS (
  SELECT *, CAST('0x' || substr(md5('7|' || skey), 1, 12) AS BIGINT) % 1048576 / 1048576.0::DOUBLE AS u,
    row_number() OVER (PARTITION BY skey ORDER BY CAST(floor(log2(size + 1.5::DOUBLE) * 4) AS INT), spot % CAST(ceil(sqrt(n_docs)) AS BIGINT), size, spot, doc_id) AS k
  FROM placed),
taken AS (SELECT *, CAST(least(floor(k * step + u) - floor((k - 1) * step + u), 3) AS BIGINT) AS copies FROM ordered)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM taken
"""
}
