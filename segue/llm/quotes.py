"""Chat formatting by quotation linking.

A line's quote level is the number of ``>`` at its start, blanks between them
allowed. Consecutive lines of one level above 0 are a quoted passage. Passages
and their lines are normalised (lower case, white space runs as one blank, ends
trimmed) and hashed, and meet, in their conversation, the hashes of unquoted
paragraphs, lines and whole bodies of earlier messages. A passage belongs to
the latest earlier message that has it; failing that, each of its lines does.
A message replies to the message that its passages name most, of equals the
latest. Threads follow replies; within a thread the order of turns is an order
of replies, for a reply comes after what it answers.

Who had a text last is found by a running maximum over turns, first over
buckets of turns and then within each, so a line that every message quotes is
met in linear work, over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, table

#: Turns in a bucket of the running maximum.
SPAN = 256

MARKS = r"^(?:[ \t]*>)+"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    """Lines as (level, body): quote marks, and one blank after them, are gone."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    marks = lambda x: F.regexp_extract(x, MARKS, 0)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    body = lambda x: F.when(level(x) > 0, F.regexp_replace(x, MARKS + " ?", "")).otherwise(x)
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), body(x).alias("body")))


def _own(lines: Column) -> Column:
    """The unquoted text; what quotes leave behind at its ends is trimmed."""
    text = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.regexp_replace(text, r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")


def _units(text: Column) -> Column:
    """Hashes of a body, its paragraphs and its lines, those that aren't blank."""
    cut = F.concat(F.array(text), F.split(text, r"\n[ \t]*\n"), F.split(text, "\n"))
    return F.array_distinct(F.transform(F.filter(F.transform(cut, normal), lambda x: x != ""), lambda x: F.xxhash64(x)))


def _last_before(asks: DataFrame, has: DataFrame) -> DataFrame:
    """asks (conv, hash, turn, ...) with ``source``: the latest earlier turn of has (conv, hash, turn)."""
    key = ["conv", "hash"]
    has = has.join(asks.select(*key).distinct(), key, "left_semi").groupBy(*key, "turn").agg(F.lit(1).alias("one")).drop("one")
    both = asks.withColumn("given", F.lit(None).cast("long")).unionByName(has.withColumn("given", F.col("turn")), allowMissingColumns=True)
    both = both.withColumn("span", F.floor(F.col("turn") / SPAN))
    spans = both.groupBy(*key, "span").agg(F.max("given").alias("top"))
    earlier = Window.partitionBy(*key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*key, "span", F.max("top").over(earlier).alias("carried"))
    inside = Window.partitionBy(*key, "span").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("near", F.max("given").over(inside)).where("rid IS NOT NULL").join(spans, [*key, "span"])
    return both.withColumn("source", F.coalesce("near", "carried")).drop("near", "carried", "given", "span")


def link(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, role, body, n_quotes, n_linked, reply_to, thread, depth, place.

    body is the text without quotes. reply_to is a turn of the same conversation
    or null; thread is the turn that its thread of replies began with, depth the
    number of replies from there. place counts a conversation's messages in reply
    order: by thread, then turn, then role and body; null where thread is. Messages of a null conversation or turn are
    parsed but not linked. Where rows share a turn, what they quote is found in
    all of them, and replies to that turn follow the thread of the least. Null
    and empty texts have an empty body and no quotes. Other columns aren't read.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), _lines(F.col(text_col).cast("string")).alias("lines")
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.keep(rows.withColumn("body", _own(F.col("lines"))).withColumn("quotes", F.exists("lines", lambda x: x["level"] > 0)))

    quoted = rows.where("quotes").select("rid", "conv", "turn", F.posexplode("lines").alias("at", "line")).select("rid", "conv", "turn", "at", "line.*")
    runs = Window.partitionBy("rid", "level").orderBy("at")
    quoted = quoted.withColumn("run", F.col("at") - F.row_number().over(runs)).where("level > 0")
    passages = quoted.groupBy("rid", "conv", "turn", "level", "run").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("lines"))
    bodies = F.transform("lines", lambda x: x["body"])
    passages = passages.select("rid", "conv", "turn", F.xxhash64("level", "run").alias("passage"), normal(F.array_join(bodies, "\n")).alias("whole"), F.filter(F.transform(bodies, normal), lambda x: x != "").alias("parts"))
    passages = scratch.keep(passages.where("whole <> ''"))
    unit = F.explode(F.concat(F.array(F.struct(F.lit(True).alias("all"), F.xxhash64("whole").alias("hash"))), F.transform("parts", lambda x: F.struct(F.lit(False).alias("all"), F.xxhash64(x).alias("hash")))))
    asks = passages.where("conv IS NOT NULL AND turn IS NOT NULL").select("rid", "conv", "turn", "passage", unit.alias("u")).select("rid", "conv", "turn", "passage", "u.all", "u.hash")
    has = rows.where("conv IS NOT NULL AND turn IS NOT NULL").select("conv", "turn", F.explode(_units(F.col("body"))).alias("hash"))
    links = _last_before(asks, has).where("source IS NOT NULL")
    best = links.groupBy("rid", "conv", "passage", "source").agg(F.max("all").alias("all"), F.count("*").alias("n"))
    best = best.groupBy("rid", "conv", "passage").agg(F.max_by("source", F.struct("all", "n", "source")).alias("source"))
    votes = best.groupBy("rid", "source").agg(F.count("*").alias("n")).groupBy("rid").agg(F.sum("n").alias("n_linked"), F.max_by("source", F.struct("n", "source")).alias("reply_to"))
    counts = passages.groupBy("rid").agg(F.count("*").alias("n_quotes"))
    out = rows.join(counts, "rid", "left").join(votes, "rid", "left")
    out = scratch.keep(out.select("rid", "conv", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to"))

    # threads: each turn points to what it answers; pointers are doubled until all are at their beginning
    hop = out.where("reply_to IS NOT NULL").groupBy("conv", "turn").agg(F.min("reply_to").alias("to")).withColumn("steps", F.lit(1).cast("long"))
    hop = scratch.keep(hop)
    while True:
        onward = hop.select("conv", F.col("turn").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        joined = hop.join(onward, ["conv", "to"], "left")
        after = scratch.keep(joined.select("conv", "turn", F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("to2").isNotNull().alias("moved")))
        hop = after.drop("moved")
        if after.where("moved").isEmpty():
            break
    hop = hop.select("conv", F.col("turn").alias("reply_to"), F.col("to"), "steps")
    out = out.join(hop, ["conv", "reply_to"], "left")
    thread = F.coalesce("to", "reply_to", "turn").alias("thread")
    depth = F.when(F.col("reply_to").isNull(), 0).otherwise(F.coalesce("steps", F.lit(0)) + 1).cast("long").alias("depth")
    out = scratch.keep(out.select(F.col("conv").alias("conv_id"), "turn", "role", "body", "n_quotes", "n_linked", "reply_to", thread, depth))
    return scratch.result(_placed(out))


def _placed(linked: DataFrame) -> DataFrame:
    """Messages with their place; only counts of spans of threads are summed over a whole conversation."""
    span, known = F.floor(F.col("thread") / SPAN), F.col("conv_id").isNotNull() & F.col("thread").isNotNull()
    rows = linked.where(known).withColumn("span", span)
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select("conv_id", "span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("conv_id", "span").orderBy("thread", "turn", "role", "body")
    rows = rows.withColumn("place", F.row_number().over(inside)).join(ahead, ["conv_id", "span"]).withColumn("place", F.col("place") + F.col("ahead"))
    return rows.drop("span", "ahead").unionByName(linked.where(~known).withColumn("place", F.lit(None).cast("long")))


def op4_chat_format(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


QUERIES = {"op4_chat_format": op4_chat_format}
ORACLE: dict[str, str] = {}
