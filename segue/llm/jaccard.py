"""N-gram Jaccard self-join over a token-group matrix.

A document's set holds its distinct word shingles; documents with the same set
are one class. Under one global order of shingles (rare before common, by a
count sketch over all documents, then by hash) two sets of Jaccard similarity
t or more share one of their first floor((1 - t) n) + 1 shingles, so only these
prefixes are exchanged, and of them only shingles that two classes have go on.

Groups: each class is compared with one leader that it shares most prefix
shingles with; classes found similar to their leaders, step by step, form a
group. Matrix: for each group, by size of its members, the union of their shared
prefix shingles. For a query class and another group, the query's prefix
shingles in that union bound the overlap with any of these members; only where
the bound reaches the threshold is the group opened, and those of these members
that themselves share enough prefix shingles with the query are
compared with the query on whole sets. Links inside a group need no opening,
for they cannot change the components. Every link between groups is found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, free_names, table
from ._components import components
from ._exchange import Outbox, exchange, first_of, last_of, likely, schema_of
from ._text import BYTE_CODE, LOWER, Run, mix64, runs, span_hashes, window_hashes

SHINGLE = 5
NUM, DEN = 80, 100

SKETCH_BITS, SLOTS = 23, 64

#: Shingles of member sets that are compared with a leader in one group of rows.
MEMBERS = 200_000

PREFIX = {"tok": "u8", "fp": "i8", "w": "u2", "lead": "i8", "done": "u1"}


class Sets:
    """The shingle sets of a run of texts: 48-bit shingles, sorted within rows."""

    def __init__(self, run: Run, shingle: int = SHINGLE):
        data = LOWER[run.data]
        starts, ends, first = run.words(data)
        words = np.diff(first)
        codes = span_hashes(BYTE_CODE[data], starts, ends) if len(starts) else np.empty(0, np.uint64)
        hashes = window_hashes(codes, shingle)
        row = np.repeat(np.arange(run.rows), words)
        at = np.flatnonzero(row[shingle - 1 :] == row[: len(hashes)]) if len(hashes) else np.empty(0, np.int64)
        few = np.flatnonzero((words > 0) & (words < shingle))
        whole = span_hashes(codes, first[few], first[few + 1], base=0xE7037ED1A0B428DB) if len(few) else np.empty(0, np.uint64)
        tok = np.concatenate([hashes[at], whole]) >> np.uint64(16)
        rows = np.concatenate([row[at], few]).astype(np.uint64)
        key = np.sort(rows << np.uint64(48) | tok)
        if len(key):
            key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        self.row = (key >> np.uint64(48)).astype(np.int64)
        self.tok = key & np.uint64((1 << 48) - 1)
        self.n = np.bincount(self.row, minlength=run.rows)
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def prints(self) -> np.ndarray:
        """A 64-bit name of each row's set, the same for equal sets."""
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(self.tok + np.uint64(1)))])
        return mix64(sums[self.first[1:]] - sums[self.first[:-1]] + self.n.astype(np.uint64)).view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows' set sizes and names; at the end the task's shingle counts (255 at most)."""
    names = ["doc_id", "tkey", "n", "fp", "slot", "counts"]
    counts = np.zeros(1 << SKETCH_BITS, np.uint8)
    for batch in batches:
        for run in runs(batch.column("text")):
            sets = Sets(run)
            cell, c = np.unique(sets.tok >> np.uint64(48 - SKETCH_BITS), return_counts=True)
            counts[cell] = np.minimum(counts[cell].astype(np.int64) + c, 255)
            rows = batch.slice(run.first, run.rows)
            nothing = pa.nulls(run.rows, pa.int32()), pa.nulls(run.rows, pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tkey"), pa.array(sets.n.astype(np.int64)), pa.array(sets.prints()), *nothing], names)
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(SLOTS, -1)]
        void = pa.nulls(SLOTS, pa.int64())
        yield pa.RecordBatch.from_arrays([void, void, void, void, pa.array(range(SLOTS), pa.int32()), pa.array(parts, pa.binary())], names)


def shingle_levels(sketch: DataFrame, shingles: int) -> np.ndarray:
    """How common the shingles of each sketch cell are (0: not uncommonly so).

    The sketch has a fixed number of cells, whatever the input's size; it only
    orders shingles, so a fuller sketch costs time, not links.
    """
    usual = 4 * shingles / (1 << SKETCH_BITS) + 1

    def level(rows: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // SLOTS, np.int64)
        for x in rows.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint8)
        out = np.clip(np.floor(np.log2(np.maximum(total, 1) / usual)) + 1, 0, 15).astype(np.uint8)
        return pa.table({"slot": rows.column("slot").slice(0, 1), "levels": pa.array([out.tobytes()], pa.binary())})

    levels = np.zeros((SLOTS, (1 << SKETCH_BITS) // SLOTS), np.uint8)
    for r in sketch.groupBy("slot").applyInArrow(level, "slot int, levels binary").collect():
        levels[r.slot] = np.frombuffer(r.levels, np.uint8)
    return levels.ravel()


def _combine_prefixes(x: dict) -> tuple[dict, np.ndarray]:
    """One entry per shingle and class. A shingle that two classes of the task
    have is known to be shared: its entries are done, and two of them go on.

    A class's weight is how many of its prefix shingles the task shares; of a
    shingle's classes the heaviest leads, for it is most like the others.
    """
    order = np.lexsort([x["fp"], x["tok"]])
    tok, fp = x["tok"][order], x["fp"][order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (fp[1:] != fp[:-1])
    tok, fp = tok[new], fp[new]
    _, which = np.unique(fp, return_inverse=True)
    shared = fp[first_of(tok)] != fp[last_of(tok)]
    weight = np.bincount(which, weights=shared).astype(np.int64)[which]
    order = np.lexsort([fp, -weight, tok])
    tok, fp, weight, shared = tok[order], fp[order], weight[order], shared[order]
    first, last = first_of(tok), last_of(tok)
    here = np.arange(len(tok))
    edge = shared & ((first == here) | (last == here))
    at = np.concatenate([here, here[edge]])
    fields = {"tok": tok[at], "fp": fp[at], "w": np.minimum(weight[at], 65535), "lead": fp[first][at]}
    fields["done"] = np.concatenate([shared.astype(np.uint8), np.full(int(edge.sum()), 2, np.uint8)])
    spots = mix64(fields["tok"])
    over = fields["done"] == 1
    fields["lead"][~over] = 0  # only those that are done need it; zeros pack well
    spots[over] = mix64(fields["fp"][over].view(np.uint64) + np.uint64(7))
    return {k: fields[k].astype(t) for k, t in PREFIX.items()}, spots


def _shared_prefixes(x: dict) -> pa.Table:
    """(tok, fp, lead): entries of shingles that two classes have."""
    out = {k: x[k][x["done"] == 1] for k in ("tok", "fp", "lead")}
    asked = np.flatnonzero(x["done"] != 1)
    if len(asked):
        order = asked[np.lexsort([x["fp"][asked], x["tok"][asked]])]
        tok, fp = x["tok"][order], x["fp"][order]
        asked = order[fp[first_of(tok)] != fp[last_of(tok)]]
        order = asked[np.lexsort([x["fp"][asked], -x["w"][asked].astype(np.int64), x["tok"][asked]])]
        tok, fp, done = (x[k][order] for k in ("tok", "fp", "done"))
        lead = fp[first_of(tok)] if len(tok) else fp
        # entries that are the shingle's only ones in their task, and the tasks' leaders
        found = (done == 0) | (fp != lead)
        mine = {"tok": tok, "fp": fp, "lead": lead}
        out = {k: np.concatenate([v, mine[k][found]]) for k, v in out.items()}
    return pa.table({k: pa.array(v.astype(np.int64)) for k, v in out.items()})


SHARED = "tok long, fp long, lead long"


def _send_prefixes(buckets: int, levels, num: int, den: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = Outbox({"tok": "u8", "fp": "i8"}, buckets, _combine_prefixes)
        level_of = levels.value
        for batch in batches:
            for run in runs(batch.column("text")):
                sets = Sets(run)
                if not len(sets.tok):
                    continue
                level = level_of[(sets.tok >> np.uint64(48 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
                key = np.sort(sets.row.astype(np.uint64) << np.uint64(52) | level << np.uint64(48) | sets.tok)
                least = -(-num * sets.n // den)
                place = np.arange(len(key)) - np.repeat(sets.first[:-1], sets.n)
                head = place <= np.repeat(sets.n - least, sets.n)
                box.add(tok=key[head] & np.uint64((1 << 48) - 1), fp=sets.prints()[sets.row[head]])
                yield from box.full()
        yield from box.close()

    return work


def _links(num: int, den: int):
    """Rows of one leader and some members to the members that link with it."""

    def work(rows: pa.Table) -> pa.Table:
        lead = rows.column("lead")[0].as_py()
        names = rows.column("fp").to_numpy()
        chosen = np.flatnonzero(names == lead)
        found = []
        if len(chosen):
            text = pa.chunked_array([pa.array([rows.column("text")[int(chosen[0])].as_py()], pa.large_string())])
            own = Sets(next(iter(runs(text)))).tok
            for run in runs(rows.column("text")):
                sets = Sets(run)
                spot = np.minimum(np.searchsorted(own, sets.tok), len(own) - 1)
                both = np.bincount(sets.row[own[spot] == sets.tok], minlength=run.rows)
                near = den * both >= num * (sets.n + len(own) - both)
                found.append(names[run.first : run.first + run.rows][near])
        found = np.concatenate(found) if found else np.empty(0, np.int64)
        found = np.unique(found[found != lead])
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array(np.full(len(found), lead), pa.int64())})

    return work


def compare(pairs: DataFrame, classes: DataFrame, docs: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """(a, b): those of the pairs (fp, lead, n) whose whole sets are similar.

    The members that are to be compared with a leader are dealt to groups of
    about ``MEMBERS`` shingles, and the leader's text goes to each of these.
    """
    load = pairs.groupBy("lead").agg(F.ceil(F.sum("n") / MEMBERS).alias("parts"))
    dealt = pairs.join(load, "lead").select("fp", "lead", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
    asks = dealt.union(dealt.select(F.col("lead").alias("fp"), "lead", "part").distinct())
    asks = scratch.keep(asks.join(classes.select("fp", "rep"), "fp").select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.tkey").alias("tkey"), "fp", "lead", "part"))
    texts = likely(docs, "tkey", asks).join(asks, ["doc_id", "tkey"]).select("fp", "lead", "part", "text")
    return texts.groupBy("lead", "part").applyInArrow(_links(num, den), "a long, b long")


def needed(nq: Column, ns: Column, num: int, den: int) -> Column:
    """Fewest shared prefix shingles of two similar sets of these sizes.

    Similar sets share num (nq + ns) / (num + den) shingles, and of those no
    more than ceil(num n / den) - 1, with n the larger, lie behind the prefixes.
    """
    return F.ceil(F.lit(num) * (nq + ns) / F.lit(num + den)) - F.ceil(F.lit(num) * F.greatest(nq, ns) / F.lit(den)) + 1


def bounds(shared: DataFrame, roots: DataFrame, size: DataFrame, scratch: Scratch, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The token-group matrix at work: the qualifying (fp, n, other, m), and the groups' members.

    The matrix holds, for each group and size m of its members, the union of
    these members' shared prefix shingles. How many of a class's t shingles are
    in it bounds what the class shares with any of them. Where k are needed,
    the k - 1 most frequent can't suffice: the bound reaches k only if one of
    the others is there, so only these look a group up, and to find one there
    is to qualify.
    """
    root = roots.select(F.col("node").alias("fp"), "root")
    step = F.floor(F.log("n") / F.log(F.lit(den / num))).cast("int")  # sizes that can be similar are a step apart at most
    member = scratch.keep(shared.select("tok", "fp").join(root, "fp", "left").select("tok", "fp", F.coalesce("root", "fp").alias("grp")).distinct())
    apart = member.groupBy("tok").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("df")).where("lo < hi").select("tok", "df")
    apart = member.join(apart, "tok").join(size, "fp").withColumn("step", step)
    # spare: most shared shingles that a group may need for this one to be among those that look it up
    mine = Window.partitionBy("fp")
    spare = F.count("*").over(mine) - F.row_number().over(mine.orderBy("df", "tok")) + 1
    apart = scratch.keep(apart.withColumn("spare", spare.cast("int")).drop("df"))
    matrix = scratch.keep(apart.select("tok", F.col("grp").alias("other"), F.col("n").alias("m"), "step").distinct())
    asks = apart.withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    # sizes of the step that fit the class; what they need is least at an end, but for rounding
    edge = lambda k: F.pow(F.lit(den / num), F.col("step") + k)
    low = F.greatest(F.ceil(F.lit(num) * F.col("n") / F.lit(den)), F.floor(edge(0)))
    high = F.least(F.floor(F.lit(den) * F.col("n") / F.lit(num)), F.ceil(edge(1)))
    asks = asks.where(low <= high).where(F.least(needed(F.col("n"), low, num, den), needed(F.col("n"), high, num, den)) - 2 <= F.col("spare"))
    rare = needed(F.col("n"), F.col("m"), num, den) <= F.col("spare")
    close = F.lit(den) * F.least("n", "m") >= F.lit(num) * F.greatest("n", "m")
    both = asks.join(matrix, ["tok", "step"]).where(F.col("grp") != F.col("other")).where(close & rare)
    found = both.select("fp", "n", "other", "m").distinct()
    own = scratch.keep(apart.groupBy("fp").agg(F.first("n").alias("m"), F.first("grp").alias("other"), F.collect_list("tok").alias("toks")))
    return found.join(own.select("fp", "toks"), "fp"), own.select(F.col("fp").alias("lead"), "m", "other", F.col("toks").alias("lead_toks"))


def joined(docs: DataFrame, scratch: Scratch, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, tkey, n, fp, component_id) for every row of (doc_id, tkey, text)."""
    spark = docs.sparkSession
    survey = docs.mapInArrow(_survey, "doc_id long, tkey long, n long, fp long, slot int, counts binary")
    survey = scratch.keep(survey)
    rows = survey.where("slot IS NULL").select("doc_id", "tkey", "n", "fp")
    shingles = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    levels = spark.sparkContext.broadcast(shingle_levels(survey.where("slot IS NOT NULL").select("slot", "counts"), shingles))
    classes = rows.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.min(F.struct("doc_id", "tkey")).alias("rep"))
    classes = scratch.keep(classes)
    size = classes.select("fp", F.col("n").cast("int").alias("n"))

    buckets = max(128, 2 * docs.rdd.getNumPartitions())
    sent = docs.select("text").mapInArrow(_send_prefixes(buckets, levels, num, den), schema_of(PREFIX))
    shared = scratch.keep(exchange(sent, PREFIX, _shared_prefixes, SHARED))

    fits = lambda a, b: F.lit(den) * F.least(a, b) >= F.lit(num) * F.greatest(a, b)
    stars = shared.where("fp <> lead").groupBy("fp", "lead").count()
    stars = stars.join(size, "fp").join(size.select(F.col("fp").alias("lead"), F.col("n").alias("m")), "lead").where(fits(F.col("n"), F.col("m")))
    stars = scratch.keep(stars.groupBy("fp", "n").agg(F.max_by("lead", F.struct("count", "lead")).alias("lead")))
    links = scratch.keep(compare(stars, classes, docs, scratch, num, den))
    roots = scratch.keep(components(links, scratch))

    # classes unlike their leader are compared with the hub of the leader's group
    degree = links.groupBy("b").agg(F.count("*").alias("links")).join(roots, F.col("b") == F.col("node"))
    hubs = degree.groupBy("root").agg(F.max_by("b", F.struct("links", "b")).alias("hub"))
    failed = stars.join(links.select(F.col("a").alias("fp"), F.col("b").alias("lead")), ["fp", "lead"], "left_anti")
    failed = failed.join(roots.withColumnRenamed("node", "lead"), "lead").join(hubs, "root").where("hub <> lead").select("fp", F.col("hub").alias("lead"), "n")
    failed = scratch.keep(failed.join(size.select(F.col("fp").alias("lead"), F.col("n").alias("m")), "lead").where(fits(F.col("n"), F.col("m"))).drop("m"))
    ordered = lambda df: df.select(F.greatest("fp", "lead").alias("fp"), F.least("fp", "lead").alias("lead"))
    tested = ordered(stars).union(ordered(failed))
    if not failed.isEmpty():
        links = scratch.keep(links.union(compare(failed, classes, docs, scratch, num, den)))
        roots = scratch.keep(components(links, scratch))

    seen, members = bounds(shared, roots, size, scratch, num, den)
    # of an opened group, the members that share enough prefix shingles with the class
    enough = F.size(F.array_intersect("toks", "lead_toks")) >= needed(F.col("n"), seen["m"], num, den)
    same = (seen["other"] == members["other"]) & (seen["m"] == members["m"])
    pairs = seen.join(members, same & enough).select("fp", "n", "lead", seen["m"])
    larger = F.when(F.col("fp") > F.col("lead"), F.col("n")).otherwise(F.col("m")).alias("n")
    pairs = pairs.select(F.greatest("fp", "lead").alias("fp"), F.least("fp", "lead").alias("lead"), larger).distinct()
    pairs = scratch.keep(pairs.join(tested, ["fp", "lead"], "left_anti"))
    if not pairs.isEmpty():
        roots = scratch.keep(components(links.union(compare(pairs, classes, docs, scratch, num, den)), scratch))
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.col("rep.doc_id").alias("least"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("fp", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.join(named, "fp", "left").select("doc_id", "tkey", "n", "fp", own.alias("component_id"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.xxhash64(text).alias("tkey"), text.alias("text"))


def _null_id(column: str) -> Column:
    return F.when(F.col(column) != -(1 << 63), F.col(column))


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_id, component_id.

    Links need den * |A and B| >= num * |A or B|. Null, empty and blank texts
    have no shingles and link with nothing: their component is their own id.
    Texts of fewer words than a shingle have one, all their words. Rows that
    are repeated, or share an id, are rows of their own; set_id names the class
    of equal sets (64 bits). A null id counts as the least id and comes out as
    null. Other columns are not read. Texts are never cut.
    """
    scratch = Scratch(docs.sparkSession, "jaccard")
    out = joined(_keyed(docs, id_col, text_col), scratch, num, den)
    return scratch.result(out.select(_null_id("doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("fp").alias("set_id"), _null_id("component_id").alias("component_id")))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents that have their component's id: one of each group of near
    copies. Of equal ids with different texts in one component all stay; texts
    without words stay."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    found = joined(_keyed(docs, id_col, text_col), scratch, num, den)
    kept = found.where("doc_id = component_id").select("doc_id", "tkey").distinct()
    kept = scratch.result(kept)
    did, key = free_names(docs.columns, "kept_id", "kept_key")
    kept = kept.select(F.col("doc_id").alias(did), F.col("tkey").alias(key))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) == F.col(did)) & (F.xxhash64(text) == F.col(key))
    return docs.join(kept, same, "left_semi")


def op1_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("set_id")


QUERIES = {"op1_ngram_jaccard": op1_ngram_jaccard}
ORACLE: dict[str, str] = {}
