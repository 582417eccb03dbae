"""Embedding near-copies by NN-descent on a neighbour graph.

Only vectors of one label (and length) are compared. Equal vectors are one
node. First lists come from random hyperplanes: the nodes of a cell, dealt to
parts of bounded size, are compared with each other. Then the graph is refined:
the neighbours of a node, in either direction, are compared with each other,
and each node keeps the best it has met. A list is saturated when all its
entries reach the threshold; such lists may grow. A component of the threshold
graph whose lists link all its nodes with each other is settled by them; where
lists are full or have gaps, the component's nodes are compared all with all
in tiles, so links in groups of any size are counted without listing them. What a
comparison joins stays joined outside the lists (its bridges), so full lists
part no component. An
audit compares a bounded sample of nodes with all rows. Its recall is a mean over
nodes, taken for nodes of few links and for others each; while either is under
the goal, new hyperplanes are added, and at last whole labels are compared in
tiles where it is under the goal still. Where no audited node has a few links,
recall can't be seen, and whole labels are compared at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._components import components
from ._vectors import blob_column, from_blobs, matrix_parts

THRESHOLD = 0.93

#: Neighbours in a list; in a saturated one; hyperplane tables a round; refinements a round; rounds.
NEAR, NEAR_FULL, TABLES, TURNS, ROUNDS = 8, 32, 12, 2, 3

#: Nodes of a cell, nodes compared at once, audited nodes, and the recall that the audit asks for.
CELL, TILE, AUDIT, GOAL = 64, 512, 400, 0.99

#: Centres whose neighbours are compared in one group of rows, about.
CENTRES = 1000

#: Audited nodes that should have a few links; so many times the audited nodes are taken where fewer have.
LINKED, MORE = 100, 8

EDGE = "u long, v long, s double, bridge boolean"


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors that can link, scaled to length one."""
    for batch in batches:
        for rows, x in matrix_parts(batch.column("embedding")):
            x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
            norm = np.sqrt((x * x).sum(axis=1))
            good = norm > 0.5
            rows, x = rows[good], x[good] / norm[good, None]
            kept = [batch.column(k).take(pa.array(rows)) for k in ("rid", "vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(len(rows), x.shape[1], np.int32)), blob_column(x)], ["rid", "vec_id", "label", "width", "x"])


def _codes(seed: int):
    """One row per hyperplane table and node, with the node's cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths, bits = (batch.column(k).to_numpy().astype(np.int64) for k in ("width", "bits"))
            for width in np.unique(widths).tolist():
                at = np.flatnonzero(widths == width)
                part = batch.take(pa.array(at))
                x = from_blobs(part.column("x"))
                for t in range(TABLES):
                    planes = np.random.default_rng([seed, t, width]).normal(size=(width, 40))
                    code = ((x @ planes > 0) * (1 << np.arange(40))).sum(axis=1) & ((1 << bits[at]) - 1)
                    yield pa.RecordBatch.from_arrays([part.column("nid"), part.column("grp"), pa.array(np.full(len(at), t, np.int32)), pa.array(code)], ["nid", "grp", "t", "code"])

    return work


def _best(s: np.ndarray, ids: np.ndarray, worst: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of similarities the ``most`` greatest that beat ``worst``."""
    most = min(most, s.shape[1] - 1)
    if most < 1:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    top = np.argpartition(-s, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(s, top, axis=1)
    good = value > worst[:, None]
    return np.repeat(ids, good.sum(axis=1)), ids[top[good]], value[good]


def _joined(hit: np.ndarray) -> np.ndarray:
    """Of each node of a stack of symmetric graphs, the least node that it is joined to."""
    n = hit.shape[-1]
    least = np.broadcast_to(np.arange(n), hit.shape[:-1])
    while True:
        near = np.minimum(least, np.where(hit, least[..., None, :], n).min(axis=-1, initial=n))
        near = np.take_along_axis(near, near, axis=-1)
        if np.array_equal(near, least):
            return least
        least = near


def _star(hit: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from nodes to the least node that they are joined to; of all that ``hit`` joins."""
    some = np.flatnonzero(hit.any(axis=1))
    least = _joined(hit[np.ix_(some, some)])
    far = least != np.arange(len(some))
    return ids[some[far]], ids[some[least[far]]]


def _edges(found: list, joined: list) -> pa.Table:
    """Found (u, v, s) for the lists, and (u, v) that are joined."""
    none = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    u, v, s = (np.concatenate(c) for c in zip(none, *found, *((a, b, np.full(len(a), np.nan)) for a, b in joined), strict=True))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s, pa.float64()), "bridge": pa.array(np.isnan(s))})


def _cell(threshold: float):
    def work(rows: pa.Table) -> pa.Table:
        ids, x = rows.column("nid").to_numpy(), from_blobs(rows.column("x"))
        found, joined = [], []
        for at in range(0, len(ids), TILE):  # a part is about TILE; in any case bounded
            some = slice(at, at + TILE)
            sim = x[some] @ x[some].T
            np.fill_diagonal(sim, -2)
            found.append(_best(sim, ids[some], np.full(len(sim), -1.5), 4))
            joined.append(_star(sim >= threshold, ids[some]))
        return _edges(found, joined)

    return work


def _local(threshold: float):
    """Neighbours of each centre, compared with each other."""

    def work(rows: pa.Table) -> pa.Table:
        centre, ids, worst = (rows.column(k).to_numpy() for k in ("centre", "nid", "worst"))
        order = np.argsort(centre, kind="stable")
        centre, ids, worst = centre[order], ids[order], worst[order]
        x = from_blobs(rows.column("x").take(pa.array(order)))
        heads = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
        size = np.diff(np.append(heads, len(centre)))
        found, joined = [], []
        for n in np.unique(size[size > 1]).tolist():
            for some in np.array_split(heads[size == n], max(1, int((size == n).sum()) * n // 20_000)):
                at = some[:, None] + np.arange(n)
                sim = x[at] @ x[at].transpose(0, 2, 1)
                sim[:, np.arange(n), np.arange(n)] = -2
                best = sim.argmax(axis=2)
                value = np.take_along_axis(sim, best[:, :, None], axis=2)[:, :, 0]
                good = value > worst[at] + 1e-12
                found.append((ids[at][good], ids[np.take_along_axis(at, best, axis=1)][good], value[good]))
                hit = sim >= threshold
                hit |= hit.transpose(0, 2, 1)
                full = hit.any(axis=(1, 2))
                least = _joined(hit[full])
                far = least != np.arange(n)
                joined.append((ids[at[full]][far], ids[np.take_along_axis(at[full], least, axis=1)][far]))
        return _edges(found, joined)

    return work


def _tile(threshold: float):
    """Links between two tiles of a component (or within one), counted for each node."""

    def work(rows: pa.Table) -> pa.Table:
        ids, mult, tile = (rows.column(k).to_numpy() for k in ("nid", "mult", "tile"))
        x = from_blobs(rows.column("x"))
        kinds = np.unique(tile)
        a = np.flatnonzero(tile == kinds[0])
        b = np.flatnonzero(tile == kinds[-1])
        links = np.zeros(len(ids), np.int64)
        for at in range(0, len(a), TILE):
            some = a[at : at + TILE]
            hit = x[some] @ x[b].T >= threshold
            hit &= ids[some][:, None] != ids[b][None, :]
            links[some] += hit @ mult[b]
            if len(kinds) > 1:
                links[b] += mult[some] @ hit
        return pa.table({"nid": pa.array(ids, pa.int64()), "links": pa.array(links)})

    return work


def _tile_joins(threshold: float):
    """What the links between two tiles (or within one) join."""

    def work(rows: pa.Table) -> pa.Table:
        ids, x = rows.column("nid").to_numpy(), from_blobs(rows.column("x"))
        hit = x @ x.T >= threshold
        np.fill_diagonal(hit, False)
        hit |= hit.T
        u, v = _star(hit, ids)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return work


def _in_tiles(members: DataFrame, key: str) -> DataFrame:
    """Each pair of tiles (lo, hi) of the nodes with one key, with their nodes."""
    tiles = members.groupBy(key).agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    members = members.join(tiles, key).withColumn("tile", F.pmod(F.xxhash64("nid"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    return members.withColumn("other", other).withColumn("lo", F.least("tile", "other")).withColumn("hi", F.greatest("tile", "other"))


def _trim(edges: DataFrame, threshold: float) -> DataFrame:
    """Each node's best neighbours; saturated lists keep more."""
    order = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    ranked = edges.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= NEAR_FULL)
    return ranked.where((F.col("r") <= NEAR) | (F.col("s") >= threshold)).drop("r")


def _audit(shared, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, int] = {}
        for batch in batches:
            groups, mult, ids = (batch.column(k).to_numpy() for k in ("grp", "mult", "nid"))
            for grp, asked, x in shared.value:
                at = np.flatnonzero(groups == grp)
                for lo in range(0, len(at), TILE):
                    some = at[lo : lo + TILE]
                    hit = x @ from_blobs(batch.column("x").take(pa.array(some))).T >= threshold
                    hit &= asked[:, None] != ids[some][None, :]
                    rows, columns = np.nonzero(hit)
                    for k, n in zip(asked.tolist(), np.bincount(rows, weights=mult[some][columns], minlength=len(asked)).astype(np.int64).tolist(), strict=True):
                        found[k] = found.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["nid", "true"])

    return work


def near_copies(vectors: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Cosines are of doubles; no link is below the threshold. Rows whose label is
    null, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing: they are kept, alone in their component.
    Equal vectors of one label link with each other. Rows that share an id are
    rows of their own. A null id counts as the least id and comes out null.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "descent")
    rows = vectors.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding")
    ).withColumn("rid", F.monotonically_increasing_id())
    rows = scratch.keep(rows)
    valid = rows.where("label IS NOT NULL").mapInArrow(_valid, "rid long, vec_id long, label string, width int, x binary")
    valid = scratch.keep(valid.withColumn("grp", F.xxhash64("label", "width")))
    nodes = valid.groupBy("grp", "x").agg(F.count("*").alias("mult"), F.min("rid").alias("nid"), F.min("vec_id").alias("least"), F.first("width").alias("width"))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("size"))
    bits = F.greatest(F.lit(1), F.least(F.lit(40), F.ceil(F.log2(F.col("size") / CELL)))).cast("int")
    nodes = scratch.keep(nodes.join(sizes, "grp").withColumn("bits", bits))

    def audited(n: int) -> DataFrame:
        picked = nodes.orderBy(F.xxhash64("nid")).limit(n).select("grp", "nid", "x").collect()
        by_group: dict[int, list] = {}
        for r in picked:
            by_group.setdefault(r.grp, []).append(r)
        asked = [(g, np.array([r.nid for r in rs]), np.frombuffer(b"".join(r.x for r in rs)).reshape(len(rs), -1)) for g, rs in sorted(by_group.items())]
        found = nodes.mapInArrow(_audit(spark.sparkContext.broadcast(asked), threshold), "nid long, true long").groupBy("nid").agg(F.sum("true").alias("true"))
        return scratch.keep(found.where(F.col("true") > 0).withColumn("few", F.col("true") <= NEAR_FULL))

    truth, whole = audited(AUDIT), nodes.count()
    if truth.where("few").count() < LINKED and whole > AUDIT:
        truth = audited(MORE * AUDIT)
    unseen = truth.where("few").isEmpty() and whole > MORE * AUDIT

    graph, bridges = None, []

    def taken(df: DataFrame) -> DataFrame:
        """The edges for the lists; what is joined is put aside."""
        edges = scratch.keep(df)
        bridges.append(edges.where("bridge").select("u", "v"))
        return edges.where("NOT bridge").select("u", "v", "s")

    for turn in range(ROUNDS):
        codes = scratch.keep(nodes.mapInArrow(_codes(turn), "nid long, grp long, t int, code long"))
        cell = ["t", "grp", "code"]
        parts = codes.groupBy(*cell).agg(F.ceil(F.count("*") / TILE).alias("parts")).where("parts >= 1")
        dealt = codes.join(parts, cell).withColumn("part", F.pmod(F.xxhash64("nid", "t"), F.col("parts")))
        first = taken(dealt.join(nodes.select("nid", "x"), "nid").groupBy(*cell, "part").applyInArrow(_cell(threshold), EDGE))
        graph = scratch.keep(_trim(first if graph is None else first.union(graph), threshold))
        for _ in range(TURNS):
            worst = graph.groupBy("u").agg(F.when(F.count("*") >= NEAR, F.min("s")).otherwise(F.lit(-1.0)).alias("worst"))
            both = graph.select(F.col("u").alias("centre"), F.col("v").alias("nid"), "s").union(graph.select(F.col("v").alias("centre"), F.col("u").alias("nid"), "s"))
            most = Window.partitionBy("centre").orderBy(F.desc("s"), "nid")
            both = both.distinct().withColumn("r", F.row_number().over(most)).where(F.col("r") <= 2 * NEAR).select("centre", "nid")
            members = nodes.select("nid", "x").join(worst, nodes["nid"] == worst["u"], "left").select("nid", "x", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
            packs = F.pmod(F.xxhash64("centre"), F.lit(max(8, -(-whole // CENTRES))))
            met = taken(both.join(members, "nid").withColumn("pack", packs).groupBy("pack").applyInArrow(_local(threshold), EDGE))
            graph = scratch.keep(_trim(graph.union(met), threshold))
        near = graph.where(F.col("s") >= threshold).select("u", "v")
        for more in bridges:
            near = near.union(more)
        near = scratch.keep(near.distinct())
        roots = scratch.keep(components(near, scratch))
        # a component whose lists link all its nodes with each other is settled; others have full lists or gaps, and are compared in tiles
        pairs = graph.where(F.col("s") >= threshold).select(F.least("u", "v").alias("node"), F.greatest("u", "v").alias("other")).distinct()
        pairs = pairs.join(roots, "node").groupBy("root").agg(F.count("*").alias("pairs"))
        members = scratch.keep(roots.withColumnRenamed("node", "nid").join(nodes.select("nid", "mult"), "nid"))
        found = members.groupBy("root").agg(F.count("*").alias("size"), F.sum("mult").alias("all")).join(pairs, "root", "left")
        found = found.select("root", "all", F.coalesce(F.col("pairs") * 2 == F.col("size") * (F.col("size") - 1), F.lit(False)).alias("settled"))
        members = scratch.keep(members.join(found, "root"))
        tiled = members.where("NOT settled").select("root", "nid", "mult").join(nodes.select("nid", "x"), "nid")
        counted = _in_tiles(tiled, "root").groupBy("root", "lo", "hi").applyInArrow(_tile(threshold), "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))
        counted = scratch.keep(counted.union(members.where("settled").select("nid", F.col("all") - F.col("mult"))))
        share = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
        recall = {r.few: r.recall for r in truth.join(counted, "nid", "left").groupBy("few").agg(F.avg(share).alias("recall")).collect()}
        if unseen or all(x >= GOAL for x in recall.values()):
            break
    if unseen or any(x < GOAL for x in recall.values()):  # the exact way: all pairs of a label
        pairs = _in_tiles(nodes.select("grp", "nid", "x", "mult"), "grp")
        roots = scratch.keep(components(scratch.keep(pairs.groupBy("grp", "lo", "hi").applyInArrow(_tile_joins(threshold), "u long, v long").distinct()), scratch))
        counted = pairs.groupBy("grp", "lo", "hi").applyInArrow(_tile(threshold), "nid long, links long").groupBy("nid").agg(F.sum("links").alias("links"))
        counted = scratch.keep(counted)

    named = nodes.join(roots.withColumnRenamed("node", "nid"), "nid", "left").join(counted, "nid", "left")
    named = named.select("grp", "x", "least", F.coalesce("root", "nid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("grp", "x", "n_links", "component_id")
    linked = valid.join(named, ["grp", "x"]).select("rid", "n_links", "component_id")
    out = rows.select("rid", "vec_id").join(linked, "rid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    null_id = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    return scratch.result(out.select(null_id("vec_id"), "n_links", null_id("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept")))


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding_dedup": op2_embedding_dedup}

ORACLE: dict[str, str] = {}
