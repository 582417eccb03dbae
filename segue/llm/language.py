"""Language identification by averaged hashed subword embeddings.

Subwords are the byte n-grams of a text's words, case folded for A-Z, with one
blank at either side of a word; what is no letter counts as a blank. Each falls
into one of 2**16 rows of an embedding table; a text's mean row goes through a
linear softmax. Table and softmax are trained by stochastic gradient descent on
a bounded sample of labelled texts; scores are made probabilities by a
temperature fitted on a part of the sample that the descent has not seen, and a
text whose score is lower than nearly all of that part's is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import table
from ._text import BYTE_CODE, LOWER, Run, runs, window_hashes

GRAMS = (3, 4)
ROWS_BITS = 16
UNKNOWN = "und"

#: Bounds of the training sample: texts in all, and bytes of a text.
SAMPLE, SAMPLE_TEXT = 2000, 20_000

#: Languages whose counts are broadcast, at most.
FEW_LANGUAGES = 10_000

LETTERS = np.full(256, 32, np.uint8)
LETTERS[65:91] = LETTERS[97:123] = np.arange(97, 123)
LETTERS[128:] = np.arange(128, 256)


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # table rows, already multiplied by the softmax where that is narrower
    linear: np.ndarray
    bias: np.ndarray
    heat: float = 1.0
    reject_below: float = 0.0

    def scores(self, run: Run) -> np.ndarray:
        """Class probabilities of each row of a run."""
        sums, counts = subword_sums(run, self.rows)
        logits = (sums / np.maximum(counts, 1)[:, None]) @ self.linear + self.bias
        return softmax(logits / self.heat)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def subwords(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all subwords of a run, and the text that each is in."""
    data = np.insert(LETTERS[run.data], run.offsets, 32)
    row = np.repeat(np.arange(run.rows), np.diff(run.offsets) + 1)
    codes, blank = BYTE_CODE[data], data == 32
    spots, owners = [], []
    for n in GRAMS:
        count = len(data) - n + 1
        if count <= 0:
            continue
        good = ~blank[1 : 1 + count]
        for k in range(2, n - 1):
            good &= ~blank[k : k + count]
        at = np.flatnonzero(good)
        spots.append((window_hashes(codes, n)[at] >> np.uint64(64 - ROWS_BITS)).astype(np.int64))
        owners.append(row[np.minimum(at, len(row) - 1)])
    if not spots:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(spots), np.concatenate(owners)


def subword_sums(run: Run, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spots, owners = subwords(run)
    counts = np.bincount(owners, minlength=run.rows)
    sums = np.empty((run.rows, rows.shape[1]))
    for k in range(rows.shape[1]):
        sums[:, k] = np.bincount(owners, weights=rows[:, k][spots], minlength=run.rows)
    return sums, counts


def train(texts: list[str], labels: list[str], *, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> Model:
    """Descent on two thirds of the texts, calibration on the rest."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    table_ = rng.normal(0, 0.1, (1 << ROWS_BITS, width)).astype(np.float32)
    linear, bias = np.zeros((width, len(names))), np.zeros(len(names))
    wanted = np.array([names.index(x) for x in labels])
    docs = []
    for run in runs(pa.array(texts, pa.large_string()), chunk=1 << 18):
        spots, owners = subwords(run)
        order = np.argsort(owners, kind="stable")
        cuts = np.searchsorted(owners[order], np.arange(run.rows + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # kept narrow, for the driver holds them all
            distinct, times = np.unique(spots[order[a:b]], return_counts=True)
            docs.append((distinct.astype(np.uint16), times.astype(np.float32)))
    order = rng.permutation(len(docs))
    fit, check = order[len(order) // 3 :], order[: len(order) // 3]
    for turn in range(epochs):
        step = rate * (1 - turn / epochs)
        for at in range(0, len(fit), 16):
            some = [k for k in fit[at : at + 16] if len(docs[k][0])]
            if not some:
                continue
            spots = np.concatenate([docs[k][0] for k in some])
            share = np.concatenate([docs[k][1] / docs[k][1].sum() for k in some])
            heads = np.cumsum([0, *(len(docs[k][0]) for k in some[:-1])])
            mean = np.add.reduceat(table_[spots] * share[:, None], heads)
            error = softmax(mean @ linear + bias)
            error[np.arange(len(some)), wanted[some]] -= 1
            back = error @ linear.T
            linear -= step * mean.T @ error
            bias -= step * error.mean(axis=0)
            sizes = np.diff(np.append(heads, len(spots)))
            np.subtract.at(table_, spots, (step * 40 * share[:, None] * np.repeat(back, sizes, axis=0)).astype(np.float32))
        rng.shuffle(fit)
    model = Model(names, table_ @ linear if len(names) <= width else table_, np.eye(len(names)) if len(names) <= width else linear, bias)
    held = [k for k in check if len(docs[k][0])]
    if held:
        mean = np.stack([(model.rows[docs[k][0]] * docs[k][1][:, None]).sum(axis=0) / docs[k][1].sum() for k in held])
        logits = mean @ model.linear + bias
        loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), wanted[held]] + 1e-12).mean()
        model.heat = min((2.0**k for k in np.arange(-3, 3.25, 0.25)), key=loss)
        scores = softmax(logits / model.heat).max(axis=1)
        model.reject_below = float(0.5 * min(np.quantile(scores, 0.002), 1.0))
    return model


def held_out(id_col: Column, mod: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % mod == rest, F.lit(False))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", mod: int = 4, rest: int = 2) -> Model:
    """A model of the labelled texts that are not held out.

    It learns from ``SAMPLE`` texts at most, an equal share for each language,
    of up to ``SAMPLE_TEXT`` bytes, chosen by a hash of id and text.
    """
    text = F.col(text_col).cast("string")
    rows = docs.where(~held_out(F.col(id_col), mod, rest)).select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(1 << 62)).alias("spot"))
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL").where(F.octet_length("text").between(1, SAMPLE_TEXT))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return Model([UNKNOWN], np.zeros((1 << ROWS_BITS, 1)), np.eye(1), np.zeros(1))
    counts = F.broadcast(counts) if languages <= FEW_LANGUAGES else counts
    cut = F.greatest(F.least(F.lit(1.0), F.lit(1.2 * SAMPLE / languages) / F.col("n")), F.lit(1e-9)) * (1 << 62)
    spots = [r.spot for r in rows.select("lang", "spot").join(counts, "lang").where(F.col("spot") < cut).orderBy("spot").limit(2 * SAMPLE).select("spot").collect()]
    some = rows.where(F.col("spot").isin(spots)) if spots else rows.orderBy("spot")
    chosen = some.limit(2 * SAMPLE).select("text", "lang", "spot").collect()
    chosen.sort(key=lambda r: (r.spot, r.lang, r.text))
    return train([r.text for r in chosen], [r.lang for r in chosen])


def has_letter(run: Run) -> np.ndarray:
    """Whether each row of a run has a letter of any script."""
    low = LOWER[run.data]
    upto = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])[run.offsets]
    found = np.diff(upto) > 0
    for r in np.flatnonzero(~found).tolist():
        found[r] = any(map(str.isalpha, run.text(r).decode("utf-8", "ignore")))
    return found


def _predict(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        names = np.array(m.languages, object)
        for batch in batches:
            spot = batch.schema.names.index("_text")
            for run in runs(batch.column(spot)):
                p = m.scores(run)
                best = p.argmax(axis=1)
                score = p[np.arange(run.rows), best]
                lettered = has_letter(run)
                lang = np.where(lettered, names[best], UNKNOWN)
                score = np.where(lettered, score, 0.0)
                rows = batch.slice(run.first, run.rows)
                columns = [rows.column(k) for k in range(rows.num_columns) if k != spot]
                kept = [x for x in rows.schema.names if x != "_text"]
                out = [pa.array(lang, pa.string()), pa.array(score), pa.array(~lettered | (score < m.reject_below))]
                yield pa.RecordBatch.from_arrays([*columns, *out], [*kept, "lang_pred", "score", "rejected"])

    return work


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", mod: int = 4, rest: int = 2) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, rejected.

    Null texts and texts without a letter are ``und`` with score 0, and are
    rejected; so are texts whose score is under the calibrated bound. Only the
    id and the text are read. Whole texts count, in whatever length. Repeated
    rows come out as often as they came in; a null id is never held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col), mod, rest).alias("held_out"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents that identification does not reject, with all their columns.

    Texts that are null, empty or without a letter go, and those whose score is
    under the calibrated bound. Columns of any names stay as they are; repeated
    rows are judged alike, each for itself. An empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, spot = docs.schema, docs.columns.index(text_col)
    names = [f"c{k}" for k in range(len(docs.columns))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predict(shared)
        for batch in batches:
            given = pa.RecordBatch.from_arrays([*batch.columns, batch.column(spot)], [*names, "_text"])
            for done in predict(iter([given])):
                done = done.filter(pa.array(~done.column("rejected").to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(done.columns[: len(names)], batch.schema.names)

    return docs.mapInArrow(work, schema)


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


QUERIES = {"op8_language_id": op8_language_id}
ORACLE: dict[str, str] = {}
