"""Quality classifier by compression.

Two zstandard dictionaries are trained, one from good and one from bad
labelled texts. A text that the good dictionary compresses better than the bad
one is likelier good: the difference of the two compressed sizes, as a share
of the text's bytes (damped for short texts), becomes a probability by a
logistic fit on further labelled texts that neither dictionary has seen. Long
texts are compressed in pieces, each against the dictionaries anew, so that
every part of a text counts alike.

The fit uses a bounded sample of labelled rows (``DICTIONARY_ROWS`` a class,
``CALIBRATION_ROWS`` more, in hash order, none above ``SAMPLE_BYTES``, ``LABEL_BYTES`` in all); its
rows alone reach the driver. Scores come from every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DICTIONARY_BYTES = 512 << 10
DICTIONARY_ROWS = 2500
CALIBRATION_ROWS = 4000
SAMPLE_BYTES = 64 << 10
#: Bytes of all texts of a label that the fit may use: what reaches the driver is twice this at most.
LABEL_BYTES = 64 << 20
#: A piece has at most so many bytes: far less than the compressor's window, beyond which no dictionary is seen.
PIECE_BYTES = 64 << 10
LEVEL = 3
SEGMENT, DMER = 1000, 8
#: Differences of this size count in full; larger ones by their logarithm, so that outliers don't steer the fit.
UNIT = 0.01
#: Bytes added to every length: a few odd words weigh less in a short text.
DAMPING = 200
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Two dictionaries and the calibration ``1 / (1 + exp(-(slope * x + offset)))``
    of ``x = asinh(difference / UNIT)``."""

    good: bytes
    bad: bytes
    slope: float
    offset: float

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            trained = zstandard.ZstdCompressionDict(data)
            trained.precompute_compress(level=LEVEL)
            out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=False,
                                                write_checksum=False, write_dict_id=False))
        return out


def held_out(doc_id: Column) -> Column:
    """Rows kept from the fit: crc32 of the id as text is divisible by 5; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _pieces(text: bytes | pa.Buffer) -> Iterator[memoryview]:
    """The whole text in pieces, cut behind the last white space that fits (or at full size, if there is none)."""
    view, at = memoryview(text), 0
    while len(view) - at > PIECE_BYTES:
        piece = bytes(view[at:at + PIECE_BYTES])
        size = max(piece.rfind(c) for c in (b" ", b"\n", b"\t", b"\r")) + 1 or PIECE_BYTES
        yield view[at:at + size]
        at += size
    yield view[at:]


def _difference(compressors: list[zstandard.ZstdCompressor], text: bytes | pa.Buffer) -> float:
    good = bad = 0
    for piece in _pieces(text):
        good += len(compressors[0].compress(piece))
        bad += len(compressors[1].compress(piece))
    return float(np.arcsinh((bad - good) / (len(text) + DAMPING) / UNIT))


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or plain content where the sample is too small to train on."""
    total = sum(map(len, texts))
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(total // 4, 1024)), texts,
                                          k=SEGMENT, d=DMER).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICTIONARY_BYTES] or b"\n" * 8


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method, lightly regularised."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-4])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + ridge @ w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame) -> dict[int, list[bytes]]:
    """Labelled texts for the fit by label, in hash order."""
    marked = (labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
              .groupBy("id").agg(F.max("label").alias("label"), F.min("label").alias("least"))
              .where("label = least").withColumn("order", F.xxhash64("id", F.lit("quality"))))
    rows = DICTIONARY_ROWS + CALIBRATION_ROWS
    # a bounded number of ids a label
    chosen = [marked.where(F.col("label") == v).orderBy("order", "id").limit(rows) for v in (0, 1)]
    ids = chosen[0].union(chosen[1]).select("id", "label", "order")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= SAMPLE_BYTES)
    # one row an id, however often it is repeated, and a bounded number of bytes a label
    found = (texts.join(F.broadcast(ids), texts.doc_id == F.col("id")).where("text != ''")
             .groupBy("label", "order", "id").agg(F.min("text").alias("text")))
    held = F.sum(F.octet_length("text")).over(Window.partitionBy("label").orderBy("order", "id")
                                              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("held", held).where(F.col("held") <= LABEL_BYTES)
    rows = sorted(tuple(r) for r in found.select("label", "order", "id", "text").collect())
    return {v: [text.encode() for label, _, _, text in rows if label == v] for v in (0, 1)}


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """Train from ``labels.quality``; with one label missing, that label's share as a constant score."""
    share = _sample(docs, labels)
    if not share[0] or not share[1]:
        return 1.0 if share[1] else 0.0 if share[0] else 0.5
    marked = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    prior = marked.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    cut = {v: min(DICTIONARY_ROWS, max(1, 2 * len(share[v]) // 3)) for v in share}
    made = {v: _dictionary(share[v][:cut[v]]) for v in share}
    rest = {v: share[v][cut[v]:] or share[v] for v in share}
    compressors = Model(made[1], made[0], 0.0, 0.0).compressors()
    x = np.array([_difference(compressors, t) for v in (0, 1) for t in rest[v]])
    y = np.array([v for v in (0, 1) for _ in rest[v]], float)
    slope, offset = _logistic(x, y)
    # from the sample's share of good texts to the labels' own
    mean = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    return Model(made[1], made[0], slope, offset + np.log(prior / (1 - prior)) - np.log(mean / (1 - mean)))


def _scorer(model, at: int, keep: list[int]):
    """Score column ``at`` of each batch; ``keep``: the columns that go out before the score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Model(*model.value)
        compressors = fitted.compressors()
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary()).fill_null(b"")
            x = np.array([_difference(compressors, t.as_buffer()) if t.as_buffer().size else 0.0 for t in texts])
            chance = 1 / (1 + np.exp(-np.clip(fitted.slope * x + fitted.offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(chance, pa.float64())],
                                             [*(batch.schema.names[i] for i in keep), "score"])

    return run


def score(docs: DataFrame, model: Model | float, keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``score`` (double, 0 to 1), from the whole text alone.

    Null texts count as empty; empty texts get the score of no difference. A
    column of ``docs`` that is called ``score`` is replaced. No rows, no rows.
    """
    docs = docs.drop("score").withColumn("text", F.col("text").cast("string"))
    names = [c for c in docs.columns if keep_text or c != "text"]
    if isinstance(model, float):
        return docs.select(*names, F.lit(model).alias("score"))
    # plain values: executors need no copy of this package
    shared = docs.sparkSession.sparkContext.broadcast(astuple(model))
    keep = [docs.columns.index(c) for c in names]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(_scorer(shared, docs.columns.index("text"), keep), f"{schema}, score double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``THRESHOLD`` on)."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return score(rows, model, keep_text=False).select("doc_id", "held_out", "score",
                                     F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with their own columns."""
    return score(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select(*docs.columns)
