"""Toxicity of texts by logistic regression, learnt with FTRL-proximal over hashed words, word pairs and skip pairs.

Every coordinate has a rate of its own and an L1 threshold, so that most weights are zero and the others, few and of a
bounded number, are broadcast for scoring.  A feature is there or not: what a text repeats counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table
from .hashing import chunks, mix, word_hashes

#: Features are hashed into so many cells, which bounds the model: 16 bytes a cell while it is learnt.
BITS = 20
#: Labelled rows that the model is learnt from, at most: those with the smallest hashes of their ids.
SAMPLE = 12_000
#: Passes over the sample.
EPOCHS = 3
#: Rates are ALPHA / (BETA + root of the sum of squared gradients); L1 sets small weights to zero, L2 pulls them there.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 8.0, 0.0
#: Beginnings of words, in bytes, that are features beside the whole word, whatever ending follows.
STEMS = (4, 5, 6)
_U = np.uint64
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = 0x20


def features(column: pa.Array, bits: int = BITS):
    """For each text the cells of its words, stems, pairs of neighbours and of words with one between, with repeats.

    Words are runs of anything but white space and ASCII punctuation, A-Z folded.
    """
    shift = _U(64 - bits)
    for _, data, offsets in chunks(column):
        data = _BLANK[data]
        words, starts, ends, rows = word_hashes(data, offsets)
        stems = [mix(_stem(data, starts, ends, k) + _U(k)) for k in STEMS]
        near, skip = (mix(words[:-k] * _U(0xC2B2AE3D27D4EB4F) + words[k:] + _U(k)) if len(words) > k else words[:0] for k in (1, 2))
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            own = [mix(words[a:b]), *[s[a:b] for s in stems], near[a : max(a, b - 1)], skip[a : max(a, b - 2)]]
            yield (np.concatenate(own) >> shift).astype(np.int64)


def _stem(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The first k bytes of each word as a number, A-Z folded; shorter words are themselves."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    padded[(padded >= 0x41) & (padded <= 0x5A)] += 0x20
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    keep = (_U(1) << (_U(8) * np.minimum(ends - starts, k).astype(_U))) - _U(1)
    return mix((eight[starts] & keep) + _U(0x51ED270B))


class Ftrl:
    """The state of FTRL-proximal: z and n of every cell, the last one being the constant."""

    def __init__(self, cells: int, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros(cells + 1) if z is None else z
        self.n = np.zeros(cells + 1) if n is None else n

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, cells: np.ndarray, label: int) -> None:
        """One step: ``cells`` are those of one text."""
        at = np.append(np.unique(cells), len(self.z) - 1)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _learnt(batches, state, bits):
    model = Ftrl(1 << bits) if state is None else Ftrl(1 << bits, *(x.copy() for x in state.value))
    for batch in batches:
        for cells, label in zip(features(batch.column("text"), bits), batch.column("label").to_pylist(), strict=True):
            model.learn(cells, label)
    at = np.flatnonzero(model.n)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(model.z[at]), pa.array(model.n[at])], ["cell", "z", "n"])


def train(labelled: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray | None:
    """The weights of all cells and the constant, learnt from ``labelled`` (key, text, label 0 or 1); None without rows.

    At most ``sample`` rows are learnt from, those with the smallest hashes of their keys; rows go one by one through a
    single task in that order, which holds the state and one batch.
    """
    order = [F.xxhash64(F.lit("toxicity"), "key"), F.xxhash64("text"), "label"]
    rows = saved(labelled.orderBy(*order).limit(sample).select("key", "text", "label"), "labelled")
    if not rows.take(1):
        return None
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    ordered, state = rows.coalesce(1).sortWithinPartitions(*order).select("text", "label"), None
    for _ in range(epochs):
        found = ordered.mapInArrow(lambda b, s=state: _learnt(b, s, bits), "cell long, z double, n double").toArrow()  # at most 2**bits + 1 rows
        z[found["cell"].to_numpy()], n[found["cell"].to_numpy()] = found["z"].to_numpy(), found["n"].to_numpy()
        if state is not None:
            state.destroy()
        state = rows.sparkSession.sparkContext.broadcast((z, n))
    if state is not None:
        state.destroy()
    return Ftrl(1 << bits, z, n).weights()


def _scored(batches, model, bits):
    cells, few = model.value
    weights = np.zeros((1 << bits) + 1)
    weights[cells] = few
    for batch in batches:
        out = []
        for cells in features(batch.column("text"), bits):
            at = np.unique(cells[weights[cells] != 0.0])
            out.append(1.0 / (1.0 + np.exp(-np.clip(weights[at].sum() + weights[-1], -35.0, 35.0))))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out, pa.float64())], ["doc_id", "held_out", "score"])


def held_out(doc_id: Column) -> Column:
    """If the id is one that is never learnt from: crc32 of it as text divides by five; a null id is an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The toxicity of every document: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on).

    Args: docs with ``doc_id`` and ``text``; labels with ``doc_id`` and ``toxic``.  Rows held out are not learnt from.

    Defined cases: null and empty texts have the constant only; labels other than 0 and 1 and those without a document
    teach nothing; a null doc_id has no label and is held out; repeated rows of either table are examples each;
    without any example all scores are 0; very long texts count in full, each feature once; an empty table of documents
    gives no rows; other columns are ignored.
    """
    taught = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("key"), F.col("toxic").cast("int").alias("label"))
    # Of the labels alone, the bounded sample is small enough to meet the documents by a broadcast.
    few = taught.join(docs.select(F.col("doc_id").alias("key")), "key", "left_semi").orderBy(F.xxhash64(F.lit("toxicity"), "key"), "label").limit(sample)
    texts = docs.select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    weights = train(texts.join(F.broadcast(saved(few, "taught")), "key"), sample)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    if weights is None:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    kept = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((kept, weights[kept]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda b: _scored(b, model, BITS), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_toxicity": op11_toxicity}
#: Held-out accuracy is tested, and one step against the published formulas.
ORACLES: dict[str, str] = {}
