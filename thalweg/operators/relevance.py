"""Layer-wise relevance (L*)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import forward

#: Pre-activations that carry relevance and are smaller than this make a message undefined.
LEAST = 1e-12


def physical_head(components: DataFrame, scaler: DataFrame, output: str, sign: float = 1.0) -> DataFrame:
    """L1: weights of components on a physical output, w = weight * scale, and its offset (pca mean * scale + centre)."""
    both = components.join(scaler, output)
    return both.select(output, "component", (sign * F.col("weight") * F.col("scale")).alias("w"), (sign * (F.col("mean") * F.col("scale") + F.col("centre"))).alias("offset"))


def physical_value(scores: DataFrame, head: DataFrame, sample: str, output: str) -> DataFrame:
    """Sum of score * w, plus the offset."""
    return scores.join(head, "component").groupBy(sample, output).agg((F.sum(F.col("score") * F.col("w")) + F.max("offset")).alias("value"))


def message(relevance: Column, z: Column, epsilon: float = 0.0) -> Column:
    """Relevance over pre-activation, stabilised by epsilon; zero relevance sends nothing, a vanishing z is an error."""
    if epsilon:
        return relevance / (z + epsilon * F.when(z >= 0, 1.0).otherwise(-1.0))
    failed = F.raise_error(F.lit("an active pre-activation vanishes")).cast("double")
    return F.when(relevance == 0, 0.0).when(F.abs(z) <= LEAST, failed).otherwise(relevance / z)


def layer_relevance(df: DataFrame, weights: DataFrame, sample: str, epsilon: float = 0.0) -> DataFrame:
    """L3 for one dense layer on arrays: (sample, relevance) of inputs from (sample, x, z, relevance of outputs).

    weights: (unit, out, w), settings-sized.
    """
    rows = weights.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("out", "w"))), lambda o: o["w"]).alias("w"))
    packed = rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("unit", "w"))), lambda u: u["w"]).alias("__w"))
    sent = df.withColumn("__m", F.zip_with("relevance", "z", lambda r, z: message(r, z, epsilon))).crossJoin(F.broadcast(packed))
    back = F.transform("__w", lambda w: F.aggregate(F.zip_with("__m", w, lambda m, v: m * v), F.lit(0.0), lambda a, v: a + v))
    return sent.select(*df.columns, "__m", F.zip_with("x", back, lambda v, m: v * m).alias("back")).withColumnRenamed("__m", "message")


def conservation(df: DataFrame, weights: DataFrame, bias: DataFrame, sample: str, epsilon: float = 0.0) -> DataFrame:
    """L4: relevance of outputs, of inputs, taken by biases and by epsilon, and what remains (zero but for rounding)."""
    packed = bias.agg(F.transform(F.array_sort(F.collect_list(F.struct("out", "b"))), lambda o: o["b"]).alias("__b"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    sent = layer_relevance(df, weights, sample, epsilon).crossJoin(F.broadcast(packed))
    sent = sent.withColumns({
        "outputs": total(F.col("relevance")), "inputs": total(F.col("back")), "biases": total(F.zip_with("message", "__b", lambda m, b: m * b)),
        "absorbed": total(F.zip_with("message", "z", lambda m, z: m * epsilon * F.when(z >= 0, 1.0).otherwise(-1.0))),
    })
    return sent.select(sample, "outputs", "inputs", "biases", "absorbed", (F.col("outputs") - F.col("inputs") - F.col("biases") - F.col("absorbed")).alias("remainder"))


def _backward(x, ws, bs, skip, head, epsilon, kind):
    """Relevance of inputs, share of biases and remainder for each row; a stack with a skip from the first z."""

    def over(r, z):
        if epsilon:
            return r / (z + epsilon * np.where(z >= 0, 1.0, -1.0))
        bad = (np.abs(z) <= LEAST) & (r != 0)
        if bad.any():
            raise ValueError("an active pre-activation vanishes")
        return np.divide(r, z, out=np.zeros_like(r), where=r != 0)

    _, zs, hs = forward(x, (ws, bs, skip), kind)
    deep, direct = zs[-1] * head, (zs[0] @ skip) * head
    out, bias = deep.sum(axis=1) + direct.sum(axis=1), np.zeros(len(x))
    r = deep
    first = zs[0] * (over(direct, zs[0] @ skip) @ skip.T)
    for k in range(len(ws) - 1, -1, -1):
        if k == 0:
            r = r + first
        m = over(r, zs[k])
        bias += m @ bs[k]
        r = hs[k] * (m @ ws[k].T)
    return r, bias, out - r.sum(axis=1) - bias, out


def explain(rows: DataFrame, networks: Sequence[tuple], key: str, head: Sequence[float], epsilon: float = 0.0, kind: str = "swish") -> DataFrame:
    """Relevance of every input for every member: (key, member, relevance) with diagnostics.

    ``networks``: (member, weights, biases, skip) as arrays, an ensemble of settings size; rows come in batches.
    """
    shared = rows.sparkSession.sparkContext.broadcast((list(networks), np.array(head, float)))

    def run(batches):
        nets, top = shared.value
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), float)
            for member, ws, bs, skip in nets:
                r, bias, rest, out = _backward(x, ws, bs, skip, top, epsilon, kind)
                yield pd.DataFrame({key: pdf[key], "member": member, "relevance": list(r), "bias": bias, "remainder": rest, "output": out})

    kind_of = rows.schema[key].dataType.simpleString()
    return rows.select(key, "x").mapInPandas(run, f"`{key}` {kind_of}, member int, relevance array<double>, bias double, remainder double, output double")
