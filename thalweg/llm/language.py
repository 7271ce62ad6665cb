"""Language of web pages by Bayesian fusion of evidence.

log P(language | page) adds up the likelihood of the text (character trigrams), of the language that the markup
declares, of the address (top-level domain and language code of the path), and a prior of the host that is smoothed
towards its domain and that towards all pages.  How far declarations and addresses are to be believed, and the priors,
come from grouped aggregation over all pages, with the language of the text alone as the first guess.
"""

from __future__ import annotations

import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined, saved, table
from .hashing import mix
from .html import extract

#: Cells of the trigram model for up to so many languages; of more languages, each has fewer cells, so that the model that
#: is broadcast keeps its size.
CELL_BITS, LANGUAGES = 16, 256
#: Hosts, declarations and suffixes up to this many are broadcast, more are joined by a shuffle.
BROADCAST_VALUES = 200_000
#: Trigrams overlap: the text counts as if it had this share of them, and at most so many.
TEXT_SHARE, TEXT_MOST = 0.2, 200
#: Pseudo-counts: of trigrams, of evidence values, of a domain's prior in its host's and of all pages' in the domain's.
ALPHA_GRAM, ALPHA_VALUE, ALPHA_HOST, ALPHA_DOMAIN = 0.5, 1.0, 5.0, 20.0
_U = np.uint64
_DECLARED = re.compile(r"""<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_META = re.compile(r"""<meta\b[^>]*?http-equiv\s*=\s*["']?content-language["']?[^>]*?content\s*=\s*["']?([A-Za-z]{2,3})""", re.I)
_PATH = re.compile(r"^/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:/|$)")


def cells(text: str, bits: int = CELL_BITS) -> np.ndarray:
    """The cells of the character trigrams of a text, in lower case."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32).astype(_U)
    if len(points) < 3:
        return np.zeros(0, np.int64)
    return (mix((points[:-2] << _U(42)) ^ (points[1:-1] << _U(21)) ^ points[2:]) >> _U(64 - bits)).astype(np.int64)


def _counted(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = total.setdefault(lang, np.zeros(1 << CELL_BITS, np.int64))
            np.add.at(own, cells(text), 1)
    for lang, own in total.items():
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], ["lang", "cell", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods of trigram cells, counted over all texts with a language."""
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(_counted, "lang string, cell int, n long")
    counts = rows.groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = saved(counts, "trigrams")
    names = sorted(r[0] for r in counts.select("lang").distinct().collect())  # languages, not documents
    bits = CELL_BITS - max(0, (max(1, len(names)) - 1) // LANGUAGES).bit_length()
    if bits < CELL_BITS:
        counts = counts.groupBy("lang", F.shiftright("cell", CELL_BITS - bits).alias("cell")).agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # LANGUAGES * 2**CELL_BITS rows at most
    model = np.full((max(1, len(names)), 1 << bits), ALPHA_GRAM)
    lang = pc.index_in(found["lang"], pa.array(names, pa.string())).to_numpy()
    np.add.at(model, (lang, found["cell"].to_numpy()), found["n"].to_numpy())
    return names, np.log(model / model.sum(axis=1, keepdims=True)).astype(np.float32)


def address(url: str | None) -> tuple[str, str, str]:
    """(host, domain, suffix) of a URL; the suffix is the last label and the path's language code."""
    try:
        parts = urlsplit((url or "") if "://" in (url or "") else f"http://{url or ''}")
        host = (parts.hostname or "").lower()
    except ValueError:
        return "", "", ""
    labels = host.split(".")
    code = _PATH.match(parts.path)
    return host, ".".join(labels[-2:]), f"{labels[-1]}/{code[1].lower() if code else ''}"


def _evidence(batches, model, n):
    bits = model.value.shape[1].bit_length() - 1
    for batch in batches:
        rows = {"host": [], "domain": [], "suffix": [], "declared": [], "text_score": []}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host, domain, suffix = address(url)
            found = _DECLARED.search(page or "") or _META.search(page or "")
            own = cells(text, bits) if (text := extract(page)) else ()
            score = model.value[:, own].mean(axis=1).astype(float) * min(TEXT_MOST, TEXT_SHARE * len(own)) if len(own) else np.zeros(n)
            for k, v in (("host", host), ("domain", domain), ("suffix", suffix), ("declared", found[1].lower() if found else ""), ("text_score", score.tolist())):
                rows[k].append(v)
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), *[pa.array(rows[k], pa.string()) for k in ("host", "domain", "suffix", "declared")], pa.array(rows["text_score"], pa.list_(pa.float64()))],
            ["page_id", "url", "host", "domain", "suffix", "declared", "text_score"],
        )


def _tally(rows: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """Counts of the first guesses of each group, as an array by language."""
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.when(F.col("guess") == i, 1.0).otherwise(0.0)) for i in range(n)]).alias(name))


def _best(scores: Column) -> Column:
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def identify(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """The language of every page: page_id, url, lang, posterior, text_lang, declared, suffix, host.

    Args: pages with ``page_id``, ``url`` and ``html``; labelled texts with ``lang`` and ``text``.

    Defined cases: null or empty html says nothing, so that address and host decide; a null url has the empty host;
    equal scores go to the first language by name; repeated rows are judged alike, and each counts in the priors; an
    empty table of pages gives no rows; without labelled rows lang is null; other columns are ignored.
    """
    names, model = train(labelled)
    n = len(names)
    if not n:
        return pages.select("page_id", "url", *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("posterior", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"))])
    shared = pages.sparkSession.sparkContext.broadcast(model)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), "html").mapInArrow(
        lambda b: _evidence(b, shared, n), f"page_id {kind}, url string, host string, domain string, suffix string, declared string, text_score array<double>"
    )
    rows = saved(rows.withColumn("guess", _best(F.col("text_score"))), "evidence")
    everywhere = rows.agg(F.count("*").alias("n"), *[F.sum((F.col("guess") == i).cast("double")).alias(f"g{i}") for i in range(n)]).first()
    base = F.array(*[F.lit(((everywhere[f"g{i}"] or 0.0) + 1.0) / (everywhere["n"] + n)) for i in range(n)])
    totals = F.array(*[F.lit(float(everywhere[f"g{i}"] or 0.0)) for i in range(n)])

    def smooth(counts: Column, prior: Column, alpha: float) -> Column:
        size = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, prior, lambda c, p: (c + F.lit(alpha) * p) / (size + F.lit(alpha)))

    # A value's likelihood under each language: how often pages of that language have it.
    likely = lambda counts: F.zip_with(counts, totals, lambda c, t: (c + ALPHA_VALUE) / (t + 2 * n * ALPHA_VALUE))
    domains = _tally(rows, ["domain"], n, "c").select("domain", smooth(F.col("c"), base, ALPHA_DOMAIN).alias("domain_prior"))
    hosts = _tally(rows, ["host", "domain"], n, "c").join(domains, "domain").select("host", smooth(F.col("c"), F.col("domain_prior"), ALPHA_HOST).alias("prior"))
    declared = _tally(rows, ["declared"], n, "c").select("declared", likely(F.col("c")).alias("by_declared"))
    suffixes = _tally(rows, ["suffix"], n, "c").select("suffix", likely(F.col("c")).alias("by_suffix"))
    fused = rows
    for side, key in ((hosts, "host"), (declared, "declared"), (suffixes, "suffix")):
        fused = joined(fused, saved(side, key), key, BROADCAST_VALUES)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + F.log(y))
    fused = fused.withColumn("score", add(add(add(F.col("text_score"), F.col("prior")), F.col("by_declared")), F.col("by_suffix")))
    top = F.array_max("score")
    name = F.array(*[F.lit(x) for x in names])
    return fused.select(
        "page_id", "url", name[_best(F.col("score"))].alias("lang"),
        (F.lit(1.0) / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("posterior"),
        F.when(F.array_min("text_score") != F.array_max("text_score"), name[F.col("guess")]).alias("text_lang"), "declared", "suffix", "host",
    )


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


QUERIES = {"op5_language": op5_language}
#: Held-out accuracy is tested.
ORACLES: dict[str, str] = {}
