"""The corpus queries and their SQL."""

from __future__ import annotations

from . import centroids, decontam, html, jaccard, language, linededup, mixing, quality, repair, repeats, sharding, toxicity, warc

_MODULES = (centroids, decontam, html, jaccard, language, linededup, mixing, quality, repair, repeats, sharding, toxicity, warc)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
