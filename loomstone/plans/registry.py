"""All registered queries of the library proper and their SQL counterparts."""

from __future__ import annotations

from loomstone.plans import codec, files, language, metrics, packing, relational, representations, results, schedule, sources, streams, text, vectors

MODULES = (text, metrics, packing, codec, representations, relational, schedule, results, sources, files, vectors, streams, language)

QUERIES = {name: f for m in MODULES for name, f in m.plans.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.plans.oracles.items()}
FLAGSHIP = "language_token_entropy"
