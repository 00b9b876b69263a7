"""Operations of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

#: Modules that register queries, by operator number.
MODULES = ("langid", "quality", "warc", "toxicity", "ann", "chat", "bpe", "decontam", "neardup", "sharding", "fim", "divergence", "lm")


def registry() -> tuple[dict, dict]:
    """Queries and their SQL, of all modules."""
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"{__name__}.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
