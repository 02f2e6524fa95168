"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["bitplane", "quantised_pairs", "secret_linking", "cross_parsing", "simhash_bk", "bpe_piece", "winnowing", "weak_toxicity", "attention_quality", "html_wrappers"]


def _collected(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"chronolith.llm.{name}"), kind)
    return out


def queries() -> dict:
    return _collected("QUERIES")


def oracles() -> dict:
    return _collected("ORACLES")
