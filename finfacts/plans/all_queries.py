"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

MODULES = ["q_rank", "q_sector", "q_statements", "q_ingest", "q_company", "q_delta", "q_extra"]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"finfacts.plans.{m}")
