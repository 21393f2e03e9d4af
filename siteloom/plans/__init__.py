"""Registered queries and the SQL that states the same results."""

from __future__ import annotations

import importlib

from siteloom.plans.inputs import reading_once

MODULES = ["pages", "site", "collected", "audit", "extraction", "reports", "sitewide"]


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(importlib.import_module(f"siteloom.plans.{m}"), name).items()}


def queries() -> dict:
    return {k: reading_once(q) for k, q in _all("QUERIES").items()}


def oracle_sql() -> dict:
    return _all("ORACLE_SQL")
