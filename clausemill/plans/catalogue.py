"""Imports every query module so that the registry is filled."""

import importlib

from clausemill.plans.registry import ORACLE, QUERIES

for _name in ("text", "structure", "ingest", "retrieval", "answers", "coding", "hierarchy", "layout_boxes", "layout_lines", "operations"):
    importlib.import_module(f"clausemill.plans.q_{_name}")

__all__ = ["ORACLE", "QUERIES"]
