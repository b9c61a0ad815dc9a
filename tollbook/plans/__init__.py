"""Derived tables and the named analyses."""

from tollbook.plans import cases, context, people, spending, studies, tooling  # noqa: F401  (register results)
from tollbook.plans.catalog_of_results import RESULTS
from tollbook.plans.workspace import Workspace

__all__ = ["RESULTS", "Workspace"]
