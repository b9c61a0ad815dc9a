"""Running many named results: several at a time, each written on its own."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from tollbook.plans.catalog_of_results import RESULTS
from tollbook.plans.workspace import Workspace
from tollbook.sources.results import write_result


def select(only: list[str] | None = None) -> list[str]:
    """Result names in order, all or those that start with one of ``only``."""
    return [n for n in sorted(RESULTS) if not only or any(n.startswith(p) for p in only)]


def run_all(ws: Workspace, folder: str, only: list[str] | None = None, parallel: int = 8) -> list[dict]:
    """Write every selected result below ``folder``. A result that fails is reported and does
    not stop the others. Results are independent jobs, so several are submitted at once and
    share the cluster."""
    def one(name: str) -> dict:
        start = time.time()
        try:
            path = write_result(RESULTS[name](ws), folder, name)
            return {"name": name, "path": path, "seconds": time.time() - start, "error": None}
        except Exception as e:  # reported per result
            return {"name": name, "path": None, "seconds": time.time() - start, "error": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(parallel) as pool:
        return list(pool.map(one, select(only)))
