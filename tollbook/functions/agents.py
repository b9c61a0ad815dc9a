"""Spellings of the agent names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted spellings.
SPELLINGS = {
    "claude code": "claude_code", "claude-code": "claude_code", "claude_code": "claude_code",
    "codex": "codex", "codex cli": "codex", "opencode": "opencode", "cursor": "cursor",
}
AGENTS = ["claude_code", "codex", "opencode", "cursor"]


def normalize_agent(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    out = None
    for spelling, agent in SPELLINGS.items():
        out = F.when(low == spelling, agent) if out is None else out.when(low == spelling, agent)
    return out
