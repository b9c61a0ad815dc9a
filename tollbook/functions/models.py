"""Model names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def norm_model(model: Column) -> Column:
    """Drop a provider prefix and lower the case; claude names write dots as dashes."""
    bare = F.lower(F.regexp_replace(model, "^.*/", ""))
    return F.when(bare.startswith("claude"), F.replace(bare, F.lit("."), F.lit("-"))).otherwise(bare)


# Family names and the pattern that selects each, in order.
FAMILIES = [
    ("%opus%", "opus"),
    ("%sonnet%", "sonnet"),
    ("%haiku%", "haiku"),
    ("%fable%", "fable"),
    ("gpt-5.5%", "gpt-5.5"),
    ("gpt-5.4%", "gpt-5.4"),
    ("gpt-5.3%", "gpt-5.3-codex"),
]


def model_family(model: Column) -> Column:
    out = F.when(model.isNull(), "unknown")
    for pattern, family in FAMILIES:
        out = out.when(model.like(pattern), family)
    return out.otherwise("other")
