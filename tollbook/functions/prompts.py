"""What a human typed, once the harness's own text is taken out of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tags that harnesses wrap around their own text.
HARNESS_TAGS = [
    "system-reminder", "command-name", "command-message", "command-args",
    "local-command-stdout", "local-command-stderr", "local-command-out",
    "manually_attached_skills", "attached_files", "attached_selection", "code_selection",
    "git_diff_from_branch_to_main", "git_diff", "environment_details", "environment_context",
    "user_instructions", "ide_selection", "ide_opened_file", "timestamp", "user_rules", "open_files",
    "linter_errors", "current_file", "recently_viewed_files", "cursor_rules", "additional_data",
    "custom_instructions", "project_layout", "attachments", "selected_code", "snippet",
    "tool_output", "function_results", "task_reminder",
]
_NAMES = "|".join(HARNESS_TAGS)
PAIRED = rf"(?s)<({_NAMES})(\s[^>]*)?>.*?</\1>"
BARE = rf"(?s)</?({_NAMES})(\s[^>]*)?/?>"
INTERRUPT = r"\[Request interrupted by[^\]]*\]"
QUERY = r"(?s)<user_query>(.*?)</user_query>"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, EDGE_SPACE, "")


def _wrapped(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(QUERY), F.lit(1))
    return F.when(F.size(found) > 0, stripped(F.array_join(F.transform(found, stripped), "\n")))


def _without_tags(text: Column) -> Column:
    for pattern in (PAIRED, BARE, INTERRUPT):
        text = F.regexp_replace(text, pattern, " ")
    return text


def human_text(text: Column) -> Column:
    """The wrapped query where there is one, else the text without harness tags, in one line."""
    bare = stripped(F.regexp_replace(_without_tags(text), r"(?U)\s+", " "))
    return F.coalesce(_wrapped(text), bare, F.lit(""))


def human_lines(text: Column) -> Column:
    """Like ``human_text``, but the prompt keeps its line breaks (at most one empty line)."""
    found = F.regexp_extract_all(text, F.lit(QUERY), F.lit(1))
    asked = F.when(F.size(found) > 0, F.array_join(F.transform(found, stripped), "\n")).otherwise(_without_tags(text))
    tidy = F.regexp_replace(F.regexp_replace(asked, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")
    return F.coalesce(stripped(tidy), F.lit(""))


def interrupted(text: Column) -> Column:
    return text.rlike(INTERRUPT)


def prompt_columns(text: Column, meta: Column | None = None) -> dict[str, Column]:
    """Derived columns of one prompt row."""
    text = F.coalesce(text, F.lit(""))
    human = human_text(text)
    start = F.regexp_replace(text, r"(?U)^\s+", "")
    only_harness = (F.length(text) > 0) & (F.length(human) == 0)
    return {
        "text": text,
        "chars": F.length(text).cast("long"),
        "human_chars": F.length(human).cast("long"),
        "is_meta": only_harness if meta is None else (F.coalesce(meta, F.lit(False)) | only_harness),
        "is_interrupt": interrupted(text),
        "is_slash_command": (start.startswith("/") & ~start.startswith("//")) | text.contains("<command-name>"),
        "has_system_reminder": text.contains("<system-reminder>"),
    }
