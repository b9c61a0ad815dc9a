"""Tool names, paths and inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tollbook.functions.variants import as_text, dump, is_list, is_object, text, whole

# Lower-cased tool names by kind.
KINDS = {
    "read": [
        "read", "view", "read_file", "readfile", "file_read", "notebookread", "readlints", "readmanyfiles", "read_many_files",
        "already_read_file"
    ],
    "edit": [
        "edit", "multiedit", "notebookedit", "str_replace", "strreplace", "str_replace_editor", "apply_patch", "applypatch", "patch",
        "edit_file", "update_file", "editfile"
    ],
    "write": ["write", "write_file", "writefile", "create", "create_file", "file_write", "delete", "remove", "move", "rename"],
    "bash": [
        "bash", "shell", "shell_command", "exec_command", "exec", "run_command", "terminal", "runterminalcmd", "awaitshell",
        "write_stdin", "send_input", "kill_shell", "killshell", "bashoutput", "runcommand"
    ],
    "glob": ["glob", "ls", "list", "listdir", "list_dir", "find", "findfiles"],
    "grep": ["grep", "search", "rg", "ripgrep", "codesearch", "searchtext", "grep_search"],
    "web": ["webfetch", "web_fetch", "fetch", "websearch", "web_search", "web_search_call", "browser", "open_url"],
    "task": ["task", "agent", "spawn_agent", "wait_agent", "close_agent", "dispatch_agent", "subagent", "collab"],
    "todo": [
        "todowrite", "todoread", "todo", "update_plan", "createplan", "exitplanmode", "updatetodos", "update_goal", "create_goal",
        "get_goal"
    ],
    "mcp": ["callmcptool", "call_mcp_tool", "read_mcp_resource", "list_mcp_resources", "use_mcp_tool"],
}
# Keys of a tool input, in order of preference.
PATH_KEYS = ["filePath", "file_path", "path", "target_file", "notebook_path", "filename", "file", "absolute_path", "target_directory"]
COMMAND_KEYS = ["command", "cmd", "script", "shell_command", "query", "search_term", "chars", "stdin"]
OLD_KEYS = ["old_string", "oldString", "old_str"]
NEW_KEYS = ["new_string", "newString", "new_str"]
CONTENT_KEYS = ["content", "contents", "file_text", "new_content", "text"]
PATCH_KEYS = ["patchText", "patch", "input", "diff"]
PATCH_LINE = r"(?m)^\*\*\*\s+(Update|Add|Delete)\s+File:\s*(.+?)\s*$"
COMMAND_HEAD = 500


def tool_kind(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = F.when(F.coalesce(name, F.lit("")) == "", "other").when(low.startswith("mcp__") | low.startswith("mcp_"), "mcp")
    for kind, names in KINDS.items():
        out = out.when(low.isin(*names), kind)
    return out.otherwise("other")


def rel_path(raw: Column, bases: list[Column]) -> Column:
    """Path below the first base that is a true prefix folder of it."""
    out = None
    for base in bases:
        rest = F.substr(raw, F.length(base) + 1)
        fits = (base != "") & raw.startswith(base) & (rest.startswith("/") | (rest == ""))
        below = F.coalesce(F.nullif(F.substr(rest, F.lit(2)), F.lit("")), F.lit("."))
        out = F.when(fits, below) if out is None else out.when(fits, below)
    return raw if out is None else out.otherwise(raw)


def _values(inp: Column, keys: list[str]) -> Column:
    """The values under ``keys``, in that order, without absent and null ones."""
    found = F.array(*[F.try_variant_get(inp, f"$.{k}", "variant") for k in keys])
    return F.filter(found, lambda x: x.isNotNull() & ~F.is_variant_null(x))


def _first(inp: Column, keys: list[str]) -> Column:
    return F.get(_values(inp, keys), F.lit(0))


def pick_path(inp: Column) -> Column:
    named = F.transform(_values(inp, PATH_KEYS), as_text)
    return F.get(F.filter(named, lambda x: x != ""), F.lit(0))


def with_tool_input(df: DataFrame, name: Column, inp: Column, bases: list[Column], raw: Column | None = None,
                    beside: Column | None = None) -> DataFrame:
    """Add the columns of a tool call that are read from its input.

    ``inp`` is the input object (NULL if it is none), ``raw`` an input that is plain text,
    ``beside`` a path given next to the input. Built in steps, so that every value is
    computed once."""
    none = F.lit(None).cast("string")
    df = df.withColumns({
        "_cmd": _first(inp, COMMAND_KEYS), "_patch": as_text(_first(inp, PATCH_KEYS)), "_given": pick_path(inp),
        "_content": F.length(as_text(_first(inp, CONTENT_KEYS))), "_plain": none if raw is None else raw,
        "_beside": none if beside is None else F.when(F.coalesce(text(inp, "filePath"), F.lit("")) == "", beside),
        "old_string_chars": F.length(as_text(_first(inp, OLD_KEYS))).cast("long"),
        "new_string_chars": F.length(as_text(_first(inp, NEW_KEYS))).cast("long"),
        "read_offset": whole(inp, "offset"), "read_limit": whole(inp, "limit"),
    })
    words = F.array_join(F.try_variant_get("_cmd", "$", "array<string>"), " ")
    df = df.withColumns({
        "_cmd": F.nullif(F.when(is_list(F.col("_cmd")), words).otherwise(as_text(F.col("_cmd"))), F.lit("")),
        "_patch": F.when(F.col("_patch").contains("*** "), F.col("_patch")),
        "_plain_patch": F.when(F.col("_plain").contains("*** "), F.col("_plain")),
    })
    # patch texts in order of preference; the first that names a file counts
    bodies = F.array("_plain_patch", "_patch", F.when(F.col("_cmd").contains("apply_patch"), F.col("_cmd")))
    naming = F.filter(bodies, lambda x: x.contains("*** ") & x.rlike(PATCH_LINE))
    df = df.withColumn("_body", F.get(naming, F.lit(0)))
    df = df.withColumns({
        "_ops": F.regexp_extract_all("_body", F.lit(PATCH_LINE), F.lit(1)), "_paths": F.regexp_extract_all("_body", F.lit(PATCH_LINE), F.lit(2)),
        "_name": name})
    df = df.withColumns({
        "file_path_raw": F.coalesce(F.get("_paths", F.lit(0)), "_beside", "_given"),
        "patched_files": F.to_json("_paths"),
        "tool_kind": F.when(F.col("_paths").isNull(), tool_kind(F.col("_name")))
                      .when(F.forall("_ops", lambda o: o == "Add"), "write").otherwise("edit"),
        "command_head": F.substring(F.coalesce("_cmd", F.when(F.col("_plain_patch").isNull(), F.col("_plain"))), 1, COMMAND_HEAD),
        "content_chars": F.coalesce("_content", F.length("_patch"), F.length("_plain_patch")).cast("long"),
    }).withColumn("file_path", rel_path(F.col("file_path_raw"), bases))
    return df.drop("_cmd", "_patch", "_given", "_content", "_plain", "_beside", "_plain_patch", "_body", "_ops", "_paths", "_name")


TOOL_COLUMNS = ["tool_kind", "file_path_raw", "file_path", "patched_files", "command_head", "old_string_chars", "new_string_chars",
                "content_chars", "read_offset", "read_limit"]


def result_text(content: Column) -> Column:
    """Text of a tool result: a string, a list of text blocks, or the JSON of anything else."""
    blocks = F.try_variant_get(content, "$", "array<variant>")
    def piece(b):
        return (F.when(is_object(b) & (text(b, "type") == "text"), F.coalesce(text(b, "text"), F.lit("")))
                .when(is_object(b), dump(b)).otherwise(F.coalesce(as_text(b), F.lit(""))))
    joined = F.array_join(F.transform(blocks, piece), "")
    return F.when(content.isNull(), "").when(is_list(content), joined).otherwise(F.coalesce(as_text(content), dump(content)))
