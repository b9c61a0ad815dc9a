import json
import re

import pytest
from pyspark.sql import functions as F

from tollbook.sources import catalog, inventory, transcripts as t

PLAN = "session_id string, agent string, repo string, fmt string"


def message(i, text="hi", **more):
    return {"info": {"id": f"m{i}", "role": "user"}, "parts": [{"type": "text", "text": text}], **more}


ODD = ['a, b', 'say "x", then', 'back\\slash\\', '\\",', '{[,]}', '}, {"info": 1}, [', "comma,\nline", ",,,", 'é,日本, 𝕏', '\\\\",\\"', ""]
LISTED = {"info": {"version": "1.2", "directory": "/w,x"}, "messages": [message(i, x, deep={"a": [1, {"b": [2, 3]}], "c": "]"}) for i, x in enumerate(ODD)], "more": [1, [2], {"x": "y"}]}
DOCUMENTS = {
    "pretty": json.dumps(LISTED, indent=2), "compact": json.dumps(LISTED, separators=(",", ":")), "plain": json.dumps(LISTED, ensure_ascii=False),
    "last": json.dumps({"a": {"messages": [5]}, "info": {"version": "3"}, "messages": [message(1), message(2, "x, y")]}), "empty_list": '{"info": {}, "messages": [ ]}', "none": '{"messages":[]}',
    "odd_items": '{"messages": [null, 5, "a, b", [1, {"x": 2}], {"no": "info, here"}, %s , true]}' % json.dumps(message(7)),
    "twice": '{"messages": [%s], "messages": [%s, %s]}' % tuple(json.dumps(message(i)) for i in range(3)), "not_list": '{"messages": {"a": [1, 2]}, "info": 1}',
    "single": json.dumps(message(1, "one, message")), "lines": "\n".join(json.dumps(message(i, x)) for i, x in enumerate(ODD)) + "\n\n{bad, line\n[1, 2]\n",
    "two": '{"messages": [%s]}\n{"messages": [1, 2]}' % json.dumps(message(1)), "broken": '{"messages": [%s, {"info": {bad}}, %s]}' % (json.dumps(message(1)), json.dumps(message(2))),
    "broken_beside": '{"messages": [%s], "x": {oops, 1}}' % json.dumps(message(1)), "cut": '{"messages": [%s, ' % json.dumps(message(1)), "closed_twice": '{"messages": [1, 2]]}', "number": "12, 13", "text": '"a, b"', "blank": " \n ",
    "spaced": '\n{ "info" : { "version" : "x" } , "messages" : [ %s , %s ] } \n' % (json.dumps(message(1)), json.dumps(message(2))),
}


def collected(frames):
    messages, errors = frames
    return (sorted(map(str, messages.select("session_id", "agent", "version", "directory", "seq", F.to_json("v").alias("v")).collect())),
            sorted(map(str, errors.select("session_id", "line_no", "exception").collect())))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("documents")
    for name, body in DOCUMENTS.items():
        (root / f"{name}.jsonl").write_text(body, encoding="utf-8")
    plan = spark.createDataFrame([(n, "opencode", "r", "opencode") for n in DOCUMENTS], PLAN)
    return str(root), plan


@pytest.mark.parametrize("split", [60, 1000, 10**6])
def test_documents_cut_by_many_tasks_are_those_parsed_whole(spark, folder, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    whole = collected(t.scan_messages(spark, *folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        cut = collected(t.scan_messages(spark, *folder, upto=0))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert cut[0] == whole[0] and len(whole[0]) > 60
    assert cut[1] == whole[1] and len(whole[1]) > 5


def test_a_large_document_is_read_by_several_tasks(spark, tmp_path):
    big = {"info": {"version": "9"}, "messages": [message(i, f"text {i}, " * 40) for i in range(3000)]}
    (tmp_path / "big.jsonl").write_text(json.dumps(big, indent=1))
    plan = spark.createDataFrame([("big", "opencode", "r", "opencode")], PLAN)
    files = inventory.planned_files(spark, str(tmp_path), plan)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        from tollbook.sources.documents import scan_pieces
        pieces = scan_pieces(spark, files.paths(documents=True, above=1000))
        assert pieces.rdd.getNumPartitions() > 5
        assert pieces.agg(F.max(F.length("piece"))).first()[0] < 1000  # no row holds the file, nor a message
        messages, errors = t.scan_messages(spark, str(tmp_path), plan, files, upto=1000)
        got = messages.select("seq", "version", F.variant_get("v", "$.parts[0].text", "string").alias("text")).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in got] == [(i, "9", f"text {i}, " * 40) for i in range(3000)] and errors.count() == 0


def test_a_large_list_with_a_record_that_is_too_large(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(t, "RECORD_BYTES", 300)
    body = {"info": {"version": "3"}, "messages": [message(1), message(2, "long, " * 100), message(3)]}
    (tmp_path / "x.jsonl").write_text(json.dumps(body, separators=(",", ":")))
    plan = spark.createDataFrame([("x", "opencode", "r", "opencode")], PLAN)
    cut = collected(t.scan_messages(spark, str(tmp_path), plan, upto=0))
    assert cut == collected(t.scan_messages(spark, str(tmp_path), plan)) and len(cut[0]) == 2 and len(cut[1]) == 1


def test_only_planned_files_are_opened(spark, tmp_path):
    for name in ("a", "b+1 %41[x]", "c"):
        (tmp_path / f"{name}.jsonl").write_text('{"n": 1}\n\n{"n": 2}\n')
    (tmp_path / "empty.jsonl").write_text("")
    (tmp_path / "unread.jsonl.gz").write_bytes(b"no archive")  # reading it fails
    (tmp_path / "doc.jsonl").write_text('{"messages": []}')
    plan = spark.createDataFrame([("a", "codex", "r", "codex"), ("b+1 %41[x]", "codex", "r", "codex"), ("empty", "codex", "r", "codex"), ("absent", "codex", "r", "codex"), ("doc", "opencode", "r", "opencode")], PLAN)
    got = t.scan_jsonl(spark, str(tmp_path), plan)
    assert sorted((r.session_id, r.seq) for r in got.collect()) == [("a", 0), ("a", 2), ("b+1 %41[x]", 0), ("b+1 %41[x]", 2)]
    assert len(got.inputFiles()) == 2
    only = t.scan_jsonl(spark, str(tmp_path), plan.where("session_id = 'a'"))
    assert [f.rsplit("/", 1)[1] for f in only.inputFiles()] == ["a.jsonl"]
    assert t.scan_jsonl(spark, str(tmp_path), plan.limit(0)).count() == 0
    listing = inventory.list_files(spark, str(tmp_path))
    assert listing.count() == 5 and [r.session_id for r in inventory.list_empty_files(spark, str(tmp_path)).collect()] == ["empty"] and "content" not in listing._jdf.queryExecution().executedPlan().toString()


def test_inventory(spark, tmp_path):
    (tmp_path / "t" / "old").mkdir(parents=True)
    for name, body in (("a", "x\n"), ("empty", ""), ("stray", "x"), ("left", "xy"), ("old/a", "zzz"), ("other", "x")):
        (tmp_path / "t" / f"{name}.jsonl").write_text(body)
    entries = [("a", "codex"), ("empty", "codex"), ("gone", "cursor"), ("left", "Claude Code"), ("other", "aider"), ("missing", "aider")]
    (tmp_path / "s.json").write_text(json.dumps({"sessions": [{"agent": a, "trajectory": f"t/{n}.jsonl", "bytes": 9} for n, a in entries]}))
    sessions = catalog.scan_catalog(spark, str(tmp_path / "s.json"))
    plan = catalog.plan_inputs(sessions, agents=["codex", "cursor"])
    ids = spark.createDataFrame([("a",), ("nobody",), ("nobody",)], "session_id string")
    files = inventory.list_files(spark, str(tmp_path / "t")).unionByName(inventory.list_empty_files(spark, str(tmp_path / "t")))
    found = inventory.inventory(sessions, files, plan, ids)
    got = sorted(((r.status, r.session_id, r.agent, r.fmt, r.bytes) for r in found.collect()), key=str)
    assert got == sorted([
        ("present", "a", "codex", "codex", 2), ("unplanned_file", "a", None, None, 3), ("empty", "empty", "codex", "codex", 0), ("absent", "gone", "cursor", "cursor", None),
        ("not_planned", "left", "claude_code", None, 2), ("skipped_agent", "other", "aider", None, 1), ("skipped_agent", "missing", "aider", None, None),
        ("unplanned_file", "stray", None, None, 1), ("unknown_id", "nobody", None, None, None)], key=str)
    totals = {(r.status, r.agent): (r.sessions, r.bytes) for r in inventory.inventory_totals(found).collect()}
    assert totals["skipped_agent", "aider"] == (2, 1) and totals["present", "codex"] == (1, 2)


def test_a_text_is_parsed_once(spark):
    lines = spark.range(1).select(F.lit("s").alias("session_id"), F.lit(0).alias("seq"), F.format_string('{"a": %d}', "id").alias("line"))
    assert t.parsed_lines(lines)._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_pieces_tell_their_quotes_and_depth(spark, tmp_path):
    from tollbook.sources.documents import scan_pieces
    pieces = ["plain text", "", '{"a": "b', 'c]"', '"x": [{"y": "}\\"]"', "]}", 'a"{"b"[["c', "\\\\", '{\n"\n', '"']
    (tmp_path / "p.jsonl").write_bytes(",".join(pieces).encode())

    def told(piece):
        parts = re.sub(r"(?s)\\.", "", piece).split('"')
        deep = lambda odd: sum("".join(parts[odd::2]).count(c) for c in "{[") - sum("".join(parts[odd::2]).count(c) for c in "}]")
        return piece, (len(parts) - 1) % 2, deep(0), deep(1)

    got = scan_pieces(spark, [str(tmp_path / "p.jsonl")])
    assert [tuple(r) for r in got.orderBy("_split", "_at").select("piece", "quotes", "outside", "inside").collect()] == [told(p) for p in pieces]
    # plain text is not taken apart
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_sessions_are_looked_up_by_cheap_steps(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"n": 1}\n')
    lines = t.scan_jsonl(spark, str(tmp_path), spark.createDataFrame([("a", "codex", "r", "codex")], PLAN))
    assert [(r.session_id, r.fmt, r.seq) for r in lines.collect()] == [("a", "codex", 0)]
    # at every place of a path a search for the last name would start anew
    assert "regexp_extract" not in lines._jdf.queryExecution().optimizedPlan().toString()
    paths = spark.createDataFrame([(p,) for p in ("/x/a.jsonl", "a b.jsonl", "/x.jsonl/b", "/x/", "/x/a.jsonl.jsonl")], "p string")
    assert [r[0] for r in paths.select(inventory.session_of(F.col("p"))).collect()] == ["a", "a b", "b", "", "a.jsonl"]
