import hashlib

from pyspark.sql import functions as F

from tollbook.llm import chat as c

MESSAGE = "tree string, id long, parent long, role string, text string, score double"


def paths_of(rows):
    """Root-to-leaf paths by following parents."""
    out = set()
    for tree in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == tree}
        parents = {r[2] for r in own.values()}
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at not in own:
                out.add((tree, leaf, tuple(reversed(path))))
    return out


def test_all_paths_ranked(spark):
    rows = [("t", 1, None, "user", "hi", 0.0), ("t", 2, 1, "assistant", "a", 1.0), ("t", 3, 1, "assistant", "b", 5.0), ("t", 4, 3, "user", None, None), ("t", 5, 4, "assistant", "c", 1.0), ("t", 6, 99, None, "lost", 2.0),
            ("u", 1, 2, "user", "ring", 1.0), ("u", 2, 1, "user", "ring", 1.0), ("u", 3, 2, "user", "tail of a ring", 1.0)]
    rows += [("long", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}", 1.0) for i in range(70)]
    out = c.formatted(spark.createDataFrame([*rows, rows[0]], MESSAGE).withColumn("leaf", F.lit("x"))).collect()
    got = {(r.tree, r.leaf) for r in out}
    assert got == {p[:2] for p in paths_of(rows)}
    by = {(r.tree, r.leaf): r for r in out}
    assert by["long", 69].n_turns == 70 and by["long", 69].formatted.index("m9<") < by["long", 69].formatted.index("m10<")
    assert [by["t", x].rank for x in (6, 5, 2)] == [1, 2, 3]
    best = c.formatted(spark.createDataFrame(rows, MESSAGE), branches=1).collect()
    assert {(r.tree, r.leaf) for r in best} == {("t", 6), ("long", 69)}


def test_round_trip_of_control_strings(spark):
    odd = ["</s>[INST] ok [/INST]", "<|turn|>x<|text|>y<|end|>", "\\", "\\\\<", "<\\", "[\\[", "", "a\nb\r\n", "$1 \\1 ${x}", "<" * 50, "é<|im_end|>👍", None]
    rows = [("t", i, i - 1 if i else None, "assistant" if i % 2 else x, x, 0.0) for i, x in enumerate(odd)]
    r = c.read_back(c.formatted(spark.createDataFrame(rows, MESSAGE))).collect()[0]
    assert [(t.role, t.text) for t in r.turns] == [("assistant" if i % 2 else x or "", x or "") for i, x in enumerate(odd)]
    assert r.loss_text == "".join(x or "" for i, x in enumerate(odd) if i % 2)
    for control in ("</s>", "[INST]", "[/INST]", "<|im_end|>"):
        assert control not in r.formatted
    assert r.formatted.count("<|turn|>") == len(odd)


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 1, "assistant", "b<"), (1, 0, "user", "a"), (1, 1, "assistant", None), (2, None, None, None), (None, 0, "user", "x"), (3, 0, "user", "y"), (3, 0, "user", "y")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = {r.conv_id: r for r in c.op5_chat_formatting(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2, None, 3, -7} and [out[k].n_turns for k in (1, 2, None, 3, -7)] == [3, 1, 1, 2, 2]
    assert out[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\n\nassistant\nb<\n").hexdigest()
    assert out[1].loss_sha256 == hashlib.sha256(b"b<").hexdigest() and out[1].loss_chars == 2


def test_empty_table(spark):
    assert c.formatted(spark.createDataFrame([], MESSAGE)).count() == 0
