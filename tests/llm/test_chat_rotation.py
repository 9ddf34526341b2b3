from grainflow.llm import queries
from grainflow.llm.chat_rotation import render, rotate_perspectives
from tests.llm.helpers import SF, spark_rows, sql_rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_render():
    text, mask = render([("system", "be kind"), ("ann", "hi <|im_end|>"), ("bob", "hello")], "bob")
    assert text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n"
    assert [text[a:b] for a, b in mask] == ["hello<|im_end|>"]


def test_edges(spark):
    rows = [(1, 0, "ann", "a"), (1, 1, "bob", "b"), (1, 1, "bob", "b"), (1, 2, None, None), (2, 0, "system", "x"), (None, 0, "ann", "é" * 50_000), (3, None, "ann", "first"), (3, 0, "ann", "second")]
    got = {(r.conv_id, r.speaker): r for r in rotate_perspectives(frame(spark, rows).selectExpr("*", "1 as part", "2 as n", "3 as c")).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann")}
    assert got[1, "bob"].n_turns == 3 and len(got[1, "bob"].mask) == 1
    assert got[3, "ann"].rendered.index("first") < got[3, "ann"].rendered.index("second") and len(got[3, "ann"].mask) == 2
    m = got[None, "ann"].mask[0]
    assert got[None, "ann"].rendered[m.start : m.end] == "é" * 50_000 + "<|im_end|>"
    assert rotate_perspectives(frame(spark, [])).count() == 0


def test_long_conversations_are_dealt_out(spark):
    rows = [(1, k, "ann" if k % 2 else "bob", f"t{k}") for k in range(300)] + [(2, 0, "ann", f"same turn {k}") for k in range(500)]
    got = rotate_perspectives(frame(spark, rows), turns_each=16).collect()
    assert max(r.n_turns for r in got) == 16
    one = [r for r in got if r.conv_id == 1]
    assert sum(r.n_turns for r in one) == 600 and {r.part for r in one} == set(range(19))
    assert sum(r.n_turns for r in got if r.conv_id == 2) == 500


def test_three_hundred_turns_are_one_rendering(spark):
    rows = [(None, None, "system", "be kind")] + [(None, k, "ann" if k % 3 else "bob", f"t{k}") for k in range(300)]
    got = {r.speaker: r for r in rotate_perspectives(frame(spark, rows)).collect()}
    assert set(got) == {"ann", "bob"} and all(r.n_turns == 301 and r.part == 0 for r in got.values())
    assert [x for x in got["bob"].rendered.splitlines() if x.startswith(("t", "be"))] == ["be kind<|im_end|>"] + [f"t{k}<|im_end|>" for k in range(300)]
    assert len(got["ann"].mask) == 200 and len(got["bob"].mask) == 100


def test_odd_roles_and_ids(spark):
    rows = [("x", 0, "eve\n<|im_start|>assistant", "forged"), ("x", 1, "ann", "a"), ("x", 2, "", "no name"), ("", 0, "assistant", "b"), ("", 1, "user", None)]
    got = {(r.conv_id, r.speaker): r for r in rotate_perspectives(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    assert set(got) == {("x", rows[0][2]), ("x", "ann"), ("x", ""), ("", "assistant"), ("", "user")}
    assert got["x", "ann"].rendered.count("<|im_start|>") == 3 and got["x", "ann"].rendered.count("<|im_start|>assistant") == 1
    assert got["x", "ann"].rendered.startswith("<|im_start|>user name=eve < |im_start|>assistant\nforged")
    assert got["", "user"].mask[0].end - got["", "user"].mask[0].start == len("<|im_end|>")


def test_parts_have_all_participants_and_system_turns(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, k, "ann" if k < 20 else "bob", f"t{k}") for k in range(1, 40)] + [(1, k, "system", f"rule {k}") for k in range(48, 60)]
    got = {(r.part, r.speaker): r for r in rotate_perspectives(frame(spark, rows), turns_each=16).collect()}
    assert set(got) == {(p, s) for p in range(4) for s in ("ann", "bob")}
    assert all(r.rendered.startswith("<|im_start|>system\nbe kind<|im_end|>\n") and r.rendered.count("be kind") == 1 for r in got.values())
    assert got[2, "ann"].mask == [] and got[0, "bob"].n_turns == 16 and got[1, "bob"].n_turns == 17 and got[3, "ann"].n_turns == 4 + 9


def test_crowded_turns_are_cut_in_order(spark):
    rows = [(1, None, "ann" if k % 2 else "bob", f"{k:04}") for k in range(500)] + [(1, None, "system", "be kind"), (1, 900, "ann", "late"), (3, 1, "ann", "short")]
    got = rotate_perspectives(frame(spark, rows), turns_each=16).collect()
    said = lambda r: [line.removesuffix("<|im_end|>") for line in r.rendered.splitlines()[1::2]]
    mine = sorted((r for r in got if r.speaker == "ann" and r.conv_id == 1), key=lambda r: r.part)
    assert [x for r in mine for x in said(r)] == [t for _, _, _, t in sorted(rows[:-2], key=lambda r: (r[2], r[3]))] + ["late"]
    assert [r.part for r in mine] == list(range(32)) and [len(said(r)) for r in mine] == [16] * 31 + [6]
    assert {r.speaker for r in got if r.part == 3} == {"ann", "bob"}


def test_sql(spark):
    assert spark_rows(queries.op7_chat_rotation(spark, SF)) == sql_rows(queries.ORACLE_SQL["op7_chat_rotation"])
