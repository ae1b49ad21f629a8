import pytest
from pyspark.sql import functions as F

from threadloom.operators import evidence, viewer
from threadloom.sources import sessions


def test_ranges():
    text = "Red fired red_x, re-red"
    assert [(text[a:b], n) for a, b, n in evidence.ranges(text, "red")] == [("Red", 0), ("red", 0), ("red", 0)]
    assert evidence.ranges("a Foo-Bar b", '"Foo-Bar"') == [(2, 9, 0)] and evidence.ranges("a foo-bar", '"Foo-Bar"') == []
    assert evidence.terms_of('alpha my_id "Alpha"') == [("alpha", False), ("my_id", True), ("Alpha", True)]
    assert evidence.ranges("", "x") == [] and len(evidence.terms_of(" ".join(f"w{i}" for i in range(99)))) == 64


def test_spans_join_over_joints():
    assert evidence.spans("see media-pipeline now", "media pipeline") == [("see ", False), ("media-pipeline", True), (" now", False)]
    assert evidence.merged([(0, 3, 0), (2, 5, 1), (9, 10, 0)]) == [(0, 5), (9, 10)]


def test_spots():
    text = "alpha here." + " x" * 200 + " alpha beta together" + " y" * 200 + " beta"
    spots = evidence.hidden_context(text, "nothing", "alpha beta")
    assert len(spots) == 3 and any(text[a:b] == "alpha beta" for a, b in spots)
    assert evidence.hidden_context("only alpha", "alpha", "alpha") == []
    assert [text[a:b] for a, b in evidence.hidden_context(text, "alpha", "alpha beta")] == ["alpha beta", "beta"]


def test_previews():
    assert evidence.without_structural_tags("alpha\n<system-reminder>hidden</system-reminder>\t beta") == "alpha beta"
    assert evidence.without_structural_tags("Vec<T> where x < y") == "Vec<T> where x < y"
    assert evidence.without_structural_tags("a </x-y> <b-c d> e") == "a e"
    assert evidence.literal_window("a" * 200 + "KEY" + "b" * 200, "KEY", 3, 2) == "…aaaKEYbb…"


def test_evidence_table(spark):
    rows = spark.createDataFrame([("c", "x alpha y", ""), ("d", None, None), ("e", "no", "")], "conv_ref string, full_text string, preview_first string")
    got = {r["conv_ref"]: [s["text"] for s in r["spots"]] for r in evidence.evidence(rows, "alpha").collect()}
    assert got == {"c": ["alpha"], "d": [], "e": []}


@pytest.mark.parametrize(
    "name, given, want",
    [
        ("Read", '{"file_path": "a.rs", "offset": 5, "limit": 3}', ("Read: a.rs:5-8", None)),
        ("Grep", '{"pattern": "x"}', ('Grep: "x" in .', None)),
        ("Edit", '{"file_path": "f", "old_string": "a\\nb", "new_string": "c"}', ("Edit: f", "- a\n- b\n+ c")),
        ("Bash", '{"command": "one\\ntwo"}', ("Bash: one", "two")),
        ("Task", '{"description": "d", "prompt": "p"}', ("Task (agent): d", "p")),
        ("Other", '{"b": 1, "a": 2}', ("Other:", '{\n  "a": 2,\n  "b": 1\n}')),
        ("Write", "broken", ("Write: ", None)),
    ],
)
def test_tool_calls(name, given, want):
    assert viewer.tool_call(name, given) == want


def test_lines_and_labels(spark):
    rendered = spark.createDataFrame([("c", 1, "One\n\n\ntwo one"), ("c", 2, "none"), ("d", 1, "one")], "conv_ref string, ordinal int, body string")
    lines = viewer.body_lines(rendered)
    assert [r["line"] for r in lines.where("conv_ref = 'c' and ordinal = 1").orderBy("line_no").collect()] == ["One", "", "two one"]
    found = viewer.find_in_lines(lines, "c", "ONE").orderBy("ordinal", "line_no").collect()
    assert [(r["ordinal"], r["line_no"], tuple(r["next"])) for r in found] == [(1, 1, (1, 3)), (1, 3, (2, 1)), (2, 1, (1, 1))]
    names = spark.createDataFrame([("acme-big-4-5-20250101",), ("acme-3-5-tiny-20240101",), ("x" * 30,), ("plain",)], "m string")
    assert [r[0] for r in names.select(viewer.model_label(F.col("m"))).collect()] == ["big-4.5", "tiny-3.5", "x" * 19 + "…", "plain"]


def test_session_files(tmp_path):
    a = tmp_path / "p" / "abc-1.jsonl"
    a.parent.mkdir()
    a.write_text('{"type":"user"}')
    (tmp_path / "p" / "abc-1").mkdir()
    sessions.rename(a, "Näme")
    assert a.read_text().splitlines()[1] == '{"type":"custom-title","customTitle":"Näme","sessionId":"abc-1"}' and a.read_text().count("\n") == 3
    assert sessions.copy(a, tmp_path / "q").exists() and (tmp_path / "q" / "abc-1").is_dir()
    assert len(sessions.find(tmp_path, "abc-1")) == 2 and sessions.delete(tmp_path, "abc-1") == 2
    assert not (tmp_path / "p" / "abc-1").exists()
    for bad in ("../x", "", "abc-1"):
        with pytest.raises((ValueError, FileNotFoundError)):
            sessions.delete(tmp_path, bad)


def test_results_and_commands_on_display(spark):
    from threadloom.functions import cleaning, labels

    rows = [('"plain"',), ('[{"text": "a"}, {"type": "image"}, {"text": "b"}]',), ('[{"type": "image"}]',), ('{"b": 1, "a": null}',), (None,)]
    v = spark.createDataFrame(rows, "j string").select(F.try_parse_json("j").alias("v"))
    got = [r[0] for r in v.select(viewer.result_display(F.col("v"))).collect()]
    assert got[:2] == ["plain", "a\n\nb"] and got[2].startswith("[\n  {") and got[3] == '{\n  "a": null,\n  "b": 1\n}' and got[4] == "<no content>"
    texts = [("<local-command-stdout> out </local-command-stdout>",), ("<local-command-stdout> </local-command-stdout>",), ("<command-name>/clear</command-name>",), ("hi",), (None,)]
    t = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in t.select(cleaning.export_command(F.col("t"))).collect()] == ["out", None, "/clear", "hi", None]
    wide = spark.createDataFrame([("ab漢字cd",), ("漢字",), ("",), (None,)], "t string")
    assert [tuple(r) for r in wide.select(labels.display_width(F.col("t")), labels.display_cut(F.col("t"), 5)).collect()] == [(8, "ab漢…"), (4, "漢字"), (0, ""), (None, None)]
    keys = spark.createDataFrame([("a:b:3",), ("none",), (None,)], "k string")
    assert [r[0] for r in keys.select(labels.key_prefix(F.col("k"))).collect()] == ["a:b", None, None]
