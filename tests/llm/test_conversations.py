import pytest

from threadloom.llm import conversations

SCHEMA = (
    "row_id long, conv_ref string, ordinal int, role string, jsonl_line int, assistant_message_id string, parent_tool_use_id string, "
    "parts array<struct<kind string, text string, id string>>, batch_no int, conv string, row string, status string"
)


def text(t="hello"):
    return [("text", t, None)]


def call(i):
    return [("tool_use", None, i)]


class Rows:
    def __init__(self):
        self.rows = []

    def add(self, conv, ordinal, role, line, parts, parent=None, ident=None):
        self.rows.append((len(self.rows) + 1, conv, ordinal, role, line, ident, parent, parts, 0, "x", "y", "z"))


def sound(r, conv):
    r.add(conv, 1, "user", 1, text())
    r.add(conv, 2, "assistant", 2, text())


@pytest.fixture
def judged(spark):
    r = Rows()
    sound(r, "sound")
    r.add("roles", 1, " USER ", 1, text())
    r.add("roles", 2, "Assistant\t", 2, text())
    r.add("narrated", 1, "user", 1, text())
    r.add("narrated", 2, "narrator", 2, text())
    r.add("null role", 1, None, 1, text())
    r.add("null role", 2, "assistant", 2, text())
    r.add("some", None, "user", 1, text())
    r.add("some", 2, "assistant", 2, text())
    r.add("gap", 1, "user", 1, text())
    r.add("gap", 3, "assistant", 2, text())
    r.add("twice", 1, "user", 1, text())
    r.add("twice", 1, "assistant", 2, text())
    r.add("falling", 1, "user", 5, text())
    r.add("falling", 2, "assistant", 2, text())
    r.add("unnumbered", None, "assistant", 9, text())
    r.add("unnumbered", None, "user", 3, text())
    r.add("orphan", 1, "user", 1, text(), parent="nowhere")
    r.add("orphan", 2, "user", 2, text())
    r.add("orphan", 3, "assistant", 3, text())
    r.add("sub", 1, "user", 1, text())
    r.add("sub", 2, "assistant", 2, call("t1"))
    r.add("sub", 3, "user", 3, text("down"), parent=" t1 ")
    r.add("sub", 4, "assistant", 4, call("t2"), parent="t1")
    r.add("sub", 5, "assistant", 5, text("deeper"), parent="t2")
    r.add("sub", 6, "assistant", 6, text("done"))
    r.add("cycle", 1, "user", 1, text())
    r.add("cycle", 2, "assistant", 2, call("t"), parent="t")
    r.add("cycle", 3, "assistant", 3, text())
    r.add("backwards", 1, "assistant", 1, text())
    r.add("blank", 1, "user", 1, text("  "))
    r.add("blank", 2, "assistant", 2, None)
    r.add("unanswered", 1, "user", 1, text())
    r.add("unanswered", 2, "assistant", 2, call("t"))
    r.add("redelivered", 1, "user", 1, text())
    r.add("redelivered", 1, "user", 1, text())
    r.add("redelivered", 2, "assistant", 2, text("par"), ident="m")
    r.add("redelivered", 2, "assistant", 3, text("partial no more"), ident=" m")
    r.add(None, 1, "user", 1, text())
    rows = spark.createDataFrame(r.rows, SCHEMA)
    return rows, {x["conv"]: x["reasons"] for x in conversations.dropped(rows).collect()}


def test_reasons(judged):
    _, why = judged
    assert why == {
        "narrated": ["bad_role", "unanswered"],
        "null role": ["bad_role", "starts_without_user"],
        "some": ["some_ordinals_missing", "ordinals_not_1_to_n"],
        "gap": ["ordinals_not_1_to_n"],
        "twice": ["ordinals_not_1_to_n"],
        "falling": ["ordinals_against_lines"],
        "orphan": ["orphan"],
        "backwards": ["starts_without_user"],
        "blank": ["no_text"],
        "unanswered": ["unanswered"],
    }


def test_emitted_in_order_with_threads_apart(judged):
    rows, _ = judged
    got = conversations.conversations(rows).toPandas()
    assert set(got.conv_ref) == {"sound", "roles", "unnumbered", "sub", "redelivered", "cycle"}
    ring = got[(got.conv_ref == "cycle") & (got.thread == "t")]
    assert len(ring) == 1 and ring.depth.isna().all() and ring.path.isna().all()
    sub = got[got.conv_ref == "sub"].sort_values("position")
    assert list(sub.depth) == [0, 0, 1, 1, 2, 0]
    assert list(sub[sub.depth == 2].path.iloc[0]) == ["t1", "t2"]
    assert list(sub.text) == ["hello", "", "down", "", "deeper", "done"]
    assert list(got[got.conv_ref == "redelivered"].sort_values("position").text) == ["hello", "partial no more"]
    assert list(got[got.conv_ref == "unnumbered"].sort_values("position").role) == ["user", "assistant"]


def test_deep_threads_and_cycles(spark):
    r = Rows()
    depth = 21
    r.add("deep", 1, "assistant", 1, call("t0"))
    for i in range(depth):
        r.add("deep", i + 2, "assistant", i + 2, call(f"t{i + 1}"), parent=f"t{i}")
    r.add("ring", 1, "user", 1, call("b"), parent="a")
    r.add("ring", 2, "user", 2, call("a"), parent="b")
    r.add("ring", 3, "user", 3, text(), parent="c")
    r.add("ring", 4, "user", 4, call("c"), parent="b")
    kept = conversations.kept_messages(spark.createDataFrame(r.rows, SCHEMA))
    got = {(t["conv"], t["thread"]): (t["status"], t["depth"]) for t in conversations.threads(kept).collect()}
    assert all(got["deep", f"t{i}"] == ("ok", i + 1) for i in range(depth))
    assert all(got["ring", t] == ("cycle", None) for t in "abc")


def test_empty_table(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert conversations.dropped(rows).count() == 0
    assert conversations.conversations(rows).count() == 0
