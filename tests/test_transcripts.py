import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import export, fold, semantic, viewer
from threadloom.sources import jsonl, manifest
from threadloom.streaming import ingest


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


def answer(text, ident=None, **more):
    blocks = [{"type": "text", "text": text}] if isinstance(text, str) else text
    return {"type": "assistant", "message": {"role": "assistant", "content": blocks, **({"id": ident} if ident else {}), **more}}


def sub(text):
    return {"type": "progress", "data": {"type": "agent_progress", "agentId": "agent-1", "message": {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": text}]}}}}


CAVEAT = "Caveat: The messages below were generated by the user while running local commands."
CLEAR = [user(CAVEAT), user("<command-name>/clear</command-name>"), user("<local-command-stdout></local-command-stdout>")]


@pytest.fixture
def fold_of(spark, tmp_path):
    def run(*lines, name="11111111-2222-3333-4444-555555555555.jsonl"):
        folder = tmp_path / "-home-u-code"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
        entries = jsonl.parse(jsonl.read_lines(spark, f"file://{tmp_path}"))
        found = fold.conversations(entries).collect()
        return (found[0] if found else None), entries

    return run


def turns(c):
    return list(zip(c["semantic_turns"], [(r["start"], r["finish"]) for r in c["semantic_turn_ranges"]]))


def test_warmup_counts_for_nothing_but_the_text(fold_of):
    c, _ = fold_of(user("Warmup"), answer("At hand"), user("Where is the lamp"), answer("On the shelf"))
    assert c["message_count"] == 2 and c["preview_first"] == "Where is the lamp ... On the shelf" and "Warmup At hand" in c["full_text"]


def test_clear_only_transcripts_vanish(fold_of):
    assert fold_of(*CLEAR)[0] is None
    assert fold_of(*CLEAR, user("but then"), answer("yes"))[0]["message_count"] == 2


def test_preview_order(fold_of):
    c, _ = fold_of(*[x for i in range(1, 4) for x in (user(f"Q{i}"), answer(f"A{i}"))])
    assert c["preview_first"] == "Q1 ... A1 ... Q2" and c["preview_last"] == "A3 ... Q3 ... A2"


def test_titles_and_summaries(fold_of):
    title = lambda t: {"type": "custom-title", "customTitle": t}
    ai = lambda t: {"type": "ai-title", "aiTitle": t}
    c, _ = fold_of(user("q"), {"type": "summary", "summary": "s1"}, {"type": "summary", "summary": "s2"}, ai("a1"), ai("a2"), title("one"), title("two"))
    assert (c["custom_title"], c["summary"]) == ("two", "a2") and c["full_text"] == "two a2 q"
    c, _ = fold_of(user("q"), {"type": "summary", "summary": "s1"}, title("one"), title(" "))
    assert (c["custom_title"], c["summary"]) == (None, "s1")


def test_ordinals_of_subagents_and_streamed_answers(fold_of):
    c, _ = fold_of(user("a plain opening"), sub("found by the helper"), answer("closing remark"))
    assert turns(c) == [("a plain opening", (1, 1)), ("closing remark", (3, 3))]
    assert c["agent_search_text"] == "found by the helper" and "helper" not in c["full_text"]
    call = [{"type": "tool_use", "id": "t", "name": "Bash", "input": {}}]
    c, _ = fold_of(user("ask"), answer(call, "m1"), answer("settled", "m1"), user("onward"))
    assert turns(c) == [("ask", (1, 1)), ("settled", (2, 2)), ("onward", (3, 3))]


def test_an_answer_that_ends_empty_clears_its_turn(fold_of):
    tag = "<system-reminder>x</system-reminder>"
    c, _ = fold_of(user("ask"), answer("opener", "m1"), answer("rough cut", "m2"), answer(tag, "m1"), answer("clean cut", "m2"))
    assert turns(c) == [("ask", (1, 1)), ("clean cut", (3, 3))]


def test_tokens_duration_and_first_values(fold_of):
    usage = lambda n: {"usage": {"input_tokens": n, "output_tokens": 1}}
    c, _ = fold_of(
        user("q", timestamp="2024-01-01T00:00:00Z", cwd="/a/b"),
        {**answer("a", "m", model="big", **usage(5)), "timestamp": "2024-01-01T00:02:30Z"},
        answer("a b", "m", model="small", **usage(9)),
        answer("c", None, **usage(1)),
    )
    assert (c["total_tokens"], c["duration_minutes"], c["cwd"], c["model"]) == (12, 2, "/a/b", "big")


def test_errors_keep_their_context(spark, tmp_path, fold_of):
    good = [user(f"line {i}") for i in range(6)]
    c, entries = fold_of(good[0], good[1], "", "{{no json", good[2], good[3], good[4], {"type": "user"}, {"type": "future", "x": 1})
    errors = {r["line_number"]: r for r in jsonl.parse_errors(jsonl.read_lines(spark, f"file://{tmp_path}"), entries).collect()}
    assert sorted(errors) == [4, 8]
    assert [json.loads(x)["message"]["content"] if x else "" for x in errors[4]["context_before"]] == ["line 1", ""]
    assert len(errors[4]["context_after"]) == 2 and len(errors[8]["context_after"]) == 1
    assert c["message_count"] == 5
    assert fold.messages(entries, bad="drop").count() == 0 and fold.messages(entries).count() == 5


def test_required_fields(spark, tmp_path, fold_of):
    broken = [
        {"type": "assistant", "message": {"role": "assistant", "content": "text"}},
        answer([{"type": "thinking", "thinking": "no signature"}]),
        answer([{"type": "tool_use", "id": "x", "name": "y"}]),
        {"type": "system"},
        {"no": "type"},
    ]
    fine = [answer([{"type": "unknown"}]), {"type": "system", "subtype": "x"}, user([{"type": "image", "source": {"a": 1}}])]
    _, entries = fold_of(*broken, *fine)
    assert [r["error"] is None for r in entries.orderBy("line_no").select("error").collect()] == [False] * 5 + [True] * 3


def test_messages_merge_streamed_lines(spark, fold_of):
    call = [{"type": "tool_use", "id": "t", "name": "Bash", "input": {"b": 1}}]
    result = [{"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": "out"}, "more", {"type": "image", "text": "no"}]}]
    _, entries = fold_of(answer("ahead of time"), user("Warmup"), user("hi"), answer("dr", "m"), answer(call, "m"), user(result), sub("deep"))
    rows = fold.messages(entries).orderBy("ordinal").collect()
    assert [(r["role"], r["jsonl_line"]) for r in rows] == [("user", 3), ("assistant", 5), ("user", 6), ("assistant", 7)]
    assert rows[1]["parts"][0]["input"] == '{"b":1}' and rows[2]["parts"][0]["content"] == "out\nmore"
    assert rows[3]["parent_tool_use_id"] == "agent-1"
    text = export.paragraphs(fold.messages(entries).withColumnRenamed("path", "conv_ref"), "markdown").orderBy("ordinal").collect()
    assert text[0]["text"] == "## You\n\nhi\n\n"


def test_entries_by_place(fold_of):
    call = [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "t", "name": "Bash", "input": {"x": 1}}, {"type": "thinking", "thinking": "hm", "signature": "s"}]
    _, entries = fold_of(user("hi"), "broken", {"type": "file-history-snapshot", "messageId": "m", "snapshot": {}, "isSnapshotUpdate": False}, answer(call))
    got = {r["entry_index"]: r["text"] for r in viewer.entry_text(entries, tools=True, thinking=True).collect()}
    assert got == {0: "hi", 1: "a\n\ntool Bash input_keys=x\n\nhm"}
    assert {r["text"] for r in viewer.entry_text(entries).collect()} == {"hi", "a"}


def test_agent_files_and_empty_folders(spark, tmp_path, fold_of):
    fold_of(user("x"), name="agent-1.jsonl")
    assert jsonl.read_lines(spark, f"file://{tmp_path}").count() == 0


def test_only_changed_files_are_folded_again(spark, tmp_path):
    root = tmp_path / "t" / "-p"
    root.mkdir(parents=True)
    seen = []

    def work(lines):
        seen.append(sorted(r[0].rsplit("/", 1)[1] for r in lines.select("path").distinct().collect()))
        return fold.conversations(jsonl.parse(lines))

    def put(name, *lines):
        (root / name).write_text("".join(json.dumps(x) + "\n" for x in lines))

    store = manifest.Store(spark, f"file://{tmp_path}/store")
    put("a.jsonl", user("one"))
    put("b.jsonl", user("two"))
    put("c.jsonl", *CLEAR)
    assert manifest.refresh(store, f"file://{tmp_path}/t", work).where("not is_empty").count() == 2
    put("b.jsonl", user("two"), answer("three"))
    (root / "a.jsonl").rename(root / "d.jsonl")
    got = manifest.refresh(store, f"file://{tmp_path}/t", work)
    assert seen == [["a.jsonl", "b.jsonl", "c.jsonl"], ["b.jsonl", "d.jsonl"]]
    assert {r["path"].rsplit("/", 1)[1]: r["is_empty"] for r in got.collect()} == {"b.jsonl": False, "c.jsonl": True, "d.jsonl": False}
    assert manifest.Store(spark, f"file://{tmp_path}/store", key="other").read() is None


def test_embeddings_are_reused(spark, tmp_path):
    store = manifest.Store(spark, f"file://{tmp_path}/vectors", "hash-8")
    asked = []

    def embed(chunks):
        asked.append(sorted(r["chunk_key"] for r in chunks.collect()))
        return semantic.embed(chunks, semantic.HashingEmbedder(8))

    table = lambda rows: spark.createDataFrame(rows, "chunk_key string, text string")
    manifest.refresh_embeddings(store, table([("a:0", "x"), ("a:1", "y")]), embed)
    got = manifest.refresh_embeddings(store, table([("a:0", "x"), ("a:1", "changed"), ("b:0", "z")]), embed)
    assert asked == [["a:0", "a:1"], ["a:1", "b:0"]] and got.count() == 3


def test_growing_files_deliver_their_new_lines(spark, tmp_path):
    root = tmp_path / "t" / "-p"
    root.mkdir(parents=True)
    store = manifest.Store(spark, f"file://{tmp_path}/offsets")
    (root / "a.jsonl").write_text("1\n2\n")
    assert ingest.grown_lines(spark, f"file://{tmp_path}/t", store).count() == 2
    (root / "a.jsonl").write_text("1\n2\n3\n")
    (root / "b.jsonl").write_text("x\n")
    assert sorted(r["raw"] for r in ingest.grown_lines(spark, f"file://{tmp_path}/t", store).collect()) == ["3", "x"]
    assert ingest.grown_lines(spark, f"file://{tmp_path}/t", store).count() == 0


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("c", 1, None), ("c", 2, "m"), ("c", 3, " m "), ("d", 1, "m")]
    spark.createDataFrame(rows, "conv_ref string, jsonl_line int, assistant_message_id string").coalesce(1).write.mode("overwrite").parquet(f"file://{tmp_path}/in")
    lines = spark.readStream.schema("conv_ref string, jsonl_line int, assistant_message_id string").parquet(f"file://{tmp_path}/in")
    got = []
    query = ingest.into(ingest.message_stream(lines), f"file://{tmp_path}/check", lambda batch, n: got.extend(batch.collect()))
    query.awaitTermination(60)
    assert sorted((r["conv_ref"], r["jsonl_line"], r["ordinal"], r["is_repeat"]) for r in got) == [("c", 1, 1, False), ("c", 2, 2, False), ("c", 3, 2, True), ("d", 1, 1, False)]
    (tmp_path / "t" / "-p").mkdir(parents=True)
    (tmp_path / "t" / "-p" / "a.jsonl").write_text('{"a": 1}\n\n')
    seen = []
    ingest.into(ingest.file_stream(spark, f"file://{tmp_path}/t"), f"file://{tmp_path}/check2", lambda b, n: seen.extend(b.select("line_no", "raw").collect())).awaitTermination(60)
    assert [(r["line_no"], r["raw"]) for r in seen] == [(1, '{"a": 1}'), (2, "")]


def test_windowed_events(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{data}/events.parquet").write.mode("overwrite").parquet(f"file://{tmp_path}/ev")
    stream = ingest.event_counts(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/ev"))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()


def test_null_texts_are_not_embedded_anew(spark, tmp_path):
    store = manifest.Store(spark, f"file://{tmp_path}/vectors", "hash-8")
    asked = []

    def embed(chunks):
        asked.append(chunks.count())
        return chunks.withColumn("embedding", F.array(F.lit(1.0).cast("float")))

    rows = spark.createDataFrame([("a:0", None), ("a:0", None), ("a:1", "x")], "chunk_key string, text string")
    assert manifest.refresh_embeddings(store, rows, embed).count() == 3
    assert manifest.refresh_embeddings(store, rows, embed).count() == 3 and asked == [3, 0]


def test_listing_opens_no_file(spark, tmp_path):
    folder = tmp_path / "-home-u-code--worktrees-x"
    folder.mkdir()
    (folder / "a.jsonl").write_text("1\n")
    (folder / "agent-b.jsonl").write_text("1\n")
    found = jsonl.newest_files(jsonl.list_files(spark, f"file://{tmp_path}")).collect()
    assert [(r["file_name"], r["file_size"], r["project_name"]) for r in found] == [("a.jsonl", 2, "code/x")]
    plan = jsonl.list_files(spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def test_a_bad_line_can_end_the_query(spark, fold_of):
    _, entries = fold_of(user("hi"), "{{no json")
    with pytest.raises(Exception, match="line 2: not JSON"):
        fold.messages(entries, bad="fail").count()
