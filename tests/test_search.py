import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.plans.query import parse_ref
from threadloom.operators import corpus, lexical, messages, positions, protocol, ranking, semantic

NOW = F.lit("2024-03-01 00:00:00").cast("timestamp")
ENTRIES = "entry_id long, path string, conv_ref string, session_id string, project_dir string, cwd string, file_size long, mtime timestamp, is_empty boolean, full_text string, agent_search_text string, preview_first string, summary string, custom_title string"


def entries(spark, rows):
    """Rows of text, project, title and age in hours."""
    data = []
    for i, (text, project, title, age) in enumerate(rows):
        full = " ".join(t for t in (title, text) if t)
        data.append((i, f"p{i}", f"c{i}", f"s{i}", "d", f"/x/{project}" if project else None, 1, None, False, full, None, None, None, title, age))
    df = spark.createDataFrame(data, ENTRIES + ", age double")
    return df.withColumn("mtime", (NOW.cast("double") - F.col("age") * 3600).cast("timestamp")).drop("age")


def order(spark, rows, query, **options):
    found = lexical.search(corpus.searchable(entries(spark, rows)), query, NOW, top=10, **options)
    return [int(r["conv_ref"][1:]) for r in found.collect()]


@pytest.mark.parametrize(
    "query, rows, want",
    [
        ('"RESTAURANT_SIGNALS"', [("literal RESTAURANT_SIGNALS identifier", None, None, 1.0), ("restaurant signals words only", None, None, 0.0)], [0]),
        ("agents-config", [("x", "agents-config", None, 22.0), ("the agents config body", None, None, 1.0)], [0, 1]),
        ("agents config", [("x", None, "agents config", 9.0), ("agents config", None, None, 9.0)], [0, 1]),
        ("config", [("config config config config", None, None, 5.0), ("config", None, None, 5.0)], [0, 1]),
        ("agents config", [("agents config here", None, None, 5.0), ("agents and also config here", None, None, 5.0)], [0, 1]),
        ("", [("a", None, None, 5.0), ("b", None, None, 1.0)], [1, 0]),
        ("red", [("fired", None, None, 1.0), ("redaction", None, None, 1.0)], [1]),
        ("alpha missing", [("alpha", None, None, 1.0)], []),
        ("设置", [("打开设置页", None, None, 1.0), ("else", None, None, 1.0)], [0]),
        ("load_snippet window", [("window load_snippet", None, None, 1.0), ("window load snippet", None, None, 1.0)], [0]),
    ],
)
def test_lexical_order(spark, query, rows, want):
    assert order(spark, rows, query) == want


def test_current_entries(spark):
    rows = [(1, "a", "c", None, None, None, 5, "2024-01-01", False), (2, "a", "c", None, None, None, 9, "2024-01-02", False), (3, "b", "c", None, None, None, 1, None, True), (4, "d", "c", None, None, None, 1, None, None)]
    df = spark.createDataFrame([(*r[:7], None, r[8], None, None, None, None, None, r[7]) for r in rows], ENTRIES + ", at string").withColumn("mtime", F.col("at").cast("timestamp"))
    assert sorted(r["entry_id"] for r in corpus.current_entries(df).collect()) == [2, 4]
    assert corpus.current_entries(df.limit(0)).count() == 0


MESSAGES = "row_id long, conv_ref string, ordinal int, role string, jsonl_line int, parent_tool_use_id string, parts array<struct<kind string, text string, id string, name string, input string, tool_use_id string, content string>>"


def rows(spark, *texts, conv="c"):
    data = []
    for i, t in enumerate(texts, 1):
        parts = [("text", t, None, None, None, None, None)] if isinstance(t, str) else t
        data.append((i, conv, i, "user" if i % 2 else "Assistant ", i, None, parts))
    return spark.createDataFrame(data, MESSAGES)


def test_all_words_in_one_message(spark):
    m = rows(spark, "alpha only", "near alpha beta evidence", "beta only", None)
    hit = messages.hits(m, "alpha beta").collect()
    assert [(h["ordinal"], tuple(h["read"]), h["preview"]) for h in hit] == [(2, (1, 3), "near alpha beta evidence")]
    assert hit[0]["score"] == pytest.approx(8 + 2 + 1 / len("near alpha beta evidence"))
    assert messages.hits(m, 'alpha "only" beta').count() == 0 and messages.hits(m, "").count() == 0
    assert [h["ordinal"] for h in messages.hits(m, '"ONLY"').collect()] == []
    assert sorted(h["ordinal"] for h in messages.hits(m, '"only"').collect()) == [1, 3]


def test_parts_flags_and_bounds(spark):
    big = [("tool_result", None, None, None, None, "t", "HEAD" + "x" * 32768 + "TAIL")]
    call = [("tool_use", None, "t", "Grep", '{"pattern": "y", "a_path": 1}', None, None), ("thinking", "deep thought", None, None, None, None, None)]
    m = rows(spark, big, call)
    assert [(h["source"], h["tool_results"]) for h in messages.hits(m, '"TAIL"').collect()] == [("tool", True)]
    assert messages.hits(m, f'"{"x" * 16385}"').count() == 0
    assert [(h["source"], h["tools"], h["thinking"]) for h in messages.hits(m, "grep").collect()] == [("tool", True, False)]
    assert [h["source"] for h in messages.hits(m, "thought").collect()] == ["thinking"]
    assert messages.hits(m, '"input_keys=a_path"').count() == 1
    assert messages.hits(m.limit(0), "x").count() == 0


def test_positions_over_blocks(spark):
    data = [("hot", i * 3) for i in range(500)] + [("cold", 7), ("cold", None), (None, 1)]
    got = positions.positions(spark.createDataFrame(data, "g string, o int"), "g", "o", block=64).collect()
    assert all(r["position"] == r["o"] // 3 + 1 for r in got if r["g"] == "hot") and len(got) == 503
    sums = positions.running_sum(spark.createDataFrame([("g", i, 1) for i in range(300)], "g string, o int, v int"), "g", "o", "v", "s", block=7).collect()
    assert all(r["s"] == r["o"] + 1 for r in sums)


def test_outline_and_read(spark):
    short = protocol.outline(rows(spark, "one\ntwo", None, "three")).collect()
    assert sorted(r["line"] for r in short) == ["m1 role=user c~7 one two", "m3 role=user c~5 three"]
    long = sorted(protocol.outline(rows(spark, *[f"message {i}" for i in range(1, 26)])).collect(), key=lambda r: r["start"])
    assert [(r["start"], r["finish"]) for r in long] == [(1, 10), (11, 20), (21, 25)]
    assert long[2]["line"] == "seg m21..m25 c~50 message 21 / message 25"
    m = rows(spark, *[f"message {i} " + "x" * 50 for i in range(1, 41)])
    whole = protocol.read(m, [("c", None, None)], budget=None)
    assert whole.startswith("protocol agent-read v=1 cut=none budget=none\nconversation ref=c path=c.jsonl\n") and whole.count("message m") == 40
    part = protocol.read(m, [("c", None, None)], focus=(20, 20), budget=600)
    assert "cut=head+focus+tail budget=600" in part and "message m20 " in part and len(part) <= 600
    assert protocol.read(m, [("c", 3, 4)], budget=None).count("message m") == 2
    both = protocol.read(m.unionByName(rows(spark, "over there", conv="d")), [("d", None, None), ("c", 2, 3)], budget=None)
    assert both.index("conversation ref=d") < both.index("over there") < both.index("conversation ref=c") < both.index("message m2 ")
    with pytest.raises(ValueError):
        protocol.read(m, [("c", 39, 41)])
    text = protocol.outline_text(m, "c", budget=300)
    assert "cut=tail" in text and len(text) <= 300 and "seg m1..m10" in text
    assert protocol.outline_text(m, "c").count("seg m") == 4


def test_intervals_within_a_budget():
    fixed = len(protocol.header("read", "head+focus+tail", 1000))
    assert protocol.within_budget([10] * 5, None, 1000) == (0, 5)
    assert protocol.within_budget([300] * 9, (4, 5), 1000) == (3, 6)
    assert protocol.within_budget([300, 300, 300, 2000, 300, 300], (4, 5), 1000) == (4, 6)  # what does not fit ends that side
    assert protocol.within_budget([2000, 10], None, 1000) == (0, 0)
    assert protocol.within_budget([1000 - fixed + 1, 20], (0, 1), 1000) == (0, 1)
    assert [protocol.cut_label(*x) for x in ((0, 5, 5), (2, 5, 5), (0, 2, 5), (2, 3, 5), (0, 0, 5), (0, 0, 0))] == ["none", "head", "tail", "head+focus+tail", "tail", "none"]


def test_long_parts_are_searched_to_their_limit_or_whole(spark):
    m = rows(spark, "x" * 14_000 + " needle " + "y" * 9_000, "x" * 17_000 + " needle")
    assert [h["ordinal"] for h in messages.hits(m, "needle").collect()] == [1]
    assert sorted(h["ordinal"] for h in messages.hits(m, "needle", limit=None).collect()) == [1, 2]


def test_newer_conversations_first_among_equals(spark):
    m = rows(spark, "alpha", conv="old").withColumn("timestamp", F.lit("2024-01-01").cast("timestamp"))
    m = m.unionByName(rows(spark, "alpha", conv="young").withColumn("timestamp", F.lit("2024-02-01").cast("timestamp")))
    m = m.unionByName(rows(spark, "alpha", conv="a").withColumn("timestamp", F.lit(None).cast("timestamp")))
    assert [h["conv_ref"] for h in messages.best_hits(messages.hits(m, "alpha"), 2).collect()] == ["young", "old"]


def test_early_stop_and_settings(spark):
    from threadloom.operators import retrieval
    from threadloom.plans import query

    found = spark.createDataFrame([("a", 1), ("c", 1), ("c", 2), ("d", 1)], "conv_ref string, ordinal int")
    listed = spark.createDataFrame([("d", 4), ("a", 1), ("b", 2), ("c", 3)], "conv_ref string, rank int")
    assert sorted(r["conv_ref"] for r in retrieval.until_enough(found, listed, 2).collect()) == ["a", "c", "c"]
    assert query.SearchOptions.from_toml('[search]\nmode = "hybrid"\ntop = 3\nexclude_projects = ["x"]') == query.SearchOptions("hybrid", 3, exclude_projects=("x",))
    with pytest.raises(ValueError):
        query.SearchOptions.from_toml("[search]\nunknown = 1")
    assert query.shown_mode("exact") == "lexical" and query.shown_mode("semantic") == "semantic"


def test_chunk_packing():
    small = semantic.ChunkOptions(10, 3, 0)
    pieces = semantic.pack([("abcdef" * 4, 1, 1)], small)
    assert pieces[0][0] == "abcdefabcd" and pieces[1][0].startswith("bcd") and all(len(p[0]) <= 10 for p in pieces)
    assert [p[0] for p in semantic.pack([("éaébé", 1, 1)], semantic.ChunkOptions(5, 2, 0))] == ["éaé", "ébé"]
    packed = semantic.pack([("a" * 1500, 1, 1), ("b" * 200, 2, 2), ("c" * 900, 3, 4)], semantic.ChunkOptions())
    assert [(p[1], p[2]) for p in packed] == [(1, 2), (2, 4)] and packed[1][0].startswith("b" * 200 + "\n\nc")
    with pytest.raises(ValueError):
        semantic.ChunkOptions(10, 10)


CHUNKS = "chunk_id long, conv_ref string, session_id string, chunk_index int, text string, m_start int, m_end int, embedding array<float>"


def test_best_chunk(spark):
    c = spark.createDataFrame([(1, "a", "a", 0, "rust cache", 1, 1, [1.0, 0.0]), (2, "a", "a", 1, "unrelated", 2, 2, [0.0, 1.0]), (3, "b", "b", 0, "rust", 1, 1, [0.5, 0.5]), (4, "z", "z", 0, None, 1, 1, [0.0, 0.0]), (5, "y", "y", 0, "", 1, 1, None)], CHUNKS)
    got = semantic.rank(c, [1.0, 0.0], "rust cache", top=10).collect()
    assert [r["conv_ref"] for r in got][:2] == ["a", "b"]
    assert got[0]["semantic"] == pytest.approx(1) and got[0]["lexical"] == pytest.approx(0.2) and got[0]["quality"] == "strong"
    assert [r["conv_ref"] for r in semantic.rank(c, [1.0, 0.0], '"cache"', top=10).collect()] == ["a"]
    embedded = semantic.embed(c.drop("embedding"), semantic.HashingEmbedder(8)).collect()
    assert all(len(r["embedding"]) == 8 for r in embedded) and np.any(embedded[0]["embedding"])


def hit(score, source="dialogue", focus=1, preview=None, **flags):
    return {"score": score, "source": source, "focus_start": focus, "focus_end": focus, "read_start": focus, "read_end": focus + 1, "preview": preview or f"p{score}{focus}", **{f: flags.get(f, False) for f in ranking._FLAGS}}


def test_folding_hits():
    got = ranking.fold_hits([hit(10.02, "tool", 1), hit(10.01, focus=2), hit(9.0, focus=3)], 2)
    assert [h["source"] for h in got] == ["dialogue", "tool"]
    got = ranking.fold_hits([hit(10.9, "tool", 1), hit(10.1, focus=2)], 2)
    assert [h["source"] for h in got] == ["tool", "dialogue"]
    done = "The file {} has been updated successfully."
    twice = [hit(5, focus=1, preview=done.format("a"), tools=True), hit(4, focus=9, preview=done.format("b"), thinking=True)]
    assert len(ranking.fold_hits(twice, 5)) == 1 and len(ranking.fold_hits(twice, 5, all_hits=True)) == 2
    merged = ranking.fold_hits(twice, 5)[0]
    assert merged["tools"] and merged["thinking"] and merged["read_end"] == 10


def test_fusion(spark):
    lex = spark.createDataFrame([("a", (1, 1), 1, False), ("b", (2, 2), 2, True)], "conv_ref string, focus struct<start int, end int>, rank int, exact boolean")
    sem = spark.createDataFrame([("a", (1, 1), 2), ("c", (3, 3), 1), ("c", (3, 3), 4)], "conv_ref string, focus struct<start int, end int>, rank int")
    got = {r["conv_ref"]: (r["source"], round(r["score"], 6)) for r in ranking.fuse(lex, sem).collect()}
    assert got == {"a": ("hybrid", round(1 / 61 + 1 / 62, 6)), "b": ("exact", round(1 / 62, 6)), "c": ("hybrid", round(1 / 64, 6))}


def test_groups_and_text(spark):
    found = messages.best_hits(messages.hits(rows(spark, "alpha one", "alpha two", "alpha three", "beta"), "alpha"), 40)
    grouped = [r.asDict() for r in ranking.best_groups(ranking.group_hits(found, 2), 10).collect()]
    assert len(grouped) == 2 and grouped[0]["total_hits"] == 3
    text = list(ranking.output_lines(grouped, "alpha", "lexical", {"c": "A  title"}))
    assert text[0] == "protocol agent-search v=2 mode=lexical groups=1 hits=2" and text[3].endswith("hits=2 total=3 | A title")
    assert lexical.shortlist_size(3) == 50 and lexical.candidate_limit(10, 2) == 80
    ranked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("a", 4), ("c", 5)], "conv_ref string, rank int")
    assert sorted(r["rank"] for r in ranking.until_conversations(ranked, 2).collect()) == [1, 2, 3]


def test_a_hot_conversation_does_not_crowd_out_groups(spark, tmp_path):
    """The candidate limit (80 for ten groups of two) was spent on one conversation."""
    from threadloom.plans import search_queries

    m = rows(spark, *["long parser"] * 100, conv="a hot")
    for i in range(11):
        m = m.unionByName(rows(spark, f"long parser and {'more ' * i}text", "long parser", conv=f"cold{i:02}"))
    m.withColumn("row_id", F.monotonically_increasing_id()).withColumn("batch_no", F.lit(0)).withColumn("assistant_message_id", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/messages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/cache_entries.parquet").limit(0).write.parquet(f"{tmp_path}/cache_entries.parquet")
    got = {(r["conv_ref"], r["total_hits"]) for r in search_queries.grouped_hits(spark, str(tmp_path)).collect()}
    assert got == {("a hot", 80)} | {(f"cold{i:02}", 2) for i in range(9)}


def test_refs_labels_and_signatures(spark):
    t = spark.createDataFrame([("ch_aaaaaaaa11", "s1", "p1"), ("ch_aaaaaaaa22", "s1", "p2"), ("ch_bbbbbbbb11", None, "p3"), ("ch_cccccccc11", "s2", "p4")], "conv_ref string, session_id string, path string")
    assert corpus.resolve_ref(t, parse_ref("ch_bbbbbbbb")) == "ch_bbbbbbbb11"
    for bad in ("ch_aaaaaaaa", "ch_dddddddd"):
        with pytest.raises(LookupError):
            corpus.resolve_ref(t, parse_ref(bad))
    assert {r["path"]: r["label"] for r in corpus.session_labels(t).collect()} == {"p1": "p1", "p2": "p2", "p3": "p3", "p4": "s2"}
    assert corpus.selected(t).where("conv_ref = 'ch_cccccccc11'").first()["json"] == '{"sessionId":"s2","sessionPath":"p4"}'
    e = spark.createDataFrame([("c", "p", ["a"], [(1, 1)]), ("c", "p", ["b"], [(1, 1)]), ("c", "p", ["a"], [(1, 1)])], "conv_ref string, path string, semantic_turns array<string>, semantic_turn_ranges array<struct<start int, finish int>>")
    assert corpus.signature(e).select("signature").distinct().count() == 2
    c = spark.createDataFrame([("x <command-name>",), ("plain",), (None,)], "text string")
    assert semantic.suspicious(c).count() == 1
