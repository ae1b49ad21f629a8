import pytest
from pyspark.sql import functions as F

from threadloom.functions import cleaning, labels, matching, paths
from threadloom.functions.text import squeeze, strip
from threadloom.plans import query


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


X = F.col("x")


@pytest.mark.parametrize("text, word, n", [("redaction plan", "red", 1), ("fired plan", "red", 0), ("aa aaa a", "aa", 2), ("x-red.red", "red", 2), ("", "red", 0), ("éred 1red", "red", 0), ("**media pipeline**", "media pipeline", 1), ("aaaa", "aa", 1)])
def test_prefix_count(spark, text, word, n):
    assert one(spark, text, matching.prefix_count(X, word, 10)) == n


def test_prefix_count_is_capped_and_pairs_add_up(spark):
    assert one(spark, "red " * 30, matching.prefix_count(X, "red", 10)) == 10
    assert one(spark, "a b c a b", matching.adjacent_count(X, ["a", "b", "c"])) == 3


def test_normalize(spark):
    text = "Foo_Bar-baz/QUX　、“x”…ΟΔΟΣ"
    assert one(spark, text, matching.normalize(X)) == "foo bar baz qux   x  οδοσ"
    assert matching.normalize_text(text) == one(spark, text, matching.normalize(X))


def test_smart_case(spark):
    assert one(spark, "Needle", matching.has_literal(X, "needle")) is True
    assert one(spark, "needle", matching.has_literal(X, "Needle")) is False


def test_white_space(spark):
    assert one(spark, " \x85 a b ​\n", squeeze(X)) == "a b ​"
    assert one(spark, "a" + " " * 50_000 + "b ", F.length(strip(X))) == 50_002


@pytest.mark.parametrize(
    "text, assistant, want",
    [
        ("before ```code``` after", False, "before after"),
        ("before ```code", False, "before"),
        ("a <system-reminder>x</system-reminder> b", False, "a b"),
        ("<command-name>/do</command-name><command-args> the thing </command-args>", False, "the thing"),
        ("/clear", False, None),
        ("all checks pass after just check", True, None),
        ("all checks pass after just check", False, "all checks pass after just check"),
        ("text ┌────┐ more words here", False, "text more words here"),
        ("| a | b |", False, None),
        ("", False, None),
    ],
)
def test_semantic_turn(spark, text, assistant, want):
    assert one(spark, text, cleaning.semantic_turn(X, F.lit(assistant))) == want


def test_commands(spark):
    call = "<command-name>/consult</command-name> <command-args>how to?</command-args>"
    assert one(spark, call, cleaning.skill_preview(X)) == "/consult how to?"
    assert one(spark, "<command-name>/clear</command-name>", cleaning.skill_preview(X)) is None
    assert one(spark, "<command-name>/clear</command-name>", cleaning.is_clear_metadata(X)) is True
    assert one(spark, "Base directory for this skill: /x\n\n Name \nrest", cleaning.viewer_command(X)) == "*Skill: /x*"
    assert one(spark, "<local-command-stdout> out </local-command-stdout>", cleaning.viewer_command(X)) == "out"
    assert one(spark, "Vec <b>x</b>  y\n<open", cleaning.list_preview(X)) == "Vec x y "


@pytest.mark.parametrize("name, path, shown", [("-a--b---c", "/a__b/__c", "/a__b/__c"), ("-x----y", "/x/__/y", "/x____y"), ("plain", "plain", "plain")])
def test_decoded_paths(spark, name, path, shown):
    assert one(spark, name, paths.decode_path(X)) == path
    assert one(spark, name, paths.display_path(X)) == shown


def test_names_of_projects(spark):
    assert one(spark, "/home/u/code/tool/.worktrees/fix", paths.encode_path(X)) == "-home-u-code-tool--worktrees-fix"
    assert one(spark, "/c/tool__worktrees/fix/deep", paths.short_name(X)) == "tool/fix"
    assert one(spark, "/c/tool/.worktrees/fix", paths.short_name(X)) == "tool/fix"
    assert one(spark, "/c/tool", paths.short_name(X)) == "tool"
    assert one(spark, "-a-b--worktrees-x", paths.project_root(X)) == "-a-b"


def test_labels(spark):
    assert one(spark, "a b%c=d|e\tf\ng", labels.atom(X)) == "a%20b%25c%3Dd%7Ce%09f%0Ag"
    assert one(spark, "x" * 30, labels.head_and_tail(X, 10)) == "x" * 10
    assert one(spark, "HEAD" + "x" * 32768 + "TAIL", F.length(labels.head_and_tail(X))) == 16384
    assert one(spark, '{"b": 1, "a": {"c": 2}}', labels.tool_summary(F.lit("Bash"), X)) == "tool Bash input_keys=a,b"
    assert one(spark, "[]", labels.tool_summary(F.lit("Bash"), X)) == "tool Bash"
    assert one(spark, "a ```` b", labels.fence(X)) == "`````"
    assert [one(spark, n, labels.token_label(X), "long") for n in (999, 1999, 1_250_000)] == ["999", "1k", "1.3M"]
    assert one(spark, "toolu_abcdefghij", labels.short_id(X)) == "abcdefg"
    now = F.lit("2024-03-08 00:00:00").cast("timestamp")
    fresh = lambda t: one(spark, t, labels.freshness(X.cast("timestamp"), now))
    assert fresh("2024-03-09") == 2.0 and fresh("2024-03-01") == pytest.approx(1.0)


def test_queries():
    p = query.parse('alpha "Beta Gamma" delta')
    assert (p.unquoted, p.literals) == ("alpha  delta", ("Beta Gamma",))
    assert query.parse('alpha "open phrase').literals == ("open phrase",)
    assert query.parse('""').empty and query.parse('"  \t "').empty
    assert query.parse('"only"').quoted_only and query.parse("my_ident and-more").words == ["and", "more"]
    assert query.parse("my_ident x").required == ["my_ident"]
    assert query.as_exact('a "b" c').literals == ("a b c",)
    assert query.effective_mode(query.parse('"x"'), "semantic") == "exact" and query.effective_mode(query.parse("x"), None, "hybrid") == "hybrid"
    assert query.is_uuid("e7d318b1-4274-4ee2-a341-e94893b5df49") and not query.is_uuid("e7d318b1")
    assert query.parse_ref("ch_bea1f946c697:m3..m5") == query.Ref("bea1f946c697", 3, 5)
    for bad in ("ch_12", "ch_bea1f946:m0", "ch_bea1f946:m5..m3", "ch_bea1f946:m1..."):
        with pytest.raises(ValueError):
            query.parse_ref(bad)
    with pytest.raises(ValueError):
        query.check_focus([query.Ref("aaaaaaaa", 1, 3)], (3, 4))
    assert query.digest("project-a", "session.jsonl").startswith("bea1f946c697")
