"""Registered queries of transcript files: lines are made of the tables, then parsed and folded.

The rows of ``messages`` become the lines they were delivered from, beside titles, commands
that clear the screen, warm-ups and the lines that do not parse. The SQL works on the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from threadloom.functions.cleaning import CAVEAT
from threadloom.functions.text import blank_to_null
from threadloom.operators import corpus, fold, viewer
from threadloom.plans.search_oracles import _CURRENT, trim, turn
from threadloom.session import cut_lineage, table
from threadloom.sources import jsonl

_CLEAR, _STDOUT = "<command-name>/clear</command-name>", "<local-command-stdout></local-command-stdout>"


def _text_line(kind: str, text, **more):
    block = F.array(F.struct(F.lit("text").alias("type"), text.alias("text")))
    message = F.struct(F.lit(kind).alias("role"), block.alias("content"), *[v.alias(k) for k, v in more.items()])
    return F.to_json(F.struct(F.lit(kind).alias("type"), message.alias("message")))


def _blocks(p):
    """A part as a content block; fields that are null are left out of the JSON."""
    is_ = lambda k: p["kind"] == k
    return F.struct(
        p["kind"].alias("type"),
        F.when(is_("text"), p["text"]).alias("text"),
        F.when(is_("thinking"), p["text"]).alias("thinking"),
        F.when(is_("thinking"), F.lit("s")).alias("signature"),
        F.when(is_("tool_use"), p["id"]).alias("id"),
        F.when(is_("tool_use"), p["name"]).alias("name"),
        F.when(is_("tool_use"), F.try_parse_json(p["input"])).alias("input"),
        F.when(is_("tool_result"), p["tool_use_id"]).alias("tool_use_id"),
        F.when(is_("tool_result"), p["content"]).alias("content"),
    )


def lines(spark: SparkSession, root: str) -> DataFrame:
    """The tables as physical lines of transcripts, as :func:`jsonl.read_lines` gives them."""
    same = Window.partitionBy("conv_ref", "jsonl_line")
    m = table(spark, root, "messages").where(F.col("conv_ref").isNotNull())
    m = m.withColumn("_n", F.row_number().over(same.orderBy(F.col("batch_no").asc_nulls_last(), "row_id")))
    late = 1_000_000 + F.row_number().over(same.orderBy("row_id"))
    m = m.withColumn("_line", F.coalesce("jsonl_line", late) + 4).where((F.col("_n") == 1) | F.col("jsonl_line").isNull())
    role = F.lower(blank_to_null("role"))
    kind = F.when(role.isin("user", "assistant"), role).otherwise("other")
    blocks = F.transform("parts", _blocks)
    plain = (F.size("parts") == 1) & (F.col("parts")[0]["kind"] == "text") & F.col("parts")[0]["text"].isNotNull()
    usage = F.struct(F.col("_line").alias("input_tokens"), F.size("parts").alias("output_tokens"))
    model = F.concat(F.lit("model-"), (F.col("_line") % 3).cast("string"))
    user = F.struct(kind.alias("type"), F.col("ts").alias("timestamp"), F.col("project_dir").alias("cwd"), F.col("parent_tool_use_id"), F.struct(role.alias("role"), blocks.alias("content")).alias("message"))
    said = F.struct(kind.alias("type"), F.col("ts").alias("timestamp"), F.col("project_dir").alias("cwd"), F.col("parent_tool_use_id"), F.struct(role.alias("role"), F.col("parts")[0]["text"].alias("content")).alias("message"))
    answer = F.struct(
        kind.alias("type"), F.col("ts").alias("timestamp"), F.col("parent_tool_use_id"),
        F.struct(F.col("assistant_message_id").alias("id"), role.alias("role"), model.alias("model"), usage.alias("usage"), blocks.alias("content")).alias("message"),
    )
    raw = F.when(kind == "assistant", F.to_json(answer)).when((kind == "user") & plain, F.to_json(said)).otherwise(F.to_json(user))
    spoken = m.select(F.col("conv_ref").alias("path"), "_line", raw.alias("raw"))
    paths = m.select(F.col("conv_ref").alias("path")).distinct()
    warm = F.right("path", F.lit(1)) < "8"
    opening = F.when(warm, F.array(_text_line("user", F.lit("Warmup")), _text_line("assistant", F.lit("ready"), id=F.lit("warm"), usage=F.struct(F.lit(5).alias("input_tokens"))))).otherwise(F.array(_text_line("user", F.lit(_CLEAR))))
    started = paths.select("path", F.posexplode(opening).alias("_at", "raw")).select("path", (F.col("_at") + 1).alias("_line"), "raw")
    entries = corpus.current_entries(table(spark, root, "cache_entries")).groupBy("conv_ref").agg(F.max("summary").alias("summary"), F.max("custom_title").alias("custom"))
    titled = entries.join(paths, F.col("conv_ref") == F.col("path"), "left_semi")
    summary = titled.where("summary is not null").select(F.col("conv_ref").alias("path"), F.lit(3).alias("_line"), F.to_json(F.struct(F.lit("summary").alias("type"), "summary")).alias("raw"))
    custom = titled.where("custom is not null").select(F.col("conv_ref").alias("path"), F.lit(4).alias("_line"), F.to_json(F.struct(F.lit("custom-title").alias("type"), F.col("custom").alias("customTitle"))).alias("raw"))
    bad = table(spark, root, "parse_errors").where(F.col("conv_ref").isNotNull() & F.col("line_content").isNotNull())
    broken = bad.select(F.col("conv_ref").alias("path"), (2_000_000 + F.row_number().over(Window.partitionBy("conv_ref").orderBy("line_number", "line_content"))).alias("_line"), F.col("line_content").alias("raw"))
    projects = table(spark, root, "projects").select("project_dir")
    cleared = F.array(*[_text_line("user", F.lit(t)) for t in (CAVEAT, _CLEAR, _STDOUT)])
    gone = projects.select(F.concat(F.lit("clear-"), "project_dir").alias("path"), F.posexplode(cleared).alias("_at", "raw")).select("path", (F.col("_at") + 1).alias("_line"), "raw")
    void = projects.select(F.concat(F.lit("empty-"), "project_dir").alias("path"), F.lit(1).alias("_line"), F.lit('{"type":"summary","summary":"nothing"}').alias("raw"))
    out = spoken
    for part in (started, summary, custom, broken, gone, void):
        out = out.unionByName(part)
    none = lambda t: F.lit(None).cast(t)
    return out.select("path", F.concat("path", F.lit(".jsonl")).alias("file_name"), none("string").alias("project_dir"), F.col("path").alias("session"), none("long").alias("file_size"), none("timestamp").alias("mtime"), F.col("_line").cast("int").alias("line_no"), "raw")


def _entries(spark, root):
    """Entries are parsed once and read by every branch of a fold."""
    return cut_lineage(jsonl.parse(lines(spark, root)), "entries")


def _folded(spark, root):
    return fold.conversations(_entries(spark, root))


def entry_failures(spark, root):
    """Which lines are entries, their type and number of blocks."""
    return _entries(spark, root).select("path", "line_no", F.when(F.col("error").isNull(), F.col("type")).alias("type"), F.col("error").isNotNull().alias("failed"), F.when(F.col("error").isNull() & F.col("type").isin("user", "assistant"), F.size("blocks")).alias("blocks"))


def error_context(spark, root):
    """Lines that do not parse, with how many lines stand around each."""
    physical = lines(spark, root)
    found = jsonl.parse_errors(physical, jsonl.parse(physical))
    return found.select("path", "line_number", F.size("context_before").alias("before"), F.size("context_after").alias("after"))


def folded_counts(spark, root):
    return _folded(spark, root).select("path", "message_count")


def folded_previews(spark, root):
    return _folded(spark, root).select("path", F.md5("preview_first").alias("first"), F.md5("preview_last").alias("last"))


def folded_texts(spark, root):
    return _folded(spark, root).select("path", F.octet_length("full_text").alias("bytes"), F.md5("full_text").alias("digest"))


def folded_tokens(spark, root):
    return _folded(spark, root).select("path", "total_tokens")


def folded_times(spark, root):
    return _folded(spark, root).select("path", "duration_minutes")


def folded_facts(spark, root):
    return _folded(spark, root).select("path", "cwd", "model", "summary", "custom_title")


def folded_turns(spark, root):
    f = _folded(spark, root)
    return f.select("path", F.size("semantic_turns").alias("turns"), F.md5(F.array_join("semantic_turns", "\n")).alias("digest"), F.aggregate("semantic_turn_ranges", F.lit(0), lambda s, r: s + r["start"]).alias("ordinals"))


def transcript_messages(spark, root):
    m = fold.messages(_entries(spark, root))
    return m.select("path", "ordinal", "role", "jsonl_line", "assistant_message_id", F.size("parts").alias("parts"))


def whole_transcripts(spark, root):
    """Only transcripts all of whose lines parse."""
    m = fold.messages(_entries(spark, root), bad="drop")
    return m.groupBy("path").agg(F.count(F.lit(1)).alias("messages"))


def entry_places(spark, root):
    return viewer.entry_index(_entries(spark, root)).select("path", "line_no", "entry_index")


def entry_texts(spark, root):
    return viewer.entry_text(_entries(spark, root), thinking=True).select("path", "entry_index", F.md5("text").alias("digest"))


_FOLDS = (
    "entry_failures error_context folded_counts folded_previews folded_texts folded_tokens folded_times folded_facts folded_turns "
    "transcript_messages whole_transcripts entry_places entry_texts"
).split()
QUERIES = {name: globals()[name] for name in _FOLDS}

_TEXT = "array_to_string(list_transform(list_filter(parts, lambda p: p.kind = 'text'), lambda p: p.text), ' ')"
_SEARCH = "array_to_string(list_filter(list_transform(parts, lambda p: CASE p.kind WHEN 'text' THEN p.text WHEN 'tool_result' THEN p.content END), lambda x: x <> ''), ' ')"
_PART = "STRUCT(kind VARCHAR, text VARCHAR, id VARCHAR, name VARCHAR, input VARCHAR, tool_use_id VARCHAR, content VARCHAR)[]"
_SHORT_PARTS = "list_transform(parts, lambda p: {'kind': p.kind, 'text': p.text, 'id': p.id, 'name': p.name, 'input': p.input, 'tool_use_id': p.tool_use_id, 'content': p.content})"


def _one(text: str) -> str:
    return f"[{{'kind': 'text', 'text': '{text}', 'id': NULL, 'name': NULL, 'input': NULL, 'tool_use_id': NULL, 'content': NULL}}]::{_PART}"


_E = f"""WITH {_CURRENT},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_ref, jsonl_line ORDER BY batch_no NULLS LAST, row_id) AS n,
    4 + coalesce(jsonl_line, 1000000 + row_number() OVER (PARTITION BY conv_ref, jsonl_line ORDER BY row_id)) AS line_no, lower({trim("role")}) AS r
  FROM messages WHERE conv_ref IS NOT NULL),
spoken AS (
  SELECT conv_ref AS path, line_no, CASE WHEN r IN ('user', 'assistant') THEN r ELSE 'other' END AS type, ts, project_dir AS cwd, assistant_message_id AS msg_id, {_SHORT_PARTS} AS parts,
    NULL::VARCHAR AS title, line_no + len(parts) AS tokens
  FROM numbered WHERE n = 1 OR jsonl_line IS NULL),
paths AS (SELECT DISTINCT path FROM spoken),
titles AS (SELECT conv_ref AS path, max(summary) AS summary, max(custom_title) AS custom FROM current WHERE conv_ref IN (SELECT path FROM paths) GROUP BY conv_ref),
lines AS (
  SELECT * FROM spoken
  UNION ALL SELECT path, 1, 'user', NULL, NULL, NULL, {_one("Warmup")}, NULL, NULL FROM paths WHERE right(path, 1) < '8'
  UNION ALL SELECT path, 2, 'assistant', NULL, NULL, 'warm', {_one("ready")}, NULL, 5 FROM paths WHERE right(path, 1) < '8'
  UNION ALL SELECT path, 1, 'user', NULL, NULL, NULL, {_one(_CLEAR)}, NULL, NULL FROM paths WHERE right(path, 1) >= '8'
  UNION ALL SELECT path, 3, 'summary', NULL, NULL, NULL, NULL, summary, NULL FROM titles WHERE summary IS NOT NULL
  UNION ALL SELECT path, 4, 'custom-title', NULL, NULL, NULL, NULL, custom, NULL FROM titles WHERE custom IS NOT NULL
  UNION ALL SELECT 'clear-' || project_dir, 1, 'user', NULL, NULL, NULL, {_one(CAVEAT)}, NULL, NULL FROM projects
  UNION ALL SELECT 'clear-' || project_dir, 2, 'user', NULL, NULL, NULL, {_one(_CLEAR)}, NULL, NULL FROM projects
  UNION ALL SELECT 'clear-' || project_dir, 3, 'user', NULL, NULL, NULL, {_one(_STDOUT)}, NULL, NULL FROM projects
  UNION ALL SELECT 'empty-' || project_dir, 1, 'summary', NULL, NULL, NULL, NULL, 'nothing', NULL FROM projects),
broken AS (
  SELECT * FROM (
    SELECT conv_ref AS path, 2000000 + row_number() OVER (PARTITION BY conv_ref ORDER BY line_number, line_content) AS line_no, line_content FROM parse_errors WHERE conv_ref IS NOT NULL AND line_content IS NOT NULL)
  WHERE coalesce({trim("line_content")}, '') <> ''),
marked AS (
  SELECT *, type IN ('user', 'assistant') AND (parts IS NULL OR len(list_filter(parts, lambda p: CASE p.kind
      WHEN 'text' THEN p.text IS NULL WHEN 'thinking' THEN p.text IS NULL WHEN 'tool_result' THEN p.tool_use_id IS NULL
      WHEN 'tool_use' THEN p.id IS NULL OR p.name IS NULL OR NOT coalesce(json_valid(p.input), false) ELSE false END)) > 0) AS failed
  FROM lines),
e AS (
  SELECT *, coalesce({_TEXT}, '') AS text, coalesce({_SEARCH}, '') AS search,
    len(list_filter(parts, lambda p: p.kind IN ('tool_use', 'tool_result') OR (p.kind IN ('text', 'thinking') AND {trim("p.text")} <> ''))) > 0 AS shows
  FROM marked WHERE NOT failed),
f AS (
  SELECT *, type = 'user' AND text <> '' AND ({trim("text")} = '' OR text LIKE 'Caveat: The messages below%' OR contains(text, '{_CLEAR}') OR contains(text, '<local-command-stdout>')) AS clear,
    type = 'user' AND text = '' AND search = '' AS skip
  FROM e),
g AS (
  SELECT *, coalesce(max(CASE WHEN type = 'user' AND NOT skip AND NOT clear AND text <> '' AND {trim("text")} <> 'Warmup' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen
  FROM f),
h AS (
  SELECT *, CASE WHEN type = 'user' THEN NOT skip AND NOT clear AND NOT (NOT seen AND {trim("text")} = 'Warmup') WHEN type = 'assistant' THEN seen AND shows ELSE false END AS counted
  FROM g),
o AS (
  SELECT *, CASE WHEN counted AND (type = 'user' OR msg_id IS NULL OR row_number() OVER (PARTITION BY path, type, msg_id, counted ORDER BY line_no) = 1) THEN 1 ELSE 0 END AS opens FROM h),
placed AS (
  SELECT *, sum(opens) OVER (PARTITION BY path ORDER BY line_no) AS running,
    CASE WHEN type = 'assistant' AND msg_id IS NOT NULL THEN msg_id ELSE line_no::VARCHAR END AS k
  FROM o),
keyed AS (
  SELECT path, k, min(running) AS ordinal, min(line_no) FILTER (text <> '') AS said_line, arg_max(text, line_no) FILTER (text <> '') AS said,
    arg_max(text, line_no) AS last_text, any_value(type) AS type
  FROM placed WHERE counted GROUP BY path, k),
kept AS (
  SELECT path FROM f GROUP BY path
  HAVING count(*) FILTER (search <> '' AND ((type = 'user' AND NOT skip) OR type = 'assistant')) > 0 AND path IN (SELECT path FROM keyed WHERE said IS NOT NULL))
"""
_TURN_USER, _TURN_ANSWER = turn("text", "false"), turn("text", "true")

ORACLES = {
    "entry_failures": _E
    + "SELECT path, line_no::INT AS line_no, CASE WHEN NOT failed THEN type END AS type, failed, CASE WHEN NOT failed AND type IN ('user', 'assistant') THEN len(parts)::INT END AS blocks FROM marked "
    "UNION ALL SELECT path, line_no::INT, NULL, true, NULL FROM broken",
    "error_context": _E
    + """, physical AS (SELECT path, line_no FROM lines UNION ALL SELECT conv_ref, 2000000 + row_number() OVER (PARTITION BY conv_ref ORDER BY line_number, line_content) FROM parse_errors WHERE conv_ref IS NOT NULL AND line_content IS NOT NULL),
        bad AS (SELECT path, line_no FROM marked WHERE failed UNION ALL SELECT path, line_no FROM broken)
        SELECT bad.path, bad.line_no::INT AS line_number, (count(*) FILTER (p.line_no BETWEEN bad.line_no - 2 AND bad.line_no - 1))::INT AS before,
          (count(*) FILTER (p.line_no BETWEEN bad.line_no + 1 AND bad.line_no + 2))::INT AS after
        FROM bad JOIN physical p ON bad.path = p.path GROUP BY bad.path, bad.line_no""",
    "folded_counts": _E + "SELECT path, sum(opens)::INT AS message_count FROM placed WHERE path IN (SELECT path FROM kept) GROUP BY path",
    "folded_previews": _E
    + """, r AS (SELECT path, said, row_number() OVER (PARTITION BY path ORDER BY said_line) AS up, row_number() OVER (PARTITION BY path ORDER BY said_line DESC) AS down FROM keyed WHERE said IS NOT NULL)
        SELECT path, md5(string_agg(said, ' ... ' ORDER BY up) FILTER (up <= 3)) AS first, md5(string_agg(said, ' ... ' ORDER BY down) FILTER (down <= 3)) AS last
        FROM r WHERE path IN (SELECT path FROM kept) GROUP BY path""",
    "folded_texts": _E
    + """, p AS (SELECT path, string_agg(search, ' ' ORDER BY line_no) AS body FROM f WHERE search <> '' AND ((type = 'user' AND NOT skip) OR type = 'assistant') GROUP BY path),
        t AS (SELECT kept.path, concat_ws(' ', nullif(trim(titles.custom), ''), titles.summary, p.body) AS full_text FROM kept LEFT JOIN titles ON kept.path = titles.path LEFT JOIN p ON kept.path = p.path)
        SELECT path, strlen(full_text)::INT AS bytes, md5(full_text) AS digest FROM t""",
    "folded_tokens": _E
    + """, u AS (SELECT path, coalesce(msg_id, line_no::VARCHAR || '?') AS k, arg_max(tokens, line_no) AS tokens FROM f WHERE type = 'assistant' GROUP BY ALL)
        SELECT kept.path, coalesce(sum(tokens), 0)::BIGINT AS total_tokens FROM kept LEFT JOIN u ON kept.path = u.path GROUP BY kept.path""",
    "folded_times": _E
    + """, t AS (SELECT path, line_no, epoch_us(try_cast(ts AS TIMESTAMPTZ)) // 1000000 AS t FROM f WHERE type IN ('user', 'assistant')),
        g2 AS (SELECT path, arg_min(t, line_no) FILTER (t IS NOT NULL) AS a, arg_max(t, line_no) FILTER (t IS NOT NULL) AS b FROM t GROUP BY path)
        SELECT kept.path, CASE WHEN floor((b - a) / 60.0) > 0 THEN floor((b - a) / 60.0)::BIGINT END AS duration_minutes FROM kept LEFT JOIN g2 ON kept.path = g2.path""",
    "folded_facts": _E
    + f""", x AS (SELECT path, arg_min(cwd, line_no) FILTER (type = 'user' AND cwd IS NOT NULL) AS cwd, min(line_no) FILTER (type = 'assistant' AND line_no > 4) AS a FROM f GROUP BY path)
        SELECT kept.path, cwd, 'model-' || (a % 3) AS model, summary, nullif({trim("custom")}, '') AS custom_title
        FROM kept JOIN x ON kept.path = x.path LEFT JOIN titles ON kept.path = titles.path""",
    "folded_turns": _E
    + f""", t AS (
          SELECT path, k, type, min(running) AS ordinal, arg_max(text, line_no) AS text, min(line_no) FILTER (CASE WHEN type = 'user' THEN {_TURN_USER} ELSE {_TURN_ANSWER} END IS NOT NULL) AS turn_line
          FROM placed WHERE counted GROUP BY ALL),
        s AS (SELECT path, turn_line, ordinal, CASE WHEN type = 'user' THEN {_TURN_USER} ELSE {_TURN_ANSWER} END AS turn FROM t)
        SELECT kept.path, count(turn)::INT AS turns, md5(coalesce(string_agg(turn, chr(10) ORDER BY turn_line), '')) AS digest, coalesce(sum(ordinal) FILTER (turn IS NOT NULL), 0)::INT AS ordinals
        FROM kept LEFT JOIN s ON kept.path = s.path GROUP BY kept.path""",
    "transcript_messages": _E
    + f""", w AS (
          SELECT *, coalesce(max(CASE WHEN type = 'user' AND NOT clear AND len(parts) > 0 AND {trim("text")} <> 'Warmup' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS after
          FROM f WHERE type IN ('user', 'assistant')),
        y AS (
          SELECT path, CASE WHEN type = 'assistant' AND msg_id IS NOT NULL THEN msg_id ELSE line_no::VARCHAR END AS k, min(line_no) AS first_line, max(line_no) AS jsonl_line,
            arg_max(type, line_no) AS role, arg_max(len(parts), line_no) AS parts, max(msg_id) AS assistant_message_id
          FROM w WHERE shows AND (CASE WHEN type = 'user' THEN NOT clear AND (after OR {trim("text")} <> 'Warmup') ELSE after END) GROUP BY ALL)
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY first_line)::INT AS ordinal, role, jsonl_line::INT AS jsonl_line, CASE WHEN role = 'assistant' THEN assistant_message_id END AS assistant_message_id, parts::INT AS parts FROM y""",
    "entry_places": _E + "SELECT path, line_no::INT AS line_no, (row_number() OVER (PARTITION BY path ORDER BY line_no) - 1)::INT AS entry_index FROM f",
    "entry_texts": _E
    + f""", i AS (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY line_no) - 1)::INT AS entry_index FROM f)
        SELECT path, entry_index, md5(array_to_string(list_transform(list_filter(parts, lambda p: p.kind IN ('text', 'thinking') AND {trim("p.text")} <> ''), lambda p: p.text), chr(10) || chr(10))) AS digest
        FROM i WHERE type IN ('user', 'assistant') AND len(parts) > 0""",
}
_WHOLE = ORACLES["transcript_messages"].replace("SELECT path, row_number()", "SELECT path, count(*) AS messages FROM y WHERE path NOT IN (SELECT path FROM marked WHERE failed UNION ALL SELECT path FROM broken) GROUP BY path --", 1)
ORACLES["whole_transcripts"] = _WHOLE
