"""DuckDB SQL for the registered search queries, built from a few macros."""

from __future__ import annotations

from threadloom.functions.cleaning import BOX, CODE_MARKERS, COMMAND_TERMS, TAGS, VALIDATION_TERMS
from threadloom.functions.matching import SEPARATORS
from threadloom.operators.activity import TOOLS
from threadloom.operators.lexical import WEIGHTS
from threadloom.plans.delivery_queries import LABELS
from threadloom.plans.search_queries import _VECTOR, NOW

_SPACE = r"\s\p{Z}\x{0B}\x{85}"
_CLASS = f"[{_SPACE}{SEPARATORS.replace('-', '').replace('/', '/')}\\-]"
_NOW = f"TIMESTAMPTZ '{NOW}+00'"


def norm(x: str) -> str:
    return f"lower(regexp_replace({x}, '{_CLASS}', ' ', 'g'))"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{_SPACE}]+', ' ', 'g'))"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def prefix(x: str, word: str, cap: int) -> str:
    """Occurrences of a word at the start of words; ``x`` must be a column."""
    p = f"string_split({x}, {quote(word)})"
    opens = f"len(list_filter(range(1, len({p})), lambda i: CASE WHEN {p}[i] = '' THEN i = 1 ELSE regexp_matches({p}[i], '[^\\p{{L}}\\p{{N}}]$') END))"
    return f"least({cap}, {opens})"


def adjacent(x: str, words: list[str], cap: int = 3) -> str:
    pairs = [prefix(x, f"{a} {b}", cap) for a, b in zip(words, words[1:])]
    return f"least({cap}, {' + '.join(pairs)})" if pairs else "0"


def turn(x: str, assistant: str) -> str:
    """The part of a turn that carries meaning, as the semantic index sees it; null if nothing is left."""
    body = f"regexp_replace({x}, '(?s)```.*?(```|\\z)', '', 'g')"
    for tag in TAGS:
        body = f"regexp_replace({body}, '(?s)<{tag}>.*?(</{tag}>|\\z)', '', 'g')"
    blocks = f"list_transform(regexp_extract_all({squeeze(body)}, '[{BOX}]+|[^{BOX}]+'), lambda b: trim(b))"
    low = " OR ".join(f"contains(b, '{o}{t}>')" for t in TAGS for o in ("<", "</"))
    status = f"(({' OR '.join(f'contains(lower(b), {quote(t)})' for t in VALIDATION_TERMS)}) AND ({' OR '.join(f'contains(lower(b), {quote(t)})' for t in COMMAND_TERMS)}))"
    count = lambda cls: f"len(regexp_extract_all(b, '{cls}'))"
    solid, box, marks, letters = count(f"[^{_SPACE}]"), count(f"[{BOX}]"), count("[|\\-+=_`]"), count("[\\p{L}\\p{Nl}\\p{N}]")
    code = " OR ".join(f"contains(b, {quote(m)})" for m in CODE_MARKERS)
    artifact = f"({solid} = 0 OR {box} * 4 >= {solid} OR ({box} >= 3 AND {solid} <= 24) OR ({marks} * 2 > {letters} AND contains(b, '|')) OR (({code}) AND {marks} > {letters} // 4))"
    kept = f"list_filter({blocks}, lambda b: b <> '' AND NOT starts_with(b, '/') AND NOT ({low}) AND NOT ({assistant} AND {status}) AND NOT {artifact})"
    return f"nullif({squeeze(f'array_to_string({kept}, chr(32))')}, '')"


_CURRENT = """current AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, file_size DESC NULLS LAST, entry_id DESC) AS version FROM cache_entries)
  WHERE version = 1 AND NOT coalesce(is_empty, false))"""

_DECODED = """array_to_string(list_transform(regexp_extract_all(project_dir, '-+|[^-]+'), lambda r: CASE WHEN r[1] <> '-' THEN r WHEN length(r) = 1 THEN '/' WHEN length(r) = 2 THEN '__'
          ELSE '/' || repeat('__', (length(r) - 1) // 2) || CASE WHEN (length(r) - 1) % 2 = 1 THEN '/' ELSE '' END END), '')"""
_SHORT = """CASE
    WHEN regexp_matches(home, '[^/]/*(__worktrees/|/\\.worktrees/)[^/]')
      THEN regexp_extract(home, '([^/]+)/*(__worktrees/|/\\.worktrees/)([^/]+)', 1) || '/' || regexp_extract(home, '([^/]+)/*(__worktrees/|/\\.worktrees/)([^/]+)', 3)
    WHEN list_extract(string_split(rtrim(home, '/'), '/'), -1) = '' THEN home
    ELSE list_extract(string_split(rtrim(home, '/'), '/'), -1) END"""

_TEXTS = f"""texts AS (
  SELECT conv_ref, path, project_dir, mtime, {_SHORT} AS project_name,
         concat_ws(' ', nullif(full_text, ''), nullif(agent_search_text, '')) AS body, custom_title, summary
  FROM (SELECT *, coalesce(cwd, {_DECODED}) AS home FROM current)),
fields AS (
  SELECT *, {norm("coalesce(custom_title, '')")} AS title_l, {norm("coalesce(summary, '')")} AS summary_l, {norm("coalesce(project_name, '')")} AS project_l,
         {norm("body")} AS body_l,
         concat_ws(' ', nullif(body, ''), nullif(project_name, '')) AS literal_text,
         {norm("concat_ws(' ', nullif(body, ''), nullif(project_name, ''))")} AS text_l,
         CASE WHEN mtime IS NULL THEN 2 * pow(2, NULL) WHEN mtime >= {_NOW} THEN 2.0
              ELSE 2 * pow(2, -(epoch_us({_NOW}) - epoch_us(mtime)) / 1e6 / 86400 / 7) END AS fresh
  FROM texts)"""

_HEAD = f"WITH {_CURRENT},\n{_TEXTS}\n"


def _score(words: list[str]) -> str:
    parts = []
    for name, weight in WEIGHTS.items():
        tf = " + ".join(f"ln(1 + {prefix(f'{name}_l', w, 10)})" for w in words)
        parts.append(f"{weight} * ({tf}) + {2 * weight} * {adjacent(f'{name}_l', words)}")
    return " + ".join(parts) + " + fresh"


def _scored(words: list[str], literals: tuple[tuple[str, bool], ...] = (), where: str = "true", columns: str = "", tail: str = "") -> str:
    parts, fields = [], []
    for name, weight in WEIGHTS.items():
        tf = " + ".join(f"ln(1 + {prefix(f'{name}_l', w, 10)})" for w in words)
        adj = adjacent(f"{name}_l", words)
        fields += [f"round({weight}::DOUBLE * ({tf}), 6) AS {name}_tf", f"round({2 * weight}::DOUBLE * {adj}, 6) AS {name}_adjacent"]
        parts.append(f"{weight} * ({tf}) + {2 * weight} * {adj}")
    tests = [f"contains(literal_text, {quote(x)})" if sensitive else f"contains(lower(literal_text), {quote(x.lower())})" for x, sensitive in literals]
    tests += [f"{prefix('text_l', w, 1)} > 0" for w in words]
    score = f"{' + '.join(parts)} + fresh" if words else "fresh"
    shown = ", ".join(fields) if columns == "fields" else f"round({score}, 6) AS score"
    return f"{_HEAD}SELECT conv_ref, path, {shown} FROM fields WHERE {' AND '.join([where, *tests])} {tail}"


# -- messages ------------------------------------------------------------------------

#: Results of tools keep head and tail, other parts the head.
_BOUND = "CASE WHEN length(t) <= 16384 THEN t WHEN kind IN ('tool_use', 'tool_result') THEN left(t, 12288) || right(t, 4096) ELSE left(t, 16384) END"
#: Messages as they remain of what was delivered, numbered in their conversation.
_DELIVERED = LABELS.strip() + """,
m AS (
  SELECT x.* EXCLUDE (ordinal), mtime,
         row_number() OVER (PARTITION BY x.conv_ref ORDER BY coalesce(x.ordinal::BIGINT, 2147483648 + coalesce(k.first_line, 2147483648)), coalesce(k.first_line, 2147483648), x.row_id)::INT AS ordinal
  FROM messages x JOIN (SELECT row_id, first_line FROM ranked WHERE rn = 1 AND conv_ref IS NOT NULL) k USING (row_id)
  LEFT JOIN (SELECT conv_ref, max(mtime) AS mtime FROM current GROUP BY conv_ref) e ON x.conv_ref = e.conv_ref)"""
_LINES = _DELIVERED.replace("WITH RECURSIVE raw AS (", f"WITH RECURSIVE {_CURRENT},\nraw AS (", 1)
_TOOL = """'tool ' || coalesce(p.name, '') || CASE WHEN len(json_keys(p.input)) > 0 THEN ' input_keys=' || array_to_string(list_sort(json_keys(p.input)), ',') ELSE '' END"""
_SEGMENTS = f"""{_LINES},
parts AS (
  SELECT row_id, conv_ref, ordinal, parent_tool_use_id, i, p.kind AS kind,
         coalesce(CASE p.kind WHEN 'tool_use' THEN {_TOOL} WHEN 'tool_result' THEN p.content ELSE p.text END, '') AS t
  FROM (SELECT row_id, conv_ref, ordinal, parent_tool_use_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM m)),
seg AS (SELECT row_id, conv_ref, ordinal, parent_tool_use_id, i, kind, {_BOUND} AS t FROM parts WHERE {trim("t")} <> ''),
off AS (
  SELECT *, coalesce(sum(strlen(t) + 1) OVER w, 0) AS b, coalesce(sum(length(t) + 1) OVER w, 0) AS c, {norm("t")} AS n,
         CASE kind WHEN 'thinking' THEN 2 WHEN 'tool_use' THEN 1 WHEN 'tool_result' THEN 1 ELSE 0 END AS source
  FROM seg WINDOW w AS (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
body AS (SELECT row_id, string_agg(t, chr(10) ORDER BY i) AS body FROM seg GROUP BY row_id),
sizes AS (SELECT conv_ref, count(*) AS size FROM m GROUP BY conv_ref)"""


def _hits(words: list[str], literals: tuple[tuple[str, bool], ...] = ()) -> str:
    spans = []
    for k, w in enumerate(words):
        spans.append(f"SELECT row_id, i, source, kind, {k} AS term, b AS b0, b + strlen(t) AS b1, c AS c0, c + length(t) AS c1 FROM off WHERE {prefix('n', w, 1)} > 0")
    for k, (x, sensitive) in enumerate(literals, len(words)):
        u, needle = ("t", x) if sensitive else ("lower(t)", x.lower())
        p = f"string_split({u}, {quote(needle)})"
        spans.append(
            f"SELECT row_id, i, source, kind, {k} AS term, b + strlen({p}[1]) AS b0, b + strlen({u}) - strlen({p}[-1]) AS b1, "
            f"c + length({p}[1]) AS c0, c + length({u}) - length({p}[-1]) AS c1 FROM off WHERE contains({u}, {quote(needle)})"
        )
    tests = [f"{prefix('n', w, 1)} > 0" for w in words]
    tests += [f"contains(body, {quote(x)})" if sensitive else f"contains(lower(body), {quote(x.lower())})" for x, sensitive in literals]
    pairs = " + ".join(f"contains(n, {quote(f'{a} {b}')})::INT" for a, b in zip(words, words[1:])) or "0"
    return f"""
{_SEGMENTS},
spans AS ({" UNION ALL ".join(spans)}),
best AS (
  SELECT row_id, count(DISTINCT term) AS terms, min(b0) AS b0, max(b1) AS b1, min(c0) AS c0, max(c1) AS c1, min(source) AS source,
         bool_or(kind = 'tool_use') AS tools, bool_or(kind = 'tool_result') AS tool_results, bool_or(kind = 'thinking') AS thinking
  FROM spans GROUP BY row_id),
bodies AS (SELECT row_id, body, {norm("body")} AS n FROM body),
hits AS (
  SELECT m.conv_ref, m.ordinal, 4.0 * terms + {3.0 * len(literals)} + 2.0 * ({pairs}) + 1.0 / greatest(b1 - b0, 1) AS score,
         ['dialogue', 'tool', 'thinking'][source + 1] AS source,
         left({squeeze("substring(body, greatest(c0 - 41, 0)::INT + 1, (c1 + 80 - greatest(c0 - 41, 0))::INT)")}, 160) AS preview,
         greatest(m.ordinal - 1, 1) AS read_start, least(m.ordinal + 1, size)::INT AS read_end, tools, tool_results, thinking, b0 AS first_offset, mtime,
         coalesce({trim("m.parent_tool_use_id")}, '') <> '' AS subagents
  FROM best JOIN bodies USING (row_id) JOIN m USING (row_id) JOIN sizes ON sizes.conv_ref = m.conv_ref
  WHERE {" AND ".join(tests)})
"""


_HIT_COLUMNS = "conv_ref, ordinal, round(score, 6) AS score, source, preview, read_start, read_end, tools, tool_results, thinking, subagents"

def _sentence(prefix_: str = "") -> str:
    said = [f"CASE WHEN {prefix_}{c} > 0 THEN '{verb} ' || {prefix_}{c} || ' {noun}' || CASE WHEN {prefix_}{c} = 1 THEN '' ELSE 's' END END" for c, _, verb, noun in TOOLS]
    s = f"concat_ws(', ', {', '.join(said)})"
    return f"upper({s}[1]) || {s}[2:]"


def _counters(name: str) -> str:
    named = ", ".join(f"'{t}'" for _, t, _, _ in TOOLS if t)
    return ", ".join(f"count(*) FILTER ({name} = '{t}') AS {c}" if t else f"count(*) FILTER (NOT coalesce({name} IN ({named}), false)) AS {c}" for c, t, _, _ in TOOLS)


_COUNTER_NAMES = ", ".join(c for c, _, _, _ in TOOLS)
_VEC = "[" + ", ".join(map(str, _VECTOR)) + "]::DOUBLE[64]"
_CHUNKS = f"""vectors AS (
  SELECT * FROM chunks WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT *, CASE WHEN list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0 THEN list_cosine_similarity(embedding::DOUBLE[], {_VEC}::DOUBLE[]) ELSE 0.0::DOUBLE END AS semantic,
         coalesce((contains(lower(text), 'slow')::INT + contains(lower(text), 'parser')::INT) * 0.1::DOUBLE, NULL) AS lexical
  FROM vectors),
by_chunk AS (
  SELECT *, semantic + lexical AS hybrid,
         row_number() OVER (PARTITION BY conv_ref ORDER BY round(semantic + lexical, 9) DESC NULLS LAST, round(semantic, 9) DESC, lexical DESC NULLS LAST, session_id NULLS FIRST, chunk_index, chunk_id) AS rn
  FROM scored),
best AS (SELECT * FROM by_chunk WHERE rn = 1)"""

_AGE = f"epoch_us({_NOW}) - epoch_us(mtime)"

#: A search for two words: fifty conversations, the first ten of these that have hits, their hits ranked.
_SEARCHED = (
    _hits(["slow", "parser"])
    + f""",
{_TEXTS},
listed AS (
  SELECT conv_ref, min(rank) AS rank FROM (
    SELECT conv_ref, row_number() OVER (ORDER BY {_score(["slow", "parser"])} DESC, mtime DESC NULLS LAST, conv_ref) AS rank FROM fields
    WHERE {prefix("text_l", "slow", 1)} > 0 AND {prefix("text_l", "parser", 1)} > 0 QUALIFY rank <= 50) GROUP BY conv_ref),
cut AS (
  SELECT * FROM hits WHERE conv_ref IN (SELECT conv_ref FROM listed)
  QUALIFY row_number() OVER (PARTITION BY conv_ref ORDER BY score DESC, ordinal, list_position(['dialogue', 'tool', 'thinking'], source), first_offset) <= 80),
asked AS (SELECT conv_ref FROM listed WHERE conv_ref IN (SELECT conv_ref FROM cut) ORDER BY rank LIMIT 10),
searched AS (SELECT *, row_number() OVER (ORDER BY score DESC, conv_ref, ordinal)::INT AS rank FROM cut WHERE conv_ref IN (SELECT conv_ref FROM asked))
"""
)
_WIDE = "[\\x{1100}-\\x{115F}\\x{2E80}-\\x{303E}\\x{3041}-\\x{33FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{A000}-\\x{A4CF}\\x{AC00}-\\x{D7A3}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE6F}\\x{FF00}-\\x{FF60}\\x{FFE0}-\\x{FFE6}]"


def _width(x: str) -> str:
    return f"(length({x}) + len(regexp_extract_all({x}, '{_WIDE}')))"


ORACLES = {
    "searched_messages": _SEARCHED + "SELECT conv_ref, ordinal, round(score, 6) AS score, 'lexical' AS kind, rank FROM searched",
    "hybrid_search": _SEARCHED
    + f""", lex AS (SELECT conv_ref, ordinal AS start, ordinal AS finish, rank AS lr FROM searched WHERE rank <= 80),
        {_CHUNKS.replace("best AS (SELECT * FROM by_chunk WHERE rn = 1)", "chunk AS (SELECT * FROM by_chunk WHERE rn = 1 AND m_start IS NOT NULL)")},
        sem AS (SELECT conv_ref, m_start AS start, m_end AS finish, source = 'agent_subagent_dialogue' AS sub, row_number() OVER (ORDER BY round(hybrid, 9) DESC NULLS LAST, conv_ref, m_start)::INT AS sr FROM chunk QUALIFY sr <= 80),
        titled AS (SELECT conv_ref, arg_max(coalesce(custom_title, summary, preview_first), (mtime, path)) AS title FROM current GROUP BY conv_ref)
        SELECT conv_ref, start, finish, lr AS lexical_rank, sr AS semantic_rank, round(coalesce(1.0 / (60 + lr), 0) + coalesce(1.0 / (60 + sr), 0), 9) AS score,
          CASE WHEN lr IS NOT NULL AND sr IS NOT NULL THEN 'hybrid' WHEN lr IS NULL THEN 'semantic' ELSE 'lexical' END AS source, coalesce(sub, false) AS subagents, title
        FROM (SELECT * FROM lex FULL JOIN sem USING (conv_ref, start, finish)) JOIN titled USING (conv_ref)""",
    "scoped_chunks": f"""WITH {_CURRENT} SELECT chunk_id, source FROM chunks
        WHERE (source = 'visible_dialogue' AND conv_ref IN (SELECT conv_ref FROM current WHERE message_count > 10))
           OR (source = 'agent_subagent_dialogue' AND conv_ref IN (SELECT conv_ref FROM current WHERE message_count > 10 AND agent_search_text <> ''))""",
    "chunk_labels": f"""WITH {_CHUNKS} SELECT chunk_id, printf('%s hybrid=%.3f semantic=%.3f lexical=%.3f', CASE WHEN hybrid < 0.35 THEN 'weak_match' WHEN lexical > 0 THEN 'lexical_boosted' ELSE 'semantic_only' END,
        round(hybrid, 3) + 0.0, round(semantic, 3) + 0.0, round(lexical, 3) + 0.0) AS label FROM best WHERE lexical IS NOT NULL""",
    "key_prefixes": "SELECT chunk_id, nullif(regexp_extract(chunk_key, '(?s)^(.*):', 1), '') AS prefix FROM chunks",
    "turn_totals": f"""WITH {_CURRENT}, f AS (SELECT coalesce(chunks.file_size = current.file_size AND chunks.mtime = current.mtime, false) AS fresh FROM chunks LEFT JOIN current ON chunks.conv_ref = current.conv_ref)
        SELECT (SELECT sum(coalesce(len(semantic_turns), 0))::BIGINT FROM current) AS turns, count(*) FILTER (fresh) AS hits, count(*) FILTER (NOT fresh) AS misses FROM f""",
    "message_clocks": "SELECT row_id, strftime(try_cast(ts AS TIMESTAMPTZ), '%H:%M') AS clock FROM messages",
    "cut_snippets": f"""WITH s AS (SELECT doc_id, {squeeze("text")} AS one, left({squeeze("text")}, 80) AS hard FROM documents),
        w AS (SELECT *, list_filter(range(0, 41), lambda n: {_width("left(hard, n)")} <= 39) AS fit FROM s)
        SELECT doc_id, md5(CASE WHEN length(one) <= 260 THEN one ELSE left(one, 259) || '…' END) AS long, hard, {_width("hard")}::INT AS width,
          CASE WHEN {_width("hard")} <= 40 THEN hard ELSE left(hard, list_max(fit)) || '…' END AS shown FROM w""",
    "tool_output_ids": f"""{_LINES}, p AS (SELECT conv_ref, ordinal, coalesce(nullif({trim("parent_tool_use_id")}, ''), 'top') AS parent, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS n FROM m)
        SELECT conv_ref, 'entry:' || ordinal || ':parent:' || parent || ':block:' || n || ':kind:' || CASE p.kind WHEN 'tool_use' THEN 'call:id:' || coalesce(p.id, 'none') ELSE 'result:id:' || coalesce(p.tool_use_id, 'none') END AS id,
          'entry:' || ordinal || ':parent:' || parent || ':kind:summary' AS summary FROM p WHERE p.kind IN ('tool_use', 'tool_result')""",
    "command_texts": f"""SELECT entry_id, CASE WHEN entry_id % 2 <> 0 THEN concat_ws(' ', '/note', nullif({trim("summary")}, '')) END AS skill,
        concat_ws(' ', CASE WHEN entry_id % 2 = 0 THEN '/clear' ELSE '/note' END, nullif({trim("summary")}, '')) AS tag,
        CASE WHEN entry_id % 3 = 0 THEN nullif({trim("summary")}, '') END AS output, summary AS plain FROM cache_entries WHERE summary IS NOT NULL""",
    "result_displays": """WITH p AS (SELECT row_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS n FROM messages)
        SELECT row_id, n::INT AS n, CASE row_id % 4 WHEN 0 THEN coalesce(p.content, '<no content>')
          WHEN 1 THEN coalesce(p.content || chr(10) || chr(10) || p.content, '[' || chr(10) || '  {},' || chr(10) || '  {}' || chr(10) || ']')
          WHEN 2 THEN '{' || chr(10) || '  "a": "x",' || chr(10) || '  "b": [' || chr(10) || '    1,' || chr(10) || '    null' || chr(10) || '  ]' || chr(10) || '}' ELSE '<no content>' END AS shown
        FROM p WHERE p.kind = 'tool_result'""",
    "current_entries": f"WITH {_CURRENT} SELECT entry_id, path, file_size, message_count FROM current",
    "list_projects": f"WITH {_CURRENT} SELECT project_dir, count(*) AS transcripts, epoch_us(max(mtime)) AS latest FROM current GROUP BY project_dir",
    "session_labels": f"WITH {_CURRENT} SELECT path, CASE WHEN session_id IS NULL OR count(*) OVER (PARTITION BY session_id) > 1 THEN path ELSE session_id END AS label FROM current",
    "parse_failures": "SELECT path, line_number, left(line_content, 200) AS line_content, error_message FROM parse_errors",
    "cached_files": f"""WITH {_CURRENT}
        SELECT e.entry_id, coalesce(e.file_size IS NOT DISTINCT FROM c.file_size AND e.mtime IS NOT DISTINCT FROM c.mtime AND c.path IS NOT NULL, false) AS hit
        FROM cache_entries e LEFT JOIN current c ON e.path = c.path""",
    "normalized_documents": f"SELECT doc_id, md5({norm('text')}) AS digest FROM documents",
    "prefix_counts": f"""WITH d AS (SELECT doc_id, {norm("coalesce(text, '')")} AS t FROM documents)
        SELECT doc_id, {prefix("t", "trans", 10)}::INT AS trans, {prefix("t", "cache", 10)}::INT AS cache, {adjacent("t", ["each", "slow", "task"])}::INT AS adjacent FROM d""",
    "cleaned_documents": "WITH c AS (SELECT doc_id, "
    + "".join("regexp_replace(" for _ in range(len(TAGS) + 1))
    + "text, '(?s)\\x{60}{3}.*?(\\x{60}{3}|\\z)', '', 'g')"
    + "".join(f", '(?s)<{t}>.*?(</{t}>|\\z)', '', 'g')" for t in TAGS)
    + f""" AS bare FROM documents),
        s AS (SELECT *, {squeeze("bare")} AS one FROM c)
        SELECT doc_id, md5(bare) AS bare, strlen(bare)::INT AS bytes, CASE WHEN length(one) <= 240 THEN one ELSE left(one, 237) || '...' END AS snippet FROM s""",
    "atoms": """SELECT item_id, replace(replace(replace(replace(url_encode(text), '+', '%20'), '%2F', '/'), '%3A', ':'), '%2B', '+') AS atom FROM eval_items""",
    "entry_labels": f"""SELECT entry_id,
        CASE WHEN total_tokens >= 1000000 THEN printf('%.1fM', total_tokens / 1000000.0) WHEN total_tokens >= 1000 THEN (total_tokens // 1000) || 'k' ELSE total_tokens::VARCHAR END AS tokens,
        CASE WHEN mtime IS NULL THEN NULL
             WHEN {_AGE} < 0 OR {_AGE} >= 7 * 86400000000 THEN strftime(mtime, '%b %d, %H:%M')
             WHEN {_AGE} < 60000000 THEN 'just now'
             WHEN {_AGE} < 3600000000 THEN ({_AGE}) // 60000000 || ' min ago'
             WHEN {_AGE} < 7200000000 THEN '1 hour ago'
             WHEN {_AGE} < 86400000000 THEN ({_AGE}) // 3600000000 || ' hours ago'
             WHEN {_AGE} < 2 * 86400000000 THEN 'yesterday'
             ELSE ({_AGE}) // 86400000000 || ' days ago' END AS age,
        CASE WHEN floor(({_AGE}) / 3600000000) < 24 THEN floor(({_AGE}) / 3600000000)::BIGINT || 'h' ELSE floor(floor(({_AGE}) / 3600000000) / 24)::BIGINT || 'd' END AS short
        FROM cache_entries""",
    "lexical_single": _scored(["transcript"]),
    "lexical_multi": _scored(["slow", "transcript"]),
    "lexical_top": _scored(["interoperability", "ranking"], tail="ORDER BY score DESC, mtime DESC NULLS LAST, conv_ref LIMIT 10"),
    "lexical_fields": _scored(["each", "slow", "parser"], columns="fields"),
    "lexical_scoped": _scored(["parser"], where="string_split(project_dir, '--worktrees-')[1] = '-home-dev-code-atlas-monorepo'"),
    "lexical_excluded": _scored(["heterogeneity"], where="(project_name IS NULL OR NOT (project_name = 'code' OR string_split(project_name, '/')[1] = 'code'))"),
    "exact_insensitive": _scored([], (("the slow task", False),)),
    "exact_sensitive": _scored([], (("The Silent Harbor", True),)),
    "mixed_literal": _scored(["parser", "build"], (("Copper Lantern", True),)),
    "identifier_literal": _scored(["window"], (("load_snippet", False),)),
    "browse": _scored([]),
    "message_words": _hits(["slow", "transcript"]) + f"SELECT {_HIT_COLUMNS} FROM hits",
    "message_literal": _hits(["queue"], (("Main Loop", True),)) + f"SELECT {_HIT_COLUMNS} FROM hits",
    "message_tools": _hits(["tool", "grep"]) + f"SELECT {_HIT_COLUMNS} FROM hits",
    "hits_per_conversation": _hits(["deduplication"])
    + """SELECT conv_ref, rank, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_ref ORDER BY floor(score * 10) DESC, list_position(['dialogue', 'tool', 'thinking'], source), score DESC, ordinal)::INT AS rank FROM hits)
        WHERE rank <= 2""",
    "tool_totals": f"""{_LINES}, t AS (SELECT conv_ref, p.name AS name FROM (SELECT conv_ref, unnest(parts) AS p FROM m) WHERE p.kind = 'tool_use'),
        c AS (SELECT conv_ref, {_counters("name")} FROM t GROUP BY conv_ref) SELECT *, {_sentence()} AS sentence FROM c""",
    "tool_runs": f"""{_LINES},
        marked AS (
          SELECT conv_ref, ordinal, parts, nullif({trim("parent_tool_use_id")}, '') AS parent,
            CASE WHEN len(parts) > 0 AND len(list_filter(parts, lambda p: p.kind <> 'tool_use')) = 0 AND lower({trim("role")}) = 'assistant' THEN 'call'
                 WHEN len(parts) > 0 AND len(list_filter(parts, lambda p: p.kind <> 'tool_result')) = 0 AND lower({trim("role")}) = 'user' THEN 'result' ELSE 'other' END AS kind
          FROM m),
        linked AS (SELECT *, lag(kind) OVER w AS was, lag(parent) OVER w AS had FROM marked WHERE kind <> 'result' WINDOW w AS (PARTITION BY conv_ref ORDER BY ordinal)),
        runs AS (
          SELECT *, sum(CASE WHEN kind = 'call' AND NOT coalesce(was = 'call' AND had IS NOT DISTINCT FROM parent, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_ref ORDER BY ordinal) AS run FROM linked),
        calls AS (SELECT conv_ref, run, parent, ordinal, unnest(parts).name AS name FROM runs WHERE kind = 'call'),
        c AS (SELECT conv_ref, run::BIGINT AS run, parent, min(ordinal) AS first, max(ordinal) AS last, {_counters("name")} FROM calls GROUP BY conv_ref, run, parent)
        SELECT *, {_sentence()} AS sentence FROM c""",
    "tool_results": """WITH p AS (SELECT conv_ref, row_id, unnest(parts) AS p FROM messages),
        calls AS (SELECT DISTINCT conv_ref, p.id AS call, p.name AS name FROM p WHERE p.kind = 'tool_use'),
        results AS (SELECT conv_ref, p.tool_use_id AS call, count(*) AS results, min(row_id) AS first_row FROM p WHERE p.kind = 'tool_result' GROUP BY ALL)
        SELECT conv_ref, call, name, results, first_row FROM calls JOIN results USING (conv_ref, call)""",
    "tool_keys": f"{_LINES} SELECT row_id, (i - 1)::INT AS n, {_TOOL} AS summary FROM (SELECT row_id, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM m) WHERE p.kind = 'tool_use'",
    "conversation_times": """WITH t AS (SELECT conv_ref, jsonl_line, row_id, try_cast(ts AS TIMESTAMPTZ) AS t FROM messages),
        g AS (SELECT conv_ref, arg_min(epoch_us(t), (jsonl_line, row_id)) FILTER (t IS NOT NULL) AS a, arg_max(epoch_us(t), (jsonl_line, row_id)) FILTER (t IS NOT NULL) AS b FROM t GROUP BY conv_ref)
        SELECT conv_ref, CASE WHEN floor((b - a) / 60000000.0) > 0 THEN floor((b - a) / 60000000.0)::BIGINT END AS minutes FROM g""",
    "semantic_turns": f"""WITH t AS (
          SELECT row_id, lower({trim("role")}) AS role, array_to_string(list_transform(list_filter(parts, lambda p: p.kind = 'text'), lambda p: p.text), ' ') AS text
          FROM messages WHERE len(list_filter(parts, lambda p: p.kind = 'text')) > 0)
        SELECT row_id, {turn("text", "coalesce(role = 'assistant', false)")} AS turn FROM t""",
    "exported_paragraphs": f"""{_LINES}, b AS (
          SELECT conv_ref, ordinal, lower({trim("role")}) AS r, array_to_string(list_transform(list_filter(parts, lambda p: p.kind = 'text' AND coalesce({trim("p.text")}, '') <> ''), lambda p: p.text), chr(10)) AS body
          FROM m WHERE coalesce({trim("parent_tool_use_id")}, '') = '')
        SELECT conv_ref, ordinal, '## ' || CASE r WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Assistant' ELSE coalesce(nullif(r, ''), '?') END || chr(10) || chr(10) || body || chr(10) || chr(10) AS text FROM b WHERE body <> ''""",
    "previews": f"""{_LINES},
        t AS (SELECT conv_ref, ordinal, array_to_string(list_transform(list_filter(parts, lambda p: p.kind = 'text' AND coalesce({trim("p.text")}, '') <> ''), lambda p: p.text), ' ') AS text FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY conv_ref ORDER BY ordinal) AS up, row_number() OVER (PARTITION BY conv_ref ORDER BY ordinal DESC) AS down FROM t WHERE text <> '')
        SELECT conv_ref, string_agg(text, ' ... ' ORDER BY up) FILTER (up <= 3) AS first, string_agg(text, ' ... ' ORDER BY down) FILTER (down <= 3) AS last FROM r GROUP BY conv_ref""",
    "message_positions": f"{_LINES} SELECT conv_ref, ordinal, row_number() OVER (PARTITION BY conv_ref ORDER BY ordinal)::INT AS position FROM m",
    "best_chunks": f"""WITH {_CHUNKS}
        SELECT conv_ref, chunk_id, round(semantic, 6) AS semantic, round(lexical, 6) AS lexical, round(hybrid, 6) AS hybrid,
          CASE WHEN hybrid >= 0.85 THEN 'strong' WHEN hybrid >= 0.65 THEN 'good' WHEN hybrid >= 0.35 THEN 'fair' ELSE 'weak' END AS quality,
          CASE WHEN hybrid < 0.35 THEN 'weak_match' WHEN lexical > 0 THEN 'lexical_boosted' ELSE 'semantic_only' END AS rationale FROM best""",
    "chunk_counts": "SELECT conv_ref, count(*) AS chunks FROM chunks GROUP BY conv_ref ORDER BY chunks DESC, conv_ref LIMIT 10",
    "stale_chunks": f"""WITH {_CURRENT} SELECT chunk_id FROM chunks LEFT JOIN current ON chunks.conv_ref = current.conv_ref
        WHERE NOT coalesce(chunks.file_size = current.file_size AND chunks.mtime = current.mtime, false)""",
    "fused_hits": _hits(["slow", "parser"])
    + f""", h AS (SELECT conv_ref, ordinal, max(score) AS score FROM hits GROUP BY conv_ref, ordinal),
        lex AS (SELECT conv_ref, ordinal AS start, ordinal AS finish, row_number() OVER (ORDER BY score DESC, conv_ref, ordinal) AS lr FROM h QUALIFY lr <= 100),
        {_CHUNKS.replace("best AS (", "chunk AS (").replace("rn = 1)", "rn = 1 AND m_start IS NOT NULL)")},
        sem AS (SELECT conv_ref, m_start AS start, m_end AS finish, row_number() OVER (ORDER BY round(hybrid, 9) DESC NULLS LAST, conv_ref) AS sr FROM chunk QUALIFY sr <= 100)
        SELECT conv_ref, start, finish, round(coalesce(1.0 / (60 + lr), 0) + coalesce(1.0 / (60 + sr), 0), 9) AS score,
          CASE WHEN lr IS NOT NULL AND sr IS NOT NULL THEN 'hybrid' WHEN lr IS NULL THEN 'semantic' ELSE 'lexical' END AS source
        FROM lex FULL JOIN sem USING (conv_ref, start, finish)""",
    "outlines": f"""{_LINES}, v AS (
          SELECT conv_ref, ordinal, lower({trim("role")}) AS role, array_to_string(list_transform(list_filter(parts, lambda p: p.kind = 'text' AND coalesce({trim("p.text")}, '') <> ''), lambda p: p.text), chr(10)) AS body
          FROM m WHERE coalesce({trim("parent_tool_use_id")}, '') = ''),
        s AS (SELECT *, row_number() OVER (PARTITION BY conv_ref ORDER BY ordinal) AS place, count(*) OVER (PARTITION BY conv_ref) AS n, left({squeeze("body")}, 80) AS snippet FROM v WHERE body <> '')
        SELECT conv_ref, ordinal AS start, ordinal AS finish, length(body) AS chars, 'm' || ordinal || ' role=' || coalesce(nullif(role, ''), '') || ' c~' || length(body) || ' ' || snippet AS line FROM s WHERE n <= 20
        UNION ALL
        SELECT conv_ref, min(ordinal), max(ordinal), sum(length(body))::BIGINT, 'seg m' || min(ordinal) || '..m' || max(ordinal) || ' c~' || sum(length(body)) || ' ' || arg_min(snippet, place) || ' / ' || arg_max(snippet, place)
        FROM s WHERE n > 20 GROUP BY conv_ref, (place - 1) // 10""",
    "project_names": """SELECT project_dir, string_split(project_dir, '--worktrees-')[1] AS root,
        array_to_string(list_transform(regexp_extract_all(project_dir, '-+|[^-]+'), lambda r: CASE WHEN r[1] <> '-' THEN r WHEN length(r) = 1 THEN '/' WHEN length(r) = 2 THEN '__'
          ELSE '/' || repeat('__', (length(r) - 1) // 2) || CASE WHEN (length(r) - 1) % 2 = 1 THEN '/' ELSE '' END END), '') AS path,
        array_to_string(list_transform(regexp_extract_all(project_dir, '-+|[^-]+'), lambda r: CASE WHEN r[1] <> '-' THEN r WHEN length(r) % 2 = 1 THEN '/' || repeat('_', length(r) - 1) ELSE repeat('_', length(r)) END), '') AS display,
        regexp_replace(path, '[^A-Za-z0-9-]', '-', 'g') AS again FROM projects""",
    "model_labels": """SELECT entry_id, CASE WHEN length(model) > 20 AND NOT regexp_matches(model, '-[0-9]{8}$') THEN left(model, 19) || '…' ELSE model END AS model FROM cache_entries""",
    "shown_lines": f"""{_LINES}, v AS (
          SELECT conv_ref, ordinal, array_to_string(list_transform(list_filter(parts, lambda p: p.kind = 'text' AND coalesce({trim("p.text")}, '') <> ''), lambda p: p.text), chr(10)) AS body
          FROM m WHERE coalesce({trim("parent_tool_use_id")}, '') = ''),
        l AS (SELECT conv_ref, ordinal, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM v WHERE body <> ''),
        k AS (SELECT *, lag(line) OVER (PARTITION BY conv_ref, ordinal ORDER BY i) AS before FROM l)
        SELECT conv_ref, ordinal, row_number() OVER (PARTITION BY conv_ref, ordinal ORDER BY i)::INT AS line_no, line FROM k WHERE i = 1 OR trim(line) <> '' OR trim(before) <> ''""",
}
