"""Registered queries of the search operators, with SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from threadloom.functions import cleaning, labels, matching, paths
from threadloom.functions.text import blank_to_null
from threadloom.operators import activity, corpus, delivery, evidence, export, lexical, messages, positions, protocol, ranking, retrieval, semantic, viewer
from threadloom.plans.query import digest
from threadloom.session import table

NOW = "2026-07-01 00:00:00"


def _now() -> Column:
    return F.lit(NOW).cast("timestamp")


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return corpus.current_entries(table(spark, root, "cache_entries"))


def _corpus(spark: SparkSession, root: str) -> DataFrame:
    return corpus.searchable(_entries(spark, root))


def _ranked(found: DataFrame) -> DataFrame:
    return found.select("conv_ref", "path", F.round("score", 6).alias("score"))


# -- corpus ------------------------------------------------------------------------


def current_entries(spark, root):
    return _entries(spark, root).select("entry_id", "path", "file_size", "message_count")


def list_projects(spark, root):
    return corpus.list_projects(_entries(spark, root)).select("project_dir", "transcripts", F.unix_micros("latest").alias("latest"))


def session_labels(spark, root):
    return corpus.session_labels(_entries(spark, root)).select("path", "label")


def parse_failures(spark, root):
    bad = table(spark, root, "parse_errors")
    return bad.select("path", "line_number", F.left("line_content", F.lit(200)).alias("line_content"), "error_message")


def project_names(spark, root):
    p = table(spark, root, "projects")
    d = F.col("project_dir")
    return p.select(
        "project_dir",
        paths.project_root(d).alias("root"),
        paths.decode_path(d).alias("path"),
        paths.display_path(d).alias("display"),
        paths.encode_path(paths.decode_path(d)).alias("again"),
    )


def cached_files(spark, root):
    """Which file versions the manifest of current folds can answer, and which must be read."""
    files = table(spark, root, "cache_entries").select("entry_id", "path", "file_size", "mtime")
    held = _entries(spark, root).select("path", F.col("file_size").alias("held_size"), F.col("mtime").alias("held_time"))
    same = F.col("file_size").eqNullSafe(F.col("held_size")) & F.col("mtime").eqNullSafe(F.col("held_time"))
    return files.join(held, "path", "left").select("entry_id", (F.coalesce(same, F.lit(False))).alias("hit"))


# -- text --------------------------------------------------------------------------


def normalized_documents(spark, root):
    return table(spark, root, "documents").select("doc_id", F.md5(matching.normalize("text")).alias("digest"))


def prefix_counts(spark, root):
    text = F.col("t")
    return table(spark, root, "documents").select("doc_id", matching.normalize(F.coalesce("text", F.lit(""))).alias("t")).select(
        "doc_id",
        matching.prefix_count(text, "trans", 10).alias("trans"),
        matching.prefix_count(text, "cache", 10).alias("cache"),
        matching.adjacent_count(text, ["each", "slow", "task"]).alias("adjacent"),
    )


def cleaned_documents(spark, root):
    """Documents without fenced code, cut for a list."""
    bare = cleaning.strip_tags(cleaning.strip_fences(F.col("text")))
    return table(spark, root, "documents").select("doc_id", F.md5(bare).alias("bare"), F.octet_length(bare).alias("bytes"), labels.snippet(bare, 240).alias("snippet"))


def semantic_turns(spark, root):
    """Texts of messages as the semantic index sees them."""
    rows = table(spark, root, "messages").where(F.exists("parts", lambda p: p["kind"] == "text"))
    text = F.array_join(F.transform(F.filter("parts", lambda p: p["kind"] == "text"), lambda p: p["text"]), " ")
    role = F.lower(blank_to_null("role"))
    return rows.select("row_id", cleaning.semantic_turn(text, F.coalesce(role == "assistant", F.lit(False))).alias("turn"))


def atoms(spark, root):
    return table(spark, root, "eval_items").select("item_id", labels.atom(F.col("text")).alias("atom"))


def entry_labels(spark, root):
    e = table(spark, root, "cache_entries")
    return e.select("entry_id", labels.token_label(F.col("total_tokens")).alias("tokens"), labels.age_label(F.col("mtime"), _now()).alias("age"), labels.short_age(F.col("mtime"), _now()).alias("short"))


# -- conversations -----------------------------------------------------------------


def lexical_single(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), "transcript", _now()))


def lexical_multi(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), "slow transcript", _now()))


def lexical_top(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), "interoperability ranking", _now(), top=10))


def lexical_fields(spark, root):
    found = lexical.search(_corpus(spark, root), "each slow parser", _now(), debug=True)
    return found.select("conv_ref", "path", *[F.round(f"{n}_{k}", 6).alias(f"{n}_{k}") for n in lexical.WEIGHTS for k in ("tf", "adjacent")])


def lexical_scoped(spark, root):
    scoped = corpus.in_workspace(_corpus(spark, root), "-home-dev-code-atlas-monorepo")
    return _ranked(lexical.search(scoped, "parser", _now()))


def lexical_excluded(spark, root):
    kept = corpus.without_projects(_corpus(spark, root), ["code"])
    return _ranked(lexical.search(kept, "heterogeneity", _now()))


def exact_insensitive(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), '"the slow task"', _now()))


def exact_sensitive(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), '"The Silent Harbor"', _now()))


def mixed_literal(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), 'parser "Copper Lantern" build', _now()))


def identifier_literal(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), "load_snippet window", _now()))


def browse(spark, root):
    return _ranked(lexical.search(_corpus(spark, root), "  ", _now()))


# -- messages ----------------------------------------------------------------------

_HIT = ("conv_ref", "ordinal", "score", "source", "preview", "read_start", "read_end", "tools", "tool_results", "thinking", "subagents")


def _messages(spark, root):
    """All messages, each once and numbered in its conversation, with its conversation's time."""
    times = _entries(spark, root).groupBy("conv_ref").agg(F.max("mtime").alias("timestamp"))
    return delivery.delivered(table(spark, root, "messages")).join(times, "conv_ref", "left")


def _hit_rows(found: DataFrame) -> DataFrame:
    return found.select("conv_ref", "ordinal", F.round("score", 6).alias("score"), "source", "preview", F.col("read.start").alias("read_start"), F.col("read.end").alias("read_end"), *_HIT[7:])


def message_words(spark, root):
    return _hit_rows(messages.hits(_messages(spark, root), "slow transcript"))


def message_literal(spark, root):
    return _hit_rows(messages.hits(_messages(spark, root), 'queue "Main Loop"'))


def message_tools(spark, root):
    return _hit_rows(messages.hits(_messages(spark, root), "tool grep"))


def hits_per_conversation(spark, root):
    best = ranking.top_per_conversation(messages.hits(_messages(spark, root), "deduplication"), 2)
    return best.select("conv_ref", "rank", F.round("score", 6).alias("score"))


def grouped_hits(spark, root):
    """The ten best conversations; the limit of candidates holds inside each conversation."""
    found = messages.best_in_conversation(messages.hits(_messages(spark, root), "long parser"), lexical.candidate_limit(10, 2))
    return ranking.best_groups(ranking.group_hits(found), 10)


def outlines(spark, root):
    return protocol.outline(_messages(spark, root))


def tool_totals(spark, root):
    return activity.tool_counts(_messages(spark, root), "conv_ref")


def tool_runs(spark, root):
    return activity.tool_runs(_messages(spark, root))


def tool_results(spark, root):
    """Calls joined with their results."""
    parts = table(spark, root, "messages").select("conv_ref", "row_id", F.explode("parts").alias("p"))
    calls = parts.where(F.col("p.kind") == "tool_use").select("conv_ref", F.col("p.id").alias("call"), "p.name").distinct()
    results = parts.where(F.col("p.kind") == "tool_result").groupBy("conv_ref", F.col("p.tool_use_id").alias("call")).agg(F.count(F.lit(1)).alias("results"), F.min("row_id").alias("first_row"))
    return calls.join(results, ["conv_ref", "call"])


def tool_keys(spark, root):
    parts = _messages(spark, root).select("row_id", F.posexplode("parts").alias("n", "p")).where(F.col("p.kind") == "tool_use")
    return parts.select("row_id", "n", labels.tool_summary(F.col("p.name"), F.col("p.input")).alias("summary"))


def conversation_times(spark, root):
    """First and last stamp of each conversation in line order, whole minutes between."""
    m = table(spark, root, "messages").withColumn("t", F.try_to_timestamp("ts"))
    at = F.when(F.col("t").isNotNull(), F.struct("jsonl_line", "row_id"))
    g = m.groupBy("conv_ref").agg(F.min_by("t", at).alias("a"), F.max_by("t", at).alias("b"))
    minutes = F.floor((F.unix_micros("b") - F.unix_micros("a")) / 60_000_000)
    return g.select("conv_ref", F.when(minutes > 0, minutes).alias("minutes"))


def previews(spark, root):
    """The first three texts of a conversation, and the last three, newest first.

    Only three of each are ever kept: ranks are limited before the shuffle.
    """
    text = F.array_join(F.transform(F.filter("parts", lambda p: (p["kind"] == "text") & blank_to_null(p["text"]).isNotNull()), lambda p: p["text"]), " ")
    t = _messages(spark, root).select("conv_ref", "ordinal", text.alias("text")).where(F.col("text") != "")
    up, down = Window.partitionBy("conv_ref").orderBy("ordinal"), Window.partitionBy("conv_ref").orderBy(F.col("ordinal").desc())
    first = t.withColumn("r", F.row_number().over(up)).where(F.col("r") <= 3)
    last = t.withColumn("r", F.row_number().over(down)).where(F.col("r") <= 3)
    joined = lambda df, name: df.groupBy("conv_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ... ").alias(name))
    return joined(first, "first").join(joined(last, "last"), "conv_ref")


def message_positions(spark, root):
    """The place of each message in its conversation, counted without gaps."""
    placed = positions.positions(_messages(spark, root).select("conv_ref", "ordinal"), "conv_ref", "ordinal", block=16)
    return placed.select("conv_ref", "ordinal", "position")


# -- semantic ----------------------------------------------------------------------

_VECTOR = [1.0 if i % 3 == 0 else -0.5 if i % 3 == 1 else 0.25 for i in range(64)]


def _chunks(spark, root):
    return table(spark, root, "chunks")


def best_chunks(spark, root):
    best = semantic.rank(_chunks(spark, root), _VECTOR, "slow parser")
    return best.select("conv_ref", "chunk_id", *[F.round(c, 6).alias(c) for c in ("semantic", "lexical", "hybrid")], "quality", "rationale")


def chunk_counts(spark, root):
    counts = table(spark, root, "chunks").groupBy("conv_ref").agg(F.count(F.lit(1)).alias("chunks"))
    return counts.orderBy(F.col("chunks").desc(), "conv_ref").limit(10)


def stale_chunks(spark, root):
    """Chunks whose file has changed or is gone since they were embedded."""
    files = _entries(spark, root).select("conv_ref", F.col("file_size").alias("now_size"), F.col("mtime").alias("now_time"))
    c = table(spark, root, "chunks").join(files, "conv_ref", "left")
    fresh = (F.col("file_size") == F.col("now_size")) & (F.col("mtime") == F.col("now_time"))
    return c.where(~F.coalesce(fresh, F.lit(False))).select("chunk_id")


def fused_hits(spark, root, limit=100):
    """Ranks of both lists fused. ``limit`` is the length of the lists, as it is for a search; None takes all."""
    hits = messages.hits(_messages(spark, root), "slow parser").groupBy("conv_ref", "ordinal").agg(F.max("score").alias("score"))
    order = Window.orderBy(F.col("score").desc(), "conv_ref", "ordinal")
    lex = hits if limit is None else hits.orderBy(F.col("score").desc(), "conv_ref", "ordinal").limit(limit)
    lex = lex.select("conv_ref", F.struct(F.col("ordinal").alias("start"), F.col("ordinal").alias("end")).alias("focus"), F.row_number().over(order).alias("rank"), F.lit(False).alias("exact"))
    sem = semantic.rank(_chunks(spark, root), _VECTOR, "slow parser").where(F.col("m_start").isNotNull())
    # Equal to nine digits is equal: engines add up products in different orders.
    sem = sem.withColumn("hybrid", F.round("hybrid", 9))
    sem = sem if limit is None else sem.orderBy(F.col("hybrid").desc(), "conv_ref").limit(limit)
    sem = sem.select("conv_ref", F.struct(F.col("m_start").alias("start"), F.col("m_end").alias("end")).alias("focus"), F.row_number().over(Window.orderBy(F.col("hybrid").desc(), "conv_ref")).alias("rank"))
    return ranking.fuse(lex, sem).select("conv_ref", F.col("focus.start").alias("start"), F.col("focus.end").alias("finish"), F.round("score", 9).alias("score"), "source")


def packed_chunks(spark, root):
    return semantic.build_chunks(_entries(spark, root))


def embedded_chunks(spark, root):
    return semantic.embed(semantic.build_chunks(_entries(spark, root)), semantic.HashingEmbedder())


def _refs(batches):
    for batch in batches:
        pairs = zip(batch.column("project_dir").to_pylist(), batch.column("file").to_pylist())
        refs = [None if p is None or f is None else f"ch_{digest(p, f)}" for p, f in pairs]
        yield pa.RecordBatch.from_arrays([batch.column("project_dir"), batch.column("file"), pa.array(refs, pa.string())], names=["p", "f", "ref"])


def conversation_refs(spark, root):
    """Refs made of project and file name; 128-bit arithmetic needs Python."""
    e = table(spark, root, "cache_entries").select("entry_id", "project_dir", F.element_at(F.split("path", "/"), -1).alias("file"))
    # Each file once, however many versions it has.
    refs = e.select("project_dir", "file").distinct().mapInArrow(_refs, "p string, f string, ref string")
    return e.join(refs, F.col("project_dir").eqNullSafe(F.col("p")) & F.col("file").eqNullSafe(F.col("f")), "left").select("entry_id", "ref")


def exported_paragraphs(spark, root):
    """Dialogue as markdown, one paragraph per message."""
    return export.paragraphs(_messages(spark, root), "markdown")


def evidence_spots(spark, root):
    """Spots of each matching conversation that its preview does not show."""
    found = lexical.search(_corpus(spark, root), "interoperability ranking", _now()).select("conv_ref", "path")
    return evidence.evidence(_entries(spark, root).join(found.select("path"), "path", "left_semi"), "interoperability ranking")


def tool_displays(spark, root):
    return viewer.tool_calls(table(spark, root, "messages"))


def shown_lines(spark, root):
    """Lines of dialogue as a viewer numbers them."""
    return viewer.body_lines(protocol.rendered(_messages(spark, root)))


def model_labels(spark, root):
    return table(spark, root, "cache_entries").select("entry_id", viewer.model_label(F.col("model")).alias("model"))


def hybrid_search(spark, root):
    """A search from the query to fused hits: shortlist, early stop, chunks of both sources."""
    found = retrieval.hybrid(_corpus(spark, root), _messages(spark, root), _chunks(spark, root), "slow parser", _VECTOR, _now())
    return found.select("conv_ref", F.col("focus.start").alias("start"), F.col("focus.end").alias("finish"), "lexical_rank", "semantic_rank", F.round("score", 9).alias("score"), "source", "subagents", "title")


def searched_messages(spark, root):
    """Hits of a search that stops once ten conversations have some."""
    found = retrieval.message_hits(_corpus(spark, root), _messages(spark, root), "slow parser", _now(), top=10)
    return found.select("conv_ref", "ordinal", F.round("score", 6).alias("score"), "kind", "rank")


def scoped_chunks(spark, root):
    """Chunks of the newest files only, and only of sources that these files have."""
    scope = _entries(spark, root).where("coalesce(message_count, 0) > 10").select("conv_ref", F.explode(F.array(F.lit(retrieval.VISIBLE), F.when(F.coalesce("agent_search_text", F.lit("")) != "", F.lit(retrieval.SUBAGENT)))).alias("source"))
    return retrieval.candidates(_chunks(spark, root), scope.where("source is not null")).select("chunk_id", "source")


def chunk_labels(spark, root):
    best = semantic.rank(_chunks(spark, root), _VECTOR, "slow parser").where(F.col("lexical").isNotNull())
    return best.select("chunk_id", labels.chunk_label(F.col("rationale"), F.round("hybrid", 3), F.round("semantic", 3), F.round("lexical", 3)).alias("label"))


def key_prefixes(spark, root):
    return _chunks(spark, root).select("chunk_id", labels.key_prefix(F.col("chunk_key")).alias("prefix"))


def turn_totals(spark, root):
    """Turns of all current files, and how many chunks the index still has for them."""
    entries = _entries(spark, root)
    files = entries.select("conv_ref", F.col("file_size").alias("now_size"), F.col("mtime").alias("now_time"))
    fresh = (F.col("file_size") == F.col("now_size")) & (F.col("mtime") == F.col("now_time"))
    chunks = _chunks(spark, root).join(files, "conv_ref", "left").agg(F.count_if(F.coalesce(fresh, F.lit(False))).alias("hits"), F.count_if(~F.coalesce(fresh, F.lit(False))).alias("misses"))
    return entries.agg(F.sum(F.coalesce(F.size("semantic_turns"), F.lit(0))).alias("turns")).crossJoin(chunks)  # one row by one row


def message_clocks(spark, root):
    return table(spark, root, "messages").select("row_id", labels.clock_label(F.col("ts")).alias("clock"))


def cut_snippets(spark, root):
    """Documents as lists show them: by characters, and by columns of a terminal."""
    text = F.col("text")
    return table(spark, root, "documents").select("doc_id", F.md5(labels.snippet(text, 260, "…")).alias("long"), labels.hard_cut(text).alias("hard"), labels.display_width(labels.hard_cut(text)).alias("width"), labels.display_cut(labels.hard_cut(text), 40).alias("shown"))


def tool_output_ids(spark, root):
    p = _messages(spark, root).select("conv_ref", "ordinal", blank_to_null("parent_tool_use_id").alias("parent"), F.posexplode("parts").alias("n", "p")).where(F.col("p.kind").isin("tool_use", "tool_result"))
    kind = F.when(F.col("p.kind") == "tool_use", "call").otherwise("result")
    ident = F.when(F.col("p.kind") == "tool_use", F.col("p.id")).otherwise(F.col("p.tool_use_id"))
    return p.select("conv_ref", labels.tool_output_id(F.col("ordinal"), F.col("parent"), F.col("n"), kind, ident).alias("id"), labels.tool_summary_id(F.col("ordinal"), F.col("parent")).alias("summary"))


def command_texts(spark, root):
    """Titles wrapped as commands, outputs and plain text, as previews and exports show them."""
    e = table(spark, root, "cache_entries").where("summary is not null")
    text = F.concat(F.lit(" <command-name>/"), F.when(F.col("entry_id") % 2 == 0, "clear").otherwise("note"), F.lit("</command-name><command-args>"), F.col("summary"), F.lit("</command-args>"))
    out = F.concat(F.lit("<local-command-stdout>"), F.when(F.col("entry_id") % 3 == 0, F.col("summary")).otherwise(" "), F.lit("</local-command-stdout>\n"))
    return e.select("entry_id", cleaning.skill_preview(text).alias("skill"), cleaning.command_tag(text).alias("tag"), cleaning.export_command(out).alias("output"), cleaning.export_command(F.col("summary")).alias("plain"))


def result_displays(spark, root):
    """Results of tools as a viewer shows them: as text, as items, as JSON, and nothing."""
    p = table(spark, root, "messages").select("row_id", F.posexplode("parts").alias("n", "p")).where(F.col("p.kind") == "tool_result")
    form = F.col("row_id") % 4
    item = F.to_json(F.struct(F.col("p.content").alias("text")))
    json = F.when(form == 0, F.to_json(F.struct(F.col("p.content").alias("t")))).when(form == 1, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]"))).when(form == 2, F.lit('{"b":[1,null],"a":"x"}'))
    content = F.when(form == 0, F.try_variant_get(F.parse_json(json), "$.t", "variant")).otherwise(F.try_parse_json(json))
    return p.select("row_id", "n", viewer.result_display(content).alias("shown"))


_NAMES = (
    "hybrid_search searched_messages scoped_chunks chunk_labels key_prefixes turn_totals message_clocks cut_snippets tool_output_ids command_texts result_displays "
    "current_entries list_projects session_labels parse_failures project_names cached_files normalized_documents prefix_counts cleaned_documents "
    "semantic_turns atoms entry_labels lexical_single lexical_multi lexical_top lexical_fields lexical_scoped lexical_excluded exact_insensitive "
    "exact_sensitive mixed_literal identifier_literal browse message_words message_literal message_tools hits_per_conversation grouped_hits outlines "
    "tool_totals tool_runs tool_results tool_keys conversation_times previews message_positions best_chunks chunk_counts stale_chunks fused_hits "
    "packed_chunks embedded_chunks conversation_refs exported_paragraphs evidence_spots tool_displays shown_lines model_labels"
).split()
QUERIES = {name: globals()[name] for name in _NAMES}
