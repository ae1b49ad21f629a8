import pytest

from threadloom.llm import mixing

DOCS = "doc_id long, text string, source string, tokens int, key string, copies int"
TARGETS = "source string, target_share double, max_repeats int, documents long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "k", 2) for i, t, s in rows], DOCS)


def targets(spark, rows):
    return spark.createDataFrame([(s, p, r, 0) for s, p, r in rows], TARGETS)


@pytest.fixture
def rows():
    out, i = [], 0
    for source, n in (("large", 300), ("Small-One", 20), ("mid one ", 80)):
        for k in range(n):
            out.append((i, f"Document {i} has some words, about {5 + k % 30} of them. " * (1 + k % 7), source))
            i += 1
    return out


def test_shares_are_reached_within_half_a_document(spark, rows):
    wanted = [("large", 0.5, 1), ("small_one", 0.2, 3), ("MID-ONE", 0.3, 2), ("absent", 0.1, 4)]
    chosen, report = mixing.mix(docs(spark, rows), targets(spark, wanted))
    report = report.toPandas().set_index("source")
    assert report.taken["absent"] == 0 and report.documents["absent"] == 0
    for source, share in (("large", 0.5), ("small_one", 0.2), ("mid_one", 0.3)):
        assert report.actual_share[source] == pytest.approx(share, abs=0.02)
    chosen = chosen.toPandas()
    assert chosen.doc_id.is_unique
    for source, cap in (("large", 1), ("small_one", 3), ("mid_one", 2)):
        part = chosen[chosen.source == source]
        assert part.copies.max() <= cap
        assert (part.tokens * part.copies).sum() == report.taken[source]
        # Complete epochs come first: copies of a source differ by one at most.
        assert part.copies.max() - part.copies.min() <= 1
    assert report.taken.sum() >= 0.98 * report.budget.sum()


def test_a_given_total_and_exact_prefix(spark, rows):
    options = mixing.Options(total_tokens=3000, bins=2)  # wide bins: the last one is cut inside
    chosen, report = mixing.mix(docs(spark, rows), targets(spark, [("large", 0.6, 1), ("mid_one", 0.4, 1)]), options)
    chosen, report = chosen.toPandas(), report.toPandas().set_index("source")
    sized = mixing.sizes(docs(spark, rows), options).toPandas()
    for source in ("large", "mid_one"):
        rest, before, want = report.budget[source], 0, set()
        for r in sized[sized.source == source].sort_values(["key", "doc_id"]).itertuples():
            if before + r.tokens / 2 <= rest:
                want.add(r.doc_id)
            before += r.tokens
        assert set(chosen[chosen.source == source].doc_id) == want


def test_better_documents_come_earlier(spark):
    good, bad = "plain words make up this text and nothing else does. " * 20, "{0x1f} == [99]; #%& 12 34 56 " * 20
    rows = [(i, good if i % 2 else bad, "s") for i in range(400)]
    chosen, _ = mixing.mix(docs(spark, rows), targets(spark, [("s", 1.0, 1)]), mixing.Options(total_tokens=20_000))
    picked = [r["doc_id"] % 2 for r in chosen.collect()]
    assert sum(picked) / len(picked) > 0.55


def test_dirty_and_empty(spark):
    some = [(1, None, "a"), (2, " ", "a"), (3, "text here", None), (4, "text here", " "), (5, "text here", "unlisted"), (6, "x" * 200_000, "a")]
    chosen, report = mixing.mix(docs(spark, some), targets(spark, [("a", 0.5, None), (None, 0.5, 1), ("b", None, 1), ("c", 0.2, 0), ("d", -1.0, 1)]))
    assert [(r["doc_id"], r["copies"]) for r in chosen.collect()] == [(6, 1)]
    assert {r["source"]: r["actual_share"] for r in report.collect()} == {"a": 1.0, "c": 0.0}
    for d, t in (([], [("a", 1.0, 1)]), (some, []), ([], [])):
        chosen, report = mixing.mix(docs(spark, d), targets(spark, t))
        assert chosen.count() == 0 and report.count() == len(t)


def test_tokens_are_those_of_the_public_tokenizer():
    encode = mixing.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken").encode_ordinary
    text = "Grüße, 世界 <|endoftext|>"
    assert mixing.encoder("/opt/tokenizers/byte_bpe_50k.tiktoken").decode(encode(text)) == text
    assert len(encode("hello world")) == 2
