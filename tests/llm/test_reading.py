import numpy as np

from threadloom.llm import reading

DOCS = "doc_id long, text string, lang string, words int, level string"
LABELS = "doc_id long, reading_level int, rater string, words long"


def corpus(n=120):
    rng = np.random.default_rng(1)
    easy = [f"easy{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows, labels = [], []
    for i in range(n):
        level = i % 5 + 1
        sentences = []
        for _ in range(12):
            words = [str(w) if rng.random() > 0.12 * (level - 1) else f"hard{''.join(rng.choice(list('abcdefgh'), 5))}" for w in rng.choice(easy, 4 + 3 * level)]
            sentences.append(" ".join(words) + ".")
        rows.append((i, " ".join(sentences), ("en", "EN", "en-US", " En_gb ")[i % 4], 1, "x"))
        labels.append((i, level, "r", 5))
    return rows, labels


def test_levels_follow_labels(spark):
    rows, labels = corpus()
    got = reading.reading_levels(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[::2], LABELS)).toPandas().set_index("doc_id")
    held = labels[1::2]
    assert np.mean([abs(got.level[i] - level) <= 1 for i, level, *_ in held]) > 0.95
    assert np.mean([(got.level[i] >= 4) == (level >= 4) for i, level, *_ in held]) >= 0.9


def test_dirty_documents(spark):
    rows, labels = corpus(60)
    extra = [
        (1000, None, "en", 1, "x"),
        (1001, " \n", "en", 1, "x"),
        (1002, "2026-01-01T00:00:00Z INFO a::b hardword hardword hardword\n" * 20, "en", 1, "x"),
        (1003, "```\nlet x = fn();\n```", "en", 1, "x"),
        (1004, "ein Satz", "de", 1, "x"),
        (1005, "no language", None, 1, "x"),
        (1006, rows[0][1] * 300, "en", 1, "x"),
        (0, rows[0][1], "en", 1, "x"),
    ]
    got = reading.reading_levels(spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, LABELS)).toPandas()
    by = got.set_index("doc_id").level
    assert by[[1000, 1001, 1002, 1003]].isna().all()
    assert 1004 not in by.index and 1005 not in by.index
    assert by[1006] == 1 and len(got[got.doc_id == 0]) == 2


def test_prose_leaves_code_and_logs_aside():
    text = "User: Hello there, friend.\n\n```py\nx = 1\n```\n- **A bullet** of text\n2026-01-01T00:00:00Z WARN x::y z\n| a | b |\nkey: value\nSee `a/b.rs` and /srv/x/y.json now."
    assert reading.prose_lines(text) == ["Hello there, friend.", "A bullet of text", "See   and   now."]


def test_without_labels_or_rows(spark):
    rows, _ = corpus(40)
    none = spark.createDataFrame([], LABELS)
    levels = {r["level"] for r in reading.reading_levels(spark.createDataFrame(rows, DOCS), none).collect()}
    assert levels and levels <= {1, 2, 3, 4, 5}
    assert reading.reading_levels(spark.createDataFrame([], DOCS), none).count() == 0


def test_few_labels_shift_the_published_formula_and_do_not_replace_it(spark):
    """The same documents with 0, 1, 10 and 60 labels: levels change step by step, with no jump at any number."""
    rows, labels = corpus(60)
    docs = spark.createDataFrame(rows, DOCS)
    found = []
    for n in (0, 1, 10, 60):
        got = reading.reading_levels(docs, spark.createDataFrame(labels[:n], LABELS)).toPandas().sort_values("doc_id")
        found.append(got.level.to_numpy())
    true = np.array([level for _, level, *_ in labels])
    off = [np.abs(f - true).mean() for f in found]
    assert off[3] <= off[0] and np.abs(found[1] - found[0]).mean() <= 1
