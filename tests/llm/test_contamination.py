import re

import numpy as np

from threadloom.llm import contamination

DOCS = "doc_id long, text string, item_id string, passages_found int"
ITEMS = "item_id long, text string, doc_id long"
ITEM = "The quick brown fox jumps over the lazy dog while seven wise owls watch from above the old mill."
WORDS = ITEM.split()


def found(spark, docs, items=None, **options):
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], DOCS)
    e = spark.createDataFrame(items if items is not None else [(1, ITEM, 7)], ITEMS)
    rows = contamination.leaks(d, e, contamination.Options(**options)).collect()
    return {(r["doc_id"], r["item_id"]): (r["passages_found"], r["passages_of_item"]) for r in rows}


def test_spellings_of_a_passage(spark):
    part = " ".join(WORDS[2:14])  # twelve words
    variants = {
        1: part,
        2: part.upper(),
        3: "\r\n> ".join(WORDS[2:14]),
        4: part.replace("jumps", "ju­mps").replace("brown", "br​own"),
        5: part.replace("seven", "se-\nven"),
        6: part.replace("lazy", "**lazy**").replace(" wise", "  wise"),
        7: part.replace("lazy", "<b>la</b>zy").replace("dog", "d&shy;og"),
        8: '{"prompt": "' + part.replace(" fox", "\\nfox") + '"}',
        9: "before. " + part + ", after" + " filler words here" * 3000,
    }
    assert set(found(spark, variants.items())) == {(k, 1) for k in variants}


def test_what_is_no_leak(spark):
    eleven = " ".join(WORDS[2:13])
    assert not found(
        spark,
        [
            (1, eleven),
            (2, eleven + " watching"),  # its last word only begins like the item's
            (3, "un" + " ".join(WORDS[2:14])),  # its first word only ends like it
            (4, " ".join(WORDS[2:8]) + " not " + " ".join(WORDS[8:14])),
            (5, None),
            (6, ""),
            (7, " \n"),
        ],
    )


def test_counts_shared_passages_and_short_items(spark):
    items = [(1, ITEM, 1), (2, "Unlike that, " + " ".join(WORDS[:13]), 1), (3, "too short", 1), (4, None, 1), (5, "", 1)]
    got = found(spark, [(1, ITEM), (1, ITEM), (2, " ".join(WORDS[:12]))], items)
    assert got == {(1, 1): (8, 8), (1, 2): (2, 4), (2, 1): (1, 8), (2, 2): (1, 4)}


def test_many_passes_give_the_same(spark):
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(words, 30)), 0) for i in range(20)]
    docs = [(i, " ".join(rng.choice(words, 200)) + " " + " ".join(items[i][1].split()[5:20])) for i in range(20)]
    want = {}
    squash = lambda s: re.findall(r"[^\W_]+", s.lower())
    for d, t in docs:
        grams = {tuple(squash(t)[k : k + 12]) for k in range(len(squash(t)) - 11)}
        for i, s, _ in items:
            n = sum(tuple(squash(s)[k : k + 12]) in grams for k in range(len(squash(s)) - 11))
            if n:
                want[d, i] = n
    one, many = found(spark, docs, items), found(spark, docs, items, sketches=30)
    assert one == many and {k: v[0] for k, v in one.items()} == want


def test_empty_tables(spark):
    assert not found(spark, [])
    assert not found(spark, [(1, ITEM)], [])


def test_long_tags_and_links_inside_a_passage(spark):
    part = " ".join(WORDS[2:14])
    texts = [
        part.replace("lazy", f'<a title="{"see note " * 40}" class=x>lazy</a>'),
        part.replace("lazy", '<a\n  class="big red"\n  id=\'k\'\n>lazy</a\n>'),
        part.replace("lazy", f"[lazy](https://x.example/{'path/' * 150})"),
        part.replace("lazy", "[lazy](\nhttps://x.example/path\n)"),
        f"if a <b then {part} " + "and so on " * 30 + "c> d",
        part.replace("lazy", f'<a hidden title="{"a > b, see note " * 700}" data-x>lazy</a>'),
        part.replace("lazy", f"[lazy](https://x.example/{'path/' * 2500} 'a title')"),
        part.replace("lazy", f"<!-- {'remark ' * 2000} -->lazy"),
    ]
    assert set(found(spark, list(enumerate(texts)))) == {(i, 1) for i in range(8)}


def test_passages_of_every_size_class(spark):
    short = "a b c d e f g h i j k l m n"
    mid = " ".join(f"w{i:02d}" for i in range(14))
    long = " ".join(f"w{i:014d}x" for i in range(14))
    items = [(1, short, 0), (2, mid, 0), (3, long, 0), (4, ITEM, 0)]
    table = contamination.passages(spark.createDataFrame(items, ITEMS)).select("part").distinct().collect()
    assert {r["part"] for r in table} == {1, 2, 4}
    docs = [(i, f"so, {t[:-2]}." ) for i, t, _ in items] + [(9, "none of it")]
    assert {(d, i) for d, i in found(spark, docs, items)} == {(i, i) for i in (1, 2, 3, 4)}
