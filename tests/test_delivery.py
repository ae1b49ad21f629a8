import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.operators import delivery
from threadloom.operators.components import connected_components

SCHEMA = "row_id long, conv_ref string, jsonl_line int, assistant_message_id string, batch_no int, conv string, line string, best int, code long, key string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "l", 1, 2, "k") for r in rows], SCHEMA)


def truth(rows):
    """Union-find in plain Python: the rows that do not remain."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    groups = defaultdict(list)
    for r, conv, line, ident, batch in rows:
        ident = (ident or "").strip()
        nodes = [(conv, "l", line)] * (line is not None) + [(conv, "i", ident)] * bool(ident) if conv is not None else []
        nodes = nodes or [("solo", r)]
        for a, b in zip(nodes, nodes[1:]):
            parent[find(a)] = find(b)
        find(nodes[0])
    for row in rows:
        r, conv, line, ident, batch = row
        ident = (ident or "").strip()
        node = ("solo", r) if conv is None or (line is None and not ident) else (conv, "l", line) if line is not None else (conv, "i", ident)
        groups[find(node)].append(row)
    out = set()
    for g in groups.values():
        keep = min(g, key=lambda x: (x[2] is None, -(x[2] or 0), x[4] is None, x[4] or 0, x[0]))
        out |= {x[0] for x in g if x[0] != keep[0]}
    return out


def extra(spark, rows):
    return {r[0] for r in delivery.extra_copies(frame(spark, rows)).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_against_union_find(spark, seed):
    rng = random.Random(seed)
    ids = [None, "", " ", "a", " a", "A", "b", "c", "d\t", "e"]
    rows = [(i, rng.choice(["x", "y", None]), rng.choice([None, *range(12)]), rng.choice(ids), rng.choice([None, 0, 1, 2])) for i in range(160)]
    assert extra(spark, rows) == truth(rows)


def test_long_chains_are_one_message(spark):
    rows = []
    for i in range(40):  # line i carries the ids i and i + 1
        rows += [(2 * i, "x", i, f"m{i}", 0), (2 * i + 1, "x", i, f"m{i + 1}", 0)]
    assert extra(spark, rows) == {r[0] for r in rows} - {78}


def test_one_message_holds_most_rows(spark):
    rows = [(i, "hot", 1, "m", i % 7) for i in range(3000)] + [(5000 + i, "hot", 2 + i, None, 0) for i in range(100)]
    assert extra(spark, rows) == set(range(1, 3000))


def test_nulls_ties_and_nothing(spark):
    rows = [(1, "x", 1, "m", None), (2, "x", 1, "m", 5), (3, "x", None, "m", 0), (4, None, 1, "m", 0), (5, None, 1, "m", 0), (6, "x", None, None, 0), (7, "x", None, " ", 0)]
    assert extra(spark, rows) == {1, 3}
    assert extra(spark, []) == set()


def test_codes_are_dense_and_bits_tell_what_is_seen(spark):
    rows = [(i, "x", i, None, 0) for i in range(500)]
    found = delivery.deliver(frame(spark, rows), shards=4).persist()
    for r in found.groupBy("shard").agg(F.min("code"), F.max("code"), F.countDistinct("code"), F.count(F.lit(1))).collect():
        assert r[1] == 0 and r[2] + 1 == r[3] == r[4]
    odd = found.where("code % 2 = 1")
    left = delivery.unseen(found.select("shard", "code", "row"), delivery.bitmaps(odd))
    assert {r["row"] for r in left.collect()} == {r["row"] for r in found.where("code % 2 = 0").collect()}


def test_rows_are_selected_by_unset_bits(spark):
    """The codes decide in p2_found itself; they were pruned from its plan."""
    rows = frame(spark, [(1, "x", 1, "m", 1), (2, "x", 2, "m", 0), (3, "x", 2, "m", 1), (4, "x", 3, None, 0)])
    plan = delivery.extra_copies(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan and "MapInArrow" in plan
    coded = delivery.coded_arrivals(rows, shards=2)
    assert {r["row"] for r in delivery.first_of_bits(coded, "row").collect()} == {2, 4}
    same = {(r["key"], r["shard"], r["code"]) for r in coded.collect()}
    assert same == {(r["key"], r["shard"], r["code"]) for r in delivery.encode(delivery.messages(rows), 2).collect()}


def test_store_delivers_each_message_once(spark, tmp_path):
    store = delivery.SeenStore(spark, f"file://{tmp_path}/seen", shards=8)
    first = [(1, "x", 1, "m", 0), (2, "x", 2, None, 0)]
    assert {r["row"] for r in store.take(frame(spark, first)).collect()} == {1, 2}
    second = [(3, "x", 1, None, 1), (4, "x", 9, " m ", 1), (5, "x", 2, "late", 1), (6, "x", 3, "new", 1), (7, "y", 1, "m", 1)]
    assert {r["row"] for r in store.take(frame(spark, second)).collect()} == {6, 7}
    assert store.take(frame(spark, first + second)).count() == 0
    third = [(8, "x", 30, "late", 2), (9, "x", 31, "newer", 2)]  # known by an id that came with a copy
    assert {r["row"] for r in store.take(frame(spark, third)).collect()} == {9}
    with pytest.raises(ValueError):
        delivery.SeenStore(spark, f"file://{tmp_path}/seen", shards=9).version()


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path):
    store = delivery.SeenStore(spark, f"file://{tmp_path}/seen", shards=2)
    store.take(frame(spark, [(1, "x", 1, None, 0)]))
    before = store.version()

    class Dies(delivery.SeenStore):
        def _publish(self, number, parts):
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        Dies(spark, f"file://{tmp_path}/seen", shards=2).take(frame(spark, [(2, "x", 2, None, 0)]))
    assert store.version() == before
    assert {r["row"] for r in store.take(frame(spark, [(2, "x", 2, None, 0)])).collect()} == {2}


def test_two_writers_do_not_lose_bits(spark, tmp_path):
    path = f"file://{tmp_path}/seen"
    delivery.SeenStore(spark, path, shards=2).take(frame(spark, [(1, "x", 1, None, 0)]))

    class Late(delivery.SeenStore):
        others = 1

        def _publish(self, number, parts):
            if self.others:  # another writer is first
                self.others -= 1
                assert {r["row"] for r in delivery.SeenStore(spark, path, shards=2).take(frame(spark, [(2, "x", 2, "m", 0)])).collect()} == {2}
            super()._publish(number, parts)

    assert {r["row"] for r in Late(spark, path, shards=2).take(frame(spark, [(3, "x", 2, None, 0), (4, "x", 5, None, 0)])).collect()} == {4}
    store = delivery.SeenStore(spark, path, shards=2)
    assert store.version()[0] == 3
    store.compact()
    assert len(store.version()[1]) == 1
    assert store.take(frame(spark, [(r, "x", n, None, 1) for r, n in ((5, 1), (6, 2), (7, 5))])).count() == 0


def test_rows_without_line_or_conversation_share_no_task(spark):
    """Nulls are a third of all rows; they meet neither in a window nor in a join."""
    rng = random.Random(3)
    rows = [(i, "x", i % 50, rng.choice(["a", "b", None]), 0) for i in range(200)]
    rows += [(1000 + i, None, None, None, 0) for i in range(60)] + [(2000 + i, "x", None, None, 0) for i in range(60)]
    assert extra(spark, rows) == truth(rows)
    executed = delivery.message_keys(frame(spark, rows))
    null_rows = executed.where("k_id is null and k_line is null")
    plan = null_rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and null_rows.count() == 120


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [("s", rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [("t", 1, 2), ("t", 2, 1), ("t", 5, 5), ("t", None, 3)]
    got = {(r[0], r[1]): r[2] for r in connected_components(spark.createDataFrame(edges, "scope string, a int, b int"), "scope", "a", "b").collect()}
    near = defaultdict(set)
    for s, a, b in edges:
        if a is not None and a != b:
            near[s, a].add((s, b))
            near[s, b].add((s, a))
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for n in near[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert got[v] == min(seen)[1]
    assert set(got) == set(near)


def test_every_message_gets_a_place(spark, tmp_path):
    from threadloom.plans import search_queries

    rows = [(1, "none", 5, "m", 0), (2, "none", 2, None, 0), (3, "none", 7, "m", 1), (4, "some", 1, None, 0), (5, "some", 2, "a", 0), (6, "some", 3, " a", 0), (7, "some", 4, None, 0), (8, "some", None, None, 0), (9, "full", 4, None, 0)]
    given = {4: 1, 5: 2, 9: 8}
    # Every message once, numbered from 1: row 3 is row 1's message, row 6 row 5's.
    want = {("none", 1): 2, ("none", 2): 3, ("some", 1): 4, ("some", 2): 6, ("some", 3): 7, ("some", 4): 8, ("full", 1): 9}
    df = frame(spark, rows).withColumn("ordinal", F.element_at(F.create_map(*[F.lit(x) for p in given.items() for x in p]), F.col("row_id").cast("int")))
    got = delivery.delivered(df).collect()
    assert {(r["conv_ref"], r["ordinal"]): r["row_id"] for r in got} == want
    assert {r["conv_ref"]: r["message_count"] for r in got} == {"none": 2, "some": 4, "full": 1}
    part = "array(named_struct('kind', 'text', 'text', concat('long parser ', row_id), 'id', '', 'name', '', 'input', '{}', 'tool_use_id', '', 'content', ''))"
    full = df.selectExpr("row_id", "conv_ref", "ordinal", "'user' role", "jsonl_line", "assistant_message_id", "cast(null as string) parent_tool_use_id", f"{part} parts", "batch_no")
    full.write.parquet(f"{tmp_path}/messages.parquet")
    spark.read.parquet("/root/testdata/sf0.001/cache_entries.parquet").limit(0).write.parquet(f"{tmp_path}/cache_entries.parquet")
    assert {(r["conv_ref"], r["ordinal"]) for r in search_queries.exported_paragraphs(spark, str(tmp_path)).collect()} == set(want)
    assert {r["conv_ref"]: r["total_hits"] for r in search_queries.grouped_hits(spark, str(tmp_path)).collect()} == {"none": 2, "some": 4, "full": 1}
