from hypothesis import given, settings, strategies as st

from threadloom.llm import splitting
from threadloom.llm.splitting import Limits, split_points

SCHEMA = "entry_id long, semantic_turns array<string>, semantic_turn_ranges array<struct<start int, finish int>>, text string, turn int, ranges string"


def _covers(text, ranges, limits):
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    for (a, b), (c, d) in zip(ranges, ranges[1:]):
        assert a < c <= b < d
    assert all(len(text[a:b].encode()) <= limits.size for a, b in ranges)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab é日🙂́‍.\n,", max_size=900), st.integers(0, 40))
def test_pieces_cover_any_text(text, overlap):
    limits = Limits(size=128, overlap=overlap)
    ranges = split_points(text, limits)
    if len(text.encode()) > 128:
        _covers(text, ranges, limits)
    else:
        assert ranges == [(0, len(text))]


def test_cuts_at_the_strongest_boundary_near_the_target():
    paragraph = "One two three four five. " * 40
    text = paragraph.strip() + "\n\n" + paragraph.strip()
    ranges = split_points(text, Limits(size=1200, overlap=100))
    assert text[: ranges[0][1]].endswith("\n\n")
    assert len(ranges) == 2


def test_long_runs_without_boundaries_are_cut_at_letters():
    ranges = split_points("x" * 10_000, Limits())
    assert len(ranges) == 5 and all(b - a <= 2400 for a, b in ranges)
    overlap = [a[1] - b[0] for a, b in zip(ranges, ranges[1:])]
    assert all(150 <= o <= 450 for o in overlap)


def test_joined_characters_stay_whole():
    text = "é" * 3000
    for a, b in split_points(text, Limits()):
        assert text[a] == "e" and text[b - 1] == "́"


def test_pieces_of_dirty_rows(spark):
    long = "Word and word. " * 400
    rows = [
        (1, [long, "short", None, long], [(1, 1), (2, 2), (3, 3), (None, 4)], "x", 9, "r"),
        (2, [long, long], [(1, 2)], None, None, None),  # the second turn has no range
        (3, None, None, None, None, None),
        (4, [" \n" + "a" * 2400 + " \n"], [(1, 1)], None, None, None),  # not too long once stripped
        (5, [long], [None], None, None, None),
        (6, [], [], None, None, None),
        (7, [long], [(5, 6)], None, None, None),
        (7, [long], [(5, 6)], None, None, None),  # a repeated row is cut for itself
    ]
    got = splitting.pieces(spark.createDataFrame(rows, SCHEMA)).toPandas()
    heads = got[got.piece == 1]
    assert sorted(zip(heads.entry, heads.turn)) == [(1, 1), (1, 4), (2, 1), (7, 1), (7, 1)]
    assert heads[heads.turn == 4].range_start.isna().all() and (heads[heads.turn == 4].range_end == 4).all()
    one = got[(got.entry == 1) & (got.turn == 1)].sort_values("piece")
    assert b"".join(t.encode()[o:] for t, o in zip(one.text, one.overlap_bytes)).decode() == long.strip()
    assert (got.piece_bytes <= 2400).all()


def test_empty_table(spark):
    assert splitting.pieces(spark.createDataFrame([], SCHEMA)).count() == 0


def test_flags_and_syllables_stay_whole():
    flags = "\U0001f1e9\U0001f1ea" * 500
    for a, _ in splitting.split_points(flags, splitting.Limits(240, 40)):
        assert a % 2 == 0
    syllables = "한" * 500
    for a, _ in splitting.split_points(syllables, splitting.Limits(240, 40)):
        assert a % 3 == 0


def test_overlaps_keep_near_their_size():
    import random

    rng = random.Random(4)
    text = " ".join("word" * rng.randint(1, 9) + rng.choice(["", ".", ",", "\n\n"]) for _ in range(3000))
    pieces = splitting.split_points(text)
    assert len(pieces) > 10
    for (_, end), (start, _) in zip(pieces, pieces[1:]):
        assert 100 <= end - start <= 500
