import pytest

from threadloom.llm import privacy

SCHEMA = "entry_id long, full_text string, preview_first string, agent_search_text string, field_name string, terms array<string>, term string"

ROLES = {"zofia": "given", "ravi": "given", "noor": "given", "lindqvist": "family", "marlow": "family", "osei": "family"}
PLACES = {"Port Amber", "Dellworth"}


def kinds(text, roles=ROLES):
    return [(text[a:b], kind) for a, b, kind in privacy.mentions_of(text, roles, PLACES)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("mailto:a.b+c@mail.example?subject=x", [("a.b+c@mail.example", "email")]),
        ("from=A.B@EXAMPLE.ORG, to=x [at] mail [dot] example.", [("A.B@EXAMPLE.ORG", "email"), ("x [at] mail [dot] example", "email")]),
        ("write me at ada dot byron at mail dot example now", [("ada dot byron at mail dot example", "email")]),
        ("joe-x(at)example.com", [("joe-x(at)example.com", "email")]),
        ("git@forge.invalid:core/x.git and ssh build@host-03 and @pkg/name@1.2.3, @retry(max=3)", []),
        ("call +1 202-555-0112, (617) 555-0136 or 303.555.0151.", [("+1 202-555-0112", "phone"), ("(617) 555-0136", "phone"), ("303.555.0151", "phone")]),
        ("020 7946 0117; +44 7700 900743; +49 (0)30 23125847", [("020 7946 0117", "phone"), ("+44 7700 900743", "phone"), ("+49 (0)30 23125847", "phone")]),
        ("tel five one two five five five zero one two six, ok", [("five one two five five five zero one two six", "phone")]),
        ("from 203.0.113.9 in 00:17:45, 2,258,362 tokens, build 20260101.8", []),
        ("social security number 912-34-5678 was", [("912-34-5678", "id_number")]),
        ("item number 912-34-5678 in stock; Set window 745-46-8105 in Grid 3", []),
        ("passport no. P1234567, holder Zofia Marlow", [("P1234567", "id_number"), ("Zofia Marlow", "name")]),
        ("name,email,national_id\nRavi Osei,r@x.example,QQ 12 34 56 A", [("Ravi Osei", "name"), ("r@x.example", "email"), ("QQ 12 34 56 A", "id_number")]),
        ("at Flat 3, 12 Elm Street, Port Amber QZ1 1XX.", [("Flat 3, 12 Elm Street, Port Amber QZ1 1XX", "address")]),
        ("9 Elm Hollow Rd.\nDellworth 12345 The log", [("9 Elm Hollow Rd.\nDellworth 12345", "address")]),
        ("moved to 12 Elm Hollow Rd. Each; to 9 Elm Hollow Rd.. That; to 8 Elm Blvd. Then", [("12 Elm Hollow Rd.", "address"), ("9 Elm Hollow Rd.", "address"), ("8 Elm Blvd", "address")]),
        ("Apt 4B, 7 Oak Way, Dellworth Can you", [("Apt 4B, 7 Oak Way, Dellworth", "address")]),
        ("Lindenstr. 5, 12345 Port Amber Das", [("Lindenstr. 5, 12345 Port Amber", "address")]),
        ("8 bis, rue des Saules, 12345 Dellworth", [("8 bis, rue des Saules, 12345 Dellworth", "address")]),
        ("Dr. Zofia K. Marlow-Osei, and Marlow, Ravi told noor", [("Zofia K. Marlow-Osei", "name"), ("Marlow, Ravi", "name"), ("noor", "name")]),
        ("see you, Ravi Marlow Zofia Osei said; R. Osei", [("Ravi Marlow", "name"), ("Zofia Osei", "name"), ("R. Osei", "name")]),
        ("Amber Orchard ships after Silent Falcon", []),
        ("to 123 Main St, Springfield, IL 62704 by noon", [("123 Main St, Springfield, IL 62704", "address")]),
        ("in Via Roma 5, Milano 20121 and Calle Mayor 3, 28013 Madrid.", [("Via Roma 5, Milano 20121", "address"), ("Calle Mayor 3, 28013 Madrid", "address")]),
        ("near Keizersgracht 12, 1015 CJ Amsterdam; Storgatan 7, 111 22 Stockholm", [("Keizersgracht 12, 1015 CJ Amsterdam", "address"), ("Storgatan 7, 111 22 Stockholm", "address")]),
        ("toll-free 1-800-555-1234, at (11) 91234-5678", [("1-800-555-1234", "phone"), ("(11) 91234-5678", "phone")]),
        ("pay to DE89 3704 0044 0532 0130 00 today", []),
        ("tax number 123.456.789-09 and RSSMRA85T10A562S", [("123.456.789-09", "id_number"), ("RSSMRA85T10A562S", "id_number")]),
        ("Zofia Marlow (file 912-34-5678), build 912-34-5679", [("Zofia Marlow", "name"), ("912-34-5678", "id_number")]),
        ("at " + "a" * 90 + "@mail.example now", [("a" * 90 + "@mail.example", "email")]),
        ("ssn" + " " * 500 + "912-34-5678", [("912-34-5678", "id_number")]),
    ],
)
def test_mentions(text, want):
    assert kinds(text) == want


def test_redaction_keeps_the_rest_readable():
    text = "Ask Zofia Marlow (z@mail.example) at 020 7946 0117."
    assert privacy.redact(text, privacy.mentions_of(text, ROLES, PLACES)) == "Ask [NAME] ([EMAIL]) at [PHONE]."


def corpus(spark):
    filler = "The queue reads each list. Our window said the note; they were pinned before the merge. " * 3
    people = [("Ada", "Quist"), ("Ben", "Corda"), ("Cleo", "Marn"), ("Dov", "Quist"), ("Ada", "Corda"), ("Cleo", "Corda")]
    rows = []
    for i, (g, f) in enumerate(people * 2):
        rows.append((i, f"{filler}Please ping {g} {f} before the merge. Author: {g} {f} <x{i}@mail.example>\n{filler}", None, f"{g} {f} lives at 5 Elm Street, Dellworth 12345, so", "f", None, "t"))
    rows.append((100, f"{filler}once more cleo marn was here, and Ada.", "", None, "f", None, "t"))
    rows.append((101, None, None, None, "f", None, "t"))
    rows.append((102, "x " * 200_000 + "Quist, Dov", None, None, "f", None, "t"))
    return spark.createDataFrame(rows, SCHEMA)


def test_names_are_learnt_from_the_corpus(spark):
    entries = corpus(spark)
    terms = {r["term"]: r["kind"] for r in privacy.lexicon(entries.select("entry_id", *privacy.FIELDS)).collect()}
    assert terms == {"ada": "given", "ben": "given", "cleo": "given", "dov": "given", "quist": "family", "corda": "family", "marn": "family", "Dellworth": "place"}
    got = privacy.mentions(entries).toPandas()
    late = got[got.entry_id == 100]
    text = entries.where("entry_id = 100").first()["full_text"]
    assert [text[a:b] for a, b in sorted(zip(late.char_start, late.char_end))] == ["cleo marn", "Ada"]
    assert list(zip(got[got.entry_id == 102].char_start, got[got.entry_id == 102].char_end)) == [(400_000, 400_010)]
    assert 101 not in set(got.entry_id)


def test_a_large_lexicon_is_joined_with_the_same_result(spark):
    entries = corpus(spark)
    order = ["entry_id", "field_name", "char_start", "char_end", "pii_kind"]
    sent = privacy.mentions(entries).toPandas().sort_values(order).reset_index(drop=True)
    joined = privacy.mentions(entries, privacy.Options(broadcast_terms=0)).toPandas().sort_values(order).reset_index(drop=True)
    assert sent.equals(joined)


def test_redacted_table_and_empty_table(spark):
    got = {r["entry_id"]: r for r in privacy.redacted(corpus(spark)).collect()}
    assert got[0]["agent_search_text"] == "[NAME] lives at [ADDRESS], so" and got[0]["preview_first"] is None
    assert got[101]["mentions"] == 0 and got[101]["full_text"] is None
    empty = spark.createDataFrame([], SCHEMA)
    assert privacy.mentions(empty).count() == 0 and privacy.redacted(empty).count() == 0


def _texts(spark, *texts):
    return spark.createDataFrame([(i, t, p, None, "f", None, "t") for i, (t, p) in enumerate(texts)], SCHEMA)


def test_copies_and_the_size_of_the_corpus_do_not_outvote_a_name(spark):
    filler = "The queue reads each list and the merge was pinned before it. " * 5
    once = f"{filler}then renzo fenarin left"
    rows = [(f"{filler}Author: Renzo Fenarin <x@mail.example>", None)] + [(once, "then renzo fenarin left")] * 4  # copies and previews
    terms = {r["term"] for r in privacy.lexicon(_texts(spark, *rows).select("entry_id", *privacy.FIELDS)).collect()}
    assert {"renzo", "fenarin"} <= terms and "queue" not in terms


@pytest.mark.parametrize(
    "text, want",
    [
        ("Author: Brax Tolwin <b@x.example>", ["Brax Tolwin"]),
        ("I met Dr. Tolwin, then", ["Tolwin"]),
        ("Reviewed-by: Zofia Tolwin", ["Zofia Tolwin"]),
        ("at 12 Elm Dr. Then we left by Sunset Dr. Each day", []),
        ("Author: see the log", []),
    ],
)
def test_a_run_at_a_strong_cue_is_a_name_in_its_place(text, want):
    assert [text[a:b] for a, b, kind in privacy.mentions_of(text, ROLES, PLACES) if kind == "name"] == want


def test_names_do_not_depend_on_how_many_other_texts_there_are(spark):
    three = [(f"{g} {f} <{g.lower()}.{f.lower()}@mail.example> wrote this", None) for g, f in (("Ada", "Quist"), ("Ben", "Corda"), ("Cleo", "Marn"))]
    other = [(f"The queue reads list {i} and the merge was pinned before it.", None) for i in range(40)]
    few, many = ({r["term"] for r in privacy.lexicon(_texts(spark, *rows).select("entry_id", *privacy.FIELDS)).collect()} for rows in (three, three + other))
    assert few == many == {"ada", "quist", "ben", "corda", "cleo", "marn"}


def test_rows_without_an_id_are_read_with_either_way_of_the_lexicon(spark):
    text = "Ada Quist <ada.quist@mail.example> wrote; later ada quist left"
    entries = spark.createDataFrame([(None, text, None, None, "f", None, "t")] * 2, SCHEMA)
    for terms in (0, 1000):
        got = privacy.mentions(entries, privacy.Options(broadcast_terms=terms)).collect()
        assert sorted((r["char_start"], r["pii_kind"]) for r in got) == sorted([(0, "name"), (11, "email"), (48, "name")] * 2)


def test_cues_are_learnt_from_texts_of_any_form(spark):
    """Templates, names and words that no list in the code knows."""
    people = [("Oona", "Veltri"), ("Pax", "Grendel"), ("Quill", "Hasbro"), ("Rhea", "Imbert"), ("Sten", "Jurado"), ("Tove", "Kallas")]
    filler = "The Harbor job moved. A Ledger was kept; Monday came. " * 4
    rows = []
    for i, (g, f) in enumerate(people):
        rows.append((f"{filler}contact for tickets: {g.lower()}.{f.lower()}@desk.example\n{filler}", None))
        rows.append((f"{filler}yesterday the caller named {g} {f} asked for row {i}.\n{filler}", None))
        rows.append((f"{filler}escalated through {f} at noon\n{filler}", None))
    rows.append((f"{filler}yesterday the caller named Ulla Lindgard asked for row 9.\n{filler}", None))
    rows.append((f"{filler}so lindgard was told\n{filler}", None))
    rows.append((f"{filler}then Lindgard left\n{filler}", None))
    got = privacy.mentions(_texts(spark, *rows)).where("pii_kind = 'name'").toPandas()
    found = [rows[r.entry_id][0][r.char_start : r.char_end] for r in got.itertuples()]
    want = [n for g, f in people for n in (f"{g} {f}", f)] + ["Ulla Lindgard", "lindgard", "Lindgard"]
    assert sorted(found) == sorted(want)


def test_places_are_generalised_where_they_stand_alone(spark):
    rows = [(f"{i} Elm Street, Dellworth 12345, is it", None) for i in range(1, 9)] + [("we met in Dellworth then", None)]
    got = {r["entry_id"]: r["full_text"] for r in privacy.redacted(_texts(spark, *rows)).collect()}
    assert got[0] == "[ADDRESS], is it" and got[8] == "we met in [PLACE] then"
