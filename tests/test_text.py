import pytest

from quillgrid.functions import pii, scoring as S, text as T, verdict as V


@pytest.mark.parametrize("raw,want", [("4.0199999999999996", "4.02"), ("4.02", "4.02"), ("6.1", "6.10"), ("6.10", "6.10"), ("5.01", "5.01"), ("A3.1", "A3.1")])
def test_ids_are_repaired_and_padded(value, raw, want):
    assert value(lambda c: T.pad_id(T.repair_id(c)), raw) == want


@pytest.mark.parametrize("f,args,want", [
    (T.normalize_text, ("a’s\r\n “b” – c  d�",), "a's \"b\" - c d"),
    (T.append_sentence, ("Disclose:", "x"), "Disclose: x"), (T.append_sentence, ("Disclose", "x"), "Disclose; x"), (T.append_sentence, ("Disclose x", "x"), "Disclose x"), (T.append_sentence, ("", "x"), "x"),
    (T.clause_token, ("(iv) any amounts",), "iv"), (T.is_roman, ("x",), True), (T.is_alpha, ("i",), False), (T.is_alpha, ("c",), True),
    (T.is_requirement_id, ("FRS 6.01",), True), (T.is_requirement_id, ("6",), False), (T.is_note_row, ("Note 1",), True), (T.is_guidance, ("This is guidance only.",), True),
    (T.type_key, ("Listed Co-DC_2025",), "ifrs"), (T.type_key, ("Charities & FRS102 x",), "frs102"), (T.form_key, ("FRS 102",), "frs102"), (T.display_name, ("frs105",), "FRS 105"),
    (T.framework_of, ("private_co_frs102_1a",), "FRS102_1A"), (T.note_number, ("Note 12.3 Tax",), "12.3"), (T.note_number, ("Notes to the accounts",), ""),
    (T.hint_phrase, ("Disclose any amounts repaid for the year;",), "amounts repaid"),
    (T.atomic_label, ("its main conditions;", "the advances and credits granted by the company to its directors"), "main conditions of advances and credits to directors"),
    (T.atomic_label, ("any amounts repaid;", "the advances and credits granted by the company to its directors"), "amounts repaid for advances and credits to directors"),
    (T.item_retrieval_text, ("", ""), "disclosure requirement"), (T.item_retrieval_text, ("full", "full"), "full"), (T.item_retrieval_text, ("full", "its amount"), "Requirement context: full\nFocus: its amount"),
    (lambda c: T.truncate(c, 5), ("abcdefgh",), "abcd…"), (T.heading_guess, ("[ORG_1] Revenue 2,016 £m. The rest",), "Revenue"),
])
def test_scalars(value, f, args, want):
    assert value(f, *args) == want


@pytest.mark.parametrize("line,want", [("", False), ("12", False), ("2016 2015", False), ("Note 1 Accounting policies", True), ("3 Staff costs", True), ("BALANCE SHEET", True), ("Revenue recognition", True),
                                        ("We recognise revenue when goods are delivered.", False), ("Total 12 34", False), ("Directors:", True)])
def test_headings(value, line, want):
    assert value(T.is_heading, line) is want


def test_tables(value):
    assert value(T.is_tableish, "Wages | 12 | 14") and value(T.is_tableish, "one two three four five")
    assert value(lambda c: T.is_tableish(c, True), "one two three four five") is False


def test_lines(value):
    assert value(T.clean_lines, "Y ear ended 2016\n\n -- 1 of 3 --\nA  b\n£\n12\n 3 ") == ["Year ended 2016", "A b"]


def test_redaction_is_numbered_by_kind(value):
    text = "Telephone: +44 20 1234 5678\nEmail: person@example.com and b@c.org, id AB123456C, 1,234 and 01234567"
    assert value(pii.redact, text) == "Telephone: [PHONE_1]\nEmail: [EMAIL_1] and [EMAIL_2], id [ID_1], 1,234 and 01234567"
    found = value(pii.audit, text)
    assert [(a["entity_type"], a["original_value"]) for a in found] == [("email", "person@example.com"), ("email", "b@c.org"), ("id", "AB123456C"), ("phone", "+44 20 1234 5678")]
    assert value(pii.redact, "Name: HOUSEHOLD\nOffice 1") == "Name: [PERSON_1]1"


@pytest.mark.parametrize("raw,want", [
    ('{"status":"FULLY","confidence":1.5}', ("fully_met", None, 1.0)), ('{"status":"partial","reason":" a  b ","confidence":"-2"}', ("partially_met", "a b", 0.0)),
    ('{"status":"MAYBE","reason":"x"}', (None, None, None)), ("FULLY", (None, None, None)), ("", (None, None, None)), ('{"status":"NONE"}', ("missing", None, None)), ("[1]", (None, None, None)),
])
def test_judgements(value, raw, want):
    got = value(V.parse_judgement, raw)
    assert (got["status"], got["reason"], got["confidence"]) == want


def test_reasons_are_cut(value):
    assert len(value(lambda c: V.parse_judgement(c, 100), '{"status":"FULLY","reason":"' + "a" * 500 + '"}')["reason"]) == 100


def test_scores(value):
    got = value(lambda k, t: S.overlap(S.keyword_sets(k), T.token_set(t)), ["revenue recognition", "policy", "tax"], "Revenue recognition policy")
    assert got == pytest.approx(2 / 3)


def test_vectors(value):
    assert value(S.parse_vector, "[-0.5,0.25,1.0]") == [-0.5, 0.25, 1.0]
    assert value(S.parse_vector, "{0.0, 2.0}") == [0.0, 2.0]
    assert value(S.parse_vector, None) == [] and value(S.parse_vector, "{}") == [] and value(S.parse_vector, "[]") == []
    assert value(S.parse_vector, "vec [1, 2e0] and [3]") == [1.0, 2.0]
    for bad in ("no vector", "[1, x]", ""):
        with pytest.raises(Exception):  # noqa: B017
            value(S.parse_vector, bad)


def test_natural_order(spark):
    from pyspark.sql import functions as F

    ids = ["6.01(b)", "1.01", "6.01(a)", "6.01(a)(i)", "6.01(a)(ii)", "4.01"]
    got = [r["value"] for r in spark.createDataFrame([(i,) for i in ids], "value string").orderBy(V.natural_id(F.col("value"))).collect()]
    assert got == ["1.01", "4.01", "6.01(a)", "6.01(a)(i)", "6.01(a)(ii)", "6.01(b)"]


def test_rule_status(spark):
    from pyspark.sql import functions as F

    def of(*pairs):
        df = spark.createDataFrame([([p[0] for p in pairs], [p[1] for p in pairs])], "s array<string>, k array<string>")
        r = df.select(V.rule_status(F.col("s"), F.col("k")).alias("v")).first()["v"]
        return r["status"], round(r["coverage"], 6)

    assert of(("fully_met", "required"), ("missing", "supporting")) == ("fully_met", round(1 / 1.35, 6))
    assert of(("missing", "required"), ("fully_met", "required")) == ("partially_met", 0.5)
    assert of(("missing", "supporting")) == ("missing", 0.0)
    assert of() == ("missing", 0.0)
