import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import chunking as C, evidence as E, report as R
from quillgrid.operators.clauses import extract_items
from quillgrid.operators.hints import with_hints
from quillgrid.operators.retrieval import cosine_topk, match
from quillgrid.operators.store import Snapshots, last_wins, upsert
from quillgrid.params import Params
from quillgrid.plans.engine import Engine
from quillgrid.schemas import RAW_ROWS
from quillgrid.sources.workbook import read_workbook, workbook_rows


def sheet(spark, *rows):
    return spark.createDataFrame([("frs102_dc.xlsx", 0, "S", i, *(list(r) + ["", "", ""])[:3], list(r)) for i, r in enumerate(rows)], RAW_ROWS)


def items(spark, *rows):
    return [r.asDict() for r in extract_items(sheet(spark, *rows)).orderBy("seq").collect()]


def test_sibling_clauses(spark):
    got = items(spark, ("6.01", "Disclose, in a note:"), ("(a)", "financial commitments;"), ("(b)", "guarantees;"), ("(c)", "contingencies"))
    assert [g["requirement_id"] for g in got] == ["6.01(a)", "6.01(b)", "6.01(c)"]
    assert got[0]["requirement_text"] == "Disclose, in a note: financial commitments;"


def test_romans_notes_and_continuations(spark):
    got = items(spark, ("Part one",), ("6.01", "Details of advances", "s413"), ("(a)", "The details required:"), ("(i)", "its amount", "r1"), ("", "in pounds"), ("Note 1", "This is guidance only."), ("(ii)", "any interest"))
    assert [g["requirement_id"] for g in got] == ["6.01(a)(i)", "6.01(a)(ii)"]
    assert got[0]["requirement_text_leaf"] == "its amount; in pounds" and got[0]["section_path"] == "Part one"
    assert got[1]["notes_text"] == "This is guidance only."


def test_plain_list_under_clause(spark):
    got = items(spark, ("3.01", "Show:"), ("(a)", "These:"), ("", "Called up share capital not paid;"), ("", "Fixed assets;"), ("", "Capital and reserves."))
    assert [g["requirement_id"] for g in got] == ["3.01(a)(1)", "3.01(a)(2)", "3.01(a)(3)"]


def test_base_alone_and_empty(spark):
    assert [g["requirement_text"] for g in items(spark, ("1.01", "State the name"), ("", "of the entity."))] == ["State the name; of the entity."]
    assert items(spark, ("Client", "x"), ("text", "y")) == []


def workbook(rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + k)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r) if v) + "</row>" for i, r in enumerate(rows))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name=" One " sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


RULES = [("Income statement",), ("5.01", "Disclose revenue by class:"), ("(a)", "the revenue from sale of goods;"), ("(b)", "the revenue from rendering of services;"), ("5.02", "Disclose the number of employees in the period.")]


def test_workbook_cells():
    assert [c for _, s, _, c in read_workbook(workbook([("5.01", "a", "b"), (), ("", "", "", "x")])) if s == "One"] == [["5.01", "a", "b"], ["", "", "", "x"]]


def model_windows(words, size, overlap):
    out, at = [], 0
    while words:
        out.append(" ".join(words[at : at + size]))
        if at + size >= len(words):
            break
        at += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 319, 320, 321, 580, 581, 1000])
def test_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = spark.createDataFrame([(words,)], "w array<string>").select(C.word_windows(F.col("w"), 320, 60).alias("v")).first()["v"]
    assert got == model_windows(words, 320, 60)


def test_sections_and_edges(spark):
    body = "Some prose that goes on and on about the company, and does not end there, so that it is long."
    pages = [("d", i, f"Annual report\nNote {i} Policies\nRevenue recognition\n{body} {i}, now.\nx footer\n{i}") for i in range(1, 4)] + [("d", 4, "NOTES TO THE FINANCIAL STATEMENTS\n1 Staff\nWages | 12\n2 Tax\nDue | 3")]
    got = C.build_chunks(spark.createDataFrame(pages, "doc_id string, page_number int, text string")).orderBy("chunk_index").collect()
    assert [g["chunk_index"] for g in got] == list(range(5))
    assert got[0]["heading_guess"] == "Note 1 Policies - Revenue recognition" and got[0]["statement_area"] == "notes" and got[0]["note_number"] == "1"
    assert "Annual report" not in got[0]["text_redacted"] and "footer" not in got[0]["text_redacted"]
    assert [(g["section_title"], g["note_number"]) for g in got[3:]] == [("1 Staff", "1"), ("2 Tax", "2")]
    assert [g["text_redacted"] for g in got[3:]] == ["1 Staff Wages | 12", "2 Tax Due | 3"]


def test_packing_stops_at_the_first_that_does_not_fit(spark):
    chunk = "struct<chunk_id:string,page_number:int,text_redacted:string,heading_guess:string,similarity:double,section_title:string,statement_area:string,chunk_type:string,note_number:string>"
    rows = [(("a", 1, "x" * 300, "", 0.5, "", "", "", ""), ("b", 2, "y" * 300, "", 0.9, "", "", "", ""), ("a", 1, "z", "", 0.1, "", "", "", ""), ("c", 0, "w", "", 0.1, "", "", "", ""))]
    df = spark.createDataFrame([(list(r),) for r in rows], f"c array<{chunk}>")
    got = df.select(E.merge_evidence(F.col("c"), 450).alias("m")).first()["m"]
    assert got["text"] == "Page 1: " + "x" * 300 + "\n\nPage 2: " + "y" * (450 - 308 - 2 - 8) and got["similarity"] == 0.5
    assert df.select(E.merge_evidence(F.col("c"), 350).alias("m")).first()["m"]["text"] == "Page 1: " + "x" * 300
    label = df.select(E.chunks_for_check(F.lit("y"), F.col("c")).alias("v")).first()["v"]
    assert [c["chunk_id"] for c in label] == ["b", "a"]


def model_match(rules, chunks, k, c):
    """Candidate algebra and ranking over small lists."""
    def dot(a, b):
        na, nb = (sum(x * x for x in v) ** 0.5 or 1e-12 for v in (a, b))
        return sum(x * y for x, y in zip(a, b)) / na / nb

    out = {}
    for key, vec, words in rules:
        sims = sorted(((-dot(vec, v), i) for i, (v, _) in enumerate(chunks)))
        near = {i for _, i in sims[:c]}
        hits = [(s, i) for s, i in sims if set(words) & set(chunks[i][1].split())]
        short = {i for _, i in sorted(hits)[:c]}
        cand = near if not words or not hits else short if len(short) >= c else short | near
        score = {i: 0.65 * dot(vec, chunks[i][0]) + 0.22 * min(1, (sum(w in chunks[i][1].split() for w in words) / len(words)) if words else 0) for i in cand}
        out[key] = sorted(cand, key=lambda i: (-score[i], -dot(vec, chunks[i][0]), i))[:k]
    return out


def test_match_equals_a_model(spark):
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(30)]
    chunks = [([rng.gauss(0, 1) for _ in range(6)], " ".join(rng.sample(vocab, 5))) for _ in range(60)]
    rules = [(f"r{i}", [rng.gauss(0, 1) for _ in range(6)], rng.sample(vocab, i % 4)) for i in range(12)] + [("none", [1.0] + [0.0] * 5, ["absent"])]
    cdf = spark.createDataFrame([("d", i, f"c{i}", v, 1, t, "", "", "", "", "") for i, (v, t) in enumerate(chunks)], "doc_id string, chunk_pos int, chunk_id string, vec array<double>, page_number int, text_redacted string, heading_guess string, section_title string, statement_area string, chunk_type string, note_number string")
    rdf = spark.createDataFrame([(k, v, w, []) for k, v, w in rules], "item_key string, rule_vec array<double>, keywords array<string>, section_hints array<string>")
    got = {}
    rows = match(rdf, cdf, Params(top_k=3, candidate_k=5)).orderBy("item_key", "rank").collect()
    for r in rows:
        got.setdefault(r["item_key"], []).append(r["chunk_pos"])
    assert got == model_match(rules, chunks, 3, 5)
    assert {r["item_key"] for r in rows if r["lexical_miss"]} == {"none"}


def test_rollup_and_report(spark):
    checks = spark.createDataFrame([("a", "fully_met", "required", "x"), ("a", "missing", "supporting", "x"), ("b", "missing", "required", None), ("b", "missing", "required", " ")], "item_key string, status string, kind string, reason string")
    got = {r["item_key"]: r for r in R.rollup_checks(checks, ["item_key"]).collect()}
    assert (got["a"]["status"], got["a"]["uniform_reason"], got["a"]["explanation"]) == ("fully_met", "x", "1 met, 1 missing out of 2 checks.")
    assert got["b"]["explanation"] == "All 2 atomic checks missing." and got["b"]["uniform_reason"] is None
    items_ = spark.createDataFrame([("a", "S", "6.10"), ("c", "S", "6.2")], "item_key string, sheet_name string, requirement_id string")
    rep = R.report_items(items_, R.rollup_checks(checks, ["item_key"]).select("item_key", "status"))
    assert [(r["item_key"], r["status"], r["needs_review"]) for r in rep.collect()] == [("c", "missing", True), ("a", "fully_met", True)]
    assert R.summarize(rep).first().asDict() == {"total": 2, "missing": 1, "partial": 0, "fully_met": 1}


def test_upsert_and_last_wins(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 5), (2, "c", 3)], "k int, v string, seq int")
    assert sorted(map(tuple, last_wins(rows, ["k"], "seq").select("k", "v", "first_seen").collect())) == [(1, "b", 0), (2, "c", 3)]
    s = Snapshots(spark, f"file://{tmp_path}/store")
    assert s.read("t") is None
    s.upsert("t", old, ["k"])
    assert s.upsert("t", new, ["k"]).count() == 3 and s.version("t") == 2
    # only the buckets of the new rows are rewritten, and of rows with one key one stays
    first = s.manifest("t")["buckets"]
    assert sorted(map(tuple, s.upsert("t", new.where("k = 3").unionByName(new.where("k = 3")), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sum(first[b] != f for b, f in s.manifest("t")["buckets"].items()) == 1
    s.delete("t", new.where("k = 2"), "k")
    assert sorted(r["k"] for r in s.read("t").collect()) == [1, 3]
    s.write("t", old.limit(0), "k")
    assert s.read("t").count() == 0 and s.read("t").columns == ["k", "v"]
    with pytest.raises(Exception, match="already exists|FileAlreadyExists"):  # a second writer of one version
        s._put("t", old, "k", {"version": s.version("t") - 1, "buckets": {}}, [])


def test_whole_run(spark, tmp_path):
    files = spark.createDataFrame([("/x/frs102_dc.xlsx", bytearray(workbook(RULES)))], "path string, content binary")
    assert workbook_rows(files).count() == 5
    e = Engine(spark, f"file://{tmp_path}/engine")
    got = e.sync_checklists(files)
    assert sorted(r["requirement_id"] for r in got.collect()) == ["5.01(a)", "5.01(b)", "5.02"]
    pages = spark.createDataFrame([("d1", 1, "Income statement\nThe revenue from sale of goods was 12 and the revenue from rendering of services was 7; Name: Jo Smith\n"), ("d1", 2, "Staff\nThe average number of employees in the period was 4, and they did well, all in all.")], "doc_id string, page_number int, text string")
    e.analyze(pages, "FRS 102")
    summary, rows = e.report("d1", "FRS 102")
    assert summary.first()["total"] == 3
    assert [r["requirement_id"] for r in rows.collect()] == ["5.01(a)", "5.01(b)", "5.02"]
    assert [(r["doc_id"], r["status"], r["progress"]) for r in e.analyses().collect()] == [("d1", "completed", 100)]
    before = e.store.read("analysis_results").count()
    e.analyze(pages.where("page_number = 1"), "FRS 102")  # again, with a page less: nothing of the old chunks is left
    assert {r["page_number"] for r in e.store.read("analysis_chunks").collect()} == {1} and e.store.read("analysis_results").count() == before
    e.analyze(pages, "FRS 102")
    assert [r["type_key"] for r in e.store.read("checklist_types").collect()] == ["frs102"]
    assert {s["state"] for s in e.status("d1")} == {"completed"} and {s["state"] for s in e.status("d2")} == {"waiting"}
    assert "Smith" not in "".join(r["text_redacted"] for r in e.store.read("analysis_chunks").collect())


def test_cosine_topk_limits_before_the_shuffle(spark):
    v = spark.createDataFrame([("d", i, [float(i % 3), 1.0]) for i in range(9)], "doc_id string, chunk_pos int, vec array<double>")
    r = spark.createDataFrame([("a", [1.0, 0.0])], "item_key string, rule_vec array<double>")
    top = cosine_topk(r, v, 3)
    assert [x["chunk_pos"] for x in top.orderBy("rank").collect()] == [2, 5, 8]
    plan = top._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_hints(spark):
    got = with_hints(extract_items(sheet(spark, ("5.01", "Advances and credits granted by the company to its directors"), ("(a)", "including:"), ("(iv)", "any amounts repaid;"), ("(iii)", "its main conditions;")))).orderBy("seq").collect()
    assert got[0]["rule_checks"][0]["label"] == "amounts repaid for advances and credits to directors" and got[0]["search_keywords"][0] == got[0]["rule_checks"][0]["label"]
    assert "directors" in got[0]["section_hints"] and "details" not in got[0]["search_keywords"]
    assert T is not None


def test_parameters():
    p = Params(top_k=0, candidate_k=1, keyword_prefilter="no", review_threshold=3, row_explanation_chars=220)
    assert (p.top_k, p.candidate_k, p.keyword_prefilter, p.review_threshold, p.row_explanation_chars) == (1, 1, False, 0.99, 256)
    with pytest.raises(ValueError):
        Params(window_words=10, overlap_words=10)


def test_pages_that_arrive(spark, tmp_path):
    from quillgrid.streaming.pages import analyze_stream

    e = Engine(spark, f"file://{tmp_path}/engine")
    e.sync_checklists(spark.createDataFrame([("/x/frs102_dc.xlsx", bytearray(workbook(RULES)))], "path string, content binary"))
    pages = spark.createDataFrame([("d7", 1, "Staff\nThe average number of employees in the period was 4, and they did well, all in all.")], "doc_id string, page_number int, text string")
    pages.write.parquet(f"file://{tmp_path}/in")
    analyze_stream(spark, f"file://{tmp_path}/in", e, "frs102", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert {r["doc_id"] for r in e.store.read("analysis_results").collect()} == {"d7"}
    old = e.store.manifest("analysis_results")["buckets"]
    more = [(f"d{k}", 1, "Staff\nThe average number of employees in the period was 9, as before, all in all.") for k in (8, 9)]
    spark.createDataFrame(more, "doc_id string, page_number int, text string").write.mode("append").parquet(f"file://{tmp_path}/in")
    analyze_stream(spark, f"file://{tmp_path}/in", e, "frs102", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert {r["doc_id"] for r in e.store.read("analysis_results").collect()} == {"d7", "d8", "d9"}
    assert all(e.store.manifest("analysis_results")["buckets"][b] == f for b, f in old.items())  # d7's files are as they were


def test_outside_services(spark):
    from quillgrid.functions import verdict as V
    from quillgrid.plans.engine import judge_checks, results_of
    from quillgrid.providers import batched_embedder, batched_judge

    texts = spark.createDataFrame([(str(i),) for i in range(7)] + [(None,)], "t string").coalesce(1)
    got = texts.select("t", batched_embedder(lambda part: [[len(part), float(len(t))] for t in part], 3)(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [[3.0, 1.0]] * 6 + [[2.0, 1.0], [2.0, 0.0]]

    def judge(prompt, evidence):
        if "fails" in prompt:
            raise RuntimeError("no service")
        return '{"status": "FULLY", "reason": "%s", "confidence": 2}' % ("context" if prompt.startswith("Row context: the requirement") else "none")

    chunk = "struct<chunk_id:string,page_number:int,text_redacted:string,heading_guess:string,similarity:double,section_title:string,statement_area:string,chunk_type:string,note_number:string>"
    found = [("a", "c1", 1, "some text " * 40), ("b", None, 0, "")]
    evidence = spark.createDataFrame([(k, "d", [(c, p, t, "", 0.9, "", "", "", "")], False) for k, c, p, t in found], f"item_key string, doc_id string, chunks array<{chunk}>, lexical_miss boolean")
    rules = spark.createDataFrame([("a", "the requirement " * 200, [("x", "holds", "required"), ("y", "fails", "supporting")])], "item_key string, requirement_text string, rule_checks array<struct<check_id:string,label:string,kind:string>>")
    checks = judge_checks(evidence, rules, Params(), batched_judge(judge))
    rows = {(r["item_key"], r["label"]): (r["status"], r["reason"], r["confidence"]) for r in checks.collect()}
    assert rows == {("a", "holds"): ("fully_met", "context", 1.0), ("a", "fails"): ("missing", V.NOT_JUDGED, None), ("b", "Disclosure requirement"): ("missing", V.NO_EVIDENCE, None)}
    got = {r["item_key"]: r for r in results_of(checks, Params()).collect()}
    assert got["a"]["status"] == "fully_met" and len(got["a"]["evidence_snippet"]) <= 160 and got["a"]["evidence"][0]["chunkId"] == "c1"
    assert got["b"]["status"] == "missing" and got["b"]["evidence"] is None and got["b"]["evidence_snippet"] is None


def test_previews_and_exports(spark, tmp_path):
    from quillgrid.operators import previews as P
    from quillgrid.plans.engine import export

    pages = spark.createDataFrame([("d", 1, "Name: Jo Smith\nmail a@b.org and c@d.org"), ("d", 2, None), ("e", 1, " ")], "doc_id string, page_number int, text string")
    blocks, rows, stats = P.pii_preview(pages)
    assert [r["block"] for r in blocks.where("doc_id = 'd'").orderBy("page_number").collect()] == ["===== Page 1 =====\nName: [PERSON_1][EMAIL_1] and [EMAIL_2]\n", "===== Page 2 =====\n\n"]
    assert sorted((r["pageNumber"], r["entityType"], r["replacementValue"]) for r in rows.collect()) == [(1, "email", "[EMAIL_1]"), (1, "email", "[EMAIL_2]"), (1, "person", "[PERSON_1]")]
    assert {(r["doc_id"], r["pages"], r["pages_with_text"], r["replacements"]) for r in stats.collect()} == {("d", 2, 1, 3), ("e", 1, 0, 0)}
    P.write_pii_preview(pages, f"file://{tmp_path}/pii")
    assert spark.read.json(f"file://{tmp_path}/pii/audit").count() == 3
    made = extract_items(sheet(spark, *RULES))
    export(made, f"file://{tmp_path}/items", "text")
    text = "\n".join(r["value"] for r in spark.read.text(f"file://{tmp_path}/items").collect())
    assert text.count("=" * 80) == 3 and "Reference: [none]" in text and "Requirement ID: 5.01(a)" in text
    assert [r["ID"] for r in P.preview(made, 2).collect()] == ["5.01(a)", "5.01(b)"]
    assert P.of_sheets(made, [" s "]).count() == 3 and P.of_sheets(made, ["x"]).count() == 0 and P.of_sheets(made).count() == 3


def test_rules_beyond_the_broadcast_bound(spark):
    """In blocks, each with a pass of its own: the same matches."""
    import math

    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    rules = spark.createDataFrame([(f"r{i}", vec(), ["alpha"] if i % 2 else [], ["note 1"] if i % 3 else []) for i in range(7)], "item_key string, rule_vec array<double>, keywords array<string>, section_hints array<string>")
    chunks = [(d, k, f"{d}{k}", 1, rng.choice(["alpha", "beta"]) + " text", rng.choice(["Note 1", ""]), "", "other", "narrative", "", vec()) for d in ("x", "y") for k in range(9)]
    chunks = spark.createDataFrame(chunks, "doc_id string, chunk_pos int, chunk_id string, page_number int, text_redacted string, heading_guess string, section_title string, statement_area string, chunk_type string, note_number string, vec array<double>")
    few, many = (sorted(map(tuple, match(rules, chunks, Params(broadcast_rules=n)).select("item_key", "doc_id", "rank", "chunk_id", "final_score", "lexical_miss").collect())) for n in (100, 3))
    assert few == many and len(few) == 7 * 2 * 4 and all(math.isfinite(r[4]) for r in few)
    assert match(rules.limit(0), chunks).count() == 0 and match(rules, chunks.limit(0)).count() == 0


def test_cosine_topk_equals_sql_in_any_batches(spark, tmp_path):
    """Copies, multiples whose similarities differ in the last bit or not, near copies, NaN and null; batches of many sizes."""
    import duckdb

    from quillgrid.plans.queries import ORACLES, QUERIES

    rng = random.Random(5)
    rows: list = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(200)]
    rows += [[x * by for x in rng.choice(rows[:40])] for by in (1.0, 3.0, 0.7, -1.1) for _ in range(60)]
    rows += [[x + rng.uniform(-1e-6, 1e-6) for x in rows[rng.randrange(0, 40, 20)]] for _ in range(150)] + [rows[20]] * 70 + [None, [float("nan")] * 16, None]
    rows[60] = None  # a query without a vector
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "vec_id bigint, embedding array<float>")
    table.repartition(3).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(map(str, con.execute(ORACLES["cosine_topk"]).fetchall()))
    for most in (10_000, 50, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
        try:
            got = QUERIES["cosine_topk"](spark, str(tmp_path))
            assert sorted(str(tuple(r)) for r in got.collect()) == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "NestedLoopJoin" not in got._jdf.queryExecution().toString()  # pairs are not rows


def test_cosine_topk_of_types_scopes_and_lengths(spark):
    """Rules in blocks against several documents; what has no similarity comes last, and only where there is nothing else."""
    from math import sqrt

    rng = random.Random(6)
    vec = lambda d: [rng.uniform(-1, 1) for _ in range(d)]
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 2.0], [1.0, 2.0], [1e200, 1e200, 0.0], [1e-200, 0.0, 1e-200]]
    rules = [(f"r{i}", rng.choice("ab"), v) for i, v in enumerate([vec(3) for _ in range(6)] + odd)]
    vectors = [(doc, k, rng.choice(["a", "b", None]), v) for doc in ("x", "y", None) for k, v in enumerate([vec(3) for _ in range(9 if doc else 2)] + odd)]

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a + b:
            return None
        (a, b) = ([x / max(map(abs, v)) if any(v) else x for x in v] for v in (a, b))
        n = sqrt(sum(x * x for x in a)) * sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for typed in (True, False):
        want = set()
        for item, kind, rule in rules:
            for doc in ("x", "y", None):
                found = [(cosine(rule, v), k) for d, k, t, v in vectors if d == doc and (t == kind or not typed)]
                found.sort(key=lambda s: (s[0] is None, -round(s[0] or 0.0, 12), s[1]))
                want |= {(doc, item, k, s if s is None else round(s, 9) + 0.0, i + 1) for i, (s, k) in enumerate(found[:4])}
        r = spark.createDataFrame(rules, "item_key string, type_key string, rule_vec array<double>")
        v = spark.createDataFrame(vectors, "doc_id string, chunk_pos int, type_key string, vec array<double>")
        got = cosine_topk(r if typed else r.drop("type_key"), v, 4, Params(broadcast_rules=5)).select("doc_id", "item_key", "chunk_pos", "similarity", "rank")
        assert {(*x[:3], x[3] if x[3] is None else round(x[3], 9) + 0.0, x[4]) for x in got.collect()} == want
    assert cosine_topk(r.limit(0), v, 4).count() == 0 and cosine_topk(r, v.limit(0), 4).count() == 0
