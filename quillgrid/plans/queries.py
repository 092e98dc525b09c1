"""Queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import pii, scoring as S, text as T, verdict as V
from ..operators import chunking as C, evidence as E, report as R, retrieval as M
from ..operators.clauses import extract_items
from ..operators.hints import with_hints
from ..operators.store import last_wins, materialize, missing, upsert
from ..params import Params
from ..sources.pages import pages_of_table
from .catalogue import HEADING, ORACLES, QUERIES, query, table  # noqa: F401

def keyword_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as rules: their long words are the keywords."""
    words = F.array_distinct(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) >= 8))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item_key"), F.col("text").alias("requirement_text"), words.alias("keywords"))


@query()
def compliance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: documents to chunks, benchmark items as rules, hybrid top 4 for each rule and source of documents, and the verdict on each.

    Vectors come from the embeddings table, which stands in for a service: a chunk has that of its document's number.
    """
    params = Params()
    docs = table(spark, sf_dir, "documents")
    chunks = C.build_chunks(C.redact_pages(pages_of_table(docs, "doc_id", "text")).drop("pii_audit"), params)
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    n = vectors.count()
    chunks = chunks.join(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.pmod("doc_id", F.lit(n)).alias("v")), "doc_id").join(vectors, "v")
    chunks = chunks.withColumns({"chunk_id": F.concat_ws("/", "doc_id", F.col("chunk_index").cast("string")), "vec": F.col("embedding")}).withColumns({"chunk_pos": F.col("chunk_id"), "doc_id": F.col("source")})
    chunks = materialize(chunks.drop("v", "embedding"), "chunks")
    rules = keyword_rules(spark, sf_dir).withColumns({"v": F.pmod(F.col("item_key").cast("long"), F.lit(n)), "section_hints": F.array().cast("array<string>")}).join(vectors, "v").withColumnRenamed("embedding", "rule_vec")
    found = E.gather(M.match(rules, chunks, params)).withColumn("merged", E.merge_evidence(F.col("chunks"), params.evidence_chars))
    sim = F.col("merged.similarity")
    return found.select("item_key", F.col("doc_id").alias("source"), S.similarity_status(sim).alias("status"), F.round(sim, 6).alias("similarity"), F.length("merged.text").alias("evidence_chars"), "lexical_miss")


@query(r"""SELECT doc_id, trim(regexp_replace(replace(translate(text, chr(13) || chr(10) || '‘’“”–—' || chr(160), '  ''''""-- '), chr(65533), ''), '\s+', ' ', 'g')) AS text FROM documents""")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("text"))


@query(r"""
WITH s AS (SELECT doc_id, string_split_regex(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || '[EMAIL_' || i || ']' ELSE x END), '') AS redacted, CAST(len(p) - 1 AS BIGINT) AS n_found FROM s""")
def pii_email_numbered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", pii.redact(F.col("text")).alias("redacted"), F.size(pii.audit(F.col("text"))).cast("long").alias("n_found"))


_NAME = r"\b(Name|Client|Prepared by|Reviewed by)\s*:\s*([A-Za-z][A-Za-z\s'.-]{1,80})"
_PHONE = r"(?i)\b(Tel|Telephone|Phone|Mobile|Fax)\s*:\s*(\+?\d[\d\s().-]{6,}\d)\b"


@query(rf"""
WITH n AS (SELECT c_custkey, translate(c_name, '#0123456789', ' abcdefghij') AS name, lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS k FROM customer),
t AS (SELECT c_custkey, 'Name : ' || name || '; Tel: 25-' || k || '; Ref: ab' || k || 'C' || CASE WHEN c_custkey % 2 = 0 THEN '; Reviewed by: ' || name || ', mobile: +44 (0) ' || k ELSE '; Fax: none' END AS x FROM n),
a AS (SELECT c_custkey, regexp_replace(x, '(?i)\b[A-Z]{{2}}\d{{6}}[A-Z]?\b', '[ID_1]') AS x FROM t),
b AS (SELECT c_custkey, regexp_replace(regexp_replace(x, '{_NAME.replace("'", "''")}', '\1: [PERSON_1]'), '{_NAME.replace("'", "''")}', '\1: [PERSON_2]') AS x FROM a)
SELECT c_custkey, regexp_replace(regexp_replace(x, '{_PHONE}', '\1: [PHONE_1]'), '{_PHONE}', '\1: [PHONE_2]') AS redacted, CAST(3 + 2 * len(regexp_extract_all(x, 'PERSON_2')) AS BIGINT) AS n_found FROM b""")
def pii_labelled_fields(spark, sf_dir):
    """Names and telephone numbers of customers in labelled fields; every second text has two of the names."""
    k = F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    name = F.translate("c_name", "#0123456789", " abcdefghij")
    text = F.concat(F.lit("Name : "), name, F.lit("; Tel: 25-"), k, F.lit("; Ref: ab"), k, F.lit("C"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("; Reviewed by: "), name, F.lit(", mobile: +44 (0) "), k)).otherwise("; Fax: none"))
    return table(spark, sf_dir, "customer").select("c_custkey", pii.redact(text).alias("redacted"), F.size(pii.audit(text)).cast("long").alias("n_found"))


@query(r"""
SELECT token, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS token FROM documents) GROUP BY token""")
def token_df(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(T.token_set(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n_docs"))


_LINES = r"""
raw AS (SELECT doc_id, source, unnest(string_split_regex(text, '\r?\n+')) AS x, generate_subscripts(string_split_regex(text, '\r?\n+'), 1) AS k FROM documents),
sq AS (SELECT doc_id, source, k, trim(regexp_replace(x, '\s+', ' ', 'g')) AS line FROM raw),
kept AS (SELECT * FROM sq WHERE line <> '' AND NOT regexp_matches(line, '^--\s*\d+\s+of\s+\d+\s*--$') AND NOT regexp_matches(line, '^(?:[£$€]\s*){1,4}$')),
lastk AS (SELECT doc_id, max(k) AS m FROM kept WHERE NOT regexp_matches(line, '^\d{1,3}$') GROUP BY doc_id),
lines AS (SELECT kept.doc_id, source, line, row_number() OVER (PARTITION BY kept.doc_id ORDER BY k) AS pos, count(*) OVER (PARTITION BY kept.doc_id) AS n FROM kept JOIN lastk USING (doc_id) WHERE k <= m)"""


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS lines_sha FROM lines GROUP BY doc_id")
def line_clean(spark, sf_dir):
    lines = T.clean_lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", lines.alias("l")).where(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.sha2(F.array_join("l", "\n"), 256).alias("lines_sha"))


@query(f"""WITH {_LINES}, e AS (SELECT source, 'head' AS side, line FROM lines WHERE pos <= 3 UNION ALL SELECT source, 'tail' AS side, line FROM lines WHERE pos > n - 3)
SELECT source, side, line FROM e GROUP BY ALL HAVING count(*) >= 3""")
def edge_lines_repeated(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), T.clean_lines(F.col("text")).alias("lines"))
    got = C.repeated_edges(pages)
    side = lambda s, c: got.select(F.col("doc_id").alias("source"), F.lit(s).alias("side"), F.explode(c).alias("line"))
    return side("head", "heads").unionByName(side("tail", "tails"))


_TABLE = r"""(regexp_matches(line, '^(?:\d{4}\s+){1,3}\d{4}$') OR contains(line, '|') OR (len(string_split(line, ' ')) >= 5 AND len(list_filter(string_split(line, ' '), lambda t: regexp_matches(t, '(?i)^[\[\]A-Z_0-9,.()%/-]+$'))) >= greatest(3, len(string_split(line, ' ')) // 2)))"""


@query(f"WITH {_LINES} SELECT doc_id, count(*) FILTER (WHERE {HEADING}) AS n_headings, count(*) FILTER (WHERE {_TABLE}) AS n_tables, count(*) AS n_lines FROM lines GROUP BY doc_id")
def line_flags(spark, sf_dir):
    """F12 and F13 over every line of every document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.clean_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count_if(T.is_heading(F.col("line"))).alias("n_headings"), F.count_if(T.is_tableish(F.col("line"))).alias("n_tables"), F.count("*").alias("n_lines"))


@query(r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 320 THEN 1 ELSE 1 + CAST(ceil((len(w) - 320) / 260.0) AS BIGINT) END)) AS k FROM w)
SELECT doc_id, k AS window_index, sha256(array_to_string(w[k * 260 + 1 : k * 260 + 320], ' ')) AS text_hash FROM i""")
def chunk_windows(spark, sf_dir):
    windows = C.word_windows(T.words_of(F.col("text")), 320, 60)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(windows).alias("k", "x")).select("doc_id", F.col("k").cast("long").alias("window_index"), F.sha2("x", 256).alias("text_hash"))


@query()
def document_chunks(spark, sf_dir):
    """The whole of W1-W6 with documents as pages of their source."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").cast("int").alias("page_number"), "text")
    return C.build_chunks(docs).select("doc_id", "chunk_index", "page_number", "text_hash", "heading_guess", "statement_area", "chunk_type", "note_number")


@query("""
WITH h AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Note ' || p_size || '.1 ' || p_type WHEN 1 THEN 'Balance sheet' WHEN 2 THEN p_size || ' ' || p_name WHEN 3 THEN 'Contents' ELSE p_brand END AS heading, CASE p_partkey % 7 WHEN 0 THEN 'see footnote' ELSE p_name END AS body, CAST(p_size % 4 AS INT) AS page FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(heading, '(?i)^(note|notes)\\s+[a-z0-9]+') THEN 'notes' WHEN regexp_matches(heading, '^\\d+\\s+[A-Za-z]') THEN 'notes'
 WHEN regexp_matches(lower(heading) || ' ' || lower(body), '\\b(balance sheet|statement of|income statement|cash flow|changes in equity)\\b') THEN 'primary_statement'
 WHEN page <= 2 AND contains(lower(heading) || ' ' || lower(body), 'contents') THEN 'front_matter' WHEN contains(lower(heading) || ' ' || lower(body), 'note') THEN 'notes' ELSE 'other' END AS statement_area,
 regexp_extract(heading, '(?i)^(?:note\\s+)?(\\d+(?:\\.\\d+)*)\\b', 1) AS note_number FROM h""".replace("\\\\", "\\"))
def area_and_note(spark, sf_dir):
    k, c = F.col("p_partkey"), F.col
    heading = F.when(k % 5 == 0, F.concat(F.lit("Note "), c("p_size").cast("string"), F.lit(".1 "), c("p_type"))).when(k % 5 == 1, "Balance sheet").when(k % 5 == 2, F.concat_ws(" ", c("p_size").cast("string"), c("p_name"))).when(k % 5 == 3, "Contents").otherwise(c("p_brand"))
    body = F.when(k % 7 == 0, "see footnote").otherwise(c("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.statement_area(heading, body, c("p_size") % 4).alias("statement_area"), T.note_number(heading).alias("note_number"))


@query("""
WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p QUALIFY rank <= 12""")
def cosine_topk(spark, sf_dir):
    """Every twentieth vector is a query, against all vectors."""
    v = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("doc_id"), F.col("vec_id").alias("chunk_pos"), F.col("embedding").alias("vec"))
    rules = v.where("chunk_pos % 20 = 0").select(F.col("chunk_pos").alias("item_key"), F.col("vec").alias("rule_vec"))
    got = M.cosine_topk(rules, v, 12)
    return got.select(F.col("item_key").alias("query_id"), F.col("chunk_pos").alias("vec_id"), F.round("similarity", 6).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query(r"""
WITH k AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?'), lambda w: len(w) >= 8)) AS token FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z]+)?')) AS token FROM documents)
SELECT CAST(item_id AS VARCHAR) AS item_key, count(DISTINCT doc_id) AS n_docs FROM k JOIN d USING (token) GROUP BY item_id""")
def lexical_gate(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("chunk_pos"), "text")
    hits = M.lexical_hits(keyword_rules(spark, sf_dir), M.inverted_index(chunks, F.col("text")))
    return hits.groupBy("item_key").agg(F.count("*").alias("n_docs"))


@query(r"""
WITH d AS (SELECT doc_id, source, sha256(trim(source) || '||' || trim(text)) AS item_key FROM documents)
SELECT item_key, arg_max(source, doc_id) AS source, min(doc_id) AS first_seen, max(doc_id) AS last_seen FROM d GROUP BY item_key""")
def item_key_dedupe(spark, sf_dir):
    key = F.sha2(F.concat_ws("||", T.strip(F.col("source")), T.strip(F.col("text"))), 256)
    rows = table(spark, sf_dir, "documents").select(key.alias("item_key"), "source", F.col("doc_id").alias("last_seen"))
    return last_wins(rows, ["item_key"], "last_seen").select("item_key", "source", "first_seen", "last_seen")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_embeddings(spark, sf_dir):
    return missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source")


_STATUS = "CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic = 1 THEN 'partially_met' WHEN quality = 1 THEN 'fully_met' ELSE 'missing' END"


def _statuses(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_key"), F.when(F.col("toxic") == 1, "partially_met").when(F.col("quality") == 1, "fully_met").otherwise("missing").alias("status"), (F.col("doc_id") % 100 / 100).alias("similarity"))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_key"), F.col("source").alias("sheet_name"), F.concat(F.col("doc_id").cast("string"), F.lit(".1")).alias("requirement_id"), "lang")
    return R.report_items(items, labels)


@query(f"SELECT d.doc_id AS item_key, {_STATUS} AS status, CASE WHEN {_STATUS} <> 'fully_met' THEN true ELSE (d.doc_id % 100) / 100.0 < 0.55 END AS needs_review FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def report_left_default(spark, sf_dir):
    return _statuses(spark, sf_dir).select("item_key", "status", "needs_review")


@query(f"WITH s AS (SELECT lang, {_STATUS} AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT lang, count(*) AS total, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'partially_met') AS partial, count(*) FILTER (WHERE status = 'fully_met') AS fully_met FROM s GROUP BY lang")
def status_counts(spark, sf_dir):
    return R.summarize(_statuses(spark, sf_dir), ["lang"])


def _line_checks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_returnflag") == "A", "fully_met").when(F.col("l_returnflag") == "N", "partially_met").otherwise("missing").alias("status"),
        F.when(F.col("l_linestatus") == "O", "required").otherwise("supporting").alias("kind"), F.col("l_linestatus").alias("reason"), (F.col("l_discount") * 10).alias("confidence"),
    )


_ROLL = """c AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN 0.5 ELSE 0.0 END AS s, CASE l_linestatus WHEN 'O' THEN 1.0 ELSE 0.35 END AS w, l_linestatus = 'O' AS req, l_linestatus AS reason, l_discount * 10 AS confidence FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE s = 1) AS f, count(*) FILTER (WHERE s = 0.5) AS p, count(*) FILTER (WHERE s = 0) AS m, CAST(sum(CAST(s AS DOUBLE) * w) AS DOUBLE) / greatest(CAST(sum(w) AS DOUBLE), 1e-9) AS coverage,
 count(*) FILTER (WHERE req) AS nr, count(*) FILTER (WHERE req AND s = 1) AS rf, count(*) FILTER (WHERE req AND s = 0) AS rm, min(reason) AS r0, max(reason) AS r1, min(confidence) AS low FROM c GROUP BY l_orderkey),
v AS (SELECT *, CASE WHEN (CASE WHEN nr > 0 THEN rf = nr ELSE f = n END) THEN 'fully_met' WHEN (CASE WHEN nr > 0 THEN rm = nr ELSE m = n END) THEN 'missing' ELSE 'partially_met' END AS status FROM g)"""


@query(f"WITH {_ROLL} SELECT l_orderkey, status, round(coverage, 10) AS coverage, n AS n_checks FROM v")
def coverage_rollup(spark, sf_dir):
    return R.rollup_checks(_line_checks(spark, sf_dir), ["l_orderkey"]).select("l_orderkey", "status", F.round("coverage", 10).alias("coverage"), "n_checks")


@query(f"""WITH {_ROLL} SELECT l_orderkey, CASE WHEN r0 = r1 THEN r0 WHEN n = 1 THEN r0 WHEN f = n THEN 'All ' || n || ' atomic checks matched.' WHEN m = n THEN 'All ' || n || ' atomic checks missing.'
 ELSE concat_ws(', ', CASE WHEN f > 0 THEN f || ' met' END, CASE WHEN p > 0 THEN p || ' partial' END, CASE WHEN m > 0 THEN m || ' missing' END) || ' out of ' || n || ' checks.' END AS explanation FROM v""")
def row_explanation(spark, sf_dir):
    got = R.rollup_checks(_line_checks(spark, sf_dir), ["l_orderkey"])
    return got.select("l_orderkey", V.row_explanation(F.lit(True), F.lit(False), F.col("uniform_reason"), F.col("explanation")).alias("explanation"))


@query(f"WITH {_ROLL} SELECT l_orderkey, CASE WHEN status = 'missing' THEN true WHEN l_orderkey % 3 <> 0 THEN low < 0.72 WHEN status = 'partially_met' THEN true ELSE (l_orderkey % 100) / 100.0 < 0.55 END AS needs_review FROM v")
def needs_review(spark, sf_dir):
    """by the status, the least confidence (none for every third order), and the similarity."""
    checks = _line_checks(spark, sf_dir)
    low = checks.groupBy("l_orderkey").agg(F.min("confidence").alias("low"))
    got = R.rollup_checks(checks, ["l_orderkey"]).select("l_orderkey", "status").join(low, "l_orderkey")
    known = F.when(F.col("l_orderkey") % 3 != 0, F.array("low")).otherwise(F.array(F.lit(None).cast("double")))
    return got.select("l_orderkey", V.needs_review(F.col("status"), known, F.col("l_orderkey") % 100 / 100).alias("needs_review"))


@query("""
WITH e AS (SELECT event_id, event_type, value, event_id % 9 IN (1, 2, 3, 4) AS broken, event_id % 9 = 5 AS odd FROM events),
v AS (SELECT *, NOT broken AND event_type IN ('click', 'view', 'purchase') AS ok FROM e)
SELECT event_id, CASE WHEN ok THEN CASE event_type WHEN 'click' THEN 'fully_met' WHEN 'view' THEN 'partially_met' ELSE 'missing' END END AS status,
 CASE WHEN ok AND NOT odd THEN 'kind ' || event_type END AS reason, CASE WHEN ok AND NOT odd THEN round(greatest(0.0, least(1.0, value)), 6) END AS confidence FROM v""")
def judge_parse(spark, sf_dir):
    """Bodies that are whole, cut off, an array, empty, another word, or with an empty reason and no number."""
    e, k = F.col("event_type"), F.col("event_id") % 9
    word = F.when(e == "click", "FULLY").when(e == "view", "partial").when(e == "purchase", "NONE").otherwise("MAYBE")
    body = F.to_json(F.struct(word.alias("status"), F.concat(F.lit(" kind  "), e).alias("reason"), F.col("value").alias("confidence")))
    odd = F.to_json(F.struct(word.alias("status"), F.lit("  ").alias("reason"), F.lit("high").alias("confidence")))
    raw = F.when(k == 1, F.lit("not json")).when(k == 2, F.concat(F.lit("["), body, F.lit("]"))).when(k == 3, "").when(k == 4, F.lit(None).cast("string")).when(k == 5, odd).when(k == 6, F.concat(F.lit(" "), body, F.lit("\n"))).otherwise(body)
    got = table(spark, sf_dir, "events").select("event_id", V.parse_judgement(raw).alias("v"))
    return got.select("event_id", "v.status", "v.reason", F.round("v.confidence", 6).alias("confidence"))


@query("""
WITH p AS (SELECT p_partkey, p_size || '.0' || (p_partkey % 7) || '(' || chr(CAST(97 + p_partkey % 5 AS INT)) || ')' AS id FROM part)
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(id), '[a-z]+\\d*|\\d+|\\([a-z0-9]+\\)'), lambda t: CASE WHEN t LIKE '(%' THEN '1/0/' || t WHEN regexp_matches(t, '^\\d+$') THEN '0/' || CAST(t AS BIGINT) || '/' ELSE '2/0/' || t END), ' ') AS sort_key FROM p""".replace("\\\\", "\\"))
def natural_id_order(spark, sf_dir):
    id_ = F.concat(F.col("p_size").cast("string"), F.lit(".0"), (F.col("p_partkey") % 7).cast("string"), F.lit("("), F.chr((F.lit(97) + F.col("p_partkey") % 5).cast("int")), F.lit(")"))
    key = F.transform(V.natural_id(id_), lambda t: F.concat_ws("/", t["tag"].cast("string"), t["num"].cast("string"), t["word"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(key, " ").alias("sort_key"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'frs105' WHEN 1 THEN 'ifrs' WHEN 2 THEN 'frs102' WHEN 3 THEN 'frs102' WHEN 4 THEN 'ifrs' ELSE trim(regexp_replace(regexp_replace(lower(replace(p_brand, '#', '')), '[ -]', '_', 'g'), '_+', '_', 'g'), '_') END AS type_key FROM part""")
def type_key_map(spark, sf_dir):
    k = F.col("p_partkey") % 6
    stem = F.when(k == 0, "My FRS105-pack").when(k == 1, "Listed Co-DC_2025").when(k == 2, "frs1021a dc 2025").when(k == 3, "Charities & FRS").when(k == 4, "x ifrs").otherwise(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", T.type_key(stem).alias("type_key"))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def upsert_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return upsert(orders, orders.where("o_orderstatus = 'F'").withColumn("o_orderpriority", F.lit("done")), ["o_orderkey"])


@query("SELECT source, count(*) FILTER (WHERE len(trim(text)) >= 40) < greatest(1, count(*) // 3) AS needs_ocr FROM documents GROUP BY source")
def ocr_need(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), "text")
    return C.needs_ocr(pages).withColumnRenamed("doc_id", "source")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN len(string_split(p_name, ' ')) <= 5 OR p_partkey % 3 = 1 THEN 'Requirement context: ' || p_type || chr(10) || 'Focus: ' || CASE WHEN p_partkey % 3 = 1 THEN 'its ' || p_name ELSE p_name END ELSE p_name END AS retrieval_text FROM part""")
def retrieval_text(spark, sf_dir):
    k = F.col("p_partkey") % 3
    leaf = F.when(k == 0, "").when(k == 1, F.concat(F.lit("its "), F.col("p_name"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.item_retrieval_text(F.col("p_type"), leaf).alias("retrieval_text"))


@query("""
WITH t AS (SELECT conv_id, role || ': ' AS label, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS j FROM conversations),
u AS (SELECT *, sum(len(label || body) + CASE WHEN j > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS used FROM t),
x AS (SELECT conv_id, min(j) FILTER (WHERE used > 900) AS cut, count(*) AS n FROM u GROUP BY conv_id),
y AS (SELECT conv_id, j, CASE WHEN cut IS NULL OR j < cut THEN label || body WHEN 900 - (used - len(label || body)) > 80 THEN left(body, CAST(900 - (used - len(label || body)) AS BIGINT)) END AS block FROM u JOIN x USING (conv_id) WHERE cut IS NULL OR j <= cut)
SELECT conv_id, any_value(n) AS n_turns, sha256(coalesce(string_agg(block, chr(10) || chr(10) ORDER BY j), '')) AS packed_sha FROM y JOIN x USING (conv_id) GROUP BY conv_id""")
def turns_packed(spark, sf_dir):
    """W14's joining of ordered blocks, with 900 characters for each conversation; of a long one only turns that may fit are gathered."""
    rows, most = table(spark, sf_dir, "conversations"), 900
    n = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    first = M._first(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], most // 3 + 2)
    gathered = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("t"))
    blocks = F.transform("t", lambda x: F.struct(F.concat(x["role"], F.lit(": ")).alias("label"), F.coalesce(x["text"], F.lit("")).alias("text")))
    packed = E._pack(blocks, most, lambda b, room: F.left(b["text"], room), lambda b: F.lit(0))
    return gathered.withColumn("packed_sha", F.sha2(packed, 256)).join(n, "conv_id").select("conv_id", "n_turns", "packed_sha")


@query()
def requirement_clauses(spark, sf_dir):
    """Each nation a sheet, its suppliers rows of a requirement with clauses."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey") % 5
    first = F.when(k == 0, F.concat(F.col("s_nationkey").cast("string"), F.lit("."), F.lpad(F.col("s_suppkey").cast("string"), 2, "0"))).when(k == 1, "(a)").when(k == 2, "(i)").when(k == 3, "").otherwise("(b)")
    rows = s.select(F.lit("frs102_dc.xlsx").alias("workbook"), F.col("s_nationkey").cast("int").alias("sheet_idx"), F.col("s_nationkey").cast("string").alias("sheet"), F.col("s_suppkey").cast("int").alias("row_idx"), first.alias("first"), F.concat(F.col("s_name"), F.lit(";")).alias("second"), F.lit("").alias("third"), F.array().cast("array<string>").alias("cells"))
    return with_hints(extract_items(rows)).select("sheet_name", "seq", "requirement_id", "requirement_text", "item_key", "checklist_type_key", F.array_join("search_keywords", ",").alias("keywords"))
