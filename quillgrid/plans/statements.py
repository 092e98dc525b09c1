"""Queries over synthetic statement pages, and over the order of retrieval, evidence and checks.

The driver's documents hold no notes and hardly a heading, so pages are composed here by one SQL expression that both
engines evaluate: a document for each customer, a page for each year in which it ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scoring as S, text as T, verdict as V
from ..operators import chunking as C, evidence as E, previews as P, retrieval as M
from ..operators.clauses import extract_items
from ..params import Params
from ..schemas import RAW_ROWS
from .catalogue import HEADING, query, table

#: The pages, for Spark and for DuckDB. Seven layouts: a primary statement, notes with and without lines before them, policies below "Note n", a chapter, prose only, headings only.
PAGES_SQL = """
SELECT doc_id, page_number, concat_ws(chr(10), CASE WHEN m = 5 THEN 'annual report of a customer, continued.' ELSE 'Annual report' END,
 CASE m WHEN 0 THEN concat_ws(chr(10), 'Balance sheet', '2023 2022', 'Cash at bank | 10 | 20', 'the cash is held at three banks, none of them abroad.')
 WHEN 1 THEN concat_ws(chr(10), 'NOTES TO THE FINANCIAL STATEMENTS', '1 Staff costs', concat('wages came to ', CAST(doc_id AS STRING), ' pounds in the year.'), '2 Tax', 'tax was paid late; it is shown here.', 'Deferred Tax', 'none is due.')
 WHEN 2 THEN concat_ws(chr(10), 'Contents', 'see the list of all notes further down.', 'Notes to the Financial Statements', 'the notes follow, as they must.', concat(CAST(page_number AS STRING), ' Leases'), 'rent is due in stages over the years.')
 WHEN 3 THEN concat_ws(chr(10), concat('Note ', CAST(page_number AS STRING), ' Policies:'), 'the company follows its policies over many long years.', 'Revenue Recognition', 'sales are recognised when made, as in other years.', '3 Leases', concat('rent of ', CAST(doc_id AS STRING), ' is due in stages.'))
 WHEN 4 THEN concat_ws(chr(10), 'INTRODUCTION', 'Directors Report:', 'the directors say little about this, and less about that.', 'body text only here and there, without a heading.')
 WHEN 5 THEN 'only prose stands on this page, and it was written for one customer alone.'
 ELSE concat_ws(chr(10), 'Balance Sheet', 'Income Statement') END,
 concat('registered office of customer ', CAST(doc_id % 3 AS STRING), ', in the usual place.'), CAST(page_number AS STRING)) AS text
FROM (SELECT DISTINCT o_custkey AS doc_id, CAST(year(CAST(o_orderdate AS DATE)) - 1991 AS INT) AS page_number, (o_custkey + year(CAST(o_orderdate AS DATE))) % 7 AS m FROM orders)"""

_LINES = rf"""
p AS ({PAGES_SQL}),
raw AS (SELECT doc_id, page_number, unnest(string_split_regex(text, '\r?\n+')) AS x, generate_subscripts(string_split_regex(text, '\r?\n+'), 1) AS k FROM p),
sq AS (SELECT doc_id, page_number, k, trim(regexp_replace(x, '\s+', ' ', 'g')) AS line FROM raw),
lastk AS (SELECT doc_id, page_number, max(k) AS m FROM sq WHERE NOT regexp_matches(line, '^\d{{1,3}}$') GROUP BY ALL),
lines AS (SELECT doc_id, page_number, line, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY k) AS pos, count(*) OVER (PARTITION BY doc_id, page_number) AS n FROM sq JOIN lastk USING (doc_id, page_number) WHERE k <= m),
flags AS (SELECT *, {HEADING} AS hd, regexp_matches(line, '^\d+\s+[A-Za-z]') AS numbered, upper(line) = 'NOTES TO THE FINANCIAL STATEMENTS' AS title, bool_or(upper(line) = 'NOTES TO THE FINANCIAL STATEMENTS') OVER (PARTITION BY doc_id, page_number) AS noted FROM lines)"""


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(PAGES_SQL)


def _sections(pages: DataFrame) -> DataFrame:
    found = pages.select("doc_id", "page_number", F.posexplode(C.sections(F.col("lines"))).alias("k", "s"))
    return found.select("doc_id", "page_number", F.col("k").cast("long").alias("section"), F.col("s.heading").alias("heading"), F.size("s.lines").cast("long").alias("n_lines"), F.sha2(F.array_join("s.lines", "\n"), 256).alias("body_sha"))


def _paged(spark: SparkSession, sf_dir: str, noted: bool) -> DataFrame:
    pages = statement_pages(spark, sf_dir).select("doc_id", "page_number", T.clean_lines(F.col("text")).alias("lines"))
    has = F.exists("lines", lambda x: F.upper(x) == T.NOTES_TITLE)
    return _sections(pages.where(has if noted else ~has))


@query(rf"""
WITH {_LINES},
s AS (SELECT *, rtrim(line, ':') AS h, sum(CAST(hd AS INT)) OVER w AS island, last_value(CASE WHEN hd AND regexp_matches(rtrim(line, ':'), '(?i)^(note|notes)\s+[a-z0-9]+') THEN rtrim(line, ':') END IGNORE NULLS) OVER (PARTITION BY doc_id, page_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS note
 FROM flags WHERE NOT noted WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY pos)),
heads AS (SELECT doc_id, page_number, island, CASE WHEN regexp_matches(h, '(?i)^(note|notes)\s+[a-z0-9]+') THEN h WHEN note IS NOT NULL AND numbered THEN h WHEN lower(note) LIKE 'note %' THEN note || ' - ' || h ELSE h END AS heading FROM s WHERE hd),
bodies AS (SELECT doc_id, page_number, island, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS body_sha FROM s WHERE NOT hd GROUP BY ALL)
SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY island) - 1 AS section, coalesce(heading, '') AS heading, n_lines, body_sha FROM bodies LEFT JOIN heads USING (doc_id, page_number, island)
UNION ALL SELECT doc_id, page_number, 0, '', count(*), sha256(string_agg(line, chr(10) ORDER BY pos)) FROM s GROUP BY doc_id, page_number HAVING bool_and(hd)""")
def section_islands(spark, sf_dir):
    """Sections of the pages without the title of the notes."""
    return _paged(spark, sf_dir, False)


@query(rf"""
WITH {_LINES},
s AS (SELECT *, coalesce(bool_or(title) OVER (PARTITION BY doc_id, page_number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside FROM flags WHERE noted),
t AS (SELECT *, title OR (inside AND numbered) OR (NOT inside AND hd) AS opens, NOT title AND NOT (NOT inside AND hd) AS body FROM s),
u AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS island FROM t),
heads AS (SELECT doc_id, page_number, island, CASE WHEN title OR inside THEN line ELSE rtrim(line, ':') END AS heading FROM u WHERE opens),
bodies AS (SELECT doc_id, page_number, island, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS body_sha FROM u WHERE body GROUP BY ALL)
SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY island) - 1 AS section, coalesce(heading, '') AS heading, n_lines, body_sha FROM bodies LEFT JOIN heads USING (doc_id, page_number, island)""")
def notes_sections(spark, sf_dir):
    """Sections of the pages with the title of the notes."""
    return _paged(spark, sf_dir, True)


@query(rf"""
WITH {_LINES},
e AS (SELECT doc_id, 'head' AS side, line FROM lines WHERE pos <= 3 UNION ALL SELECT doc_id, 'tail', line FROM lines WHERE pos > n - 3),
often AS (SELECT doc_id, side, line FROM e GROUP BY ALL HAVING count(*) >= 3),
m AS (SELECT l.*, h.line IS NOT NULL AS head, t.line IS NOT NULL AS tail FROM lines l LEFT JOIN often h ON h.doc_id = l.doc_id AND h.side = 'head' AND h.line = l.line LEFT JOIN often t ON t.doc_id = l.doc_id AND t.side = 'tail' AND t.line = l.line),
b AS (SELECT doc_id, page_number, min(pos) FILTER (WHERE NOT head) AS a, max(pos) FILTER (WHERE NOT tail) AS z FROM m GROUP BY ALL)
SELECT doc_id, page_number, count(*) AS n_lines, sha256(string_agg(line, chr(10) ORDER BY pos)) AS lines_sha FROM lines JOIN b USING (doc_id, page_number) WHERE pos BETWEEN a AND z GROUP BY ALL""")
def edge_strip(spark, sf_dir):
    """Pages less the lines repeated at their edges."""
    pages = statement_pages(spark, sf_dir)
    return C.cleaned_pages(pages).select("doc_id", "page_number", F.size("lines").cast("long").alias("n_lines"), F.sha2(F.array_join("lines", "\n"), 256).alias("lines_sha"))


# retrieval ----------------------------------------------------------------------------
_TOKEN = "'[a-z0-9]+(?:''[a-z]+)?'"


def _hybrid_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    n, k = vectors.count(), F.col("item_id")
    words = T.tokens(F.col("text"))
    long_ = lambda a: F.filter(F.array_distinct(words), lambda w: F.length(w) >= a)
    keywords = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.slice(long_(9), 1, 2)).when(k % 4 == 2, F.array(F.lit("zzqxv"))).otherwise(F.slice(long_(4), 1, 6))
    hints = F.when(k % 3 == 0, F.array(F.lit("Note 3"), F.lit("policies"))).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("Balance Sheet")))
    rules = table(spark, sf_dir, "benchmark").withColumn("v", F.pmod(k, F.lit(n))).join(vectors, "v").select(k.alias("item_key"), F.col("embedding").alias("rule_vec"), keywords.alias("keywords"), hints.alias("section_hints"))
    d = F.col("doc_id")
    heading = F.when(d % 5 == 0, F.concat(F.lit("Note "), (d % 7).cast("string"), F.lit(" policies"))).when(d % 5 == 1, "Balance sheet").otherwise("")
    docs = table(spark, sf_dir, "documents").withColumn("v", F.pmod("doc_id", F.lit(n))).join(vectors, "v")
    chunks = docs.select(
        (d % 3).alias("doc_id"), d.alias("chunk_pos"), d.cast("string").alias("chunk_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text_redacted"), heading.alias("heading_guess"),
        F.lit("").alias("section_title"), F.when(d % 5 == 1, "primary_statement").otherwise("other").alias("statement_area"), F.lit("narrative").alias("chunk_type"), F.lit("").alias("note_number"), F.col("embedding").alias("vec"),
    )
    return rules, chunks


@query(rf"""
WITH n AS (SELECT count(*) AS n FROM embeddings),
rw AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), {_TOKEN})) AS seen, regexp_extract_all(lower(text), {_TOKEN}) AS w FROM benchmark),
rd AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS w FROM rw),
r AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN [] WHEN 1 THEN list_filter(w, lambda x: len(x) >= 9)[1:2] WHEN 2 THEN ['zzqxv'] ELSE list_filter(w, lambda x: len(x) >= 4)[1:6] END AS kw,
 CASE item_id % 3 WHEN 0 THEN [['note', '3'], ['policies']] WHEN 1 THEN [] ELSE [['balance', 'sheet']] END AS hs, e.embedding AS rv FROM rd, n JOIN embeddings e ON e.vec_id = item_id % n.n),
c0 AS (SELECT doc_id % 3 AS scope, doc_id AS pos, coalesce(text, '') AS body, CASE doc_id % 5 WHEN 0 THEN 'Note ' || (doc_id % 7) || ' policies' WHEN 1 THEN 'Balance sheet' ELSE '' END AS heading, CASE doc_id % 5 WHEN 1 THEN 'primary_statement' ELSE 'other' END AS area, e.embedding AS cv FROM documents, n JOIN embeddings e ON e.vec_id = doc_id % n.n),
c AS (SELECT scope, pos, cv, list_distinct(regexp_extract_all(lower(heading || ' ' || area || ' narrative ' || body), {_TOKEN})) AS tk, list_distinct(regexp_extract_all(lower(heading), {_TOKEN})) AS ht FROM c0),
pr AS (SELECT item_id, scope, pos, kw, list_cosine_similarity(rv::DOUBLE[], cv::DOUBLE[]) AS sim, len(kw) > 0 AND list_has_any(tk, kw) AS hit,
 CASE WHEN len(hs) > 0 THEN len(list_filter(hs, lambda h: list_has_all(tk, h))) / len(hs) ELSE 0.0 END AS hint,
 CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda k: list_contains(tk, k))) / len(kw) ELSE 0.0 END AS kov, CASE WHEN len(kw) > 0 AND len(ht) > 0 THEN len(list_filter(kw, lambda k: list_contains(ht, k))) / len(kw) ELSE 0.0 END AS hov FROM r, c),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id, scope ORDER BY sim DESC, pos) AS g, row_number() OVER (PARTITION BY item_id, scope ORDER BY hint DESC, pos) AS m, row_number() OVER (PARTITION BY item_id, scope, hit ORDER BY sim DESC, pos) AS s,
 count(*) FILTER (WHERE hit) OVER (PARTITION BY item_id, scope) AS hits FROM pr),
cand AS (SELECT *, len(kw) > 0 AND hits = 0 AS miss FROM rk WHERE (m <= 12 AND hint > 0) OR (hit AND s <= 12) OR (g <= 12 AND NOT (len(kw) > 0 AND hits >= 12))),
sc AS (SELECT *, 0.65 * sim + 0.22 * least(1.0, kov + 0.35 * hint) + 0.13 * greatest(hov, hint) AS score FROM cand)
SELECT item_id, scope, pos, round(score, 6) AS score, miss AS lexical_miss, row_number() OVER (PARTITION BY item_id, scope ORDER BY score DESC, sim DESC, pos) AS rank FROM sc QUALIFY rank <= 4""")
def hybrid_topk(spark, sf_dir):
    """Rules with no keywords, few hits, none and many, with hints and without."""
    got = M.match(*_hybrid_inputs(spark, sf_dir), Params())
    return got.select(F.col("item_key").alias("item_id"), F.col("doc_id").alias("scope"), F.col("chunk_pos").alias("pos"), F.round("final_score", 6).alias("score"), "lexical_miss", F.col("rank").cast("long").alias("rank"))


# evidence -----------------------------------------------------------------------------
_TURNS = """t AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations)"""


def _ranked_turns(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The turns of a conversation as ranked chunks. A block takes a character and a gap at least, so of a longer conversation only the first ones can ever be packed."""
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role").alias("chunk_id"), F.col("turn").cast("int").alias("page_number"), T.nn(F.col("text")).alias("text_redacted"), (1.0 / (2 + F.col("turn"))).alias("similarity"),
    )
    return M._first(rows, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], most)


@query(rf"""
WITH t AS (SELECT conv_id, turn, conv_id || '/' || turn || '/' || role AS cid, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, cid ORDER BY i) AS copy FROM t),
b AS (SELECT conv_id, i, CASE WHEN turn > 0 THEN 'Page ' || turn || ': ' ELSE '' END AS label, body, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS j FROM f WHERE copy = 1 AND body <> ''),
u AS (SELECT *, sum(len(label || body) + CASE WHEN j > 1 THEN 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS used FROM b),
x AS (SELECT conv_id, min(j) FILTER (WHERE used > 300) AS cut FROM u GROUP BY conv_id),
y AS (SELECT u.conv_id, j, CASE WHEN cut IS NULL OR j < cut THEN label || body WHEN 300 - (used - len(label || body)) - len(label) > 80 THEN label || left(body, CAST(300 - (used - len(label || body)) - len(label) AS BIGINT)) END AS block FROM u JOIN x USING (conv_id) WHERE cut IS NULL OR j <= cut),
z AS (SELECT conv_id, string_agg(block, chr(10) || chr(10) ORDER BY j) AS text FROM y GROUP BY conv_id)
SELECT conv_id, CAST(len(coalesce(z.text, '')) AS BIGINT) AS n_chars, sha256(coalesce(z.text, '')) AS text_sha, round(1.0 / (2 + f.turn), 9) AS similarity FROM f LEFT JOIN z USING (conv_id) WHERE i = 1""")
def evidence_pack(spark, sf_dir):
    """The turns of each conversation packed into 300 characters, the last one cut."""
    most = 300
    rows = _ranked_turns(spark, sf_dir, most)
    chunks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("chunk_id", "page_number", "text_redacted", "similarity").alias("c")))).alias("r"))
    merged = chunks.select("conv_id", E.merge_evidence(F.transform("r", lambda x: x["c"]), most).alias("m"))
    return merged.select("conv_id", F.length("m.text").cast("long").alias("n_chars"), F.sha2("m.text", 256).alias("text_sha"), F.round("m.similarity", 9).alias("similarity"))


@query(rf"""
WITH l AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS label FROM benchmark),
lt AS (SELECT item_id, list_filter(list_distinct(regexp_extract_all(lower(label), {_TOKEN})), lambda w: NOT list_contains(['the','a','an','and','of','for','to','in','on','by','or','its','any'], w)) AS w FROM l),
c AS (SELECT doc_id, doc_id % 40 AS g, CASE WHEN doc_id % 2 = 0 THEN array_to_string(string_split(coalesce(text, ''), ' ')[1:4], ' ') ELSE '' END AS title, 'other' AS area, coalesce(text, '') AS body, (doc_id % 11) / 11.0 AS sim FROM documents),
ct AS (SELECT *, regexp_extract_all(lower(title || ' ' || area || ' ' || body), {_TOKEN}) AS tk, regexp_extract_all(lower(title), {_TOKEN}) AS tt FROM c),
s AS (SELECT item_id, doc_id, 0.67 * sim + 0.28 * len(list_filter(w, lambda x: list_contains(tk, x))) / greatest(1, len(w)) + (CASE WHEN list_has_any(w, tt) THEN 0.05 ELSE 0.0 END + CASE WHEN list_contains(w, 'other') THEN 0.03 ELSE 0.0 END) AS score FROM lt JOIN ct ON item_id % 40 = g)
SELECT item_id, doc_id, round(score, 9) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM s QUALIFY rank <= 2""")
def check_evidence(spark, sf_dir):
    """For each label the two best of the documents that share its number."""
    label = F.array_join(F.slice(F.split("text", " "), 1, 8), " ")
    rules = table(spark, sf_dir, "benchmark").select("item_id", label.alias("label"), (F.col("item_id") % 40).alias("g"))
    d, text = F.col("doc_id"), T.nn(F.col("text"))
    title = F.when(d % 2 == 0, F.array_join(F.slice(F.split(text, " "), 1, 4), " ")).otherwise("")
    docs = table(spark, sf_dir, "documents").select(
        (d % 40).alias("g"), d.alias("doc_id"), d.cast("string").alias("chunk_id"), text.alias("text_redacted"), F.lit("").alias("heading_guess"), title.alias("section_title"), F.lit("other").alias("statement_area"),
        F.lit("").alias("chunk_type"), F.lit("").alias("note_number"), ((d % 11) / F.lit(11.0)).alias("similarity"),
    )
    fields = [c for c in docs.columns if c not in ("g", "doc_id")]
    rows = rules.join(docs, "g").select("item_id", "doc_id", F.struct(*fields).alias("c"), "label")
    scored = rows.select("item_id", "doc_id", E.check_score(F.col("label"), F.col("c")).alias("score"))
    got = M._first(scored, ["item_id"], [F.desc(F.round("score", 12)), F.col("doc_id")], 2)
    return got.select("item_id", "doc_id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


# clauses ------------------------------------------------------------------------------
#: Rows of a sheet, and the requirements that they make.
SHEET = [
    ("Income statement", "", ""), ("6.01", "Disclose, in a note:", ""), ("(a)", "financial commitments;", ""), ("(b)", "guarantees;", ""), ("(c)", "contingencies", ""),
    ("6.02", "Details of advances", "s413"), ("(a)", "The details required:", ""), ("(i)", "its amount", "r1"), ("", "in pounds", ""), ("Note 1", "This is guidance only.", ""), ("(ii)", "any interest", ""),
    ("3.01", "Show:", ""), ("(a)", "These:", ""), ("", "Called up share capital not paid;", ""), ("", "Fixed assets;", ""), ("", "Capital and reserves.", ""), ("1.01", "State the name", ""), ("", "of the entity.", ""),
]


@query("""
SELECT * FROM (VALUES ('6.01(a)', 'Disclose, in a note: financial commitments;', ''), ('6.01(b)', 'Disclose, in a note: guarantees;', ''), ('6.01(c)', 'Disclose, in a note: contingencies', ''),
 ('6.02(a)(i)', 'Details of advances; The details required: its amount; in pounds', ''), ('6.02(a)(ii)', 'Details of advances; The details required: any interest', 'This is guidance only.'),
 ('3.01(a)(1)', 'Show: These: Called up share capital not paid;', ''), ('3.01(a)(2)', 'Show: These: Fixed assets;', ''), ('3.01(a)(3)', 'Show: These: Capital and reserves.', ''), ('1.01', 'State the name; of the entity.', '')) AS t(requirement_id, requirement_text, notes_text)""")
def clause_fold(spark, sf_dir):
    """W7 over literal rows of one sheet."""
    rows = [("frs102_dc.xlsx", 0, "S", i, *r, list(r)) for i, r in enumerate(SHEET)]
    return extract_items(spark.createDataFrame(rows, RAW_ROWS)).select("requirement_id", "requirement_text", F.coalesce("notes_text", F.lit("")).alias("notes_text"))


@query(r"""
WITH p AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b, CASE a.vec_id % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.8 ELSE 0.3 END AS w FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)),
m AS (SELECT vec_id, a, list_transform(list_zip(list_transform(a, lambda x: x / greatest(sqrt(list_dot_product(a, a)), 1e-12)), list_transform(b, lambda x: x / greatest(sqrt(list_dot_product(b, b)), 1e-12))), lambda z: w * z[1] + sqrt(1 - w * w) * z[2]) AS v FROM p),
s AS (SELECT vec_id, list_cosine_similarity(a, v) AS s FROM m)
SELECT vec_id, round(s, 6) AS similarity, CASE WHEN s >= 0.83 THEN 'fully_met' WHEN s >= 0.72 THEN 'partially_met' ELSE 'missing' END AS status FROM s""")
def similarity_bands(spark, sf_dir):
    """A vector against its mixture with the next, in three strengths."""
    v = table(spark, sf_dir, "embeddings")
    n = v.count()
    a, b = v.select("vec_id", S.unit(F.col("embedding")).alias("a")), v.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), S.unit(F.col("embedding")).alias("b"))
    w = F.when(F.col("vec_id") % 3 == 0, 0.95).when(F.col("vec_id") % 3 == 1, 0.8).otherwise(0.3)
    mixed = a.join(b, "vec_id").withColumn("w", w).withColumn("v", F.zip_with("a", "b", lambda x, y: F.col("w") * x + F.sqrt(1 - F.col("w") * F.col("w")) * y))
    sim = mixed.select("vec_id", S.dot(F.col("a"), S.unit(F.col("v"))).alias("s"))
    return sim.select("vec_id", F.round("s", 6).alias("similarity"), S.similarity_status(F.col("s")).alias("status"))


@query(r"""
WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 'No document passages matched the rule keyword filter.' WHEN l_orderkey % 5 = 1 THEN 'the same reason' WHEN l_orderkey % 5 = 2 THEN 'Keyword shortlist missed; fallback retrieval used. ' || n || ' checks.' ELSE n || ' checks.' END AS explanation FROM c""")
def explanation_branches(spark, sf_dir):
    """A4 in all its branches: no evidence, a shared reason, a missed shortlist, and counts alone."""
    k = F.col("l_orderkey") % 5
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return rows.select("l_orderkey", V.row_explanation(k != 0, k == 2, F.when(k == 1, "the same reason"), F.concat(F.col("n").cast("string"), F.lit(" checks."))).alias("explanation"))


# previews -----------------------------------------------------------------------------
@query("""
WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings e, q WHERE label % 2 = 1)
SELECT vec_id, round(s, 6) AS similarity FROM s ORDER BY s DESC, vec_id LIMIT 8""")
def nearest_items(spark, sf_dir):
    """Of the vectors of one kind the eight nearest to the first of all."""
    v = table(spark, sf_dir, "embeddings")
    asked = v.where("vec_id = 0").first()["embedding"]
    items = v.select(F.col("vec_id").alias("item_key"), F.when(F.col("label") % 2 == 1, "odd").otherwise("even").alias("checklist_type_key"))
    got = P.match_checklist_items(asked, items, v.select(F.col("vec_id").alias("item_key"), F.col("embedding").alias("rule_vec")), "odd")
    return got.select(F.col("item_key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(r"""
SELECT source, count(*) AS pages, count(*) FILTER (WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '') AS pages_with_text, round(coalesce(avg(len(text)) FILTER (WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> ''), 0.0), 6) AS average_chars,
 CAST(sum(len(regexp_extract_all(coalesce(text, ''), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b'))) AS BIGINT) AS replacements FROM documents GROUP BY source""")
def pii_preview_counts(spark, sf_dir):
    """Pages, those with text, their average length, and replacements."""
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page_number"), "text")
    _, _, stats = P.pii_preview(pages)
    return stats.select(F.col("doc_id").alias("source"), "pages", "pages_with_text", F.round("average_chars", 6).alias("average_chars"), "replacements")


@query("""
SELECT p_type AS sheet, count(*) AS n FROM part WHERE lower(p_brand) IN ('brand#12', 'brand#23', 'brand#34') GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10""")
def sheet_counts(spark, sf_dir):
    """The ten most frequent types among three brands, named in any case."""
    items = table(spark, sf_dir, "part").select(F.col("p_brand").alias("sheet_name"), F.col("p_type").alias("sheet"))
    return P.most_common(P.of_sheets(items, [" BRAND#12", "brand#23 ", "Brand#34", " "]), "sheet", 10)
