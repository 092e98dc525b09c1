"""The whole run: pages and rules to a report, as one plan over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T, verdict as V
from ..operators import evidence as E, report as R
from ..operators.chunking import build_chunks, redact_pages
from ..operators.clauses import extract_items
from ..operators.hints import with_hints
from ..operators.previews import item_text
from ..operators.retrieval import match
from ..operators.store import Snapshots, last_wins, missing, of_keys
from ..params import Params
from ..providers import Embedder, Judge, hashing_embedder, overlap_judge
from ..schemas import STEPS
from ..sources.workbook import find_workbooks, workbook_rows


def embedded_chunks(pages: DataFrame, params: Params, embedder: Embedder) -> DataFrame:
    """Redacted pages in chunks with ids that follow from their place, and vectors."""
    chunks = build_chunks(redact_pages(pages).drop("pii_audit"), params)
    chunks = chunks.withColumns({"chunk_pos": F.col("chunk_index"), "chunk_id": F.sha2(F.concat_ws("||", "doc_id", F.col("chunk_index").cast("string")), 256)})
    return chunks.withColumn("vec", embedder(T.chunk_embedding_text()))


def judge_checks(evidence: DataFrame, rules: DataFrame, params: Params, judge: Judge) -> DataFrame:
    """(item_key, doc_id, chunks, lexical_miss) -> a row for each check with its verdict and evidence. No check without evidence is judged."""
    merged = E.merge_evidence(F.col("chunks"), params.evidence_chars)
    asked = rules.select("item_key", F.left(T.nn(F.col("requirement_text")), F.lit(params.requirement_chars)).alias("requirement_text"), "rule_checks")
    rows = evidence.join(asked, "item_key", "left").withColumn("merged", merged)
    rows = rows.select("item_key", "doc_id", "chunks", "lexical_miss", "merged", "requirement_text", F.posexplode(V.checks_or_default(F.col("rule_checks"), F.col("requirement_text"))).alias("n", "check"))
    label, some = F.col("check.label"), F.col("merged.text") != ""
    rows = rows.withColumn("chosen", F.when(some, E.chunks_for_check(label, F.col("chunks"))))
    text = E.check_evidence(F.col("chosen"), E.evidence_budget(F.col("merged.text")))
    rows = rows.withColumn("excerpt", F.when(some, F.when(text != "", text).otherwise(F.col("merged.text"))))
    rows = rows.withColumn("raw", F.when(some, judge(label, F.col("excerpt"), V.check_prompt(F.col("requirement_text"), label))))
    rows = rows.withColumn("verdict", F.when(some, V.parse_judgement(F.col("raw"), params.reason_chars)))
    v = F.col("verdict")
    reason = (
        F.when(~some, V.NO_EVIDENCE).when(F.col("raw").isNull(), V.NOT_JUDGED).when(v["status"].isNull(), V.BAD_JUDGEMENT)
        .when((v["status"] == "missing") & v["reason"].isNull(), V.UNSUPPORTED).otherwise(v["reason"])
    )
    return rows.select(
        "item_key", "doc_id", "n", "lexical_miss", "merged", "chunks", F.col("check.check_id").alias("check_id"), label.alias("label"), F.col("check.kind").alias("kind"),
        F.coalesce(v["status"], F.lit("missing")).alias("status"), reason.alias("reason"), v["confidence"].alias("confidence"),
        F.coalesce(F.transform("chosen", lambda c: c["chunk_id"]), F.array().cast("array<string>")).alias("selected_chunk_ids"), F.when(F.col("excerpt") != "", T.truncate(F.col("excerpt"), 180)).alias("evidence_snippet"),
    )


def results_of(checks: DataFrame, params: Params) -> DataFrame:
    """One result for each rule and document; the few checks of a rule are gathered once."""
    entry = F.struct("n", F.struct(F.col("check_id").alias("checkId"), "label", "kind", "status", "reason", "confidence", F.col("selected_chunk_ids").alias("selectedChunkIds"), F.col("evidence_snippet").alias("evidenceSnippet")).alias("c"))
    rows = checks.groupBy("item_key", "doc_id").agg(F.array_sort(F.collect_list(entry)).alias("e"), F.first("merged").alias("merged"), F.first("chunks").alias("chunks"), F.bool_or("lexical_miss").alias("lexical_miss"))
    rows = rows.withColumn("check_results", F.transform("e", lambda x: x["c"]))
    each = lambda f: F.transform("check_results", lambda c: c[f])
    n = lambda status: F.size(F.filter("check_results", lambda c: c["status"] == status))
    reasons = F.transform("check_results", lambda c: T.strip(c["reason"]))
    rows = rows.withColumns({"v": V.rule_status(each("status"), each("kind")), "first_reason": F.element_at(reasons, 1), "one": F.size(F.array_distinct(reasons)) == 1})
    counted = V.counts_text(F.size("check_results"), n("fully_met"), n("partially_met"), n("missing"), F.col("first_reason"), params.row_explanation_chars)
    explanation = V.row_explanation(F.col("merged.text") != "", F.col("lexical_miss"), F.when(F.col("one"), F.col("first_reason")), counted)
    return rows.select(
        "item_key", "doc_id", F.col("v.status").alias("status"), F.col("v.coverage").alias("coverage"), explanation.alias("explanation"), F.col("merged.similarity").alias("similarity"),
        F.when((F.col("merged.text") != "") & (F.col("v.status") != "missing"), T.truncate(F.col("merged.text"), 160)).alias("evidence_snippet"),
        F.when(F.col("v.status") != "missing", R.valid_evidence(E.evidence_blocks(F.col("chunks")))).alias("evidence"), "check_results",
    )


class Engine:
    """Checklists and analyses below a folder."""

    def __init__(self, spark: SparkSession, root: str, params: Params = Params(), embedder: Embedder | None = None, judge: Judge | None = None):
        self.spark, self.params, self.store = spark, params, Snapshots(spark, root)
        self.embedder, self.judge = embedder or hashing_embedder(), judge or overlap_judge()

    def sync_checklists(self, workbooks: DataFrame | str, replace_type: bool = False, only_missing: bool = True) -> DataFrame:
        """Workbooks to items, upserted by key; vectors only for items that have none, or for all."""
        files = find_workbooks(self.spark, workbooks) if isinstance(workbooks, str) else workbooks
        items = last_wins(with_hints(extract_items(workbook_rows(files))), ["item_key"], "seq").drop("first_seen")
        return self.put_items(items, replace_type, only_missing)

    def put_items(self, items: DataFrame, replace_type: bool = False, only_missing: bool = True) -> DataFrame:
        """U1-U3. With replace_type the types' other items go, and with them their vectors."""
        if replace_type and (old := self.store.read("checklist_items")) is not None:
            gone = of_keys(old, items, "checklist_type_key").join(items.select("item_key"), "item_key", "left_anti")
            for name in ("checklist_item_embeddings", "analysis_results", "checklist_items"):
                self.store.delete(name, gone, "item_key")
        types = items.groupBy(F.col("checklist_type_key").alias("type_key")).agg(F.first("framework").alias("framework")).withColumn("display_name", T.display_name(F.col("type_key")))
        self.store.upsert("checklist_types", types, ["type_key"])
        out = self.store.upsert("checklist_items", items, ["item_key"])
        done = self.store.read("checklist_item_embeddings") if only_missing else None
        new = out if done is None else missing(out, done)
        self.store.upsert("checklist_item_embeddings", new.select("item_key", self.embedder(F.col("retrieval_text")).alias("rule_vec")), ["item_key"])
        return out

    def _mark(self, documents: DataFrame, done: int, state: str, error: str = "") -> None:
        """U4: documents with the first ``done`` steps completed, the next in ``state``, and the progress that this comes to."""
        steps = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("completed" if k < done else state if k == done else "waiting").alias("state")) for k, n in enumerate(STEPS)))
        status = "completed" if done == len(STEPS) else "failed" if state == "failed" else "processing"
        rows = documents.select("doc_id").distinct().select("doc_id", F.lit(status).alias("status"), F.lit(100 if status != "processing" else 10 + 90 * done // len(STEPS)).alias("progress"), steps.alias("steps"), F.lit(error).alias("error_message"))
        self.store.upsert("analyses", rows, ["doc_id"])

    def analyze(self, pages: DataFrame, framework: str) -> DataFrame:
        """Results for each rule of the framework and each document, kept as table analysis_results; a document that is analysed again loses its old chunks and results of the framework."""
        key = self.spark.range(1).select(T.form_key(F.lit(framework)).alias("k")).first()["k"]
        documents = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"))
        self.store.upsert("analysis_documents", documents, ["doc_id"])
        self._mark(documents, 0, "in_progress")
        try:
            items = self.store.read("checklist_items").where(F.col("checklist_type_key") == key)
            rules = items.join(self.store.read("checklist_item_embeddings"), "item_key").withColumn("keywords", F.col("search_keywords"))
            chunks = self.store.replace("analysis_chunks", embedded_chunks(pages, self.params, self.embedder), "doc_id", documents)
            self._mark(documents, 2, "in_progress")
            mine = chunks.join(documents.select("doc_id"), "doc_id", "left_semi")
            checks = judge_checks(E.gather(match(rules, mine, self.params)), items, self.params, self.judge)
            results = results_of(checks, self.params).withColumn("checklist_type_key", F.lit(key))
            old = self.store.read("analysis_results")
            others = None if old is None else old.where(F.col("checklist_type_key") != key).join(documents.select("doc_id"), "doc_id", "left_semi")
            out = self.store.replace("analysis_results", results if others is None else results.unionByName(others), "doc_id", documents)
        except Exception as error:
            self._mark(documents, 0, "failed", str(error)[:500])
            raise
        self._mark(documents, len(STEPS), "completed")
        return out

    def status(self, doc_id: str) -> list[dict[str, str]]:
        """The steps and how far each is for one document."""
        table = self.store.read("analyses")
        row = table.where(F.col("doc_id") == doc_id).first() if table is not None else None
        return [{"name": s["name"], "state": s["state"]} for s in row["steps"]] if row else [{"name": n, "state": "waiting"} for n in STEPS]

    def analyses(self) -> DataFrame:
        """Each document's status, progress, steps and error."""
        return self.store.read("analyses")

    def report(self, doc_id: str, framework: str) -> tuple[DataFrame, DataFrame]:
        """(summary, items)."""
        key = self.spark.range(1).select(T.form_key(F.lit(framework)).alias("k")).first()["k"]
        items = self.store.read("checklist_items").where(F.col("checklist_type_key") == key)
        results = self.store.read("analysis_results").where(F.col("doc_id") == doc_id).drop("checklist_type_key")
        rows = R.report_items(items, results, self.params)
        return R.summarize(rows), rows


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as JSON or CSV, with nested columns as JSON text in CSV; or items as blocks of text."""
    if kind == "csv":
        df = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    if kind == "text":
        df = df.select(item_text().alias("value"))
    df.write.mode("overwrite").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)
