"""Rows of a requirement sheet to atomic rules.

Everything that depends on one row alone is computed as columns; what depends on
the rows before is a fold over the few hundred rows of a sheet, group by group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..schemas import ITEMS


def classify_rows(rows: DataFrame) -> DataFrame:
    """Raw rows with cleaned cells, their text, their role and their clause token."""
    cleaned = rows.select(
        "workbook", "sheet_idx", "sheet", "row_idx", T.pad_id(T.repair_id(F.col("first"))).alias("first"), T.nn(F.col("second")).alias("second"), T.nn(F.col("third")).alias("third"), F.col("first").alias("_raw")
    )
    first, second, text, token = (F.col(c) for c in ("first", "second", "text", "_token"))
    cleaned = cleaned.withColumn("text", T.row_text(first, second)).withColumn("_token", T.clause_token(text))
    role = (
        F.when(T.is_metadata_row(first), "skip").when(T.is_section_header(first, second), "section").when(T.is_requirement_id(first), "base")
        .when(T.is_note_row(text), "note").when(T.is_alpha(token), "alpha").when(T.is_roman(token), "roman").otherwise("text")
    )
    stem = F.regexp_replace(F.element_at(F.split("workbook", "/"), -1), r"\.[^.]*$", "")
    return cleaned.withColumns({
        "role": role, "token": F.lower(token), "body": T.clause_body(text), "splits": T.splits_alpha_list(F.col("_raw"), second),
        "section": F.regexp_replace(F.when(second != "", second).otherwise(first), "^[ :-]+|[ :-]+$", ""), "framework": T.framework_of(stem),
    }).drop("_raw", "_token")


class _Sheet:
    """The state of the fold. ``base`` and ``alpha`` are open clauses or None."""

    def __init__(self, join):
        self.join, self.path, self.out, self.base, self.alpha = join, "", [], None, None

    def emit(self, path: str, text: str, leaf: str, ref: str) -> None:
        b = self.base
        self.out.append({"section_path": self.path, "requirement_id": b["id"] + path, "requirement_text": text, "reference_text": ref, "requirement_base_id": b["id"],
                         "clause_path": path, "requirement_text_leaf": leaf, "notes_text": " ".join(b["notes"]).strip()})
        b["split"] = True

    def composed(self, leaf: str = "") -> str:
        text = self.base["text"].strip()
        if self.alpha and self.alpha["text"]:
            text = self.join(text, self.alpha["text"])
        return self.join(text, leaf).strip()

    def close_alpha(self) -> None:
        """A clause without parts of its own is a rule; it stays open if nothing came of it."""
        a = self.alpha
        if a and not a["roman"] and not a["parts"] and self.composed():
            self.emit(f"({a['token']})", self.composed(), a["text"].strip(), self.base["ref"])
            self.alpha = None

    def close_base(self) -> None:
        b = self.base
        if b:
            self.close_alpha()
            if not b["split"] and b["text"]:
                self.emit("", b["text"], b["text"], b["ref"])
        self.base = self.alpha = None

    def refer(self, holder: dict, key: str, third: str) -> None:
        if third and third not in holder[key]:
            holder[key] = self.join(holder[key], third)

    def step(self, r) -> None:
        if r.role == "skip":
            return
        if r.role == "section":
            self.close_base()
            if r.section and not self.path.endswith(r.section):
                self.path = f"{self.path} > {r.section}" if self.path else r.section
            return
        if r.role == "base":
            self.close_base()
            self.base = {"id": r.first, "text": r.second.strip(), "ref": r.third.strip(), "notes": [], "split": False}
            return
        if self.base is None:
            return
        b, a = self.base, self.alpha
        if r.role == "note":
            b["notes"].append(r.text)
        elif r.role == "alpha":
            if a and a["token"] != r.token:
                self.close_alpha()
            self.alpha = {"token": r.token, "text": r.body, "roman": False, "parts": 0}
        elif r.role == "roman" and a:
            self.emit(f"({a['token']})({r.token})", self.composed(r.body), r.body, self.join(b["ref"], r.third))
            a["roman"], a["parts"] = True, a["parts"] + 1
        elif r.role == "roman":
            self.extend_base(r)
        elif a and not a["roman"] and r.splits:
            a["parts"] += 1
            if self.composed(r.text):
                self.emit(f"({a['token']})({a['parts']})", self.composed(r.text), r.text.strip(), b["ref"])
            self.refer(b, "ref", r.third)
        elif a and not a["roman"] and r.text:
            a["text"] = self.join(a["text"], r.text)
            self.refer(b, "ref", r.third)
        elif b["split"] and self.out and self.out[-1]["requirement_base_id"] == b["id"]:
            last = self.out[-1]
            if r.text:
                for key in ("requirement_text_leaf", "requirement_text"):
                    last[key] = self.join(last[key], r.text)
            self.refer(last, "reference_text", r.third)
        else:
            self.extend_base(r)

    def extend_base(self, r) -> None:
        if r.text:
            self.base["text"] = self.join(self.base["text"], r.text)
        self.refer(self.base, "ref", r.third)


_PLAIN = str.maketrans({"\r": " ", "\n": " ", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "�": None})


def _join(base: str, extra: str) -> str:
    """C2 for the fold."""
    b, e = (" ".join(x.translate(_PLAIN).split()) for x in (base, extra))
    if not b or not e or e in b:
        return b or e
    return f"{b}{' ' if b[-1] in '.:;)]' else '; '}{e}"


def extract_items(rows: DataFrame) -> DataFrame:
    """Raw rows -> items, in the columns of schemas.ITEMS and sheet_idx, seq for their order. A sheet is one group."""
    def fold(sheet: pd.DataFrame) -> pd.DataFrame:
        s = _Sheet(_join)
        sheet = sheet.sort_values("row_idx", kind="stable")
        for r in sheet.itertuples(index=False):
            s.step(r)
        s.close_base()
        head = sheet.iloc[0]
        items = [x for x in s.out if x["requirement_text"]]
        out = pd.DataFrame(items, columns=["section_path", "requirement_id", "requirement_text", "reference_text", "requirement_base_id", "clause_path", "requirement_text_leaf", "notes_text"])
        out["source_workbook"], out["framework"], out["sheet_name"], out["item_kind"], out["sheet_idx"], out["seq"] = head.workbook, head.framework, head.sheet, "rule", head.sheet_idx, range(len(out))
        return out[[c.split(" ")[0] for c in ITEMS.split(", ")] + ["sheet_idx", "seq"]]

    return classify_rows(rows).groupBy("workbook", "sheet_idx", "sheet").applyInPandas(fold, ITEMS + ", sheet_idx int, seq int")
