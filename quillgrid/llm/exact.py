"""Exact deduplication by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .store import Scratch, filter_by, own_uid_aside, rows_with_uid

#: Bytes of a block.
BLOCK_BYTES = 4096


def _names(keys: DataFrame, by: list[str]) -> DataFrame:
    """Distinct keys with an integer name each: the rank in the sort of its partition, after the partition's number.

    Equal keys are merged before and after one shuffle; the sort makes the
    numbering the same when a lost task runs again.
    """
    return keys.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_blocks(rows: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, route: Column | None = None) -> DataFrame:
    """(_uid, _text) -> (_uid, pos, n_blocks, name): each fixed-size block under its integer name.

    Block texts are sorted and compared in full, once; they are brought
    back to their rows through a 64-bit route. Where two different blocks share
    a route (which is checked), that route's rows are joined on the text itself.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / block_bytes)).cast("int")
    route = F.xxhash64("block") if route is None else route
    # cut as bytes, whose places are known without a walk from the start of the text; each byte is copied once
    cut = F.expr(f"transform(sequence(0, n_blocks - 1), p -> substring(cast(_text as binary), p * {block_bytes} + 1, {block_bytes}))")
    blocks = rows.withColumn("n_blocks", n).select("_uid", "n_blocks", F.posexplode(cut).alias("pos", "block")).withColumn("route", route)
    names = scratch.table(_names(blocks, ["route", "block"]).select("route", "name"), "blocknames")
    shared = names.groupBy("route").count().where("count > 1").select("route")
    plain = blocks.select("_uid", "n_blocks", "pos", "route").join(names.select("route", "name"), "route")
    if not shared.take(1):
        return plain.select("_uid", "pos", "n_blocks", "name")
    shared = scratch.table(shared, "routes")
    texts = blocks.join(shared, "route", "left_semi")
    extra = scratch.table(_names(texts, ["route", "block"]).select("route", "block", F.expr("-1 - name").alias("name")), "texts")
    exact = texts.join(extra, ["route", "block"])
    alone = plain.join(shared, "route", "left_anti")
    return alone.select("_uid", "pos", "n_blocks", "name").unionByName(exact.select("_uid", "pos", "n_blocks", "name"))


def identities(rows: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES, route: Column | None = None) -> DataFrame:
    """(_uid, _text) -> (_uid, n_blocks, name): equal (n_blocks, name) if and only if the texts are equal.

    Level by level, adjacent names are paired and the distinct pairs named by
    sorting, until one name is left for each text. A text takes part only in as
    many levels as it needs; the number of levels is the logarithm of the longest
    text's blocks.
    """
    now = scratch.table(name_blocks(rows, scratch, block_bytes, route), "level0")
    done = now.where("n_blocks = 1").select("_uid", "n_blocks", "name")
    most = now.agg(F.max("n_blocks")).first()[0] or 1
    now, width = now.where("n_blocks > 1"), 1
    while width < most:
        width *= 2
        pairs = now.groupBy("_uid", "n_blocks", F.shiftright("pos", 1).alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            #: an odd one out is paired with nothing, which no block is named
            F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("right"),
        )
        pairs = scratch.table(pairs.withColumn("right", F.coalesce("right", F.lit(-(2**62)))), "pairs")
        names = scratch.table(_names(pairs, ["left", "right"]).select("left", "right", "name"), "pairnames")
        level = scratch.table(pairs.join(names, ["left", "right"]).select("_uid", "pos", "n_blocks", "name"), "level")
        scratch.drop(pairs, names)
        ended = F.col("n_blocks") <= width
        done = done.unionByName(level.where(ended).select("_uid", "n_blocks", "name"))
        now = level.where(~ended)
    return done


def exact_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, route: Column | None = None) -> DataFrame:
    """docs (with ``_uid``, see rows_with_uid) -> (_uid, keep_uid, keep_id, group_size), one row for each row.

    Texts are equal when identical; null counts as empty. Of a group the row with
    the largest id stays (null is less than any id); of wholly equal rows just one.
    An empty table gives an empty table. No other column of docs is read. Group
    sizes are summed before the shuffle and go back by a join that can be split.
    """
    rows = docs.select("_uid", F.coalesce(text_col, F.lit("")).alias("_text"))
    named = identities(rows, scratch, block_bytes, route).join(docs.select("_uid", F.col(id_col).alias("_id")), "_uid")
    named = scratch.table(named, "identities")
    groups = scratch.table(named.groupBy("n_blocks", "name").agg(F.max(F.struct("_id", "_uid")).alias("keep"), F.count("*").alias("group_size")), "groups")
    return named.join(groups, ["n_blocks", "name"]).select("_uid", F.col("keep._uid").alias("keep_uid"), F.col("keep._id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256 (of the text in UTF-8)."""
    docs = rows_with_uid(docs, scratch, id_col)
    thin = docs.select("_uid", F.col(id_col), F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256).alias("text_sha256"))
    return thin.join(exact_groups(docs, scratch, id_col, text_col), "_uid").select(
        id_col, "keep_id", "group_size", (F.col("_uid") == F.col("keep_uid")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one of the rows with equal texts; the columns stay.

    Null counts as empty; the row with the largest id stays (null is less than any id), of wholly equal rows just one. An empty table gives an empty table.
    """
    docs, back = own_uid_aside(docs)
    docs = rows_with_uid(docs, scratch, id_col)
    gone = exact_groups(docs, scratch, id_col, text_col).where("_uid <> keep_uid").select("_uid")
    return back(filter_by(docs, scratch.table(gone, "gone"), "left_anti"))
