"""Hybrid retrieval: lexical gate, section hints and vectors give candidates; a weighted score ranks them."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scoring as S, text as T
from ..params import Params


#: pairs of rules and vectors that are compared by one product of matrices, and pairs that are scored again at once
TILE, AT_ONCE = 1 << 20, 1 << 16
#: numbers that a task keeps of the scopes it has met
KEPT = 1 << 23


class Vectors:
    """A column of lists of numbers. length: 0 for a list that is null or empty or has a null in it; such a list has no similarity."""

    def __init__(self, column: pa.Array):
        self.length = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin, flat = np.cumsum(self.length) - self.length, column.flatten()
        self.flat = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        if flat.null_count:
            self.length[np.repeat(np.arange(len(self.length)), self.length)[flat.is_null().to_numpy(zero_copy_only=False)]] = 0

    def columns(self, at: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lists of length d: numbers by place, squared norms, and rows of length one in single precision.

        Numbers are divided by a power of two, which changes no similarity and keeps squares in range.
        """
        m = self.flat[self.begin[at][:, None] + np.arange(d)]
        m = np.ldexp(m, -np.frexp(np.abs(m).max(1, keepdims=True))[1]).T.copy()
        squares = np.zeros(len(at))
        for x in m:
            squares += x * x
        return m, squares, (m / np.maximum(np.sqrt(squares), 1e-12)).T.astype(np.float32)


def _cosines(a: np.ndarray, aa: np.ndarray, b: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """C22 of pairs, in double and summed up in the order of the numbers as SQL's list_cosine_similarity does; 0 for a zero vector."""
    dots = np.zeros(len(aa))
    for x, y in zip(a, b):
        dots += x * y
    lengths = np.sqrt(aa * bb)
    return np.clip(np.divide(dots, lengths, out=np.zeros(len(dots)), where=lengths != 0), -1.0, 1.0)


def _top_of(a: tuple, b: tuple, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rules a and vectors b by position (both as ``columns`` gives them) -> rule, vector, similarity of all pairs that may be among a rule's first.

    best: the highest similarities met of each rule, as many as are asked for; brought up to date. Products in single precision leave
    out what is below the last of them by more than their error, and what is left is scored in double.
    """
    (a, aa, a1), (b, bb, b1) = a, b
    k, n, d = best.shape[1], len(bb), len(a)
    margin = 4 * (d + 8) * np.finfo(np.float32).eps
    odd = np.isnan(a1).any() or np.isnan(b1).any()
    for low in range(0, len(aa), step := max(1, TILE // n)):
        own = best[low : low + step]
        sims = a1[low : low + step] @ b1.T
        if odd:  # NaN is above all numbers, as in SQL
            sims[np.isnan(sims)] = np.inf
        bound = own[:, 0]
        if n > k and np.isneginf(bound).any():
            bound = np.maximum(bound, np.partition(sims, n - k, axis=1)[:, n - k])
        rule, at = np.nonzero(sims >= (bound - margin).astype(np.float32)[:, None])
        score = np.empty(len(rule))
        for i in range(0, len(rule), AT_ONCE):
            r, v = low + rule[i : i + AT_ONCE], at[i : i + AT_ONCE]
            score[i : i + AT_ONCE] = _cosines((x[r] for x in a), aa[r], (x[v] for x in b), bb[v])
        by = np.where(np.isnan(score), np.inf, score)
        order = np.lexsort((-by, rule))  # stable: of equal ones the first position
        rank = np.arange(len(rule)) - np.searchsorted(rule, rule)  # rule ascends before and after
        order, rank = order[rank < k], rank[rank < k]
        rule, at, score, by = rule[order], at[order], score[order], by[order]
        new = np.full(own.shape, -np.inf)
        new[rule, rank] = by
        own[:] = np.sort(np.concatenate([own, new], 1), 1)[:, -k:]
        kept = by >= own[rule, 0]
        yield low + rule[kept], at[kept], score[kept]


def _nearest(rules: pa.Table, k: int, scope: str, typed: bool):
    """Vectors -> for each rule and scope, all that may be among the first k, given what the task has met before."""
    keys, asked = rules.column("item_key").combine_chunks(), Vectors(rules.column("rule_vec").combine_chunks())
    types = rules.column("type_key").to_pylist() if typed else [0] * len(keys)
    own: dict = defaultdict(lambda: defaultdict(list))  # by type and length
    for i, (t, d) in enumerate(zip(types, asked.length.tolist())):
        if t is not None:
            own[t][d].append(i)
    groups = {t: [(d, np.array(at), asked.columns(np.array(at), d) if d else None) for d, at in by.items()] for t, by in own.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        for batch in batches:
            batch = batch.take(pa.compute.sort_indices(batch, [(c, "ascending") for c in (scope, *["type_key"] * typed, "chunk_pos")]))
            had = Vectors(batch.column("vec"))
            scopes = list(zip(batch.column(scope).to_pylist(), batch.column("type_key").to_pylist() if typed else [0] * batch.num_rows))
            found = []
            for key, places in groupby(range(len(scopes)), scopes.__getitem__):
                places = np.array(list(places))
                if len(best) * len(keys) * k > KEPT:  # what is forgotten only makes more rows pass
                    best.clear()
                for d, at, columns in groups.get(key[1], ()):
                    top = best.setdefault((key, d), np.full((len(at), k), -np.inf))
                    like = places[had.length[places] == d] if d else places[:0]
                    if len(like):
                        found += [(at[r], like[v], s, np.zeros(len(s), bool)) for r, v, s in _top_of(columns, had.columns(like, d), top)]
                    # pairs without a similarity come last
                    rest = (places[had.length[places] != d] if d else places)[:k]
                    short = at[np.isneginf(top[:, 0])] if len(rest) else rest
                    if len(short):
                        found.append((np.repeat(short, len(rest)), np.tile(rest, len(short)), np.zeros(len(short) * len(rest)), np.ones(len(short) * len(rest), bool)))
            if found:
                rule, at, similarity, none = map(np.concatenate, zip(*found))
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(scope).take(at), keys.take(pa.array(rule)), batch.column("chunk_pos").take(at), pa.array(similarity, mask=none)], [scope, "item_key", "chunk_pos", "similarity"])

    return work


def cosine_topk(rules: DataFrame, vectors: DataFrame, k: int, params: Params = Params(), scope: str = "doc_id") -> DataFrame:
    """Rules (item_key, rule_vec) against vectors (scope, chunk_pos, vec), of one type_key if both have it: the k nearest for each rule and scope.

    Vectors may have any length; those of another number of dimensions, null or with nulls have no similarity and come last. Rules go to the executors in blocks of
    at most ``broadcast_rules``, vectors are dealt out evenly once, and of the pairs only those that may be among the first leave a task.
    """
    spark = rules.sparkSession
    typed = "type_key" in rules.columns and "type_key" in vectors.columns
    typing = ["type_key"] * typed
    rules = rules.select("item_key", *typing, F.col("rule_vec").cast("array<double>").alias("rule_vec"))
    dealt = vectors.select(scope, *typing, "chunk_pos", "vec").repartition(spark.sparkContext.defaultParallelism).withColumn("vec", F.col("vec").cast("array<double>"))
    kinds = dict(vectors.dtypes)
    out = f"`{scope}` {kinds[scope]}, item_key {dict(rules.dtypes)['item_key']}, chunk_pos {kinds['chunk_pos']}, similarity double"
    pairs = spark.createDataFrame([], out)
    for some in rule_blocks(rules, params):
        pairs = pairs.unionByName(dealt.mapInArrow(_nearest(some.toArrow(), k, scope, typed), out))
    return _first(pairs, [scope, "item_key"], [F.desc("similarity"), F.asc_nulls_last("chunk_pos")], k)


def rule_blocks(rules: DataFrame, params: Params) -> Iterator[DataFrame]:
    """Rules in blocks of about ``broadcast_rules``, by their keys."""
    blocks = -(-rules.count() // params.broadcast_rules)
    for k in range(blocks):
        yield rules if blocks == 1 else rules.where(F.pmod(F.xxhash64("item_key"), F.lit(blocks)) == k)


def _first(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; the planner limits groups before the shuffle too."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def inverted_index(chunks: DataFrame, text: Column) -> DataFrame:
    """(doc_id, token, chunk_pos), each once."""
    return chunks.select("doc_id", "chunk_pos", F.explode(T.token_set(text)).alias("token"))


def lexical_hits(rules: DataFrame, index: DataFrame) -> DataFrame:
    """(item_key, doc_id, chunk_pos) of chunks that hold any keyword as one token; keywords are few for each rule."""
    words = rules.select("item_key", F.explode(F.array_distinct("keywords")).alias("token"))
    return index.join(words, "token").select("item_key", "doc_id", "chunk_pos").distinct()


class RuleBlock:
    """Up to ``broadcast_rules`` rules as arrays: unit vectors, and for each token the rules (or hints) that it stands in."""

    def __init__(self, rows: list):
        self.keys, self.types = [r["item_key"] for r in rows], np.array([r["type_key"] or "" for r in rows], object)
        self.vectors = unit_rows(np.array([r["rule_vec"] for r in rows], np.float64).reshape(len(rows), -1))
        self.words, self.hints, self.n_hints = defaultdict(list), defaultdict(list), np.zeros(len(rows), np.int64)
        self.hint_sizes: list[int] = []
        self.hint_rules: list[int] = []
        for i, r in enumerate(rows):
            for w in set(r["keywords"]):
                self.words[w].append(i)
            self.n_hints[i] = len(r["hint_sets"])
            for tokens in r["hint_sets"]:
                for w in tokens:
                    self.hints[w].append(len(self.hint_sizes))
                self.hint_sizes.append(len(tokens))
                self.hint_rules.append(i)

    def hits(self, tokens: list[str]) -> list[int]:
        return [i for w in tokens if w in self.words for i in self.words[w]]

    def hint_share(self, tokens: list[str]) -> np.ndarray:
        """For each rule the share of its hints whose tokens are all among these."""
        met: dict[int, int] = defaultdict(int)
        for w in tokens:
            for h in self.hints.get(w, ()):
                met[h] += 1
        out = np.zeros(len(self.keys))
        for h, n in met.items():
            if n == self.hint_sizes[h]:
                out[self.hint_rules[h]] += 1
        return out / np.maximum(self.n_hints, 1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


def _candidates(block: RuleBlock, most: int, gate: bool, schema: pa.Schema):
    """Chunks -> for each rule and document of a batch, the first ``most`` of every kind (g: nearest, m: hinted, s: gated): the rest can't be among the first of all."""
    def top(score: np.ndarray, kind: str, sims: np.ndarray, wanted: np.ndarray | None) -> Iterator[tuple]:
        score = score if wanted is None else np.where(wanted, score, -np.inf)
        order = np.argsort(-score, axis=0, kind="stable")[:most]
        by = np.take_along_axis(score, order, 0)
        place, rule = np.nonzero(by > -np.inf)
        at = order[place, rule]
        yield at, rule, sims[at, rule], kind, by[place, rule]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not block.keys:
                continue
            batch = batch.take(pa.compute.sort_indices(batch, [("doc_id", "ascending"), ("type_key", "ascending"), ("chunk_pos", "ascending")]))
            vectors = unit_rows(np.array(batch.column("vec").to_pylist(), np.float64))
            tokens, hinted = batch.column("search_tokens").to_pylist(), batch.column("hint_tokens").to_pylist()
            scopes = list(zip(batch.column("doc_id").to_pylist(), batch.column("type_key").to_pylist()))
            begin = 0
            while begin < len(scopes):
                end = begin + 1
                while end < len(scopes) and scopes[end] == scopes[begin]:
                    end += 1
                own = np.flatnonzero(block.types == (scopes[begin][1] or ""))
                if len(own):
                    sims = vectors[begin:end] @ block.vectors[own].T
                    found = [*top(sims, "g", sims, None)]
                    if block.hint_sizes:
                        hint = np.stack([block.hint_share(t)[own] for t in hinted[begin:end]])
                        found += top(hint, "m", sims, hint > 0)
                    if gate:
                        hit = np.zeros((end - begin, len(block.keys)), bool)
                        for k, t in enumerate(tokens[begin:end]):
                            hit[k, block.hits(t)] = True
                        found += top(sims, "s", sims, hit[:, own])
                    for at, rule, sim, kind, by in found:
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("doc_id").take(pa.array(begin + at)), pa.array([block.keys[i] for i in own[rule]], schema.field("item_key").type), batch.column("chunk_pos").take(pa.array(begin + at)), pa.array(sim), pa.array([kind] * len(at), pa.string()), pa.array(by)],
                            ["doc_id", "item_key", "chunk_pos", "similarity", "kind", "by"],
                        )
                begin = end

    return work


def candidates(rules: DataFrame, chunks: DataFrame, most: int, gate: bool, params: Params) -> DataFrame:
    """(doc_id, item_key, chunk_pos, similarity, kind, by): of each kind the first ``most`` for each rule and document.

    rules: item_key, type_key, rule_vec, keywords, hint_sets; chunks: doc_id, type_key, chunk_pos, vec, search_tokens, hint_tokens. Rules
    go to the executors in blocks of at most ``broadcast_rules``, each with a pass over the chunks. Similarities are products of
    matrices, and only what may be among the first leaves a task. Empty rules or chunks give no rows.
    """
    spark = rules.sparkSession
    out = f"doc_id {dict(chunks.dtypes)['doc_id']}, item_key {dict(rules.dtypes)['item_key']}, chunk_pos {dict(chunks.dtypes)['chunk_pos']}, similarity double, kind string, by double"
    made = spark.createDataFrame([], out)
    for some in rule_blocks(rules, params):
        table = some.toArrow()
        made = made.unionByName(chunks.mapInArrow(_candidates(RuleBlock(table.to_pylist()), most, gate, table.schema), out))
    return _first(made, ["doc_id", "item_key", "kind"], [F.desc("by"), F.col("chunk_pos")], most)


def match(rules: DataFrame, chunks: DataFrame, params: Params = Params()) -> DataFrame:
    """W12. rules: item_key, rule_vec, keywords, section_hints (type_key); chunks: doc_id, chunk_pos, chunk_id, vec and the text columns (type_key).

    -> item_key, doc_id, rank, chunk_id, chunk_pos, page_number, similarity, final_score, lexical_miss and the text
    columns of the chunk, at most top_k for each rule and document. Each of the three kinds of candidates
    is cut to candidate_k before it is shuffled; texts come back to candidates only.
    """
    c = params.candidate_k
    keys = ["doc_id", "item_key"]
    heading, search = F.col("heading_guess"), T.chunk_search_text()
    rest = F.concat_ws(" ", *(T.nn(F.col(x)) for x in ("heading_guess", "section_title", "statement_area", "chunk_type", "note_number", "text_redacted")))
    typed = "type_key" in rules.columns and "type_key" in chunks.columns
    type_key = (F.col("type_key").cast("string") if typed else F.lit("")).alias("type_key")
    rules = rules.select("item_key", type_key, F.col("rule_vec").cast("array<double>").alias("rule_vec"), S.normalize_keywords(F.col("keywords")).alias("keywords"), S.normalize_keywords(F.col("section_hints")).alias("hints"))
    rules = rules.withColumns({"keyword_sets": S.keyword_sets(F.col("keywords")), "hint_sets": S.keyword_sets(F.col("hints"))})
    gate = params.keyword_prefilter
    narrow = chunks.select("doc_id", type_key, "chunk_pos", F.col("vec").cast("array<double>").alias("vec"), T.token_set(search).alias("search_tokens"), T.token_set(rest).alias("hint_tokens"))
    first = candidates(rules.select("item_key", "type_key", "rule_vec", "keywords", "hint_sets"), narrow, c, gate, params)
    found = first.groupBy(*keys, "chunk_pos").agg(F.first("similarity").alias("similarity"), *(F.bool_or(F.col("kind") == x).alias(x) for x in "gms"))
    w = Window.partitionBy(*keys)
    n_short = F.count_if(F.col("s")).over(w)
    asked = F.lit(gate) & (F.size("keywords") > 0)
    rules_side = rules.select("item_key", "keywords", "keyword_sets", "hint_sets")
    found = found.withColumn("n_short", n_short).join(F.broadcast(rules_side) if rules_side.limit(params.broadcast_rules + 1).count() <= params.broadcast_rules else rules_side, "item_key")
    # The nearest join in unless the gate alone fills the shortlist
    full = asked & (F.col("n_short") >= c)
    found = found.withColumn("lexical_miss", asked & (F.col("n_short") == 0)).where(F.col("m") | F.col("s") | (F.col("g") & ~full))
    texts = chunks.select("doc_id", "chunk_pos", "chunk_id", "page_number", "text_redacted", "heading_guess", "section_title", "statement_area", "chunk_type", "note_number")
    # a chunk's tokens are found once, before it meets the rules that it is a candidate for
    split = texts.withColumns({"_have": T.token_set(search), "_heading": T.token_set(heading), "_section": T.token_set(F.concat_ws(" ", T.nn(heading), search))})
    scored = found.join(split, ["doc_id", "chunk_pos"])
    kept = F.col("keyword_sets")
    score = S.rank_score(F.col("similarity"), S.overlap(kept, F.col("_have")), S.overlap(kept, F.col("_heading")), S.overlap(F.col("hint_sets"), F.col("_section"))).alias("final_score")
    scored = scored.select(*keys, "lexical_miss", "similarity", score, *texts.columns[1:])
    ranked = _first(scored, keys, [F.desc("final_score"), F.desc("similarity"), F.col("chunk_pos")], params.top_k)
    return ranked.select("item_key", "doc_id", "rank", "final_score", "similarity", "lexical_miss", *texts.columns[1:])
