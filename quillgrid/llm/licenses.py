"""Licence scan: a trained paragraph classifier confirmed by templates, in DataFrame operations only.

The classifier is a softmax regression on the words and word pairs of a paragraph,
trained in numpy on varied notices; the scan itself is SQL. A class "unknown" is trained on
sentences that use the same words otherwise, and calibrated on notices that were kept back.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

# Licence families and short notices by which each is commonly stated.
NOTICES = {
    "MIT": [
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the terms of the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "spdx-license-identifier mit",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 you may not use this file except in compliance with the license",
        "distributed under the apache license 2.0",
        "spdx-license-identifier apache-2.0",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3",
        "spdx-license-identifier gpl-3.0-only",
        "released under the gnu gpl v3",
    ],
    "GPL-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "this program is free software under the terms of the gnu general public license version 2",
        "spdx-license-identifier gpl-2.0-only",
    ],
    "LGPL": [
        "licensed under the gnu lesser general public license",
        "this library is free software under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-3.0-only",
    ],
    "BSD": [
        "released under the bsd license",
        "licensed under the 3-clause bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "spdx-license-identifier bsd-3-clause",
    ],
    "MPL-2.0": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "spdx-license-identifier mpl-2.0",
    ],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "available under the creative commons attribution license"],
    "CC-BY-SA": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license", "text is available under the creative commons attribution sharealike license"],
    "CC-BY-NC": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC0": ["dedicated to the public domain under cc0 1.0 universal", "this work is in the public domain under creative commons zero", "spdx-license-identifier cc0-1.0"],
    "ISC": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx-license-identifier isc"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved no part of this work may be reproduced without permission", "proprietary and confidential unauthorized copying of this file is strictly prohibited"],
}
UNKNOWN = "unknown"
#: Sentences that use such words otherwise.
OTHER = [
    "the driver showed a license to the officer at the gate", "a fishing license is needed in this county", "the court spoke about copyright and the public domain for hours", "she has poetic license to change the terms",
    "please read the terms of the agreement before use", "the general public may use the library free of charge", "the software comes in source and binary forms", "permission to enter the building was granted by the office",
    "the company asked for a new version of the program", "mit is a university and apache is a helicopter", "the license fee rose by two percent", "see the license file for more", "copyright law is a branch of law", "the work was released in may and modified later",
    "this file is part of the project", "all rights come with duties", "the public license office is open on monday", "creative people share common ground", "they distribute books without a fee", "version 2.0 and version 3 differ in many ways",
]
TOKEN = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"
#: Words that say little, the last to be made anchors.
COMMON = "a all and any by for in is it may no not of or that the this to use with you work under part terms file free".split()
#: Blank lines end a paragraph.
BREAK = r"\n\s*\n"
#: Tokens of a window, and tokens from one window to the next; and tokens of the windows that tell short notices apart: these may cut longer ones, so they count only with a whole template.
WINDOW, STEP = 48, 24
NARROW = (16, 8)
COPIES, ROUNDS, RATE, RIDGE = 60, 400, 0.5, 2e-4
#: Least probability, and least share of a template's tokens found, for a family to be reported.
LEAST_SCORE, LEAST_MATCH = 0.5, 0.6


def grams(tokens: list[str]) -> list[str]:
    return list(dict.fromkeys(tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]))


@lru_cache(1)
def anchors() -> list[str]:
    """Tokens of which each window that a template can confirm has one.

    Of a template's k tokens a confirmed window has at least m, so it has one of any k - m + 1; the
    longest ones are taken, common words last. A window without anchors is not confirmed by any template.
    """
    out = set()
    for template in {frozenset(re.findall(TOKEN, x)) for notices in NOTICES.values() for x in notices}:
        k = len(template)
        m = next(m for m in range(k + 1) if m / k >= LEAST_MATCH)
        out.update(sorted(template, key=lambda t: (t in COMMON, -len(t), t))[: k - m + 1])
    return sorted(out)


@lru_cache(1)
def trained(seed: int = 11) -> tuple[list[str], list[str], np.ndarray, float]:
    """classes, vocabulary, weights (bias first, then the share of tokens beyond the vocabulary, then the n-grams), temperature."""
    rng = np.random.default_rng(seed)
    classes = [*NOTICES, UNKNOWN]
    filler = [f"{a}{b}" for a in ("ta", "re", "mo", "sil", "en", "or") for b in ("ven", "nd", "lu", "st", "ing", "er")]
    ordinary = sorted({w for s in OTHER for w in re.findall(TOKEN, s)})
    samples: list[tuple[list[str], int]] = []
    for k, family in enumerate(classes[:-1]):
        for notice in NOTICES[family]:
            base = re.findall(TOKEN, notice)
            for c in range(COPIES):
                words = [w for w in base if c < 6 or rng.random() > 0.08]
                pad = int(rng.integers(0, 9)) if c >= 6 else 0
                extra = list(rng.choice(filler + ordinary, pad)) if pad else []
                cut = int(rng.integers(0, len(extra) + 1))
                samples.append((extra[:cut] + words + extra[cut:], k))
    pool = [w for f in NOTICES.values() for n in f for w in re.findall(TOKEN, n)]
    for s in OTHER * (COPIES // 2):
        words = re.findall(TOKEN, s)
        samples.append((words + list(rng.choice(filler, int(rng.integers(0, 9)))), len(classes) - 1))
    for _ in range(COPIES * 20):  # words of notices, out of order, among others
        words = list(rng.choice(pool, int(rng.integers(1, 7)))) + list(rng.choice(filler + ordinary, int(rng.integers(2, 14))))
        samples.append(([str(w) for w in rng.permutation(words)], len(classes) - 1))
    vocabulary = sorted({g for f in NOTICES.values() for n in f for g in grams(re.findall(TOKEN, n))})
    number = {g: i + 2 for i, g in enumerate(vocabulary)}
    x, y = np.zeros((len(samples), len(vocabulary) + 2), np.float32), np.array([k for _, k in samples])
    for i, (words, _) in enumerate(samples):
        x[i, 0] = 1
        x[i, 1] = np.mean([w not in number for w in words])
        x[i, [number[g] for g in grams(words) if g in number]] = 1
    back = rng.random(len(y)) < 0.2
    w, m, v = np.zeros((x.shape[1], len(classes))), 0.0, 0.0
    target = np.eye(len(classes))[y]

    def soft(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    xt, tt = x[~back], target[~back]
    for t in range(1, ROUNDS + 1):
        g = xt.T @ (soft(xt @ w) - tt) / len(xt) + RIDGE * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w -= RATE * 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    # calibration: the temperature with the least loss on samples kept back
    z, rows = x[back] @ w, np.arange(int(back.sum()))
    loss = {s: -np.log(np.maximum(soft(z / s)[rows, y[back]], 1e-12)).mean() for s in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    return classes, vocabulary, w, min(loss, key=loss.get)


def _values(spark: SparkSession, rows: list[str], names: str) -> DataFrame:
    """An inline table, which the planner holds as a local relation of fixed size."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t({names})")


def _windows(width: int, step: int, least: float) -> str:
    return f"transform(sequence(0, greatest(0, (size(s.t) - {width} + {step} - 1) div {step})), i -> struct({least}D AS least, slice(s.t, i * {step} + 1, {width}) AS t))"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _row, paragraph, line, window, family, score, matched, confirmed, others) of each window that a template could confirm and a family is found in.

    Each paragraph is looked at as a whole, its line breaks taken as spaces (line is -1), and each of its lines by itself,
    so that a notice is found wrapped over lines or among other lines; in windows of several sizes that overlap by half.
    A window may cut a notice: others are the families whose templates it matches as well.
    Tables of the model are of fixed size and broadcast; all sums are pre-aggregated.
    """
    spark = docs.sparkSession
    classes, vocabulary, w, heat = trained()
    any_of = ", ".join(f"'{x}'" for x in anchors())
    has_anchor = lambda t: f"exists({t}, x -> x IN ({any_of}))"
    paragraphs = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), BREAK)).alias("paragraph", "words"))
    # the tokens of the lines, bound once; the paragraph's are theirs in a row
    lines = f"transform(split(words, '\n'), x -> regexp_extract_all(lower(x), r'{TOKEN}', 0))"
    parts = "concat(transform(l, (t, i) -> struct(i AS line, t AS t)), if(size(l) > 1, array(struct(-1 AS line, flatten(l) AS t)), array()))"
    parts = paragraphs.select("_id", "_row", "paragraph", F.explode(F.expr(f"flatten(transform(array({lines}), l -> if(exists(l, t -> {has_anchor('t')}), filter({parts}, s -> {has_anchor('s.t')}), array())))")).alias("s"))
    windows = parts.select("_id", "_row", "paragraph", "s.line", F.posexplode(F.expr(f"concat({', '.join([_windows(WINDOW, STEP, LEAST_MATCH), *(f'if(size(s.t) > {k}, {_windows(k, k // 4, 1)}, array())' for k in NARROW)])})")).alias("window", "v"))
    windows = windows.where(F.expr(has_anchor("v.t"))).select("_id", "_row", "paragraph", "line", "window", "v.least", "v.t")
    # shares of the templates in each window; what none of them can confirm goes no further
    quoted = lambda x: "array(" + ", ".join(repr(t) for t in dict.fromkeys(re.findall(TOKEN, x))) + ")"
    known = ", ".join(f"struct('{f}' AS family, array({', '.join(map(quoted, xs))}) AS templates)" for f, xs in NOTICES.items())
    words = ", ".join(f"'{t}'" for t in sorted({t for xs in NOTICES.values() for x in xs for t in re.findall(TOKEN, x)}))
    shares = f"transform(array({known}), f -> struct(f.family AS family, array_max(transform(f.templates, x -> size(array_intersect(x, h)) / size(x))) AS share))"
    shares = f"filter(transform(array(array_distinct(filter(t, x -> x IN ({words})))), h -> {shares}), m -> exists(m, f -> f.share >= least))"
    windows = windows.select("*", F.explode(F.expr(shares)).alias("m"))
    n = len(classes)
    weights = _values(spark, [f"('{g}', {', '.join(f'{x:.6f}D' for x in row)})" for g, row in zip(vocabulary, w[2:])], "gram, " + ", ".join(f"w{k}" for k in range(n)))
    key = ["_id", "_row", "paragraph", "line", "window"]
    gram = windows.select(*key, "least", "m", "t", F.explode(F.expr("array_distinct(concat(t, transform(sequence(1, size(t)), i -> if(i < size(t), t[i - 1] || ' ' || t[i], t[i - 1]))))")).alias("gram"))
    hits = gram.join(F.broadcast(weights), "gram", "left").groupBy(*key).agg(
        F.first("least").alias("least"), F.first("m").alias("m"), F.first("t").alias("t"), F.collect_set(F.when(F.col("w0").isNotNull() & ~F.contains("gram", F.lit(" ")), F.col("gram"))).alias("known"), *(F.sum(f"w{k}").alias(f"s{k}") for k in range(n))
    )
    beyond = "(size(filter(t, x -> not array_contains(known, x))) / size(t))"
    z = [f"((coalesce(s{k}, 0D) + {w[0, k]:.6f}D + {w[1, k]:.6f}D * {beyond}) / {heat}D)" for k in range(n)]
    scored = hits.withColumn("z", F.expr(f"array({', '.join(z)})")).withColumn("best", F.array_max("z"))
    scored = scored.withColumn("score", F.expr("1D / aggregate(z, 0D, (a, x) -> a + exp(x - best))"))
    names = ", ".join(f"'{c}'" for c in classes)
    scored = scored.withColumn("family", F.expr(f"element_at(array({names}), cast(array_position(z, best) AS int))")).where(f"family <> '{UNKNOWN}' and score >= {LEAST_SCORE}")
    matched = scored.withColumn("matched", F.expr("aggregate(m, 0D, (a, f) -> if(f.family = family, f.share, a))"))
    matched = matched.withColumn("others", F.expr("transform(filter(m, f -> f.family <> family and f.share >= matched), f -> f.family)"))
    return matched.select("_id", "_row", "paragraph", "line", "window", "family", "score", "matched", (F.col("matched") >= F.col("least")).alias("confirmed"), "others")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_licences, families (sorted, joined by a comma), best_score for each distinct id of docs.

    Only families that a template confirms count: once for each line that states one, and once for a paragraph
    that does so only over several lines. A null or empty text has none. An empty
    table gives an empty table; of rows with one id the findings are joined; other columns are not read.
    """
    found = scan(docs, id_col, text_col).where("confirmed").groupBy("_id", "_row", "paragraph", "line", "family", "matched", "others").agg(F.max("score").alias("score"))
    # a part of a notice that another window of the paragraph shows to be of another family
    found = found.groupBy("_id", "_row", "paragraph").agg(F.collect_list(F.struct("line", "family", "matched", "others", "score")).alias("found"), F.collect_set(F.struct("family", "matched")).alias("best"))
    found = found.select("_id", "_row", "paragraph", F.inline(F.expr("filter(found, r -> not exists(best, b -> b.matched > r.matched and array_contains(r.others, b.family)))")))
    found = found.groupBy("_id", "_row", "paragraph", "line", "family").agg(F.max("score").alias("score"))
    found = found.groupBy("_id", "_row", "paragraph", "family").agg(F.greatest(F.count_if(F.col("line") >= 0), F.lit(1)).alias("n"), F.max("score").alias("score"))
    each = found.groupBy("_id").agg(F.sum("n").alias("n_licences"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("score").alias("best_score"))
    ids = docs.select(F.col(id_col)).distinct()
    return ids.join(each, ids[id_col].eqNullSafe(each["_id"]), "left").select(id_col, F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("best_score", F.lit(0.0)).alias("best_score"))
