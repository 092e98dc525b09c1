"""Operators on small tables with nulls, empty and repeated rows, and columns whose names clash."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillgrid.llm.store")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quillgrid.llm import exact, grammar, jaccard, licenses, packing, pieces, quality, repetition, substring, toxicity  # noqa: E402
from quillgrid.llm.store import Scratch  # noqa: E402

SCHEMA = "doc_id long, text string, name string, pos int, block string, n long, sig string"


def make(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "x", 1, "y", 2, "z") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(45)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    out = [None, "", " \n ", "one", "one two three four", "One Two three FOUR"]
    out += [" ".join(words(n)) for n in (5, 8, 40, 36, 35, 200)]
    out += [" ".join(words(a) + passage + words(b)) for a, b in ((0, 0), (3, 9), (40, 0), (9, 60), (2, 2), (1, 4), (5, 5))]
    base = words(60)
    for k in range(9):
        b = list(base)
        b[k * 5] = "changed"
        out.append(" ".join(b))
    return out + [out[8], out[8], out[14], "a <|endoftext|> b <|startoftext|>", "<|endoftext|>", "a b " * 60, "é" * 5000, "é" * 4096 + "x" * 5000, "é" * 4096 + "x" * 5000]


def ids_of(name, text, end):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids + [end]


def test_packing(spark):
    texts = corpus()
    rows = packing.pack(make(spark, texts), public_tokenizers.path("word_bpe_49k.json"), 2, most=64).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        want = ids_of("word_bpe_49k.json", t, 2)
        assert [x for r in by[i] for x in r["ids"]] == want and by[i][0]["doc_tokens"] == len(want)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["offset"] == 0 and 2 ** r["bucket"] == r["length"] for r in by[i])
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_token_files(spark, tmp_path):
    texts = corpus()
    df = make(spark, texts).unionByName(make(spark, ["again"], 3))
    path, scratch = f"file://{tmp_path}/tokens", Scratch(spark, "t")
    grammar.write_token_files(df, path, public_tokenizers.path("byte_bpe_50k.json"), 0, 50257, shard_ids=500)
    got = sorted(grammar.read_token_files(spark, path, scratch).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([*range(len(texts)), 3])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] != 3:
            want = ids_of("byte_bpe_50k.json", texts[r["doc_id"]], 0)
            assert r["n_tokens"] == len(want) and r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
    one = grammar.read_documents(spark, path, spark.createDataFrame([(8,)], "doc_id long")).collect()
    assert [r["tokens"] for r in one] == [ids_of("byte_bpe_50k.json", texts[8], 0)]


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(spark, collide):
    texts = corpus()
    route = F.lit(1) if collide else None
    from quillgrid.llm.store import rows_with_uid

    scratch = Scratch(spark, "t")
    docs = rows_with_uid(make(spark, texts), scratch)
    got = {r["_uid"]: r for r in exact.exact_groups(docs, scratch, block_bytes=7, route=route).collect()}
    last, size = {}, Counter(t or "" for t in texts)
    for i, t in enumerate(texts):
        last[t or ""] = i
    for i, t in enumerate(texts):
        assert (got[i]["keep_id"], got[i]["group_size"]) == (last[t or ""], size[t or ""])


def test_exact_dedup_with_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, "a")], "doc_id long, text string")
    rows = exact.exact_dedup(df, Scratch(spark, "t")).collect()
    assert len(rows) == 5 and sum(r["kept"] for r in rows) == 2
    assert {(r["keep_id"], r["group_size"]) for r in rows} == {(2, 4), (1, 1)}
    assert all(r["text_sha256"] in {hashlib.sha256(x).hexdigest() for x in (b"a", b"b")} for r in rows)
    assert exact.drop_copies(df, Scratch(spark, "t")).columns == ["doc_id", "text"]


def brute_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def families(seed):
    """Boilerplate with private words, its parts, copies with edits, a chain of subsets, and short texts."""
    rng = random.Random(seed)
    words = lambda n: [f"q{rng.randrange(10**9)}" for _ in range(n)]
    out = []
    for _ in range(3):
        b, share = words(rng.randrange(20, 120)), rng.choice([0.15, 0.2, 0.25, 0.3, 0.4])
        for _ in range(rng.randrange(20, 60)):
            w = words(int(len(b) * share * rng.uniform(0.7, 1.3)))
            out.append(w[: len(w) // 2] + b + w[len(w) // 2 :] if rng.random() < 0.5 else b + w)
        out += [b[rng.randrange(6) : len(b) - rng.randrange(6)] for _ in range(4)]
    for _ in range(3):
        b, edits = words(rng.randrange(10, 150)), rng.choice([0.01, 0.015, 0.02, 0.03])
        for _ in range(rng.randrange(10, 70)):
            t = [words(1)[0] if r < edits else "" if r < 1.3 * edits else w for w, r in ((w, rng.random()) for w in b)]
            out.append([w for w in t if w])
    b, short = words(90), words(6)
    out += [b[i:] for i in range(30)] + [words(rng.randrange(7)) for _ in range(10)] + [short[: rng.randrange(3, 7)] + words(rng.randrange(3)) for _ in range(40)]
    rng.shuffle(out)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("hot,seed", [(2, 1), (3, 2), (24, 3)])
def test_jaccard_on_boilerplate_edits_and_chains(spark, hot, seed):
    texts = families(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(make(spark, texts), Scratch(spark, "t"), hot=hot).collect()}
    assert got == brute_components(texts)


def test_jaccard(spark):
    texts = corpus(24)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(make(spark, texts), Scratch(spark, "t")).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("least", [True])
def test_jaccard_members_meet_the_linked_lead_of_another_class(spark, least):
    rng = random.Random(4)
    words = lambda n: [f"v{rng.randrange(10**9)}" for _ in range(n)]
    shared = words(64)
    family = [" ".join(shared + words(18)) for _ in range(4 * jaccard.HOT)]
    texts = [" ".join(shared[1:]), *family] if least else [*family, " ".join(shared[1:])]
    want = brute_components(texts)
    assert len({root for _, root in want.values()}) == 1 and len({root for _, root in brute_components(family).values()}) == len(family)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(make(spark, texts), Scratch(spark, "t")).collect()}
    assert got == want


def brute_repeats(texts):
    """For each text its words, and the places of those in windows of 35 that also start elsewhere."""
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    return [(w, {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}) for w in words]


@pytest.mark.parametrize("key_bits", [64, 2])
def test_substring(spark, key_bits):
    """With two bits nearly all entries share a key, and the other half of their digests tells them apart."""
    texts, s = corpus() + passages(5), Scratch(spark, "t")
    want = brute_repeats(texts)
    got = {r["doc_id"]: r for r in substring.remove_repeats(make(spark, texts), s, key_bits=key_bits).collect()}
    for i, (w, gone) in enumerate(want):
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    cut = substring.cut_repeats(make(spark, texts), s)
    assert cut.columns == make(spark, texts).columns
    for r in cut.collect():
        w, gone = want[r["doc_id"]]
        assert r["text"] == (b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else texts[r["doc_id"]])


def passages(seed, n=40):
    """Texts of shared passages with private words between them; some whole, some cut short."""
    rng = random.Random(seed)
    words = lambda k: [f"s{rng.randrange(10**6)}" for _ in range(k)]
    shared = [words(rng.choice([20, 34, 35, 36, 50, 120, 300])) for _ in range(8)] + [["la", "li", "lu"] * 30]
    out = []
    for _ in range(n):
        text = words(rng.randrange(4))
        for _ in range(rng.randrange(5)):
            p = rng.choice(shared)
            a, b = (0, len(p)) if rng.random() < 0.6 else sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            text += p[a:b] + words(rng.choice([0, 0, 1, 5, 40]))
        out.append(rng.choice([" ", "  ", "\n"]).join(text))
    return out


def test_factors_are_equal_passages(spark):
    texts, s = passages(6), Scratch(spark, "t")
    words = [t.split() for t in texts]
    rows = substring.factors_of(make(spark, texts), s).collect()
    covered = {}
    for r in rows:
        assert r["words"] >= 35 and words[r["doc_id"]][r["at"] : r["at"] + r["words"]] == words[r["ref"]][r["ref_at"] : r["ref_at"] + r["words"]]
        covered.setdefault(r["doc_id"], set()).update(range(r["at"], r["at"] + r["words"]))
    for i, (_, gone) in enumerate(brute_repeats(texts)):
        assert covered.get(i, set()) == gone
    # a whole copy is one factor
    rows = substring.factors_of(make(spark, [" ".join(f"t{k}" for k in range(400))] * 3), s).collect()
    assert sorted((r["doc_id"], r["at"], r["words"], r["ref"], r["ref_at"]) for r in rows) == [(i, 0, 400, 0, 0) for i in range(3)]


def test_empty_tables(spark):
    none, labels = make(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    s = Scratch(spark, "t")
    made = [
        packing.pack(none, public_tokenizers.path("word_bpe_49k.json"), 2), pieces.encode_documents(none, public_tokenizers.path("piece_bpe_32k.model")), exact.exact_dedup(none, s),
        substring.remove_repeats(none, s), jaccard.near_groups(none, s), repetition.repetition_rules(none), licenses.license_scan(none),
        quality.score_quality(none, quality.train(none, labels, s)), toxicity.score_toxicity(none, toxicity.train(none, labels, s)),
        exact.drop_copies(none, s), jaccard.drop_near_copies(none, s), substring.cut_repeats(none, s), quality.keep_good(none, quality.train(none, labels, s)), substring.factors_of(none, s),
    ]
    assert [df.count() for df in made] == [0] * len(made)
    path = s.path("tokens")
    grammar.write_token_files(none, path, public_tokenizers.path("byte_bpe_50k.json"), 0, 50257)
    assert grammar.read_token_files(spark, path, s).count() == 0


def test_classifiers_do_not_read_held_out_labels(spark):
    df = make(spark, ["good words stand here in a line."] * 20 + ["### $$$ %%% &&&"] * 20)
    labels = spark.createDataFrame([(i, int(i < 20), int(i >= 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    s = Scratch(spark, "t")
    a, b = (quality.score_quality(df, quality.train(df, x, s)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in a)
    kept = quality.keep_good(df, quality.train(df, labels, s))
    assert kept.columns == df.columns


def test_licences(spark):
    texts = ["Intro line\nReleased under the MIT License.\nmore", "Licensed under the Apache License, Version 2.0.", "the driver showed a license to the officer", None, "", "All talk of copyright law aside, nothing.", "This work is licensed under the GNU General Public License, version 3."]
    got = {r["doc_id"]: r["families"] for r in licenses.license_scan(make(spark, texts)).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: "", 3: "", 4: "", 5: "", 6: "GPL-3.0"}


MIT_TEXT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""


def test_licences_wrapped_over_lines(spark):
    texts = [
        MIT_TEXT, MIT_TEXT.replace("\n", "\r\n"), "it rained all day and\nthe report is released\nunder the\nmit\nlicense\nas the office said", "Permission\n\nis hereby granted free of charge\n\nto any person obtaining",
        "Licensed under the\nApache License,\nVersion 2.0.\nReleased under\nthe MIT License.", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
        "This work is licensed under the GNU General Public\nLicense, version 2.",
    ]
    got = {r["doc_id"]: (r["families"], r["n_licences"]) for r in licenses.license_scan(make(spark, texts)).collect()}
    assert got == {0: ("MIT", 1), 1: ("MIT", 1), 2: ("MIT", 1), 3: ("", 0), 4: ("Apache-2.0,MIT", 2), 5: ("Apache-2.0,MIT", 3), 6: ("GPL-2.0", 1)}


def test_each_notice_is_reported(spark):
    want = [(family, notice) for family, notices in licenses.NOTICES.items() for notice in notices] + [("CC-BY-SA", "Available under CC BY-SA 4.0")]
    got = {r["doc_id"]: r["families"] for r in licenses.license_scan(make(spark, [notice for _, notice in want])).collect()}
    assert [(got[i], notice) for i, (_, notice) in enumerate(want)] == want


def test_windows_without_anchors_are_confirmed_by_no_template():
    held = set(licenses.anchors())
    for notice in (x for notices in licenses.NOTICES.values() for x in notices):
        tokens = set(licenses.re.findall(licenses.TOKEN, notice))
        assert len(tokens - held) / len(tokens) < licenses.LEAST_MATCH


def test_pipeline_stages(spark, tmp_path):
    """Each stage against brute force over what the one before kept."""
    import corpus_pipeline

    rng = random.Random(9)
    prose = lambda: " ".join(f"{rng.choice(['The', 'A'])} {rng.choice('cat dog man sea hill road'.split())} {rng.choice('saw held met left'.split())} the {rng.choice('boat tree gate lamp'.split())} by the river." for _ in range(12))
    junk = lambda: " ".join(rng.choice(["###", "$$$", "%%|%%", "<<>>", "&&"]) + str(rng.randrange(100)) for _ in range(60))
    good, bad = [prose() for _ in range(60)], [junk() for _ in range(60)]
    texts = corpus() + good + bad
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), f"extra {i}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, _uid string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    first = len(corpus())
    labels = [(i, int(i < first + 60), 0) for i in range(first, len(texts))] + [(i, 1, 0) for i in range(first)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns, left = now.columns, {"documents": dict(enumerate(texts))}
    for name, stage in corpus_pipeline.STAGES:
        now = Scratch(spark, "t").table(stage(spark, now, f"file://{tmp_path}"), name)
        if name != "packing":
            assert now.columns == columns
            left[name] = {r["doc_id"]: r["text"] for r in now.collect()}
            assert all(r["_uid"] == f"extra {r['doc_id']}" for r in now.select("doc_id", "_uid").collect())
    kept = set(left["quality"])
    assert not kept & set(range(first + 60, len(texts))) and len(kept & set(range(first, first + 60))) == 60
    last = {t or "": i for i, t in left["quality"].items()}
    assert set(left["exact"]) == set(last.values())
    order = sorted(left["exact"])
    comp = brute_components([left["exact"][i] for i in order])
    assert set(left["near"]) == {order[k] for k, (_, root) in comp.items() if k == root}
    order = sorted(left["near"])
    for i, (w, gone) in zip(order, brute_repeats([left["near"][i] for i in order])):
        assert left["substring"][i] == (b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else left["near"][i])
    packed = {}
    for r in now.orderBy("doc_id", "start").collect():
        packed.setdefault(r["doc_id"], []).extend(r["ids"])
    assert packed == {i: ids_of("word_bpe_49k.json", t, 2) for i, t in left["substring"].items()}


def plain_windows(text):
    """(paragraph, line, least share, tokens) of every window of a text."""
    out = []
    for p, paragraph in enumerate(re.split(licenses.BREAK, text or "")):
        lines = [re.findall(licenses.TOKEN, x.lower()) for x in paragraph.split("\n")]
        parts = list(enumerate(lines)) + ([(-1, [t for x in lines for t in x])] if len(lines) > 1 else [])
        for line, tokens in parts:
            for width, step, least in [(licenses.WINDOW, licenses.STEP, licenses.LEAST_MATCH), *((k, k // 4, 1.0) for k in licenses.NARROW if len(tokens) > k)]:
                for i in range(max(0, -(-(len(tokens) - width) // step)) + 1):
                    out.append((p, line, least, tokens[i * step : i * step + width]))
    return out


def test_licence_windows_against_the_classifier_in_numpy(spark):
    """Every window scored by the trained weights one by one: the same families, scores and shares of templates."""
    classes, vocabulary, w, heat = licenses.trained()
    number = {g: i + 2 for i, g in enumerate(vocabulary)}
    templates = {f: [set(re.findall(licenses.TOKEN, x)) for x in xs] for f, xs in licenses.NOTICES.items()}
    rng = random.Random(2)
    notices = [x for xs in licenses.NOTICES.values() for x in xs]
    texts = [MIT_TEXT, "", None, "no licence here\n\nat all", "Licensed under the Apache License,\nVersion 2.0"]
    for _ in range(25):
        parts = [rng.choice(notices + licenses.OTHER + ["plain words of a story"]) for _ in range(rng.randrange(1, 5))]
        texts.append(rng.choice(["\n", "\n\n", " "]).join(parts))
    want = Counter()
    for i, text in enumerate(texts):
        for p, line, least, tokens in plain_windows(text):
            shares = {f: max(len(t & set(tokens)) / len(t) for t in ts) for f, ts in templates.items()}
            if not tokens or max(shares.values()) < least:
                continue
            x = np.zeros(len(vocabulary) + 2)
            x[0], x[1] = 1, np.mean([t not in number for t in tokens])
            x[[number[g] for g in licenses.grams(tokens) if g in number]] = 1
            z = x @ w / heat
            score, best = 1 / np.exp(z - z.max()).sum(), classes[int(z.argmax())]
            if best != licenses.UNKNOWN and score >= licenses.LEAST_SCORE:
                want[i, p, line, best, round(score, 3), round(shares[best], 6), bool(shares[best] >= least)] += 1
    got = licenses.scan(make(spark, texts), "doc_id").collect()
    assert Counter((r["_id"], r["paragraph"], r["line"], r["family"], round(r["score"], 3), round(r["matched"], 6), r["confirmed"]) for r in got) == want and want


def odd_table(spark, n_words=700_000):
    """Null, repeated and missing ids, repeated rows, null, empty and very long texts, and columns whose names clash with the operators' own."""
    rng = random.Random(7)
    long_ = " ".join(f"x{rng.randrange(10**6)}" for _ in range(n_words))  # 5 MB
    rows = [(1, "a b c", 9), (1, "a b c", 9), (1, "other words", 8), (None, None, None), (None, "a b c", 1), (2, "", 2), (3, long_, 3), (4, long_ + " end", 4), (5, "la " * 400, 5)]
    schema = "doc_id long, text string, _uid long, comp long, sig string, bucket int, label int, score double, kept boolean, n_chars long"
    return spark.createDataFrame([(i, t, u, 1, "s", 2, 1, 0.5, True, len(t or "")) for i, t, u in rows], schema)


def test_odd_rows_in_every_operator(spark):
    docs, s, word, byte = odd_table(spark), Scratch(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    docs = s.table(docs, "odd")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    pieces_ = packing.pack(docs, word, 2, ids=False).groupBy().agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("rows")).first()
    assert pieces_["rows"] == 9
    path = s.path("tokens")
    grammar.write_token_files(docs, path, byte, 0, 50257)
    assert grammar.read_token_files(spark, path, s).count() == 9
    assert pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False).count() == 9
    got = exact.exact_dedup(docs, s).collect()
    assert sorted(r["group_size"] for r in got) == [1, 1, 1, 1, 2, 2, 3, 3, 3] and sum(r["kept"] for r in got) == 6
    near = jaccard.near_groups(docs, s).collect()
    assert len(near) == 9 and sum(r["n_shingles"] == 0 for r in near) == 2
    cut = substring.remove_repeats(docs, s).collect()
    assert sorted(r["n_removed"] for r in cut) == [0] * 6 + [400, 700_000, 700_000]
    assert repetition.repetition_rules(docs).count() == 9 and licenses.license_scan(docs).count() == 6
    assert quality.score_quality(docs, quality.train(docs, labels, s)).count() == 9 and toxicity.score_toxicity(docs, toxicity.train(docs, labels, s)).count() == 9


def test_odd_rows_in_every_stage(spark):
    """The stages' operators give back the input's columns, one named as the operators' own among them."""
    s = Scratch(spark, "t")
    docs = s.table(odd_table(spark, 150_000), "odd")  # longer than a block of the kernels
    for stage in (exact.drop_copies, jaccard.drop_near_copies, substring.cut_repeats):
        out = stage(docs, s)
        assert out.columns == docs.columns
        rows = {(r["doc_id"], r["_uid"]) for r in out.collect()}
        assert rows <= {(1, 9), (1, 8), (None, None), (None, 1), (2, 2), (3, 3), (4, 4), (5, 5)} and (2, 2) in rows
        if stage is jaccard.drop_near_copies:
            assert len({(3, 3), (4, 4)} & rows) == 1
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, quality.train(docs, labels, s)).columns == docs.columns


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
def test_queries_on_the_driver_s_tables(spark):
    """Each opN_ query over whole tables, against brute force where that is exact."""
    from quillgrid.llm import queries

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    ids = sorted(docs)
    texts = [docs[i] for i in ids]
    got = {name: q(spark, DATA).collect() for name, q in queries.QUERIES.items()}
    by = lambda name: {r["doc_id"]: r for r in got[name]}
    assert all(set(by(name)) == set(ids) for name in got)
    last = {t or "": i for i, t in zip(ids, texts)}
    assert all(r["keep_id"] == last[docs[i] or ""] for i, r in by("op5_exact_dedup").items())
    want = brute_components(texts)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by("op2_ngram_jaccard").items()} == {ids[k]: (n, ids[c]) for k, (n, c) in want.items()}
    for i, (w, gone) in zip(ids, brute_repeats(texts)):
        r = by("op4_substring_dedup")[i]
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone)) and r["kept_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    at = 0
    for i in ids:
        r, own = by("op9_token_output")[i], ids_of("byte_bpe_50k.json", docs[i], 0)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        at += len(own)
    packed = Counter()
    for r in got["op1_packing"]:
        packed[r["doc_id"]] += r["length"]
    assert packed == {i: len(ids_of("word_bpe_49k.json", docs[i], 2)) for i in ids}
    for name, n, out in (("op6_toxicity", 4, 2), ("op8_quality_classifier", 5, 0)):
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % n == out) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in by(name).items())
