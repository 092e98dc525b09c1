"""Kernels against brute force, without Spark."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quillgrid.llm.text")
public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from quillgrid.llm import grammar, graph, jaccard, pieces, quality, repetition, substring, toxicity, units  # noqa: E402
from quillgrid.llm.packing import lengths  # noqa: E402
from quillgrid.llm.text import Words, text_bytes, window_hashes  # noqa: E402

ODD = ["", None, " ", "a  b", "a \n b\n\n c.\n", "x y  z　 q", "éÀ b", "don't 's \t tab", "<|endoftext|> hi", "a <|endoftext|> b", "x<|startoftext|>y <|ENDOFTEXT|>  <|endoftext|><|endoftext|>", "<|endoftext", "|>", "é. é, a.b,c", "\n", "  lead", "trail  ", "1.5 2,3 x1.y", "▁x ▁", " " * 40 + "x", "a" * 100 + " " + "ab" * 80, "日本語 🙂"]


def some_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "B", "é", " ", "\n", "\t", ".", ",", "'s", "1", " ", "　", "🙂", "́", "!", "the", "ing"]
    return ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", units.SPACE_UNITS), ("byte_bpe_50k.json", units.BYTE_UNITS)])
def test_units_give_the_library_s_ids(name, kind):
    texts = some_texts(150)
    enc, library = units.Encoder(public_tokenizers.path(name), kind), Tokenizer.from_file(public_tokenizers.path(name))
    batch, i = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"]), 0
    for b, flat, bounds in enc.encoded([batch], 7):
        for k in range(b.num_rows):
            assert flat[bounds[k] : bounds[k + 1]].tolist() == library.encode(texts[i] or "", add_special_tokens=False).ids + [7]
            i += 1
    assert i == len(texts)


def test_units_of_letters_go_to_the_model_together():
    words = ["Haus", "über", "naïveté", "straße", "don't", "x×", "y÷", "Ÿ", "ñandú", "a1", "ÿ", "é"] + ["w" + "abcde"[k % 5] * (k // 5 + 1) for k in range(100)]
    ends = ["", "!!", "?", "$$$", "'s", ".", ",&", "7", "-é"]
    texts = [" ".join(w + e for w in words) + "\n" + "\n".join(w + e for w in reversed(words)) for e in ends]
    path, calls = public_tokenizers.path("byte_bpe_50k.json"), []
    enc, library = units.Encoder(path, units.BYTE_UNITS), Tokenizer.from_file(path)
    model = SimpleNamespace(tokenize=lambda x: calls.append(x) or library.model.tokenize(x), token_to_id=library.model.token_to_id)
    enc.tok = SimpleNamespace(model=model, encode_batch_fast=library.encode_batch_fast)
    flat, bounds = enc.flat(*text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(calls) * 8 < len(enc.known) < 350  # each word with and without a space, each end once


def test_hashes_that_differ_in_the_low_bits_only():
    h = np.array([5, 4, 5, 4, 1 << 40, 5, 4], np.uint64)
    order, in_turn = units.in_order(h)
    assert in_turn.tolist() == sorted(h.tolist()) and (h[order] == in_turn).all()


def test_units_when_the_store_is_full(monkeypatch):
    monkeypatch.setattr(units, "KEPT_UNITS", 20)
    test_units_give_the_library_s_ids("byte_bpe_50k.json", units.BYTE_UNITS)


def test_pieces_equal_the_library_and_come_back():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts, lib = some_texts(150, 3), sentencepiece.SentencePieceProcessor(model_file=path)
    enc = pieces.PieceEncoder(path)
    flat, bounds = enc.encode(pa.array(texts))
    back = pieces.decode(flat, bounds, enc.model)
    for i, t in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == lib.encode(t or "")
        assert back[i].decode() == (t or "").replace("▁", " ")


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 12289])
def test_lengths_are_powers_of_two(n):
    got = lengths(n)
    assert sum(got) == n and all(k & (k - 1) == 0 and k <= 4096 for k in got) and sum(k < 4096 for k in got) <= 12


@pytest.mark.parametrize("terminals", [10, 50257, 70000])
def test_grammar_round_trip(terminals):
    rng = np.random.default_rng(2)
    ids = np.concatenate((rng.integers(0, 10, 3000), np.tile([1, 2, 3, 1, 2], 500), np.full(300, 4))).astype(np.uint32)
    bounds = np.array([0, 1, 40, 40, 2999, 5000, len(ids)])
    shard = grammar.Shard(grammar.compress(ids, bounds, terminals))
    assert (shard.decode(0, shard.n_docs) == ids).all() and len(shard.symbols) < len(ids) / 2 and len(shard.rules)
    assert shard.n_docs == len(bounds) - 1
    for i in range(shard.n_docs):
        assert (shard.document(i) == ids[bounds[i] : bounds[i + 1]]).all()


@pytest.mark.parametrize("terminals", [50257, 70000])
def test_grammar_goes_on_until_no_pair_is_frequent(terminals):
    rng = np.random.default_rng(3)
    ids = np.concatenate((np.tile(rng.integers(0, 5000, 64), 100), np.full(1000, 7), rng.integers(0, 10, 500))).astype(np.uint32)
    shard = grammar.Shard(grammar.compress(ids, np.array([0, 6400, len(ids)]), terminals))
    assert (shard.decode(0, 2) == ids).all()
    pairs = Counter(p for a, b in zip(shard.starts[:-1], shard.starts[1:]) for p in zip(shard.symbols[a : b - 1].tolist(), shard.symbols[a + 1 : b].tolist()))
    assert max(pairs.values()) < grammar.LEAST and shard.starts[1] < 20


@pytest.mark.parametrize("terminals", [6, 50257, 70000])
def test_grammar_is_the_same_whether_gaps_are_closed_or_linked(terminals, monkeypatch):
    rng = np.random.default_rng(4)
    ids = np.concatenate((rng.integers(0, 6, 4000), np.full(333, 5), np.tile([1, 1, 2], 200))).astype(np.uint32)
    for cut in ([], [0, 0, 7, 4100, len(ids)], rng.integers(0, len(ids), 200)):
        bounds, blobs = np.concatenate(([0], np.sort(np.array(cut, np.int64)), [len(ids)])), set()
        for gaps in (1, 16, 1 << 40):
            monkeypatch.setattr(grammar, "GAPS", gaps)
            blobs.add(grammar.compress(ids, bounds, terminals))
        (blob,) = blobs
        shard = grammar.Shard(blob)
        assert (shard.decode(0, shard.n_docs) == ids).all()
        pairs = Counter(p for a, b in zip(shard.starts.tolist()[:-1], shard.starts.tolist()[1:]) for p in zip(shard.symbols[a : b - 1].tolist(), shard.symbols[a + 1 : b].tolist()))
        assert max(pairs.values()) < grammar.LEAST


def test_words_and_windows():
    texts = some_texts(60, 5)
    w = Words(*text_bytes(pa.array(texts)))
    assert w.counts().tolist() == [len((t or "").encode().split()) for t in texts]
    seen = {}
    for t, a, b in zip(texts, w.bounds[:-1], w.bounds[1:]):
        for word, h in zip((t or "").encode().split(), w.hashes[a:b].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert len(window_hashes(w.hashes[:3], 5)) == 0


def test_repetition_rules_against_counting():
    rng = random.Random(9)
    texts = [None, "", "a " * 30, "one two three"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) + "\n" + "x y z 1 2 3 4 5 6 7 8\n" * rng.randrange(3) for _ in range(60)]
    got = repetition.measure(pa.array(texts))
    for i, t in enumerate(texts):
        w = (t or "").split()
        for k, field in ((5, "n_repeat_words"), (10, "covered_words")):
            c = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
            assert got[field][i] == len({p for j in range(len(w) - k + 1) if c[tuple(w[j : j + k])] > 1 for p in range(j, j + k)})
        lines = [x for x in (t or "").split("\n") if x.split()]
        assert got["n_dup_lines"][i] == len(lines) - len(set(lines))
        longest = max((k for k in range(1, len(w)) if max(Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)).values()) > 1), default=0)
        assert got["longest_repeat"][i] == longest
        n, repeated, covered = len(w), got["n_repeat_words"][i], got["covered_words"][i]
        assert got["base_failed"][i] == (n < 10 or 100 * repeated > 20 * n)
        assert got["kept"][i] == (not got["base_failed"][i] and 100 * covered <= 15 * n and not (longest >= 30 and 100 * longest > 10 * n))
        assert got["n_words"][i] == n and got["word_chars"][i] == sum(map(len, w)) and got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in t or "")


def test_blocks_partition_the_windows():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 34, 35, 36, 120, 400)] + ["a " * 90]
    owner, at, size, seed = substring.blocks_of(Words(*text_bytes(pa.array(texts))))
    for i, t in enumerate(texts):
        n = max(0, len(t.split()) - 34)
        covered = [p for a, s in zip(at[owner == i], size[owner == i]) for p in range(a, a + s)]
        assert covered == list(range(n)) and (size <= 20).all()


def test_digests_are_of_the_words():
    texts = ["a b  c\td", "x", "a b c d", " a\nb c d "]
    w = Words(*text_bytes(pa.array(texts)))
    got = substring.digests(w, w.bounds[:-1], w.bounds[1:])
    assert (got[0] == got[2]).all() and (got[2] == got[3]).all() and (got[0] != got[1]).all()


def test_forest():
    rng = np.random.default_rng(4)
    u, v = rng.integers(-400, 400, (2, 350))
    ids, root = graph.forest(u, v)
    reach = {int(x): {int(x)} for x in ids}
    for a, b in zip(u.tolist(), v.tolist()):
        if reach[a] is not reach[b]:
            reach[a] |= reach[b]
            for x in reach[b]:
                reach[x] = reach[a]
    assert {int(i): int(r) for i, r in zip(ids, root)} == {x: min(c) for x, c in reach.items()}


def test_parity_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40, 700):
        both = rng.integers(0, 2**63, n, dtype=np.uint64)
        x, y = (np.unique(np.concatenate((both, rng.integers(0, 2**63, k, dtype=np.uint64)))) for k in (n // 3, n // 9))
        a, b = jaccard.parity(x), jaccard.parity(y)
        size = min(len(a), len(b))
        assert np.bitwise_count(jaccard.fold(a, size) ^ jaccard.fold(b, size)).sum() <= len(np.setxor1d(x, y))


def test_segments_hold_the_bound():
    for n in (4, 7, 20, 100, 1000):
        assert jaccard.n_segments(n) == jaccard.limit(n) + 1 + jaccard.slack(n)
        assert all(used <= m for _, m, used in jaccard.schemes_of(n) + jaccard.large_schemes(n))


def test_trees_learn_and_empty_texts_score():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 5)).astype(np.float32)
    y = (x[:, 1] + 0.3 * x[:, 3] > 0).astype(float)
    model = quality.fit(x[:400], y[:400])
    assert ((model.score(x[400:]) >= 0.5) == (y[400:] > 0)).mean() > 0.9
    s = quality.statistics(pa.array(["", None, "a", "A b, c.\n" * 50]))
    assert s.shape == (4, len(quality.FEATURES)) and np.isfinite(s).all()
    assert quality.fit(x[:5], np.ones(5)).score(x[:2]).tolist() == pytest.approx([0.999, 0.999], abs=1e-6)
    assert quality.fit(x[:0], y[:0]).score(x[:1])[0] == pytest.approx(0.5)


def test_toxicity_finds_unseen_spellings():
    rng = random.Random(5)
    calm = ["".join(rng.choice(["ta", "re", "mo", "sil", "lu", "gen"]) for _ in range(4)) for _ in range(400)]
    bad = ["vogonish", "vogonly", "vogoner", "vogons", "vogonism"]
    texts, y = [], []
    for i in range(600):
        words = [rng.choice(calm) for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
        y.append(float(i % 4 == 0))
    model = toxicity.fit(pa.array(texts), np.array(y))
    seen, unseen, clean, empty, null = model.score(pa.array([" ".join([*calm[:9], w]) for w in ("vogonly", "vogonxs", calm[9])] + ["", None]))
    assert seen > 0.3 > clean and unseen > 10 * clean and empty == null and 0 <= empty <= 1
    assert toxicity.fit(pa.array(["a"]), np.array([1.0])).score(pa.array(["b"]))[0] > 0.9


def test_trees_are_walked_as_node_by_node():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    model = quality.fit(x, (x[:, 0] * x[:, 2] > 0).astype(float))
    for row, score in zip(x[:60], model.score(x[:60])):
        margin = model.start
        for feature, cut, value in zip(model.feature, model.cut, model.value):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += value[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-6)


def plain_toxicity(model, text):
    """One segment, one word and one subword after the other."""
    words = (text or "").encode().lower().split()
    logits = []
    for k in range(0, len(words), toxicity.SEGMENT):
        values = []
        for w in words[k : k + toxicity.SEGMENT]:
            data = np.frombuffer(w, np.uint8)
            sub, _ = toxicity.subwords(data, np.array([0]), np.array([len(data)]))
            values.append(float(np.mean([float(model.bucket[b]) for b in sub])))
        logits.append(sum(values) / len(values) + model.bias)
    top = sorted((max(x, model.bias) for x in logits), reverse=True)[: toxicity.TOP]
    row = top + [model.bias] * (toxicity.TOP - len(top)) + [np.log1p(len(logits)), 1.0]
    return 1 / (1 + np.exp(-float(np.dot(row, model.curve))))


def test_toxicity_scores_as_word_by_word():
    rng = random.Random(12)
    calm, bad = ["".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(60)], ["zorkish", "zorkly"]
    texts = [" ".join(rng.choice(calm) for _ in range(rng.randrange(1, 40))) + (" " + rng.choice(bad)) * (i % 3 == 0) for i in range(300)]
    model = toxicity.fit(pa.array(texts), np.array([float(i % 3 == 0) for i in range(300)]))
    some = [*texts[:40], "", None, "É Zorkish  ALL\ncaps", "one"]
    assert model.score(pa.array(some)) == pytest.approx([plain_toxicity(model, t) for t in some], abs=1e-5)
    # ties and repeated rows; no words at all; nothing frequent
    assert len(set(model.score(pa.array([texts[0]] * 3)))) == 1
    for t in (["", ""], ["a", "b"]):
        assert toxicity.fit(pa.array(t), np.array([0.0, 1.0])).score(pa.array(t)).tolist() == pytest.approx([0.5, 0.5])
