"""Tokenisation with the tokenizers library, each distinct piece of text once.

Text is cut only where no token of the given tokenizer can span the cut; the
ids of a document are then those of its units in turn. Units that a worker has
met are looked up by hash; only new ones go to the library. A text with the
string of a special token goes to the library as a whole, which gives that token's id.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer
from tokenizers.models import BPE

from .text import LOWER, U, run_starts, slices, span_hashes, text_bytes

#: How text is cut. SPACE: units are words, for tokenizers that drop white space
#: and ignore case. BYTE: a unit may begin with one space, for byte-level tokenizers.
SPACE_UNITS, BYTE_UNITS = "space", "byte"
#: Units kept by a worker; beyond that it starts anew (bounds memory only).
KEPT_UNITS = 1_200_000
_cls = np.zeros(256, np.uint8)
_cls[[0x20]] = 1
_cls[[9, 10, 11, 12, 13]] = 2
_cls[list(range(65, 91)) + list(range(97, 123))] = 3
_cls[[0x2E, 0x2C]] = 4
_cls[128:] = 5
_cls[[b for b in range(0x21, 0x7F) if _cls[b] == 0]] = 6
#: White space beyond ASCII, in UTF-8; a text with any of it is encoded whole.
_ODD = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ODD_HEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")


#: Byte-level models write each byte as a visible character: printable Latin-1 as itself, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_SHOWN = np.array([_VISIBLE.get(b, b) for b in range(256)], "<u2")
#: Bytes that are in no text, since UTF-8 has no use for them.
_NEVER = (0xC0, 0xC1, *range(0xF5, 0x100))
#: Units that are one pre-token, and how many of them go to the model at once.
_LETTERS = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
JOINED_UNITS = 16


def odd_space(raw: bytes) -> bool:
    return any(x[:1] in raw and x in raw for x in _ODD_HEADS) and _ODD.search(raw) is not None


def cuts(data: np.ndarray, offsets: np.ndarray, kind: str) -> np.ndarray:
    """Ascending unit starts (all document starts among them)."""
    c = _cls[data]
    before, now = c[:-1], c[1:]
    space = (c == 1) | (c == 2)
    if kind == SPACE_UNITS:
        cut = (space[:-1] != space[1:]) | ((before == 3) & (now == 4))
    else:
        # before a lone space or newline between characters that are no ASCII space, after such a newline, and between a letter and a visible ASCII character that is none
        after = np.concatenate((space[2:], [True]))
        lone = space[1:] & ~space[:-1] & ~after
        mark = (now == 4) | (now == 6)
        cut = lone | ((before == 3) & mark)
        wide = np.flatnonzero((before == 5) & mark)  # the letter may be one of U+00C0 to U+00FF, but for the signs of times and division
        cut[wide[(data[wide - 1] == 0xC3) & (data[wide] != 0x97) & (data[wide] != 0xB7)]] = True
        newline = lone & (now == 2)
        cut[1:] |= newline[:-1]
    start = np.concatenate(([True], cut, [True]))
    start[offsets] = True
    return np.flatnonzero(start[:-1])


def in_order(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the hashes, and the hashes in it: their high bits are sorted with the place in the low ones."""
    low = (U(1) << U(len(hashes).bit_length())) - U(1)
    order = (np.sort((hashes & ~low) | np.arange(len(hashes), dtype=U)) & low).astype(np.int64)
    sorted_ = hashes[order]
    if (sorted_[1:] < sorted_[:-1]).any():  # some differ in the low bits only
        order = np.argsort(hashes)
        sorted_ = hashes[order]
    return order, sorted_


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok, self.kind = Tokenizer.from_file(path), kind
        #: Strings that the library takes out of a text before anything else, as they are and in lower case.
        self.special = sorted({raw for t in self.tok.get_added_tokens_decoder().values() for raw in (t.content.encode(), t.content.lower().encode())})
        self.border = self._border()
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, U)  # sorted hashes of units
        self.at = np.zeros(0, np.int64)  # where a unit's ids begin
        self.size = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _border(self) -> int | None:
        """A byte that the model can join with nothing: a symbol of its own, in no other token and in no text."""
        model = self.tok.model
        if not isinstance(model, BPE) or model.ignore_merges or model.dropout or model.continuing_subword_prefix or model.end_of_word_suffix:
            return None
        vocab = self.tok.get_vocab(with_added_tokens=False)
        met = Counter(c for token in vocab for c in set(token))
        return next((b for b in _NEVER if chr(b) in vocab and met[chr(b)] == 1), None)

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are one pre-token each go to the model, several at once with borders between them."""
        joined = "\n".join(texts)
        raw = np.frombuffer((joined.lower() if self.kind == SPACE_UNITS else joined).encode(), np.uint8)
        shown = _SHOWN.copy()
        shown[0x0A] = shown[self.border or 0x0A]
        visible, model = shown[raw].tobytes().decode("utf-16-le"), self.tok.model.tokenize
        ends = np.append(np.flatnonzero(raw == 0x0A), len(raw))
        ends = np.append(ends[JOINED_UNITS - 1 : -1 : JOINED_UNITS], ends[-1]).tolist() if self.border else ends.tolist()
        ids, begin, border = [], 0, None if self.border is None else self.tok.model.token_to_id(chr(self.border))
        sizes = []
        for end in ends:
            own = [t.id for t in model(visible[begin:end])]
            ids += own
            if border is None:
                sizes.append(len(own))
            else:
                ids.append(border)
            begin = end + 1
        flat = np.array(ids, np.uint32)
        if border is None:
            return np.array(sizes, np.int32), flat
        at = np.flatnonzero(flat == border)
        return (np.diff(at, prepend=-1) - 1).astype(np.int32), flat[flat != border]

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of one run, with a space before them or not, are one pre-token and need the model only."""
        word = np.fromiter((_LETTERS.fullmatch(x) is not None for x in texts), bool, len(texts))
        sizes = np.zeros(len(texts), np.int32)
        words, rest, own = [x for x, w in zip(texts, word.tolist()) if w], [x for x, w in zip(texts, word.tolist()) if not w], []
        for k in range(0, len(rest), 4096):
            own += [e.ids for e in self.tok.encode_batch_fast(rest[k : k + 4096], add_special_tokens=False)]
        sizes[~word] = [len(x) for x in own]
        if words:
            sizes[word], ids = self._words(words)
        out, of_word = np.zeros(int(sizes.sum()), np.uint32), np.repeat(word, sizes)
        if words:
            out[of_word] = ids
        out[~of_word] = [y for x in own for y in x]
        return sizes, out

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """hashes: ascending."""
        if len(self.known) + len(hashes) > KEPT_UNITS:
            self.forget()
        sizes, ids = self._library(texts)
        at = len(self.ids) + np.cumsum(sizes, dtype=np.int64) - sizes
        where = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, where, hashes)
        self.at = np.insert(self.at, where, at)
        self.size = np.insert(self.size, where, sizes)
        self.ids = np.concatenate((self.ids, ids))

    def whole(self, raw: bytes) -> bool:
        """Whether the library must see this text as a whole: it may hold a special token, or white space beyond ASCII."""
        return odd_space(raw) or any(x in raw for x in self.special) or (self.kind == SPACE_UNITS and any(x in raw.lower() for x in self.special))

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return cuts(data, offsets, self.kind)

    def flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and the n+1 bounds of the texts in them."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.kind == SPACE_UNITS:
            data = LOWER[data]
        starts = self.starts(data, offsets)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        if self.kind == SPACE_UNITS:
            word = _cls[data[starts]]
            keep = (word != 1) & (word != 2)
            starts, ends = starts[keep], ends[keep]
        hashes = span_hashes(data, starts, ends)
        order, sorted_ = in_order(hashes)
        first = run_starts(sorted_)
        distinct, where = sorted_[first], order[first]
        inverse = np.empty(len(hashes), np.int64)
        inverse[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        slot = np.searchsorted(self.known, distinct)
        new = slot == len(self.known)
        new[~new] = self.known[slot[~new]] != distinct[~new]
        if new.any():
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())]
            self.learn(distinct[new], texts)
            slot = np.searchsorted(self.known, distinct)
            if (slot == len(self.known)).any() or (self.known[np.minimum(slot, len(self.known) - 1)] != distinct).any():
                # the store was emptied to make room: take the rest too
                lost = np.ones(len(distinct), bool)
                ok = slot < len(self.known)
                lost[ok] = self.known[slot[ok]] != distinct[ok]
                raw = data.tobytes()
                self.learn(distinct[lost], [raw[a:b].decode() for a, b in zip(starts[where[lost]].tolist(), ends[where[lost]].tolist())])
                slot = np.searchsorted(self.known, distinct)
        slot = slot[inverse]
        size = self.size[slot].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(size)))
        source = np.repeat(self.at[slot] - total[:-1], size) + np.arange(total[-1])
        bounds = total[np.searchsorted(starts, offsets, "left")]
        return self.ids[source], bounds

    def encoded(self, batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """For slices of the batches: the rows, the ids of all their texts with end_id after each, and the bounds."""
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            raw = data.tobytes()
            if self.whole(raw):
                flat, sizes = [], []
                for i in range(batch.num_rows):
                    part = data[offsets[i] : offsets[i + 1]]
                    text = raw[offsets[i] : offsets[i + 1]]
                    if self.whole(text):
                        ids = np.array(self.tok.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
                    else:
                        ids = self.flat(part, np.array([0, len(part)]))[0]
                    flat.append(ids)
                    sizes.append(len(ids))
                ids, bounds = np.concatenate(flat), np.concatenate(([0], np.cumsum(sizes)))
            else:
                ids, bounds = self.flat(data, offsets)
            out = np.full(len(ids) + batch.num_rows, end_id, np.uint32)
            shifted = bounds + np.arange(len(bounds))
            keep = np.ones(len(out), bool)
            keep[shifted[1:] - 1] = False
            out[keep] = ids
            yield batch, out, shifted


_made: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if (path, kind) not in _made:
        _made[path, kind] = Encoder(path, kind)
    return _made[path, kind]
