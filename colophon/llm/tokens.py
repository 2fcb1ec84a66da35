"""Token ids of whole texts by a tokenizer file.

The split of a byte-level pre-tokenizer depends on classes of characters and on nothing that lies
before white space, so the bytes of a whole batch are cut into its words by array operations, the
distinct words of a few batches are encoded once, and their ids are gathered.  If the file numbers its merges
in order, as byte-level files do, their ids are ranks, and tiktoken merges the words of a batch in
one call; else the tokenizers library encodes them.

Text between two runs of white space that has characters whose class is not certain is encoded by
the tokenizer as one unit.  Texts with unusual white space before other white space or with an added
token, and all texts of tokenizers of another kind, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE, BREAK, LETTER, DIGIT, OTHER, UNSURE, EDGE = range(1, 8)
# The contractions that the byte-level split pattern takes as words of their own.
SHORT, LONG = (b"s", b"t", b"m", b"d"), (b"re", b"ve", b"ll")
# White space beyond space, tab and line breaks, as some engine has it.
UNUSUAL_SPACE = "\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff"


def _classes() -> np.ndarray:
    """The class of each byte; letters of two bytes are found apart."""
    out = np.full(256, UNSURE, np.uint8)
    out[0x21:0x7F] = OTHER
    for low, high, kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
        out[ord(low) : ord(high) + 1] = kind
    out[ord(" ")] = SPACE
    out[[9, 10, 13]] = BREAK
    return out


CLASSES = _classes()
#: last bytes of unusual white space, as numbers of one, two and three bytes
UNUSUAL = [np.array([int.from_bytes(c.encode(), "big") for c in UNUSUAL_SPACE if len(c.encode()) == n]) for n in (1, 2, 3)]


def byte_letters() -> dict[int, str]:
    """The visible character that stands for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def kinds(raw: np.ndarray) -> np.ndarray:
    """The class of each byte of a text."""
    out = np.frombuffer(bytearray(raw).translate(CLASSES.tobytes()), np.uint8)
    # 0xC3 to 0xC5
    lead = np.flatnonzero(raw - np.uint8(0xC3) <= 2)
    if len(lead):
        # Latin letters of two bytes, without the signs of multiplication and division
        after = raw.take(lead + 1)
        lead = lead[~((raw.take(lead) == 0xC3) & ((after == 0x97) | (after == 0xB7)))]
        out[lead] = out[lead + 1] = LETTER
    return out


def word_starts(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words (or units that are not cut) of joined texts start, and which texts must be encoded whole.

    ``raw`` has the bytes of the texts, ``begins`` their beginnings and the end of the last.
    """
    n = len(raw)
    kind = kinds(raw)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
    before[1:], after[:-1] = kind[:-1], kind[1:]
    before[first[:n]] = after[first[1:]] = EDGE
    space, space_before = kind <= BREAK, before <= BREAK
    run = space & ~space_before
    # a run of white space gives its last character to what follows, and a space is part of that
    start = space & (~space_before | (after <= UNSURE) & (after > BREAK))
    start |= ~space & (space_before & (before == BREAK) | ~space_before & (kind != before))
    start |= first[:n]
    whole = np.zeros(len(begins) - 1, bool)
    unsure = np.flatnonzero(kind == UNSURE)
    cut = None
    if len(unsure):
        units = run | first[:n]
        unit = np.cumsum(units) - 1
        cut = np.ones(int(unit[-1]) + 1, bool)
        cut[unit.take(unsure)] = False
        start = start & cut.take(unit) | units
        at = unsure[(after.take(unsure) == SPACE) | (after.take(unsure) == BREAK)]
        value = np.zeros(len(at), np.int64)
        odd = np.zeros(len(at), bool)
        for k, codes in enumerate(UNUSUAL):
            value |= raw.take(np.maximum(at - k, 0)).astype(np.int64) << 8 * k
            odd |= np.isin(value, codes)
        whole[np.searchsorted(begins, at[odd], "right") - 1] = True
    quote = np.flatnonzero((raw == ord("'")) & start & (kind == OTHER))
    if len(quote):
        if cut is not None:
            quote = quote[cut.take(unit.take(quote))]
        padded = np.r_[raw, np.zeros(3, np.uint8)]
        edge = np.r_[first, np.ones(3, bool)]
        one, two = padded.take(quote + 1), padded.take(quote + 2)
        short = np.isin(one, [x[0] for x in SHORT]) & ~edge.take(quote + 1)
        long = np.isin(one.astype(np.int64) << 8 | two, [int.from_bytes(x, "big") for x in LONG]) & ~edge.take(quote + 1) & ~edge.take(quote + 2)
        start[quote[short | long] + 1] = False
        ends = np.r_[quote[short] + 2, quote[long] + 3]
        start[ends[ends < n]] = True
    return np.flatnonzero(start), whole


def merge_ranks(file: dict) -> dict[bytes, int] | None:
    """Ids of a byte-level file as ranks of their bytes, None unless ids and merges have one order."""
    model = file.get("model") or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    shown = byte_letters()
    vocabulary, letters = model["vocab"], {c: b for b, c in shown.items()}
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    singles = [vocabulary.get(c) for c in letters]
    if None in singles or max(singles) > 255 or any(shown[0] in m for m in merges) or any(vocabulary.get(m) != 256 + k for k, m in enumerate(merges)):
        return None
    return {bytes(map(letters.__getitem__, t)): k for t, k in vocabulary.items() if k < 256 + len(merges)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A special token that a text spells out has its own id, as the library has it by default, or is
    plain text with ``special_as_text``.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        split = kind.get("pre_tokenizer") or {}
        self.by_word = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not kind.get("normalizer")
        self.added = [t["content"] for t in kind.get("added_tokens") or [] if t["content"]]
        self.merger = self.mark = None
        ranks = merge_ranks(kind) if self.by_word else None
        if ranks:
            import tiktoken

            # each word comes after a byte that no word has and no merge takes
            self.merger, self.mark = tiktoken.Encoding("words", pat_str=r"\x00[^\x00]*", mergeable_ranks=ranks, special_tokens={}), ranks[b"\0"]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word_ids(self, words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        if self.merger is None:
            found = self.whole([w.decode() for w in words.to_pylist()])
            return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)
        odd = np.add.reduceat(kinds(raw[begins[0] : begins[-1]]) == UNSURE, begins[:-1] - begins[0]) > 0
        sure = words.filter(pa.array(~odd)) if odd.any() else words
        begins = np.frombuffer(sure.buffers()[1], np.int64)[sure.offset : sure.offset + len(sure) + 1]
        lengths = np.diff(begins)
        marked = np.zeros(len(sure) + begins[-1] - begins[0], np.uint8)
        marked[np.arange(begins[-1] - begins[0]) + np.repeat(np.arange(1, len(sure) + 1), lengths)] = np.frombuffer(sure.buffers()[2], np.uint8)[begins[0] : begins[-1]]
        ids = self.merger.encode_to_numpy(marked.tobytes().decode(), disallowed_special=())
        marks = np.flatnonzero(ids == self.mark)
        sizes = np.diff(np.r_[marks, len(ids)]) - 1
        ids = np.delete(ids, marks)
        if not odd.any():
            return ids, sizes
        found = [np.frombuffer(x, "<u4") for x in self.whole([w.decode() for w in words.filter(pa.array(odd)).to_pylist()])]
        both = np.concatenate([ids, *found])
        counts = np.zeros(len(words), np.int64)
        counts[~odd] = sizes
        counts[odd] = [len(x) for x in found]
        place = np.r_[np.flatnonzero(~odd), np.flatnonzero(odd)]
        return both[np.argsort(np.repeat(place, counts[place]), kind="stable")], counts

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text, null as empty."""
        return next(self.encode_all([texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())]))

    def encode_all(self, parts: list[pa.Array]) -> Iterator[list[bytes]]:
        """The ids of each text, part by part; a word that several parts have is encoded once."""
        parts = [texts.fill_null("").cast(pa.large_string()) for texts in parts]
        if not self.by_word:
            yield from (self.whole(texts.to_pylist()) for texts in parts)
            return
        cut = [self._cut(texts) for texts in parts]
        words = pa.chunked_array([c[0] for c in cut]).unify_dictionaries().chunks
        table, sizes = self._word_ids(words[0].dictionary) if len(words[0].dictionary) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        place = np.cumsum(sizes) - sizes
        for texts, own, (_, before, whole) in zip(parts, words, cut):
            picked = own.indices.to_numpy()
            length = sizes.take(picked)
            ends = np.r_[0, np.cumsum(length)]
            flat = table.take(np.repeat(place.take(picked) - ends[:-1], length) + np.arange(ends[-1])).tobytes()
            # ids before each text: those of the words before it
            upto = (ends.take(before) * 4).tolist()
            out = [flat[a:b] for a, b in zip(upto, upto[1:])]
            at = np.flatnonzero(whole)
            if len(at):
                for k, found in zip(at.tolist(), self.whole(texts.take(pa.array(at)).to_pylist())):
                    out[k] = found
            yield out

    def _cut(self, texts: pa.LargeStringArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """The words of all texts, how many come before each text, and which texts must be encoded whole."""
        begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[begins[0] : begins[-1]] if begins[0] < begins[-1] else np.zeros(0, np.uint8)
        begins = begins - begins[0]
        starts, whole = word_starts(raw, begins) if len(raw) else (np.zeros(0, np.int64), np.zeros(len(texts), bool))
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int64)), pa.py_buffer(raw)])
        return words.dictionary_encode(), np.searchsorted(starts, begins), whole


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, special tokens as the library has them."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encoded(batches: Iterator, path: str, end_id: int = 0, column: str = "text", most: int = 4 << 20, together: int = 1) -> Iterator[tuple]:
    """Arrow batches of bounded size, each with the ids of its texts as bytes, ``end_id`` appended to each.

    The distinct words of so many batches ``together`` are encoded at once.
    """
    from colophon.llm.common import slices

    end = np.array([end_id], "<u4").tobytes()
    for several in slices(batches, column, together * most):
        parts = list(slices([several], column, most))
        for batch, found in zip(parts, encoder(path).encode_all([part.column(column) for part in parts])):
            yield batch, [ids + end for ids in found]
