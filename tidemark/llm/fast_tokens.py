"""Whole-text token ids by a public tokenizer file, with each distinct word encoded once.

The library does all merging.  For tokenizer files whose pre-tokenization never
joins characters across white space, a text's ids are those of its words one
after another, so words are looked up in a bounded table and only new ones go to
the library's model.  Texts with characters for which the library's
Unicode tables might differ from Python's go to the library whole.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import string
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words, and pieces of words, that a worker remembers.
CACHE = 500_000
#: The normalizer and the pattern for which word-wise encoding holds.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMAL = ["NFC", "Replace", "Lowercase"]
#: Characters that no normal form, case rule or class treats differently: the rest make a text go whole.
_ODD = re.compile("[^\x00-\x1b\x20-įı-ɏЀ-ҁҊ-ӿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥]|<\\|")

#: Neither letters nor digits; a run of them is one piece where no letter follows.
_MARKS = string.punctuation


class Encoder:
    """``encode`` gives each text's ids as little-endian bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        top = max(self.full.get_vocab().values())
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        raw = json.loads(self.full.to_str())
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.by_word = self._by_word(raw)
        if self.by_word:
            import regex

            self.find = regex.compile(_SPLIT).findall
            self.model = Tokenizer.from_str(json.dumps(raw)).model
            self.table = _byte_table()

    @staticmethod
    def _by_word(raw: dict) -> bool:
        norm, pre, model = raw.get("normalizer") or {}, raw.get("pre_tokenizer") or {}, raw["model"]
        kinds = [x.get("type") for x in norm.get("normalizers", [])]
        steps = pre.get("pretokenizers", [])
        return kinds == _NORMAL and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == _SPLIT and bool(steps[0]["invert"]) and not steps[1]["add_prefix_space"] and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.full.encode_batch(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.whole(texts)
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        get, learn, odd, out = self.words.get, self._learn, [], []
        for i, t in enumerate(texts):
            if _ODD.search(t):
                odd.append(i)
                t = ""
            words = t.lower().split()
            ids = list(map(get, words))
            if None in ids:  # learned at once, while the rest is at hand
                ids = [y if y is not None else learn(w) for w, y in zip(words, ids, strict=True)]
            out.append(b"".join(ids))
        if odd:
            for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
                out[i] = ids
        return out

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            shown = codecs.charmap_decode(piece.encode(), "strict", self.table)[0]
            ids = [t.id for t in self.model.tokenize(shown)]
            known = self.pieces[piece] = struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)
        return known

    def _learn(self, word: str) -> bytes:
        stem = word.rstrip(_MARKS)
        if stem.isalpha():  # a word and the run of marks behind it
            ids = self._piece(word) if len(stem) == len(word) else self._piece(stem) + self._piece(word[len(stem) :])
        else:
            ids = b"".join(map(self._piece, self.find(word)))
        self.words[word] = ids
        return ids


def _byte_table() -> str:
    """A printable character for each byte, as byte-level pre-tokenization writes them."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
