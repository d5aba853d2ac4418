"""Ids of whole texts by word-level BPE files of the ``tokenizers`` library, with each distinct word encoded once.

A file whose normaliser is NFC, white space to one space and lower case, and
whose pre-tokeniser keeps ``'s|'t|'re|'ve|'m|'ll|'d|letters|digit|others``,
encodes every word by itself. So a text's ids are its words' ids joined. The
words of texts within U+0000 to U+024F are found here (NFC leaves them as they
are); all other texts, those that may hold an added token, and files of another
kind go through the library whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from .textvec import CACHES

_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LAST = 0x24F


def _ranges(wanted) -> str:
    """A character class of the code points up to _LAST that are wanted."""
    out, codes = "", [c for c in range(_LAST + 1) if wanted(chr(c))]
    for c in codes:
        if c - 1 not in codes:
            end = c
            while end + 1 in codes:
                end += 1
            out += f"\\u{c:04x}-\\u{end:04x}"
    return out


_L, _N = _ranges(lambda c: unicodedata.category(c)[0] == "L"), _ranges(lambda c: unicodedata.category(c)[0] == "N")
_WORD = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\s{_L}{_N}]+")
#: U+001C to U+001F are white space to Python alone; the lower case of U+0130 is two characters.
_ODD = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]|<\\|")
#: Bytes as the letters of byte-level files: printable ones stand for themselves, others follow from U+0100 on.
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTER = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}
_NORMALS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
MEMORY_BYTES = 48 << 20  # of one generation of a cache, counted with _ENTRY for each entry
_ENTRY = 200
_LONG = 256  # characters; longer strings are worked out anew each time


class WordIds:
    """``ids(text)`` gives the ids of a text as little-endian unsigned 32-bit bytes. Memory is bounded by two generations of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_str(json.dumps(spec))
        self.whole.no_truncation()
        self.whole.no_padding()
        self.added = [x["content"] for x in spec.get("added_tokens", ())]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = (
            (spec.get("normalizer") or {}).get("normalizers") == _NORMALS
            and steps[0].get("pattern", {}).get("Regex") == _PATTERN
            and steps[0].get("behavior") == "Removed"
            and len(steps) == 2
            and steps[1]["type"] == "ByteLevel"
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
            and all(x.startswith("<|") for x in self.added)
            and spec["model"]["type"] == "BPE"
        )
        self.words = Generations(2 * MEMORY_BYTES)

    def library(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(_LETTER)
        ids = [x.id for x in self.whole.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or _ODD.search(text):
            return self.library(text)
        return b"".join(self.words.all(_WORD.findall(text.lower()), self._word))


class Generations:
    """What has been worked out for strings, in memory bounded by bytes: when the newer half is full, the older one is forgotten. Long strings are not kept."""

    def __init__(self, size: int = MEMORY_BYTES):
        self.size, self.used, self.new, self.old = size, 0, {}, {}

    def _cost(self, key: str, value) -> int:
        return _ENTRY + 2 * len(key) + (len(value) if isinstance(value, bytes) else 0)

    def put(self, key: str, value) -> None:
        if len(key) > _LONG:
            return
        self.used += self._cost(key, value)
        if self.used > self.size:
            self.old, self.new, self.used = self.new, {}, self._cost(key, value)
        self.new[key] = value

    def all(self, keys: list[str], work) -> list:
        out = list(map(self.new.get, keys))
        if None not in out:
            return out
        for i in [i for i, value in enumerate(out) if value is None]:
            key = keys[i]
            value = self.new.get(key)
            if value is None:
                value = self.old.get(key)
                if value is None:
                    value = work(key)
                self.put(key, value)
            out[i] = value
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, until it gets a task of another operator."""
    return WordIds(path)


CACHES["word_ids"] = word_ids.cache_clear
