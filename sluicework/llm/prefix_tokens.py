"""Token counts at every prefix of a text, by dynamic programming over byte-level BPE.

The encoding of a prefix ends with one token t, and what stands before t is the
encoding of a shorter prefix whose last token forms a valid pair with t: one
that the file's merges leave as it is. So

    last[i] = the token t that ends at i and forms a valid pair with last[i - |t|]
    count[i] = count[i - |t|] + 1

gives the exact count of every prefix in one pass, without encoding again.
Whether a pair is valid is asked of the library's merges once a pair. Words
repeat, so the counts of a string are kept and the counts of a text are sums of
those of its strings. ``budgets`` needs the total of each pre-token alone, but
around the place where the budget ends, where all counts are looked at.

A prefix that ends inside a run of white space, a contraction or a special
token is split otherwise than the whole text is; those places are corrected, so
``count[k]`` is what the library gives for ``text[:k]`` for every k.

Defined results. A null or empty text has no prefixes and 0 tokens. Special
strings in a text count as the library's default has it: one token. Repeated
rows are counted each, an empty table gives an empty result, and columns of the
caller are kept as they are; one that is named like an output gets underscores
before its name. Very long texts are counted whole, and what is remembered of
strings and pairs is bounded by bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .shared import kept, table
from .textvec import blocks
from .word_tokens import _L, _LETTER, _N, _ODD, Generations

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512
BLOCK_BYTES = 1 << 20
_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")
_CROSSING = re.compile(r"\s ")
_PAIRS = 800_000
_STRING_BYTES = 80 << 20
_TOTAL_BYTES = 120 << 20


def _space(sign: str) -> bool:
    """As the library has it: U+001C to U+001F are none."""
    return sign.isspace() and not "\x1c" <= sign <= "\x1f"


class PrefixCounter:
    """``counts(text)``: int32 array with the number of tokens of text[:1], text[:2] and so on."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without a normaliser is needed")
        self.library = Tokenizer.from_str(json.dumps(spec))
        self.model = self.library.model
        self.specials = [x["content"] for x in spec.get("added_tokens", ())]
        self.special = re.compile("|".join(re.escape(x) for x in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        byte = {c: b for b, c in _LETTER.items()}
        self.vocabulary = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.specials}
        self.letters = {i: t.decode("latin-1").translate(_LETTER) for t, i in self.vocabulary.items()}
        self.longest = max(map(len, self.vocabulary))
        self.pairs: dict[int, bool] = {}
        self.pieces, self.strings = Generations(_STRING_BYTES), Generations(_STRING_BYTES)
        self.totals = Generations(_TOTAL_BYTES)
        self.state: tuple[bytes, list[int], list[int], list[int]] = (b"", [-1], [0], [0])

    def _valid(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens, or with left -1 the right one alone, as they are."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= _PAIRS:
                self.pairs.clear()
            whole = [right] if left < 0 else [left, right]
            known = self.pairs[key] = [x.id for x in self.model.tokenize("".join(self.letters[x] for x in whole))] == whole
        return known

    def _bytes(self, data: bytes) -> list[int]:
        """The dynamic program over one pre-token: 0, then the counts at the ends of its bytes.

        What the piece before shares with this one from the start is not done again.
        """
        token_of, known, longest = self.vocabulary.get, self.pairs.get, self.longest
        before, last, count, begin = self.state
        shared, most = 0, min(len(before), len(data))
        while shared < most and before[shared] == data[shared]:
            shared += 1
        del last[shared + 1 :], count[shared + 1 :], begin[shared + 1 :]
        for end in range(shared + 1, len(data) + 1):
            # one token alone is right, so the likely places are looked at first: the last token one byte longer, then the shortest
            likely = start = begin[end - 1]
            token = token_of(data[start:end])
            if token is not None:
                left = last[start]
                valid = known(left << 32 | token)
                if valid if valid is not None else self._valid(left, token):
                    last.append(token)
                    count.append(count[start] + 1)
                    begin.append(start)
                    continue
            for start in chain(range(end - 1, likely, -1), range(likely - 1, max(0, end - longest) - 1, -1)):
                token = token_of(data[start:end])
                if token is None:
                    continue
                left = last[start]
                valid = known(left << 32 | token)
                if valid if valid is not None else self._valid(left, token):
                    last.append(token)
                    count.append(count[start] + 1)
                    begin.append(start)
                    break
        self.state = data, last, count, begin
        return count

    def _piece(self, piece: str) -> bytes:
        """The counts at the ends of the characters of one pre-token."""
        data = piece.encode()
        count = self._bytes(data)
        if len(data) == len(piece):
            return array("i", count[1:]).tobytes()
        ends = [i for i in range(1, len(data)) if data[i] & 0xC0 != 0x80]
        return array("i", [count[i] for i in (*ends, len(data))]).tobytes()

    def _total(self, piece: str) -> int:
        return self._bytes(piece.encode())[-1]

    def learn(self, texts: list[str]) -> None:
        """Works out what is new in ordinary texts, its pieces in sorted order, in which neighbours share most."""
        strings, pieces = self.strings, self.pieces
        new: set[str] = set()
        for t in texts:
            if not _ODD.search(t):
                new.update(t.split(" "))
        new.difference_update(strings.new)
        split = {x: _PIECE.findall(" " + x) for x in new if x not in strings.old}
        unknown = {p for ps in split.values() for p in ps}
        unknown.difference_update(pieces.new)
        pieces.all(sorted(unknown), self._piece)
        for x, ps in split.items():
            strings.put(x, self._string_of(x, ps))

    def _split(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _PIECE.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    @staticmethod
    def _joined(values: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        out = np.frombuffer(b"".join(values), np.int32).copy()
        end = np.cumsum(size)
        total = np.cumsum(out[end - 1], dtype=np.int32)
        if len(total) > 1:
            out[size[0] :] += np.repeat(total[:-1], size[1:])
        return out

    def _general(self, text: str) -> np.ndarray:
        return self._counts_of(self._split(text))

    def _counts_of(self, pieces: list[str]) -> np.ndarray:
        out = self._joined(self.pieces.all(pieces, self._piece))
        at, before = 0, 0
        for i, piece in enumerate(pieces):
            total = int(out[at + len(piece) - 1])
            if len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                one, two = (np.frombuffer(x, np.int32)[-1] for x in self.pieces.all(["'", piece[1]], self._piece))
                out[at + 1] = before + one + two
            if i and _space(piece[0]) and _space(pieces[i - 1][-1]) and (len(piece) == 1 or not _space(piece[-1])):
                run, start = pieces[i - 1] + piece[0], at - len(pieces[i - 1])
                out[at] = base + np.frombuffer(self.pieces.all([run], self._piece)[0], np.int32)[-1]
            base, before, at = before, total, at + len(piece)
        return out

    def _ordinary(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if _CROSSING.search(text) or _ODD.search(text):
            return self._general(text)
        first, *rest = text.split(" ")  # no run of white space crosses a part, so parts are independent
        values = self.strings.all(rest, self._string)
        return self._joined([self._general(first).tobytes(), *values] if first else values)

    def _string(self, string: str) -> bytes:
        return self._string_of(string, _PIECE.findall(" " + string))

    def _string_of(self, string: str, pieces: list[str]) -> bytes:
        if len(pieces) > 2 or any(len(p) == 3 and p[0] == "'" for p in pieces) or _space(pieces[-1][0]) and len(pieces) > 1:
            return self._general(" " + string).tobytes()
        values = self.pieces.all(pieces, self._piece)
        if len(values) == 1:
            return values[0]
        first, second = array("i", values[0]), array("i", values[1])
        base = first[-1]
        first.extend([base + x for x in second])
        return first.tobytes()

    def counts(self, text: str) -> np.ndarray:
        if not self.special or not (found := self.special.search(text)):
            return self._ordinary(text)
        out, base, at = [], 0, 0
        while found:
            head = text[at : found.start()]
            out.append(self._ordinary(head + found[0][:-1]) + np.int32(base))
            base += (int(self._ordinary(head)[-1]) if head else 0) + 1
            out.append(np.array([base], np.int32))
            at = found.end()
            found = self.special.search(text, at)
        out.append(self._ordinary(text[at:]) + np.int32(base))
        return np.concatenate(out)

    def budgets(self, texts: list[str], budget: int) -> tuple[list[int], list[int]]:
        """The number of tokens of each text, and of how many characters its longest prefix of at most ``budget`` tokens is."""
        n, fits = [], []
        split = [None if self.special and self.special.search(x) else self._split(x) for x in texts]
        unknown = set().union(*filter(None, split)).difference(self.totals.new)
        self.totals.all(sorted(unknown), self._total)  # neighbours in sorted order share most
        for text, pieces in zip(texts, split, strict=True):
            if pieces is None:
                counts = self.counts(text)
                n.append(int(counts[-1]))
                fits.append(self._within(counts, budget))
                continue
            totals = self.totals.all(pieces, self._total)
            n.append(sum(totals))
            fits.append(len(text) if n[-1] <= budget else self._fits(pieces, totals, budget))
        return n, fits

    @staticmethod
    def _within(counts: np.ndarray, budget: int) -> int:
        found = np.flatnonzero(counts <= budget)
        return int(found[-1]) + 1 if len(found) else 0

    def _fits(self, pieces: list[str], totals: list[int], budget: int) -> int:
        """The longest prefix within the budget of a text that is not. It ends in the last piece that begins below the budget,
        or at the first character of the next, where a run of white space may count less than its pieces do."""
        ends = list(accumulate(totals[: max(budget, 0) + 1]))  # a piece has one token at least
        last = bisect_left(ends, budget)
        first = max(0, last - 2)
        found = self._within(self._counts_of(pieces[first : last + 2]), budget - (ends[first - 1] if first else 0))
        if first and found <= len(pieces[first]):
            return self._within(self._counts_of(pieces), budget)
        return sum(map(len, pieces[:first])) + found


@lru_cache(maxsize=2)
def prefix_counter(path: str) -> PrefixCounter:
    """One for each Python worker."""
    return PrefixCounter(path)


def _mapped(docs: DataFrame, path: str, keep: list[str], text: str, schema: str, answer) -> DataFrame:
    """The columns ``keep`` with those of ``schema``, which ``answer`` makes of the counter and a block's texts."""
    outputs = [x.split()[0] for x in schema.split(", ")]
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        counter = prefix_counter(path)
        for block in blocks(batches, BLOCK_BYTES):
            texts = [x or "" for x in block.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns[1:], *answer(counter, texts)], names=[*names, *outputs])

    renamed = docs.select(F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    own = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    return renamed.mapInArrow(run, f"{own}, {schema}").toDF(*kept(keep, outputs), *outputs)


def prefix_counts(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with prefix_counts: array<int>, entry k the tokens of the first k characters."""

    def whole(counter, texts):
        counter.learn(texts)
        counts = [counter.counts(x) for x in texts]
        at = np.concatenate(([0], np.cumsum([len(c) for c in counts]))).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(counts)))]

    return _mapped(docs, path, keep, text, "prefix_counts array<int>", whole)


def budgets(docs: DataFrame, path: str, keep: list[str], budget: int, text: str = "text") -> DataFrame:
    """The columns ``keep`` with n_tokens and fits, the longest prefix in characters of at most ``budget`` tokens.

    The questions are asked where the counts are made, so these don't leave the task.
    """

    def asked(counter, texts):
        return [pa.array(x, pa.int64()) for x in counter.budgets(texts, budget)]

    return _mapped(docs, path, keep, text, "n_tokens long, fits long", asked)


def tokens_of(counts: Column, characters: Column | int | None = None) -> Column:
    """Tokens of the first ``characters`` characters, or of the whole text."""
    at = F.size(counts) if characters is None else F.least(F.lit(characters), F.size(counts))
    return F.when(at > 0, F.get(counts, at - 1)).otherwise(0).cast("long")


def longest_within(counts: Column, budget: Column | int) -> Column:
    """The longest prefix, in characters, of at most ``budget`` tokens."""
    return F.coalesce(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i + 1))), F.lit(0))


def op8_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = budgets(docs, public_tokenizers.path(TOKENIZER), ["doc_id", "n_bytes"], TOKEN_LIMIT)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fits")
