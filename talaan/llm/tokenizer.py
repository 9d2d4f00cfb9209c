"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

**Encoding.** A text is cut into pre-tokens by the vocabulary's pattern; merges never cross them. Within a
pre-token the transducer reads one byte at a time:

* For every prefix of a pre-token the last token of its encoding is unique: it is the longest vocabulary
  suffix whose left neighbour, the last token of the remaining prefix, may stand before it. Two tokens may
  stand side by side if merging their joint bytes gives back exactly the two. So the encoding of a
  prefix is a chain of back pointers, and all open chains share a trunk.
* A token is emitted when every position from which a later token could start lies on chains that pass
  through it. A later token starts within the bytes that are still a prefix of some token, so the
  lookahead is bounded by the longest token.
* A state is what is left after emission: the last emitted token, the open bytes, and their chains. States
  and transitions are made when first met and kept in a table; most bytes then cost one lookup. The table
  is emptied when it reaches ``MAX_STATES``, which changes no result.

Finished pre-tokens are remembered in a table with the same kind of bound.

**Decoding.** Token bytes are streamed through an incremental UTF-8 state machine, which holds at most
three pending bytes. Malformed bytes become U+FFFD.

Empty and null texts have the empty list of ids; an empty or null list decodes to the empty text.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("TALAAN_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_STATES = 400_000
MAX_WORDS = 400_000


class Transducer:
    """Encodes with the merges of a rank file (base64 bytes and rank per line)."""

    def __init__(self, vocabulary: str = VOCABULARY, pattern: str = PATTERN):
        import regex

        with open(vocabulary, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: b for b, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.prefixes = {b[:k] for b in self.rank for k in range(1, len(b))}
        self.split = regex.compile(pattern).findall
        self.beside: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        # A state: (last emitted token or -1, open bytes, last token of each open prefix, bytes that may begin a token)
        self.states: list[tuple] = [(-1, b"", (), 0)]
        self.numbers = {self.states[0]: 0}
        self.step: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def _merge(self, word: bytes) -> list[bytes]:
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _may_stand(self, left: int, right: int) -> bool:
        found = self.beside.get((left, right))
        if found is None:
            a, b = self.token[left], self.token[right]
            found = self.beside[left, right] = self._merge(a + b) == [a, b]
        return found

    def _next(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The transition that the table doesn't hold yet: the new state and the tokens it emits."""
        before, data, last, _ = self.states[state]
        data = data + bytes((byte,))
        n = len(data)
        for start in range(max(0, n - self.longest), n):
            right = self.rank.get(data[start:])
            if right is None:
                continue
            left = last[start - 1] if start else before
            if left < 0 or self._may_stand(left, right):
                last = last + (right,)
                break
        else:
            raise ValueError("the vocabulary lacks a single byte")
        begin = next((s for s in range(max(0, n - self.longest + 1), n) if data[s:] in self.prefixes), n)
        # Chains of all ends at which a later token may start; what they share is final.
        shared: list[int] | None = None
        for end in range(begin, n + 1):
            cuts, at = [], end
            while at > 0:
                cuts.append(at)
                at -= len(self.token[last[at - 1]])
            cuts.reverse()
            if shared is None:
                shared = cuts
            else:
                k = 0
                while k < min(len(shared), len(cuts)) and shared[k] == cuts[k]:
                    k += 1
                shared = shared[:k]
            if not shared:
                break
        out = tuple(last[c - 1] for c in shared or ())
        if out:
            gone = shared[-1]
            data, last, before = data[gone:], last[gone:], out[-1]
        new = (before, data, last, n)
        number = self.numbers.get(new[:3])
        if number is None:
            number = self.numbers[new[:3]] = len(self.states)
            self.states.append(new)
            self.step.append({})
        self.step[state][byte] = (number, out)
        return number, out

    def _flush(self, state: int) -> tuple[int, ...]:
        _, data, last, _ = self.states[state]
        out, at = [], len(data)
        while at > 0:
            out.append(last[at - 1])
            at -= len(self.token[out[-1]])
        return tuple(reversed(out))

    def word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        if len(self.states) > MAX_STATES:
            self._clear()
        if len(self.beside) > 4 * MAX_STATES:
            self.beside.clear()
        ids: tuple[int, ...] = ()
        state = 0
        for byte in word:
            found = self.step[state].get(byte)
            state, out = found if found is not None else self._next(state, byte)
            if out:
                ids += out
        return ids + self._flush(state)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; what looks like a special token is ordinary text. Empty and null give []."""
        if not text:
            return []
        ids: list[int] = []
        words = self.words
        for w in self.split(text):
            found = words.get(w)
            if found is None:
                if len(w) > 256:  # long runs aren't remembered
                    ids += self.stream(w.encode("utf-8", "replace"))
                    continue
                if len(words) >= MAX_WORDS:
                    words.clear()
                found = words[w] = self.word(w.encode("utf-8", "replace"))
            ids += found
        return ids

    def stream(self, word: bytes) -> list[int]:
        """``word`` with the output in a list; for pre-tokens of any length."""
        ids: list[int] = []
        state = 0
        for byte in word:
            if len(self.states) > MAX_STATES:
                state = self._keep(state)
            found = self.step[state].get(byte)
            state, out = found if found is not None else self._next(state, byte)
            if out:
                ids += out
        ids += self._flush(state)
        return ids

    def _keep(self, state: int) -> int:
        """Empty the table, but for the state at hand."""
        kept = self.states[state]
        self._clear()
        if kept[:3] == self.states[0][:3]:
            return 0
        self.numbers[kept[:3]] = 1
        self.states.append(kept)
        self.step.append({})
        return 1


class Utf8:
    """An incremental UTF-8 machine: bytes in, characters out; a malformed part becomes U+FFFD.

    The state is the number of continuation bytes still due, the value so far, and the range the next byte
    must be in. The range excludes overlong forms, surrogates and values above U+10FFFF.
    """

    def __init__(self):
        self.due, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out = []
        i = 0
        while i < len(data):
            b = data[i]
            if self.due:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.due -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.due:
                        out.append(chr(self.value))
                    i += 1
                else:
                    out.append("�")
                    self.__init__()
                continue
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.due, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.due, self.value = 2, b & 0x0F
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.due, self.value = 3, b & 0x07
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
            i += 1
        return "".join(out)

    def end(self) -> str:
        left = "�" if self.due else ""
        self.__init__()
        return left


def decode(token: dict[int, bytes], ids: Iterable[int] | None) -> str:
    machine = Utf8()
    parts = [machine.feed(token[int(i)]) for i in (() if ids is None else ids)]
    return "".join(parts) + machine.end()


@lru_cache(maxsize=4)
def transducer(vocabulary: str = VOCABULARY) -> Transducer:
    """One transducer per Python worker and vocabulary."""
    return Transducer(vocabulary)


def encode_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("array<int>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(vocabulary)
        for s in parts:
            yield pd.Series([t.encode(x) for x in s], dtype=object)

    return encode(text)


def count_column(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """How many tokens a text has."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = transducer(vocabulary)
        for s in parts:
            yield pd.Series([len(t.encode(x)) for x in s], dtype="int32")

    return count(text)


def decode_column(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        token = transducer(vocabulary).token
        for s in parts:
            yield pd.Series([decode(token, x) for x in s], dtype=object)

    return text(ids)


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, ``ids`` for every row. Other columns are dropped, so none can clash."""
    return documents.select(F.col(key), encode_column(F.col(text), vocabulary).alias("ids"))
