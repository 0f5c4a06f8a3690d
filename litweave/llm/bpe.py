"""Exact byte-level BPE of a corpus by dynamic programming over prefixes.

For every prefix of a pre-token exactly one token can be the last of its encoding. An automaton over the vocabulary
yields the tokens that end at a position; the one that is compatible with the last token of the prefix before it is
stored, and the encoding is read off the back-pointers. The work is linear in the length, also for very long
pre-tokens. Pre-tokens repeat, so each worker keeps a bounded cache of them.

Defined results
    * text null or empty: an empty list. Special-token strings are ordinary text. Texts of any length, never cut.
    * repeated doc ids: one row each. Other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litweave.runtime import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Cached pre-tokens a worker, and the length in characters up to which they are cached.
CACHED, CACHED_CHARS = 200_000, 64
#: Characters from which a text is not split at once.
LONG = 1_000_000


class PrefixBPE:
    """Encoder from ranks: {token bytes: id}, ids in order of the merges and single bytes below 256."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for t, i in ranks.items()}
        self.matches = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.matches.add_word(token.decode("latin-1"), i)
        self.matches.make_automaton()
        self.parts: dict[int, tuple[int, int]] = {}
        self.meets: dict[tuple[int, int], bool] = {}
        self.words: dict[str, array] = {}

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: what is left of its bytes before the last merge."""
        if (got := self.parts.get(token)) is None:
            pieces = [bytes([b]) for b in self.bytes_of[token]]
            while len(pieces) > 2:
                rank, at = min((self.ranks.get(pieces[k] + pieces[k + 1], 1 << 60), k) for k in range(len(pieces) - 1))
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
                if rank >= token:
                    raise ValueError(f"token {token} has no merge")
            got = self.parts[token] = (self.ranks[pieces[0]], self.ranks[pieces[1]])
        return got

    def _merge_of(self, a: int, b: int) -> int | None:
        """The token that the pair merges to, if it is that token's own merge."""
        m = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
        return m if m is not None and m > 255 and self.split(m) == (a, b) else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether both stay as they are side by side.

        The merges that made them are undone from the latest to the earliest. While a pair of pieces meets at the
        border, it would merge if its rank came before the merge that ends one of the pieces; of equal ranks the
        left one merges first.
        """
        key = (left, right)
        if (got := self.meets.get(key)) is not None:
            return got
        before, ok = 1 << 60, True  # the pieces meet until the merge of this rank
        a, b = left, right
        while True:
            m = self._merge_of(a, b)
            if m is not None and m < before:
                ok = False
                break
            if a < 256 and b < 256:
                break
            if a > b:
                before, a = a, self.split(a)[1]
            else:
                before, b = b + 1, self.split(b)[0]
        if len(self.meets) > 2_000_000:
            self.meets.clear()
        self.meets[key] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        raw = word.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None and len(raw) == 1:
            return [whole]
        n = len(raw)
        last, length, compatible = [-1] * (n + 1), self.length, self.compatible
        for end, token in self.matches.iter(raw.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - length[token]
            if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                last[end] = token
        out, at = [], n
        while at:
            out.append(last[at])
            at -= length[last[at]]
        out.reverse()
        return out

    def encode(self, text: str | None) -> array:
        """Ids of a text. Pre-tokens of a long text are taken one by one, so that it costs little more than its ids."""
        out = array("i")
        if not text:
            return out
        words = self.words
        found = self.pattern.findall(text) if len(text) <= LONG else (m.group() for m in self.pattern.finditer(text))
        for w in found:
            ids = words.get(w)
            if ids is None:
                ids = array("i", self.encode_word(w))
                if len(w) <= CACHED_CHARS:
                    if len(words) >= CACHED:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: base64 token and rank a line."""
    return {base64.b64decode(t): int(i) for t, i in map(bytes.split, raw.splitlines()) if t}


@cache
def _encoder(raw: bytes) -> PrefixBPE:
    return PrefixBPE(read_ranks(raw))


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, broadcast: its size is fixed (under 1 MB) whatever the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids) of every row. No shuffle unless the input has too few splits to keep the cores busy."""
    raw = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t.as_py()), np.int32) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: tuple[str, ...], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The kept columns with n_tokens, the number of ids of the text."""
    raw = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw.value)
        for batch in batches:
            n = pa.array([len(encoder.encode(t.as_py())) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*keep, "n_tokens"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return spread(df.select(*keep, F.col(text))).mapInArrow(run, f"{kinds}, n_tokens long")
