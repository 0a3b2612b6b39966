"""Encoding a corpus with a public byte-level BPE (problem 7).

The text is split by the tokenizer's pattern and each distinct word is encoded once per
worker by dynamic programming over its prefixes. An automaton over the vocabulary, linked
by longest suffixes, gives all tokens that end at a position. A prefix has exactly one
encoding, hence one last token: the match that is compatible with the last token of the
prefix before it, i.e. for which the merges of the two, put side by side, give the two
back. The last tokens are stored and the ids are read off by following them backwards.
This takes time linear in the word, while merging by rank takes quadratic time in long runs.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.runtime import spread

DEFAULT_VOCABULARY = os.environ.get("SKERRY_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries after which a worker's memories of words and of pairs start afresh.
WORDS_KEPT = 400_000
PAIRS_KEPT = 2_000_000
#: Longer words are encoded but not remembered.
LONGEST_KEPT = 64


class PrefixEncoder:
    """The ids of a text, the same as by merging pairs in the order of ranks."""

    def __init__(self, vocabulary: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(vocabulary, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(PATTERN).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _merged(self, data: bytes) -> list[bytes]:
        """Plain merging by rank, for the few bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, first: int, second: int) -> bool:
        """Whether ``second`` can follow ``first``; ``first`` is -1 at the start of a word."""
        key = (first, second)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            b = self.tokens[second]
            if first < 0:
                known = self._merged(b) == [b]
            else:
                a = self.tokens[first]
                known = self._merged(a + b) == [a, b]
            self.pairs[key] = known
        return known

    def _word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        rank = self.ranks.get(data)
        if rank is not None and self.compatible(-1, rank):
            return [rank]
        n = len(data)
        last = [-1] * (n + 1)  # the last token of each prefix, -2 where none is possible
        size = [0] * (n + 1)
        for k in range(1, n + 1):
            last[k] = -2
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            k = end + 1
            before = last[k - length]
            if last[k] == -2 and before != -2 and self.compatible(before, rank):
                last[k] = rank
                size[k] = length
        if last[n] == -2:
            raise ValueError("the vocabulary has no encoding of some byte")
        ids = []
        k = n
        while k:
            ids.append(last[k])
            k -= size[k]
        ids.reverse()
        return ids

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        if text:
            known = self.words
            for word in self.split(text):
                found = known.get(word)
                if found is None:
                    found = self._word(word)
                    if len(word) <= LONGEST_KEPT:
                        if len(known) >= WORDS_KEPT:
                            known.clear()
                        known[word] = found
                ids += found
        return ids


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> PrefixEncoder:
    return PrefixEncoder(vocabulary)


def _ids_of(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            # a few rows at a time, so that long texts don't add up in memory
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                flat: list[np.ndarray] = []
                offsets = [0]
                for text in part.column("text").to_pylist():
                    ids = encode(text)
                    flat.append(np.asarray(ids, dtype=np.int32))
                    offsets.append(offsets[-1] + len(ids))
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=["doc_id", "ids"])

    return run


def encode_documents(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The ids of each text, without special tokens: (doc_id, ids).

    Null and empty texts give an empty list; blank texts are encoded as they are; strings that
    look like special tokens are ordinary text. Every row gives one row, repeated and null keys
    included. Only the key and the text are read. ``vocabulary`` is the path of a rank file that
    every executor can read.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(docs).mapInArrow(_ids_of(vocabulary), "doc_id bigint, ids array<int>")


def token_counts(documents: DataFrame, columns: list[Column], vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """The given columns and ``n_tokens`` of each row's text, 0 for null and empty ones."""
    docs = documents.select(*columns, F.col(text).cast("string").alias("skerry_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            counts = [len(encode(t.as_py())) for t in batch.column("skerry_text")]
            kept = [batch.column(n) for n in batch.schema.names if n != "skerry_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64())], names=[*(n for n in batch.schema.names if n != "skerry_text"), "n_tokens"])

    kept = [f for f in docs.schema.fields if f.name != "skerry_text"]
    from pyspark.sql.types import LongType, StructField, StructType

    return spread(docs).mapInArrow(run, StructType([*kept, StructField("n_tokens", LongType())]))
