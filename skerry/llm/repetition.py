"""Repetition inside a document, by a cleaning that goes line by line (problem 9).

Each line is judged by rules of its own: punctuation, navigation, boilerplate, and how
many of its words repeat what the document has said before. What fails is taken out
line by line, and a document that loses too large a share of its words is rejected.

A stretch of words may begin in one line and end in another, so the repetition rule works on
the document's word stream and charges what it finds to the lines. Which lines are
boilerplate is measured on the whole corpus: lines that a given share of documents has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.runtime import spread

STRETCH = 8
SHARE = 0.35
#: Words of documents that are handled together; one longer document is handled alone.
_WORDS_AT_ONCE = 300_000

_words = regex.compile(r"\p{L}+").findall


def _ranked(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def repeated_words(codes: np.ndarray, docs: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """For each word whether it lies in a stretch that also began at an earlier word of its document.

    ``codes`` are the words as numbers, ``docs`` the document of each, equal ones together. Stretches
    are compared exactly: the number of a stretch is the rank of its pair of half stretches.
    """
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    if n < stretch:
        return hit
    ids, length = _ranked(codes), 1
    while length < stretch:
        step = min(length, stretch - length)
        m = len(ids) - step
        ids = _ranked(ids[:m] * (int(ids.max()) + 1) + ids[step : step + m])
        length += step
    inside = docs[: len(ids)] == docs[stretch - 1 :]
    key = ids * (int(docs.max()) + 1) + docs[: len(ids)]
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    again = np.flatnonzero((first[inverse] < np.arange(len(ids))) & inside)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + stretch, -1)
    return np.cumsum(edges[:-1]) > 0


def _measure(texts: list[str | None], stretch: int) -> tuple[list[list[int]], list[list[int]]]:
    """For each text the number of words of its lines and how many of them are repeated."""
    vocabulary: dict[str, int] = {}
    codes: list[int] = []
    per_line: list[list[int]] = []
    sizes = []
    for text in texts:
        counts = []
        before = len(codes)
        # letters only make words, so words never cross the end of a line
        for line in (text or "").lower().split("\n"):
            words = _words(line)
            counts.append(len(words))
            codes += [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        per_line.append(counts)
        sizes.append(len(codes) - before)
    docs = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    hit = repeated_words(np.asarray(codes, dtype=np.int64), docs, stretch)
    ends = np.cumsum([0, *(c for counts in per_line for c in counts)])
    total = np.concatenate([[0], np.cumsum(hit)])
    lost = (total[ends[1:]] - total[ends[:-1]]).tolist()
    per_line_lost = []
    at = 0
    for counts in per_line:
        per_line_lost.append(lost[at : at + len(counts)])
        at += len(counts)
    return per_line, per_line_lost


#: Phrases of site furniture and of notices.
_BOILERPLATE = regex.compile(r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookies?|subscribe|sign (in|up)|log in|click here|read more|share this|lorem ipsum|javascript)\b")
_NAVIGATION = regex.compile(r"^\s*(?:[^|>»·•/]{1,24}\s*[|>»·•/]\s*){2,}[^|>»·•/]{0,24}$")
_SENTENCE_END = regex.compile(r"[.!?…:;。！？”\"'’)\]}]\s*$")
#: Words of a line from which on it can be a sentence, or be told as one that many documents have.
_LEAST_WORDS = 4
#: Share of the characters of a line of prose, blanks left out, that are letters; code has more marks and digits.
_PROSE = 0.85
_BLANK = regex.compile(r"\s+")


def line_fails(line: str, words: int, common: frozenset[int] = frozenset()) -> str | None:
    """The rule that a line with so many words fails, if any; blank lines fail none.

    Navigation is three or more short parts between bars or arrows; boilerplate a short line with a
    phrase of notices, or a line that stands in many documents; punctuation is asked of prose only.
    """
    if not line or line.isspace():
        return None
    if ("|" in line or ">" in line or "»" in line or "·" in line or "•" in line or "/" in line) and _NAVIGATION.match(line):
        return "navigation"
    if len(line) < 200 and _BOILERPLATE.search(line):
        return "boilerplate"
    if words >= _LEAST_WORDS:
        if common and line_key(line) in common:
            return "boilerplate"
        if not _SENTENCE_END.search(line):
            dense = _BLANK.sub("", line)
            if sum(map(str.isalpha, dense)) >= _PROSE * len(dense):
                return "punctuation"
    return None


_DIGITS = regex.compile(r"[0-9]+")


def line_key(line: str) -> int:
    """What a line is compared by between documents: its letters in lower case, with any number alike."""
    return xxhash.xxh3_64_intdigest(_DIGITS.sub("0", line.strip().lower())) - (1 << 63)


#: A line is common if so large a share of the documents has it, and this many at least.
COMMON_SHARE, COMMON_LEAST = 0.002, 10


def common_lines(documents: DataFrame, share: float = COMMON_SHARE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(line, documents) of the lines, by ``line_key``, of four words or more that stand in many documents.

    A document counts once for each of its lines. There can be no more of them than a document has lines on
    average, divided by ``share``, however large the corpus is.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int] = []
            for t in batch.column("text").to_pylist():
                out += {line_key(x) for x in (t or "").split("\n") if len(_words(x)) >= _LEAST_WORDS}
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["line"])

    docs = documents.select(F.col(text).cast("string").alias("text"))
    counts = spread(docs).mapInArrow(keys, "line bigint").groupBy("line").agg(F.count("*").alias("documents"))
    size = docs.agg(F.greatest(F.count("text") * F.lit(share), F.lit(float(COMMON_LEAST))).alias("least"))  # one row
    return counts.join(F.broadcast(size), F.col("documents") >= F.col("least")).select("line", "documents")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch with a bounded number of characters, a row at least."""
    start, held, size = 0, [], 0
    for i in range(batch.num_rows):
        text = batch.column("text")[i].as_py()
        held.append(text)
        size += len(text or "") // 5
        if size >= _WORDS_AT_ONCE or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start), held
            start, held, size = i + 1, [], 0


def _lines_judged(stretch: int, rules: bool, common: frozenset[int], cleaned: bool):
    """Line by line: what the repetition rule takes from each line, and which lines fail another rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _slices(batch):
                counts, repeated = _measure(texts, stretch)
                rows: list[tuple] = []
                for whole, words, again in zip(texts, counts, repeated):
                    n, lost, kept, gone = sum(words), sum(again), [], dict.fromkeys(("navigation", "boilerplate", "punctuation"), 0)
                    if whole is not None and rules:
                        for line, w, r in zip(whole.split("\n"), words, again):
                            rule = None if w and w == r else line_fails(line, w, common)
                            if rule:
                                gone[rule] += w - r
                            elif not w or w != r:
                                kept.append(line)
                    rows.append((0 if whole is None else len(words), n, lost, sum(1 for w, r in zip(words, again) if w and w == r), *gone.values(), "\n".join(kept) if cleaned and whole is not None else None))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.string())],
                    names=["doc_id", "lines", "words", "repeated_words", "repeated_lines", "navigation", "boilerplate", "punctuation", "text"],
                )

    return run


_JUDGED = "doc_id bigint, lines bigint, words bigint, repeated_words bigint, repeated_lines bigint, navigation bigint, boilerplate bigint, punctuation bigint, text string"


def judged_lines(documents: DataFrame, stretch: int = STRETCH, key: str = "doc_id", text: str = "text", rules: bool = True, common: frozenset[int] = frozenset(), cleaned: bool = False) -> DataFrame:
    """Line-first cleaning of each document: how many words each rule takes from its lines.

    (doc_id, lines, words, repeated_words, repeated_lines, navigation, boilerplate, punctuation, text)

    Words are the longest runs of Unicode letters of the lower-cased text. A word is repeated if it
    lies in a stretch of ``stretch`` consecutive words that also began at an earlier word of the same
    document; it is charged to its line, and a line that loses all its words so is gone. Of the other
    lines those that fail a rule of ``line_fails`` are gone too, which takes their words that aren't
    repeated; without ``rules`` only repetition is looked at. ``text`` is what is left, if ``cleaned``.
    Null, empty and word-less texts have no words. Every row gives a row; texts are read whole. A
    document is handled in one task, in memory linear in its words; nothing is exchanged between documents.
    """
    docs = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread(docs).mapInArrow(_lines_judged(stretch, rules, common, cleaned), _JUDGED)


def _share(*taken: str) -> Column:
    return F.when(F.col("words") > 0, sum((F.col(c) for c in taken), F.lit(0)) / F.col("words")).otherwise(0.0)


def repetition_shares(documents: DataFrame, stretch: int = STRETCH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lines, words, repeated_words, repeated_lines, share) of each document, see ``judged_lines``."""
    judged = judged_lines(documents, stretch, key, text, rules=False)
    return judged.select("doc_id", "lines", "words", "repeated_words", "repeated_lines", _share("repeated_words").alias("share"))


def repetitive_documents(documents: DataFrame, share: float = SHARE, stretch: int = STRETCH) -> DataFrame:
    """Documents whose lines lose at least ``share`` of their words to the repetition rule: (doc_id)."""
    lost = repetition_shares(documents, stretch)
    return lost.where((F.col("words") > 0) & (F.col("share") >= share)).select("doc_id")


def clean_lines(documents: DataFrame, max_lost: float = SHARE, stretch: int = STRETCH, key: str = "doc_id", text: str = "text", common_share: float = COMMON_SHARE) -> DataFrame:
    """Line-first cleaning: (doc_id, text, lost, repeated, rejected).

    Lines that fail a rule, that stand in a share of ``common_share`` of all documents, or all of whose
    words are repeated, are removed. ``lost`` is the share of the document's words that went with them or
    are repeated in lines that stay; a document that lost ``max_lost`` or more is rejected, so every
    document of ``repetitive_documents`` is. Null texts stay null; texts without words lose nothing.
    """
    common = frozenset(r.line for r in common_lines(documents, common_share, key, text).toLocalIterator())
    judged = judged_lines(documents, stretch, key, text, common=common, cleaned=True)
    lost = _share("repeated_words", "navigation", "boilerplate", "punctuation")
    return judged.select("doc_id", "text", lost.alias("lost"), _share("repeated_words").alias("repeated"), ((F.col("words") > 0) & (lost >= max_lost)).alias("rejected"))
