"""A stored search index: postings and trigrams in the order of their terms, so that a query reads what it asks for.

Both tables are range-partitioned and sorted by term and chunk. A term's rows lie in few row
groups, which Parquet's statistics find; a term that is everywhere is cut into as many parts
as its rows need. Statistics are stored, so no query counts the corpus.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import search
from skerry.operators.lines import literal_lines
from skerry.runtime import measured_side, shuffle_partitions

_GRAM = 3


def trigrams(chunks: DataFrame) -> DataFrame:
    """(gram, chunk_id): the different runs of three characters in the lower-cased lines of a chunk."""
    text = chunks.where(F.length("content") >= _GRAM).select("chunk_id", F.split(F.lower("content"), "").alias("chars"))
    grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("chars") - _GRAM, F.lit(0))), lambda i: F.concat(*(F.get("chars", i + k) for k in range(_GRAM))))
    rows = text.select("chunk_id", F.explode(F.array_distinct(grams)).alias("gram"))
    return rows.where(~F.contains("gram", F.lit("\n"))).select("gram", "chunk_id").distinct()


class SearchIndex:
    """Postings, terms, trigrams and statistics of chunks in one folder, and the queries on them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._counts: tuple[int, float] | None = None

    def write(self, chunks: DataFrame) -> SearchIndex:
        """Replaces what the folder holds."""
        return self.write_postings(chunks).write_trigrams(chunks)

    def write_postings(self, chunks: DataFrame) -> SearchIndex:
        """Postings, terms, places and statistics. Tokens of over ``search.MAX_TOKEN`` characters have no posting."""
        self._tables, self._counts = {}, None
        n = shuffle_partitions(self.spark)
        ordered = lambda df, *keys: df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        rows = search.postings(chunks).where(F.length("term") <= search.MAX_TOKEN)
        ordered(rows, "term", "chunk_id").write.mode("overwrite").parquet(f"{self.folder}/postings")
        ordered(self._read("postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "term").write.mode("overwrite").parquet(f"{self.folder}/terms")
        end = F.col("start_line") + F.size(F.split("content", "\n", -1)) - 1
        ordered(search.lengths(chunks, end.alias("end_line")), "chunk_id").write.mode("overwrite").parquet(f"{self.folder}/chunks")
        self._read("chunks").agg(F.count("*").alias("n"), F.avg("length").alias("mean")).write.mode("overwrite").parquet(f"{self.folder}/stats")
        return self

    def write_trigrams(self, chunks: DataFrame) -> SearchIndex:
        self._tables.pop("trigrams", None)
        ordered = trigrams(chunks).repartitionByRange(shuffle_partitions(self.spark), "gram", "chunk_id").sortWithinPartitions("gram", "chunk_id")
        ordered.write.mode("overwrite").parquet(f"{self.folder}/trigrams")
        return self

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self._tables[name]

    def _stats(self) -> tuple[int, float]:
        """How many chunks there are, and their mean length."""
        if self._counts is None:
            row = self._read("stats").first()
            self._counts = (row.n, row.mean or 0.0)
        return self._counts

    def terms(self, prefix: str = "") -> DataFrame:
        """(term, df, tf) of the terms that begin with ``prefix``."""
        return self._read("terms").where(F.col("term").startswith(prefix))

    def search(self, query: str, prefix: bool = False) -> DataFrame:
        """(chunk_id, file_id, bm25) as ``search.search_all`` gives it, from the postings of the query's terms."""
        terms = search.query_terms(query)
        rows = self._read("postings")
        if not terms:
            return rows.select("chunk_id", "file_id", F.lit(0.0).alias("bm25")).where(F.lit(False))
        same = [F.col("term").startswith(t) if prefix else F.col("term") == t for t in terms]
        wanted = functools.reduce(Column.__or__, same) if prefix else F.col("term").isin(terms)
        found = rows.where(wanted).groupBy("chunk_id", "file_id", "length").agg(*(F.sum(F.when(c, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, c in enumerate(same)))
        if prefix:  # one row
            found = found.join(F.broadcast(found.agg(*(F.sum(F.when(F.col(f"tf{i}") > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))))), how="inner")
            df = [F.col(f"df{i}") for i in range(len(terms))]
        else:  # as many rows as the query has terms
            known = {r.term: r.df for r in self._read("terms").where(F.col("term").isin(terms)).collect()}
            df = [F.lit(known.get(t, 0)) for t in terms]
        n, mean = self._stats()
        score, held = F.lit(0.0), F.lit(True)
        for i in range(len(terms)):
            score = score + search.bm25(F.col(f"tf{i}"), df[i], F.col("length"), F.lit(n), F.lit(mean))
            held = held & (F.col(f"tf{i}") > 0)
        return found.where(held).select("chunk_id", "file_id", F.round(score, 6).alias("bm25"))

    def ranked(self, query: str, chunks: DataFrame, files: DataFrame, symbols: DataFrame, limit: int) -> DataFrame:
        """Ranked hits as ``search.search_ranked`` gives them; contents are only looked at where the query isn't a single term."""
        low = query.strip().lower()
        places = self._read("chunks").select("chunk_id", "file_id", "start_line", "end_line")
        hits = self.search(query).join(places, ["chunk_id", "file_id"])
        if search.query_terms(query) == [low]:
            hits = hits.withColumn("text_match", F.lit(True))
        else:
            held = literal_lines_chunks(chunks, low).join(measured_side(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
            hits = hits.join(held.withColumn("text_match", F.lit(True)), "chunk_id", "left").withColumn("text_match", F.coalesce("text_match", F.lit(False)))
        return search.ranked_hits(hits.select("chunk_id", "file_id", "start_line", "end_line", "text_match", "bm25"), files, symbols, query, limit)

    def literal_chunks(self, query: str) -> DataFrame | None:
        """(chunk_id) of chunks that have all trigrams of ``query``; None if it is too short or spans lines, and any chunk may hold it."""
        low = query.lower()
        if len(low) < _GRAM or "\n" in low:
            return None
        grams = sorted({low[i : i + _GRAM] for i in range(len(low) - _GRAM + 1)})
        rows = self._read("trigrams").where(F.col("gram").isin(grams))
        return rows.groupBy("chunk_id").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("chunk_id")

    def literal_lines(self, chunks: DataFrame, query: str, exact: bool = False) -> DataFrame:
        """(file_id, chunk_id, line, text) of the lines that hold ``query``; only chunks with all of its trigrams are looked at."""
        some = self.literal_chunks(query)
        rows = chunks if some is None else chunks.join(measured_side(some), "chunk_id", "left_semi")
        return literal_lines(rows, query, exact)


def literal_lines_chunks(chunks: DataFrame, low: str) -> DataFrame:
    """(chunk_id) of chunks whose content holds a lower-cased text."""
    return search.found_chunks(chunks, F.contains(F.lower("content"), F.lit(low))).select("chunk_id").distinct()


def texts_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``hits`` (chunk_id, ...) with the content of their chunks; the hits are counted and broadcast if few."""
    contents = chunks.where("content is not null").select("chunk_id", "content").join(measured_side(hits.select("chunk_id").distinct()), "chunk_id", "left_semi")
    return hits.join(contents.distinct(), "chunk_id")
