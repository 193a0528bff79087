"""Ranked lexical search by NRA ("no random access") over impact-sorted lists.

A document's score for a query is a sum over the query's terms of weight times impact,
all whole numbers. Each task takes documents in chunks of bounded size and lists, for
every term of the queries, the chunk's documents by falling impact. For a query, the
lists are read from their heads in steps that double. A document's lower bound is what
was read of it; its upper bound adds, for every term not yet read of it, that term's
weight times the impact that comes next in its list. Documents whose upper bound is
below the k-th largest lower bound are given up; reading goes on for the others until
both bounds of each are equal, so membership, ties and scores are final. Lists are read
in order only, never by document.

Chunks are independent. Each gives its k best per query, and the k best of those are the
answer: a document among the k best of all is among the k best of its chunk. Weights and
mean length are those of the whole corpus. No posting is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import LOWER, UPPER, as_bytes, saved, text_or_empty

#: Bytes that end a term: ASCII other than letters and digits (fixed value).
_BREAKS = bytes(b for b in range(0x80) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(UPPER.encode() + _BREAKS, LOWER.encode() + b" " * len(_BREAKS))
#: A chunk ends with the batch that reaches one of these.
CHUNK_DOCS, CHUNK_POSTINGS = 16_384, 4_000_000
#: Queries of one pass over the documents, and entries of each list read in the first step.
QUERIES_AT_ONCE, FIRST_STEP = 2_000, 64
#: Groups in which the best of the chunks are first cut down to k per query.
GROUPS = 64


class Corpus(NamedTuple):
    docs: int  # with a term at least
    terms: int  # of all documents, with repeats


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of letters, digits and all that is not ASCII; only A-Z are lower-cased."""
    return text.translate(_TO_SPACE).split(b" ")


def counted(docs: DataFrame, vocabulary: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n, terms, tfs) of every document: its number of terms, and number and count of each term of `vocabulary` in it."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                n, ends, terms, tfs = [], [0], [], []
                for x in as_bytes(part.column(1)):
                    found = Counter(terms_of(x))
                    found.pop(b"", None)
                    n.append(sum(found.values()))
                    own = [(number[t], found[t]) for t in found.keys() & number.keys()]
                    terms += [t for t, _ in own]
                    tfs += [c for _, c in own]
                    ends.append(len(terms))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_or_empty(text).alias("text"))
    out = rows.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")
    return out.where("n > 0").withColumn("row", F.monotonically_increasing_id())  # unique once it is written


def weight(docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, corpus: Corpus) -> np.ndarray:
    length = 25 + (75 * n * corpus.docs) // corpus.terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * length)


class Lists:
    """A chunk's impact-sorted lists: of term t, `docs` and `impact` from `start[t]` to `start[t + 1]`."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int):
        by = np.lexsort((-impact, term))
        self.docs, self.impact = doc[by], impact[by]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=n_terms))])


def nra(lists: Lists, terms: np.ndarray, weights: np.ndarray, n_docs: int, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) that include the k best of the chunk with a score of `floor` or more; all their scores are final.

    `weights` are those of the distinct `terms`, times their repeats in the query. Documents
    below the k-th best may be returned too, if their bounds reached it.
    """
    ends = lists.start[terms + 1]
    at = lists.start[terms].copy()
    lower = np.zeros(n_docs, np.int64)
    alive, step = np.arange(n_docs), FIRST_STEP
    open_mask = np.ones(n_docs, bool)
    while True:
        for j in range(len(terms)):
            to = min(ends[j], at[j] + step)
            if to > at[j]:
                docs, read = lists.docs[at[j]:to], lists.impact[at[j]:to]
                if len(alive) < n_docs:
                    mine = open_mask[docs]
                    docs, read = docs[mine], read[mine]
                lower[docs] += weights[j] * read  # a document stands in a list once
                at[j] = to
        ahead = [int(weights[j]) * int(lists.impact[at[j]]) if at[j] < ends[j] else 0 for j in range(len(terms))]
        room = np.full(n_docs, sum(ahead), np.int64)
        for j, a in enumerate(ahead):
            if a:  # what was read of a document can add no more
                room[lists.docs[lists.start[terms[j]]:at[j]]] -= a
        low, room = lower[alive], room[alive]
        least = floor
        if len(alive) > k:
            least = max(least, int(np.partition(low, len(low) - k)[len(low) - k]))
        keep = low + room >= least
        open_mask[alive[~keep]] = False
        alive, room = alive[keep], room[keep]
        if not room.any():
            return alive, lower[alive]
        step *= 4


def best(rows: DataFrame, queries: list[tuple[list[int], list[int]]], weights: np.ndarray, corpus: Corpus, k: int) -> DataFrame:
    """(query, row, doc_id, score): the k best of each chunk, `queries` as (terms, repeats) by number."""
    asked = [(np.array(t, np.int64), np.array(r, np.int64) * weights[t]) for t, r in queries]
    asked = [(t[w > 0], w[w > 0]) for t, w in asked]
    n_terms = len(weights)

    def chunk(parts: list[pa.RecordBatch], floors: list[int]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        doc_id, row = t["doc_id"].combine_chunks(), t["row"].to_numpy()
        sizes = np.diff(t["terms"].combine_chunks().offsets.to_numpy())
        doc = np.repeat(np.arange(t.num_rows), sizes)
        term, tf = (np.concatenate([b.column(c).flatten().to_numpy() for b in parts]).astype(np.int64) for c in ("terms", "tfs"))
        lists = Lists(term, doc, impacts(tf, t["n"].to_numpy()[doc], corpus), n_terms)
        order = np.array([2**63 - 1 if x is None else x for x in doc_id.to_pylist()], np.int64)
        query, picked, scores = [], [], []
        for q, (terms, w) in enumerate(asked):
            found, score = nra(lists, terms, w, t.num_rows, k, floors[q])
            top = np.lexsort((row[found], order[found], -score))[:k]
            if len(top) == k:
                floors[q] = max(floors[q], int(score[top[-1]]))
            query.append(np.full(len(top), q))
            picked.append(found[top])
            scores.append(score[top])
        at = np.concatenate([*picked, np.zeros(0, np.int64)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([*query, np.zeros(0)]).astype(np.int32)), pa.array(row[at]), doc_id.take(pa.array(at)),
            pa.array(np.concatenate([*scores, np.zeros(0)]).astype(np.int64)),
        ], names=["query", "row", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        floors = [1] * len(asked)  # k documents of this task reach it
        docs = postings = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(batch)
            docs, postings = docs + batch.num_rows, postings + len(batch.column(3).flatten())
            if docs >= CHUNK_DOCS or postings >= CHUNK_POSTINGS:
                yield chunk(parts, floors)
                parts, docs, postings = [], 0, 0
        if parts:
            yield chunk(parts, floors)

    return rows.select("row", "doc_id", "n", "terms", "tfs").mapInArrow(run, "query int, `row` bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", query: str = "text", doc_id: str = "doc_id", text: str = "text", k: int = 10) -> DataFrame:
    """(`query_id`, rank, doc_id, score): for each row of `queries` the k documents with the highest score above 0.

    Every row of `docs` is a document, also where ids or whole rows repeat; equal scores
    stand by ascending doc_id, null ids last, copies in any order. Null and empty texts
    have no term, rank nowhere and count for nothing; a query without terms, or an empty
    table, gives no row. Long texts count whole. Queries with equal ids are ranked apart.
    Queries go in blocks of about QUERIES_AT_ONCE, each one pass over the documents.
    """
    asked = saved(queries.select(F.col(query_id).alias("id"), text_or_empty(query).alias("text")), "search-queries")
    n_blocks = max(1, math.ceil(asked.count() / QUERIES_AT_ONCE))
    block = F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(n_blocks))
    asked = saved(asked.withColumn("block", block), "search-blocks")
    answers = [_search_block(docs, asked.where(F.col("block") == b), doc_id, text, k) for b in range(n_blocks)]
    out = answers[0]
    for more in answers[1:]:
        out = out.union(more)
    return out.withColumnRenamed("id", query_id)


def _search_block(docs: DataFrame, block: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    listed = block.select("id", "text").collect()  # about QUERIES_AT_ONCE
    counts = [Counter(t for t in terms_of(r.text.encode()) if t) for r in listed]
    vocabulary = sorted(set().union(*counts))
    number = {t: i for i, t in enumerate(vocabulary)}
    rows = saved(counted(docs, vocabulary, doc_id, text), "search-terms")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per term of the queries
    weights = np.array([weight(n, held.get(i, 0)) for i in range(len(vocabulary))], np.int64)
    as_numbers = [([number[t] for t in c], list(c.values())) for c in counts]
    found = best(rows, as_numbers, weights, Corpus(n, max(1, total)), k)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    group = F.pmod(F.xxhash64("row"), F.lit(GROUPS))
    for keys in (["query", "group"], ["query"]):
        found = found.withColumn("group", group).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.id) for i, r in enumerate(listed)], f"query int, id {block.schema['id'].dataType.simpleString()}")
    return found.join(F.broadcast(names), "query").select("id", "rank", "doc_id", "score")
