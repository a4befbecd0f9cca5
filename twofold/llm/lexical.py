"""Ranked lexical search, term at a time with limited accumulators.

Terms are runs of ASCII letters and digits and of characters from U+0080 on, only
A-Z lower-cased. Items are searched in blocks; a block's terms are the only ones
that are looked for in the documents.

1. One pass writes a forward list per document: its length and the counts of the
   block's terms in it. Sums over these lists give the numbers of documents and
   terms and every term's document frequency.
2. A task turns the lists of a chunk of documents into postings of contributions.
   Each item's terms are taken rarest first. While the largest contributions of
   the terms left, summed, can still reach the k-th best score known (of partial
   scores in the chunk, or of chunks done before), a posting may create an
   accumulator. After that no other document can enter: only accumulators there
   are get what the remaining terms add, exactly. A task returns its best k.
3. The best k of each task are ranked per item, in shares before the whole.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twofold.llm.text import chunks
from twofold.sources.tables import stage

LIMIT = 10
BLOCK_ITEMS = 256
SHARES = 64
PIECE = 1 << 22
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_LISTS = "ids binary, named binary, lengths binary, per binary, terms binary, counts binary"


def terms(text: str | None) -> list[bytes]:
    """UTF-8 terms of a text in order; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def term_counts(text: str | None, vocabulary: dict[bytes, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of terms of a text, and numbers and counts of those in ``vocabulary``; very long texts go piece by piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    n, found, start = 0, [], 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE)
        end = len(raw) if end < 0 else end
        piece = raw[start:end].split()
        n += len(piece)
        found.append(np.fromiter((k for k in map(vocabulary.get, piece) if k is not None), np.int32))
        start = end
    at, count = np.unique(np.concatenate(found) if found else np.empty(0, np.int32), return_counts=True)
    return n, at, count


def forward_lists(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row per chunk of documents: ids, whether there is an id, lengths, and numbers and counts of terms, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded: the terms of one block of items

    def run(batches):
        for pdf in chunks(batches):
            found = [term_counts(t, shared.value) for t in pdf["text"]]
            cols = (
                pdf["id"].to_numpy(np.int64),
                pdf["named"].to_numpy(np.int8),
                np.array([n for n, _, _ in found], np.int64),
                np.array([len(at) for _, at, _ in found], np.int64),
                np.concatenate([at for _, at, _ in found]).astype(np.int32),
                np.concatenate([c for _, _, c in found]).astype(np.int64),
            )
            yield pd.DataFrame([tuple(c.tobytes() for c in cols)], columns=["ids", "named", "lengths", "per", "terms", "counts"])

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("named"), "text")
    return rows.mapInPandas(run, _LISTS)


def statistics(lists: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, all terms, and documents per term of the block."""

    def run(batches):
        docs = total = 0
        df = np.zeros(0, np.int64)
        for pdf in batches:
            for lengths, at in zip(pdf["lengths"], pdf["terms"]):
                n, one = np.frombuffer(lengths, np.int64), np.bincount(np.frombuffer(at, np.int32))
                docs, total = docs + int((n > 0).sum()), total + int(n.sum())
                if len(one) > len(df):
                    df = np.r_[df, np.zeros(len(one) - len(df), np.int64)]
                df[: len(one)] += one
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-2, -1, some], "n": np.r_[docs, total, df[some]]})

    rows = lists.select("lengths", "terms").mapInPandas(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # at most the terms of one block
    return found.pop(-2, 0), found.pop(-1, 0), found


class Postings:
    """Contributions of a chunk's documents by term: documents in ascending place, values, and the largest value."""

    def __init__(self, row, weights: np.ndarray, n_docs: int, n_terms: int):
        lengths = np.frombuffer(row.lengths, np.int64)
        per = np.frombuffer(row.per, np.int64)
        at, tf = np.frombuffer(row.terms, np.int32), np.frombuffer(row.counts, np.int64)
        m = np.array([10 + 90 * int(n) * n_docs // n_terms for n in lengths], np.int64) if n_terms else np.zeros(len(lengths), np.int64)
        doc = np.repeat(np.arange(len(lengths)), per)
        value = weights[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
        order = np.argsort(at, kind="stable")
        self.size = len(lengths)
        self.docs, self.values = doc[order], value[order]
        self.starts = np.searchsorted(at[order], np.arange(len(weights) + 1))
        self.top = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            self.top[some] = np.maximum.reduceat(self.values, self.starts[some])

    def __getitem__(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.starts[term], self.starts[term + 1])
        return self.docs[span], self.values[span]


def best_of_chunk(postings: Postings, by_rarity: np.ndarray, limit: int, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of all documents that can be among the best ``limit`` of an item, given that ``known`` is reached by so many.

    ``by_rarity`` are the item's terms, rarest first.
    """
    rest = np.r_[np.cumsum(postings.top[by_rarity][::-1])[::-1], 0]
    acc, goal, done = np.zeros(postings.size, np.int64), known, 0
    # A document without accumulator can reach rest at most; one that ties with the goal may still win by its id.
    for done, term in enumerate(by_rarity):
        if rest[done] < goal or not rest[done]:
            break
        docs, values = postings[term]
        acc[docs] += values
        if len(docs) and postings.size >= limit:
            goal = max(goal, int(np.partition(acc, -limit)[-limit]))
    else:
        done = len(by_rarity)
    live = np.flatnonzero((acc > 0) & (acc + rest[done] >= goal))
    score = acc[live]
    for term in by_rarity[done:]:
        docs, values = postings[term]
        if len(docs) and len(live):
            at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
            score += np.where(docs[at] == live, values[at], 0)
    return live, score


def _best(ids: np.ndarray, named: np.ndarray, score: np.ndarray, limit: int) -> np.ndarray:
    """Places of the best: by score, then id, those without id last."""
    return np.lexsort((ids, named == 0, -score))[:limit]


def search_block(lists: DataFrame, item_terms: list[np.ndarray], n_terms_known: int, limit: int) -> DataFrame:
    """(item, id, named, score) with at least the best ``limit`` of each item (by place in the block); few rows per task."""
    n_docs, n_all, df = statistics(lists)
    found = np.array([df.get(t, 0) for t in range(n_terms_known)], np.int64)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in found], np.int64)
    order = [t[np.lexsort((t, found[t]))] for t in item_terms]
    order = [t[found[t] > 0] for t in order]
    # Bounded: the terms of one block of items.
    shared = lists.sparkSession.sparkContext.broadcast((weights, order, n_docs, n_all))

    def run(batches):
        weights, order, n_docs, n_all = shared.value
        none = np.empty(0, np.int64)
        best = [(none, none, none)] * len(order)
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                postings = Postings(row, weights, n_docs, n_all)
                ids, named = np.frombuffer(row.ids, np.int64), np.frombuffer(row.named, np.int8)
                for i, by_rarity in enumerate(order):
                    have = best[i]
                    live, score = best_of_chunk(postings, by_rarity, limit, int(have[2][-1]) if len(have[2]) == limit else 0)
                    if len(live):
                        pool = [np.r_[a, b] for a, b in zip(have, (ids[live], named[live], score))]
                        top = _best(*pool, limit)
                        best[i] = tuple(c[top] for c in pool)
        for i, (ids, named, score) in enumerate(best):
            if len(ids):
                yield pd.DataFrame({"item": i, "id": ids, "named": named.astype(bool), "score": score})

    return lists.mapInPandas(run, "item long, id long, named boolean, score long")


def search(docs: DataFrame, items: DataFrame, limit: int = LIMIT, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``limit`` best documents of each item with a score above 0.

    The score sums, over an item's distinct terms, w * ((10^9 * tf) div (1000 * tf
    + 8 * m)) with w = floor(1000 ln((2N + 2) / (2 df + 1))) and m = 10 + (90 n N)
    div L; N counts documents with a term, L all terms, n a document's, df the
    documents that hold the term, tf its occurrences. Equal scores go by doc_id,
    null last. Null and empty texts have no terms; documents without terms and items
    without a known term give no rows. Repeated rows of ``docs`` are documents each;
    rows of one item_id (null is one) are one item with the terms of all. Columns
    other than doc_id, item_id and text are not read. Empty tables give an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    blocks = max(1, -(-items.count() // block_items))
    dealt = items.select("item_id", "text").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        texts: dict[int | None, set[bytes]] = {}
        for r in dealt.where(F.col("block") == block).toLocalIterator():  # about block_items rows
            texts.setdefault(r["item_id"], set()).update(terms(r["text"]))
        names = sorted(texts, key=lambda i: (i is None, i))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))}
        item_terms = [np.array(sorted(vocabulary[t] for t in texts[i]), np.int64) for i in names]
        lists = stage(forward_lists(docs, vocabulary), "forward")
        found = search_block(lists, item_terms, len(vocabulary), limit)
        ids = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "item long, item_id long")
        found = found.join(F.broadcast(ids), "item").drop("item")  # one block of items
        out = found if out is None else out.union(found)
    best = [F.desc("score"), F.desc("named"), "id"]
    shares = out.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "share").orderBy(*best))).where(F.col("rank") <= limit)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(*best))
    ranked = some.withColumn("rank", rank).where(F.col("rank") <= limit)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("named"), F.col("id")).alias("doc_id"), "score")
