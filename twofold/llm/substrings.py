"""Removal of repeated passages by suffix automata of reference shards.

A run of ``window`` words is removed from a document if a document with a smaller
doc_id also has it. References are the parts of documents that others repeat:
hashes of all windows, joined within each task before the shuffle and by bucket
after it, name for every repeated window one smaller document that has it. The
parts so named are dealt to shards by reference document. Each shard's task
builds one suffix automaton of its references, in which a state knows the
smallest document it occurs in, and streams the other documents' parts through
it for matching statistics: the longest match ending at each word. Matches of at
least ``window`` words in a smaller document mark the words they cover; hashes
only choose what is streamed. A shard that many documents repeat is sent to
several tasks, each with a share of those documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.text import bucket_count, chunks, deal, group_starts, sieve, undeal, window_hashes, word_hashes, words
from twofold.sources.tables import stage

WINDOW = 13
SHARE_WINDOWS = 200_000
_EVIDENCE = "doc_id long, other long, windows binary"


class SuffixAutomaton:
    """Automaton of all substrings of several sequences, each with an owner; states know their smallest owner."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [1 << 62]

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.owner.append(1 << 62)
        return len(self.length) - 1

    def _split(self, p: int, c, q: int) -> int:
        """Clone q for the strings that p reaches it by."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence, owner: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                last = new
            if owner < self.owner[last]:
                self.owner[last] = owner

    def close(self) -> None:
        """Hand smallest owners down to the suffixes of what they own."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.owner[v] < self.owner[p]:
                self.owner[p] = self.owner[v]

    def covered(self, sequence, window: int, below: int) -> list[tuple[int, int]]:
        """Maximal [start, end) parts made of runs of ``window`` items that occur in an owner smaller than ``below``."""
        out: list[tuple[int, int]] = []
        state = matched = 0
        for i, c in enumerate(sequence, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            while state and self.length[self.link[state]] >= window:
                # A shorter match is enough, and may have a smaller owner.
                if self.owner[state] < below:
                    break
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.owner[state] < below:
                if out and out[-1][1] >= i - window:
                    out[-1] = (out[-1][0], i)
                else:
                    out.append((i - window, i))
        return out


def repeated_windows(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(doc_id, other, windows): hashes of windows of a document that the smaller document ``other`` has too.

    A null ``other`` marks windows for which the document itself is the reference.
    """

    def entries(batches):
        for pdf in chunks(batches):
            pdf = pdf.sort_values("doc_id", kind="stable")
            ids = pdf["doc_id"].to_numpy(np.int64)
            per = [window_hashes(word_hashes(words(t)), window) for t in pdf["text"]]
            keys = np.concatenate(per)
            if not len(keys):
                continue
            owners = np.repeat(np.arange(len(ids)), [len(p) for p in per])
            order = np.argsort(keys, kind="stable")
            start = group_starts(keys[order])
            first = start == np.arange(len(order))
            mine, hub, key = owners[order], owners[order][start], keys[order]
            far = ids[mine] != ids[hub]
            rows = [(b, 0, None, None, *blobs) for b, *blobs in deal(keys[np.sort(order[first])], owners[np.sort(order[first])], ids, buckets)]
            upper = (key >> np.uint64(32)).astype(np.uint32)
            for d, o, w in _grouped(ids[mine[far]], ids[hub[far]], upper[far]):
                rows.append((d % buckets, 1, d, o, None, None, w))
            for d, _, w in _grouped(ids[hub[far]], ids[hub[far]], upper[far]):
                rows.append((d % buckets, 2, d, d, None, None, w))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "doc", "other", "ids", "per", "upper"])

    def join(pdf):
        sent, local = pdf[pdf["kind"] == 0], pdf[pdf["kind"] > 0]
        owner, upper = undeal(sent["ids"], sent["per"], sent["upper"])
        order = np.lexsort((owner, upper))
        owner, upper = owner[order], upper[order]
        hub = owner[group_starts(upper)] if len(owner) else owner
        far, upper = hub != owner, (upper >> np.uint64(32)).astype(np.uint32)
        rows = list(_grouped(owner[far], hub[far], upper[far]))
        rows += [(d, None, w) for d, _, w in _grouped(hub[far], hub[far], upper[far])]
        for k, d, o, w in zip(local["kind"], local["doc"], local["other"], local["upper"]):
            rows.append((int(d), int(o) if k == 1 else None, w))
        out = pd.DataFrame(rows, columns=["doc_id", "other", "windows"])
        return out.astype({"other": "Int64"})

    return (
        docs.select("doc_id", "text")
        .mapInPandas(entries, "bucket long, kind int, doc long, other long, ids binary, per binary, upper binary")
        .groupBy("bucket")
        .applyInPandas(join, _EVIDENCE)
    )


def _grouped(doc: np.ndarray, other: np.ndarray, windows: np.ndarray):
    """(doc, other, windows) for each pair of documents."""
    if not len(doc):
        return
    order = np.lexsort((windows, other, doc))
    doc, other, windows = doc[order], other[order], windows[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]), True]
    cuts = np.flatnonzero(new)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(doc[a]), int(other[a]), np.unique(windows[a:b]).tobytes()


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): word ranges of each document that a document with a smaller doc_id has too.

    ``spans`` is a list of (start, end); documents without such ranges have no
    row. Rows without doc_id take no part. Rows that share a doc_id are one
    document, so they do not repeat each other.
    """
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    spark = docs.sparkSession
    buckets = bucket_count(known)
    evidence = stage(repeated_windows(known, window, buckets), "repeats")

    # Shares of a reference document's users, as many as its repeats call for.
    users = (
        evidence.where("other is not null")
        .groupBy(F.col("other").alias("of"))
        .agg(F.ceil(F.sum(F.octet_length("windows")) / (4 * SHARE_WINDOWS)).cast("long").alias("shares"))
    )
    used = evidence.where("other is not null").join(users.withColumnRenamed("of", "other"), "other")
    parts = used.select("doc_id", "other", F.pmod(F.xxhash64("doc_id"), F.col("shares")).alias("share"), F.lit(1).cast("long").alias("shares"), "windows")
    whole = evidence.where("other is null").join(users.withColumnRenamed("of", "doc_id"), "doc_id")
    refs = whole.select("doc_id", F.lit(None).cast("long").alias("other"), F.lit(0).cast("long").alias("share"), "shares", "windows")
    per_doc = parts.union(refs).groupBy("doc_id").agg(F.collect_list(F.struct("other", "share", "shares", "windows")).alias("items"))

    def cut(batches):
        for pdf in chunks(batches):
            rows = []
            for doc, text, items in zip(pdf["doc_id"], pdf["text"], pdf["items"]):
                tokens = words(text)
                full = window_hashes(word_hashes(tokens), window)
                upper = (full >> np.uint64(32)).astype(np.uint32)
                # Different windows may share these 32 bits; such a one goes to every reference named for them.
                values, often = np.unique(np.unique(full) >> np.uint64(32), return_counts=True)
                shared = np.isin(upper, values[often > 1].astype(np.uint32))
                by: dict[tuple, list[bytes]] = {}
                shares = 1
                for it in items:
                    other = None if pd.isna(it["other"]) else int(it["other"])
                    by.setdefault((other, int(it["share"])), []).append(it["windows"])
                    shares = max(shares, int(it["shares"]))
                free = np.ones(len(upper), bool)
                found = {k: np.isin(upper, np.frombuffer(b"".join(w), np.uint32)) for k, w in by.items()}
                for (other, share), mask in sorted(found.items(), key=lambda x: (x[0][0] is not None, -int(x[1].sum()), x[0][0] or 0)):
                    if other is not None:
                        mask, free = mask & free, free & (~mask | shared)
                    for a, b in _runs(mask):
                        body = b" ".join(tokens[a : b + window - 1])
                        for s in range(shares) if other is None else (share,):
                            rows.append((doc if other is None else other, s, doc, other is None, a, body))
            yield pd.DataFrame(rows, columns=["of", "share", "doc_id", "reference", "start", "body"])

    pieces = sieve(known, evidence.select("doc_id")).where("maybe").join(per_doc, "doc_id").mapInPandas(cut, "of long, share long, doc_id long, reference boolean, start long, body binary")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * buckets)

    def match(pdf):
        known_words: dict[bytes, int] = {}

        def coded(body: bytes) -> list[int]:
            return [known_words.setdefault(w, len(known_words)) for w in body.split(b" ")]

        automaton = SuffixAutomaton()
        refs = pdf[pdf["reference"]]
        for doc, body in sorted(set(zip(refs["doc_id"], map(bytes, refs["body"])))):
            automaton.add(coded(body), doc)
        automaton.close()
        rest = pdf[~pdf["reference"]]
        rows = []
        for doc, start, body in zip(rest["doc_id"], rest["start"], rest["body"]):
            rows.extend((doc, start + a, start + b) for a, b in automaton.covered(coded(bytes(body)), window, doc))
        return pd.DataFrame(rows, columns=["doc_id", "first", "last"], dtype="int64")

    matched = (
        pieces.withColumn("shard", F.pmod(F.xxhash64("of"), F.lit(shards)))
        .groupBy("shard", "share")
        .applyInPandas(match, "doc_id long, first long, last long")
    )
    return matched.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


_RESULT = "doc_id string, n_words long, n_removed long, kept string, kept_sha256 string"


def _kept(rows: DataFrame, with_text: bool) -> DataFrame:
    """Rows (doc_id, text, spans) to words kept and removed."""

    def run(batches):
        for pdf in batches:
            out = []
            for doc, text, spans in zip(pdf["doc_id"], pdf["text"], pdf["spans"]):
                tokens = words(text)
                gone = np.zeros(len(tokens), bool)
                for s in spans if spans is not None else ():
                    gone[s["first"] : s["last"]] = True
                n = int(gone.sum())
                left = b" ".join([w for w, g in zip(tokens, gone) if not g] if n else tokens)
                kept = (left.decode("utf-8", "surrogatepass") if n else text) if with_text else None
                out.append((doc, len(tokens), n, kept, hashlib.sha256(left).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    named = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "spans")
    return named.mapInPandas(run, _RESULT).withColumn("doc_id", F.col("doc_id").cast("long"))


def _with_spans(rows: DataFrame, window: int) -> DataFrame:
    """``rows`` with spans, null where nothing repeats; those rows are not shuffled, by and large."""
    spans = stage(repeated_spans(rows, window), "spans")
    told = sieve(rows, spans)
    few = told.where("maybe").drop("maybe").join(spans, "doc_id", "left")
    return few.unionByName(told.where("not maybe").drop("maybe").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def without_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row of ``docs``; with ``kept``, the text left, if asked for.

    Null and empty texts have no words. A text shorter than the window keeps all
    its words. Rows without doc_id keep all their words and repeat nothing for
    others. Only doc_id and text are read. An empty table gives an empty table. A
    text that loses nothing is kept as it is, others as words joined by a space.
    """
    out = _kept(_with_spans(docs.select("doc_id", "text"), window), with_text)
    return out if with_text else out.drop("kept")


def deduplicated_documents(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents without their repeated passages; one that loses all its words goes.

    Columns are doc_id, text, lang, source and n_chars, of the text that is left.
    """
    rows = _with_spans(docs.select("doc_id", "text", "lang", "source"), window)

    @F.pandas_udf("string")
    def left(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(text, spans):
            tokens = words(t)
            for s in sorted(found, key=lambda s: -s["first"]):
                tokens[s["first"] : s["last"]] = [None] * (min(s["last"], len(tokens)) - s["first"])
            out.append(b" ".join(w for w in tokens if w is not None).decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    cut = rows.where("spans is not null").withColumn("text", left("text", "spans")).where("text <> ''")
    both = rows.where("spans is null").drop("spans").unionByName(cut.drop("spans"))
    return both.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
