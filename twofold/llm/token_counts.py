"""Exact token counts of every prefix of a text, by dynamic programming over byte-pair tokens.

For byte-pair merging, the encoding of a prefix is the encoding of a shorter
prefix followed by one token, and that token is the only one that fits: the only
suffix in the vocabulary that stays separate from the token before it. So the
count of a prefix is one more than that of the shorter prefix, and one pass over
a word gives the counts of all its prefixes, in time linear in its length.
Words are independent, because the pattern cuts a text before merging; counts of
a text's prefixes are sums over whole words plus one entry of a word's table.
Tables of words are kept in a bounded cache in each worker.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_WORDS = 400_000
# The vocabulary's word pattern and its special string.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
_CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary file: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Cache(dict):
    """Values made on first use; emptied when it has ``CACHE_WORDS`` entries, long keys are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value


class Pieces:
    """Cuts a text before runs of blanks, where its words end whatever follows, and looks the pieces up."""

    def __init__(self, make):
        self.cut = regex.compile(r"\s*\S+|\s+")
        self.double = regex.compile(r"\s ")
        self.bare = Cache(make)
        self.spaced = Cache(lambda item: make(" " + item))

    def values(self, text: str) -> list:
        if self.double.search(text):
            return list(map(self.bare.__getitem__, self.cut.findall(text)))
        # Only single spaces: pieces are the items between them, each but the first with its space.
        head, *items = text.split(" ")
        return [self.bare[head], *map(self.spaced.__getitem__, items)]


class PrefixCounter:
    """Counts tokens of prefixes for one vocabulary file of the byte-level kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.ids = {raw[t]: i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.ids))
        self.tails = {t[i:] for t in self.ids for i in range(len(t))}
        size = 1 + max(self.ids.values())
        self.left, self.right, self.rank = list(range(size)), list(range(size)), [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = raw[a], raw[b]
            x, y, both = self.ids[a], self.ids[b], self.ids[a + b]
            self.merged[x, y] = rank
            if self.rank[both] < 0:
                self.left[both], self.right[both], self.rank[both] = x, y, rank
        self.words = regex.compile(PATTERN)
        self.blanks = regex.compile(r"\s*")
        self._apart: dict[tuple[int, int], bool] = {}
        self._totals = Cache(lambda w: self.word(w.encode("utf-8", "surrogatepass"))[-1])
        self._pieces = Pieces(lambda p: sum(map(self._totals.__getitem__, self.words.findall(p))))

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of tokens a and b again gives a, b.

        Undo the merges that made the two, last first. At each step the edges that
        face each other must not have had a merge that comes before the one undone.
        """
        found = self._apart.get((a, b))
        if found is not None:
            return found
        x, y, before, answer = a, b, 1 << 60, None
        strict_left = False
        while answer is None:
            rank = self.merged.get((x, y))
            if rank is not None and (rank < before or (strict_left and rank == before)):
                answer = False
            elif self.rank[x] < 0 and self.rank[y] < 0:
                answer = True
            elif self.rank[x] > self.rank[y]:
                before, strict_left, x = self.rank[x], False, self.right[x]
            else:
                before, strict_left, y = self.rank[y], True, self.left[y]
        if len(self._apart) > CACHE_WORDS:
            self._apart.clear()
        self._apart[a, b] = answer
        return answer

    def word(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of one word, by byte, from the empty one on."""
        ids, tails, apart, longest = self.ids, self.tails, self.apart, self.longest
        count, last = [0], [-1]
        for end in range(1, len(word) + 1):
            for start in range(end - 1, max(-1, end - 1 - longest), -1):
                part = word[start:end]
                if part not in tails:
                    break
                token = ids.get(part)
                if token is not None and (start == 0 or apart(last[start], token)):
                    count.append(count[start] + 1)
                    last.append(token)
                    break
        return count

    def total(self, text: str | None) -> int:
        """Tokens of a whole text; a special string counts as one."""
        parts = (text or "").split(SPECIAL)
        return len(parts) - 1 + sum(sum(self._pieces.values(p)) for p in parts)

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of text[:i] for every i from 0 to len(text), each as if the text ended there.

        A special string counts as one token once it is complete and as plain
        characters before that.
        """
        text = text or ""
        out, base = [0], 0
        parts = text.split(SPECIAL)
        for k, part in enumerate(parts):
            tail = SPECIAL[:-1] if k < len(parts) - 1 else ""
            counts = self._plain(part + tail)
            out.extend(base + c for c in counts[1:])
            if k < len(parts) - 1:
                base += counts[len(part)] + 1
                out.append(base)
        return np.array(out, np.int64)

    def _plain(self, text: str) -> list[int]:
        out, base = [0], 0
        for piece in self._pieces.cut.findall(text):
            blank = self.blanks.match(piece).end()
            # A run of blanks is one word while the text ends within it, whatever follows later.
            here = [base + c for c in self._by_char(piece[:blank])[1:]]
            at = 0
            for w in self.words.findall(piece):
                counts = self._by_char(w)
                if w in _CONTRACTIONS:
                    counts[2] = self._totals[w[:1]] + self._totals[w[1:2]]
                for i, c in enumerate(counts[1:], 1):
                    if at + i > blank:
                        here.append(base + c)
                at += len(w)
                base += counts[-1]
            out.extend(here)
        return out

    def _by_char(self, word: str) -> list[int]:
        """Counts of a word's prefixes by character."""
        raw = word.encode("utf-8", "surrogatepass")
        table = self.word(raw)
        if len(raw) == len(word):
            return table
        ends = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
        return [0, *(table[e] for e in ends)]


@lru_cache(maxsize=2)
def counter(name: str) -> PrefixCounter:
    """The counter of a vocabulary file that the job has distributed, one per worker."""
    return PrefixCounter(SparkFiles.get(name))


def distribute(docs: DataFrame, path: str) -> str:
    """Send a vocabulary file to all executors; its name there."""
    context = docs.sparkSession.sparkContext
    name = path.rsplit("/", 1)[-1]
    if name not in {f.rsplit("/", 1)[-1] for f in context.listFiles}:
        context.addFile(path)
    return name


def token_counts(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of ``docs``.

    Null and empty texts have no bytes and no tokens. Repeated rows and rows
    without doc_id are counted like any other. Only doc_id and text are read.
    """
    name = distribute(docs, path)

    def run(batches):
        count = counter(name)
        for pdf in batches:
            yield pd.DataFrame({"n_tokens": [count.total(t) for t in pdf["text"]], "doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"]})

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInPandas(run, "n_tokens long, doc_id string, n_bytes long")
    return counted.select(F.col("doc_id").cast("long"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` rows as (doc_id, text, counts): counts[i] is the token count of the first i characters."""
    name = distribute(docs, path)

    @F.pandas_udf("array<long>")
    def counts(text: pd.Series) -> pd.Series:
        return text.map(counter(name).prefixes)

    return docs.select("doc_id", "text", counts(F.coalesce("text", F.lit(""))).alias("counts"))


def truncated(counted: DataFrame, limit: int) -> DataFrame:
    """Longest prefix of each text whose token count is at most ``limit``, read off ``prefix_counts`` rows.

    Counts may fall as a prefix grows (a merge may close over a boundary), so the
    longest prefix is sought over all of them. Null texts stay null.
    """
    fits = F.expr(f"aggregate(sequence(0, size(counts) - 1), 0, (best, i) -> if(counts[i] <= {int(limit)}, i, best))")
    return counted.select("doc_id", F.substring("text", F.lit(1), fits).alias("text"), F.element_at("counts", fits + 1).alias("n_tokens"))
