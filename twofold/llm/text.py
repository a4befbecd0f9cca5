"""Words and hashes of whole texts, and hashed entries dealt to buckets.

A word is a run of characters other than space and U+0009 to U+000D. Entries
are (64-bit key, owner row) pairs; they travel to reducers as one packed row
per bucket and chunk, so a shuffle of very many small entries moves few rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_CHARS = 6_000_000
BUCKET_CHARS = 14_000_000
LEAST_BUCKETS = 64
SIEVE_BITS = 21

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text; null has none. Bytes split at the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def lower_words(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased and all else unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * _MULTIPLIER + hashes[i : i + n]
    return mix(out)


def word_count(text: Column) -> Column:
    """Number of words, null and empty texts 0, as a plain expression."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks(batches: Iterator[pd.DataFrame], limit: int = CHUNK_CHARS) -> Iterator[pd.DataFrame]:
    """Cut batches with a ``text`` column so that a chunk holds a bounded number of characters."""
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf["text"].str.len().fillna(0).to_numpy(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        for _, at in pdf.groupby(part, sort=True).indices.items():
            yield pdf.iloc[at]


def bucket_count(docs: DataFrame, chars_per_bucket: int = BUCKET_CHARS) -> int:
    """Number of buckets that keeps a bucket's share of the texts bounded, from one pass over lengths."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-total // chars_per_bucket))


def deal(keys: np.ndarray, owners: np.ndarray, ids: np.ndarray, buckets: int, width: int = 6) -> Iterable[tuple[int, bytes, bytes, bytes]]:
    """Pack entries by bucket: (bucket, owner ids, entries per owner, upper ``width`` bytes of the keys).

    ``owners`` are positions in ``ids`` in ascending order. Bucket and upper bytes
    tell keys apart up to rare collisions, which users of the entries verify.
    """
    if not len(keys):
        return
    bucket = (keys % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bucket, owners = bucket[order], owners[order]
    upper = keys[order].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = owners[a:b]
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        per = np.diff(np.r_[starts, b - a]).astype(np.uint32)
        yield int(bucket[a]), ids[own[starts]].tobytes(), per.tobytes(), upper[a:b].tobytes()


def undeal(ids: Iterable[bytes], per: Iterable[bytes], upper: Iterable[bytes], width: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Owner id and upper bytes, as the top of a 64-bit value, of each entry of a bucket."""
    owner = np.repeat(np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(per), np.uint32))
    raw = np.frombuffer(b"".join(upper), np.uint8).reshape(-1, width)
    keys = np.zeros((len(raw), 8), np.uint8)
    keys[:, 8 - width :] = raw
    return owner, keys.view("<u8").ravel()


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Position of the first of its equals, for each element of a sorted array."""
    first = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    return np.maximum.accumulate(np.where(first, np.arange(len(sorted_keys)), 0))


def sieve(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """``docs`` with a boolean ``maybe``: true for every id of ``ids`` and for few others.

    A bitmap of ``SIEVE_BITS`` (one hash per id, 64 bits a row) is broadcast: its
    size is fixed, whatever the number of ids, so a join by id need not shuffle
    texts that it drops anyway. With very many ids it lets more documents through;
    the join that follows decides. Null ids do not pass.
    """
    at = F.pmod(F.xxhash64(column), F.lit(1 << SIEVE_BITS)).cast("int")
    bits = (
        ids.where(F.col(column).isNotNull())
        .select(at.alias("_at"))
        .groupBy(F.shiftright("_at", 6).alias("_word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, _at % 64)")).alias("_bits"))
    )
    joined = docs.withColumn("_at", at).withColumn("_word", F.shiftright("_at", 6)).join(F.broadcast(bits), "_word", "left")
    hit = F.expr("coalesce(shiftrightunsigned(_bits, _at % 64) & 1L = 1L, false)")
    return joined.withColumn("maybe", F.col(column).isNotNull() & hit).drop("_word", "_at", "_bits")
