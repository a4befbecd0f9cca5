"""Jaccard self-join of documents on word n-grams, by PartEnum signatures.

A document's set holds its distinct runs of ``size`` words, hashed to 64 bits;
hashes are uniform, so equal ranges of hash values partition the feature domain.
Sets are banded by size (powers of two). A pair that reaches the threshold is in
one band or in neighbouring ones and differs in at most k features, k known for
the band. The domain is cut into more than k/2 first-level parts, so some part
holds at most one difference; each part is cut into three, and every two of the
three make a signature: one of them holds no difference, and both sets share it.
Empty signatures say nothing and are left out. A set with so many of them that
sharing is no longer certain also emits a prefix (its first features in a fixed
order, enough for any partner to share one).

Pairs are found in steps, so that no group is expanded to all its pairs:

1. Each group of equal signatures links its members to its smallest document
   only; equal signatures within a task are joined there, before the shuffle.
   A document's candidate with most shared signatures is verified on whole sets,
   unless they are too few to be likely, and verified links give components.
2. Components that likely candidates still connect go through another round of
   stars, with several hubs chosen by hash.
3. Groups that span several components are settled exactly. A linked partner
   shares a known number of signatures, the slack. Groups of few components give
   pairs of components. A component with fewer signatures in larger groups (a
   passage that many documents share) than its slack cannot miss a partner by
   leaving those out. For the others, features in more than ``common`` components
   are left out of the partition: a difference count over fewer features is no
   larger, so the guarantee holds, and signatures of the rest give pairs.
4. Jaccard distance is a metric: two documents can only be linked if the distance
   of their components' first documents is at most their own distances to those
   plus the limit. Members of components that this leaves open meet block by block;
   parities of hashed features rule out most pairs, and others are verified.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.components import components
from twofold.llm.text import bucket_count, chunks, deal, group_starts, lower_words, mix, sieve, undeal, window_hashes, word_hashes
from twofold.sources.tables import stage

_SUBSETS = 3
_WIDTH = 5
_LIKELY = 50
_PARITY_BITS = 11
_MARK_BITS = 8
_BLOCK_FEATURES = 400_000
_CHUNK_CHARS = 3_000_000
_BUCKET_CHARS = 7_000_000
_PREFIX = np.uint64(0xD6E8FEB86659FD93)
_ENTRY = "bucket int, kind int, ids binary, per binary, upper binary"


def features(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; a shorter text is one n-gram, an empty one has none."""
    tokens = lower_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(word_hashes(tokens), min(size, len(tokens))))


@lru_cache(maxsize=1024)
def _cuts(parts: int) -> np.ndarray:
    n = parts * _SUBSETS
    return np.array([(i * 2**64) // n for i in range(1, n)], np.uint64)


@lru_cache(maxsize=1024)
def _salts(parts: int, tag: int) -> np.ndarray:
    salt = np.arange(parts, dtype=np.uint64)[:, None] * np.uint64(_SUBSETS) + np.arange(_SUBSETS, dtype=np.uint64)
    return mix(salt + np.uint64(tag << 40))


@lru_cache(maxsize=4096)
def _tags(s: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(tag, differences allowed for, differences a set of size s can have) of a size's bands."""

    def most(a: int, b: int) -> int:
        return (den - num) * (a + b) // (den + num)

    band = s.bit_length() - 1
    low, high, partner = 1 << band, (2 << band) - 1, s * den // num
    out = [(2 * band, most(high, high), most(s, min(high, partner)))]
    if partner > high:
        out.append((2 * band + 1, most(high, high * den // num), most(s, partner)))
    if band and s <= (low - 1) * den // num:
        out.append((2 * band - 1, most(low - 1, (low - 1) * den // num), most(s, low - 1)))
    return out


def _least_shared(parts: int, differences: int) -> int:
    """Fewest signatures that two sets share: a part's first difference costs two of its three, a second one the last."""
    return max(_SUBSETS * parts - 2 * differences, 2 * parts - differences, 0)


def signatures(f: np.ndarray, s: int, num: int, den: int) -> tuple[np.ndarray, int]:
    """PartEnum signatures of a set of size ``s`` over the features ``f`` (all of them, or the rarer ones), and its slack.

    A linked partner shares at least ``slack`` of them. Where that count falls
    below one, a prefix in order of hashes is added, and with it the slack is one
    again if the partner does the same.
    """
    sums = np.zeros(len(f) + 1, np.uint64)
    np.cumsum(mix(f ^ _PREFIX), out=sums[1:])
    out, slack = [], 1 << 30
    for tag, k, own in _tags(s, num, den):
        parts = k // 2 + 2 + max(1, k // 16)
        at = np.zeros(parts * _SUBSETS + 1, np.intp)
        at[1:-1], at[-1] = f.searchsorted(_cuts(parts)), len(f)
        below = sums[at]
        sub, n = (below[1:] - below[:-1]).reshape(parts, _SUBSETS), (at[1:] - at[:-1]).reshape(parts, _SUBSETS)
        ends = below[:: _SUBSETS], at[:: _SUBSETS]
        sig, some = (ends[0][1:] - ends[0][:-1])[:, None] - sub, (ends[1][1:] - ends[1][:-1])[:, None] > n
        out.append(mix(sig ^ _salts(parts, tag))[some])
        full = int(np.count_nonzero(some[:, 0] & some[:, 1] & some[:, 2]))
        slack = min(slack, max(full - own // 2, _least_shared(parts, own) - some.size + len(out[-1])))
    if slack < 1:
        out.append(mix(f[: _prefix(s, num, den)] + _PREFIX))
    return np.concatenate(out), max(slack, 0)


def _prefix(s: int, num: int, den: int) -> int:
    """First features of a set of size ``s`` of which a linked partner has one, in any order both sets follow."""
    return s - -(-num * s // den) + 1


def sets_and_stars(docs: DataFrame, size: int, num: int, den: int, buckets: int) -> DataFrame:
    """One pass over the texts: rows (a, null, size, slack, digest) of sets and (a, b, shared, null, null) of star candidates.

    A set's digest has 128 bits; an empty set has none. A candidate pairs each
    member b of a signature group with the group's smallest document a.
    """

    def entries(batches):
        for pdf in chunks(batches, _CHUNK_CHARS):
            pdf = pdf.sort_values("doc_id")
            ids = pdf["doc_id"].to_numpy(np.int64)
            sets = [features(t, size) for t in pdf["text"]]
            n = np.array([len(f) for f in sets], np.int64)
            digests = b"".join(xxhash.xxh3_128_digest(f.tobytes()) for f in sets)
            some, slack, rows = np.flatnonzero(n), np.zeros(len(n), np.int64), []
            if len(some):
                per, slack[some] = zip(*(signatures(sets[i], len(sets[i]), num, den) for i in some))
                keys, owners = np.concatenate(per), np.repeat(some, [len(k) for k in per])
                keep, hub, member = _stars(keys, owners, owners, None)
                rows += [(b, 0, *blobs) for b, *blobs in deal(keys[keep], owners[keep], ids, buckets, _WIDTH)]
                rows.append(_pair_row(ids[hub], ids[member], buckets))
            rows.append((int(ids[0] % buckets), 2, ids.tobytes(), np.stack([n, slack], 1).tobytes(), digests))
            yield pd.DataFrame(rows, columns=["bucket", "kind", "ids", "per", "upper"])

    def join(pdf):
        local, sent, sets = (pdf[pdf["kind"] == k] for k in (1, 0, 2))
        owner, key = undeal(sent["ids"], sent["per"], sent["upper"], _WIDTH)
        _, hub, member = _stars(key, owner, owner, None)
        pairs = _counted(hub, member, local)
        ids, (n, slack) = np.frombuffer(b"".join(sets["ids"]), np.int64), np.frombuffer(b"".join(sets["per"]), np.int64).reshape(-1, 2).T
        raw = b"".join(sets["upper"])
        digest = [raw[16 * i : 16 * i + 16] if k else None for i, k in enumerate(n)]
        out = pd.DataFrame({"a": ids, "b": pd.array([None] * len(ids), "Int64"), "n": n, "slack": slack, "set_key": digest})
        return pd.concat([pairs.assign(b=pairs["b"].astype("Int64"), slack=0, set_key=None), out])

    return (
        docs.select("doc_id", "text")
        .mapInPandas(entries, _ENTRY)
        .groupBy("bucket")
        .applyInPandas(join, "a long, b long, n long, slack long, set_key binary")
    )


def _stars(keys: np.ndarray, owners: np.ndarray, order_by: np.ndarray, comps: np.ndarray | None):
    """Entries that stand for their group (in ascending place), and hub and member of the other entries.

    The hub of a group of equal keys is its first by ``order_by``. With ``comps``
    only members of other components than their hub's are given.
    """
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    at = np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(order) else order
    at = at[np.lexsort((order_by[at], keys[at]))]
    start = group_starts(keys[at]) if len(at) else at
    kept = np.ones(len(keys), bool)
    kept[at[start != np.arange(len(at))]] = False
    hub, member = owners[at][start], owners[at]
    far = hub != member
    if comps is not None:
        far &= comps[at][start] != comps[at]
    return np.flatnonzero(kept), hub[far], member[far]


def _pair_counts(hub: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and how often each occurs."""
    order = np.lexsort((member, hub))
    a, b = hub[order], member[order]
    fresh = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, int)
    return a[fresh], b[fresh], np.diff(np.r_[fresh, len(a)]).astype(np.int64)


def _pair_row(hub: np.ndarray, member: np.ndarray, buckets: int) -> tuple:
    a, b, count = _pair_counts(hub, member)
    at = int(a[0] % buckets) if len(a) else 0
    return at, 1, a.tobytes(), b.tobytes(), count.tobytes()


def _counted(hub: np.ndarray, member: np.ndarray, local: pd.DataFrame) -> pd.DataFrame:
    """(a, b, n) of a bucket's pairs and of those that tasks found before the shuffle."""
    found = _pair_counts(hub, member)
    cols = [np.frombuffer(b"".join(local[c]), np.int64) for c in ("ids", "per", "upper")]
    return pd.DataFrame({c: np.r_[x, y] for c, x, y in zip(("a", "b", "n"), found, cols)})


def overlaps(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, num: int, den: int, sized: bool = True, per_task: int = 500) -> DataFrame:
    """(a, b, na, nb, both) of pairs (a, b): set sizes and size of the intersection of whole sets.

    With ``sized``, pairs whose sizes alone rule out a link are left out. Equal
    digests need no texts. Else b's text goes to the task that holds a's; an a with
    many partners is repeated, once for every ``per_task`` of them.
    """
    spark = docs.sparkSession
    side = sets.where("n > 0").select("doc_id", "n", "set_key").distinct()
    known = (
        pairs.select("a", "b")
        .distinct()
        .join(side.toDF("a", "na", "ka"), "a")
        .join(side.toDF("b", "nb", "kb"), "b")
        .withColumn("same", F.col("ka") == F.col("kb"))
    )
    if sized:
        known = known.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    known = stage(known.select("a", "b", "na", "nb", "same").distinct(), "pairs")
    alike = known.where("same").select("a", "b", "na", "nb", F.col("na").alias("both"))
    rest = known.where("not same").select("a", "b").distinct()
    total = rest.count()
    if not total:
        return alike
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // per_task)
    salts = rest.groupBy("a").agg(F.ceil(F.count("*") / per_task).alias("salts"))
    dealt = rest.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    routes = dealt.select("a", "salt", F.col("a").alias("doc_id")).distinct().union(
        dealt.select("a", "salt", F.col("b").alias("doc_id"))
    )
    needed = sieve(docs.select("doc_id", "text"), rest.select(F.explode(F.array("a", "b")).alias("doc_id"))).where("maybe").drop("maybe")
    sent = routes.join(needed, "doc_id").withColumn("task", F.pmod(F.xxhash64("a", "salt"), F.lit(groups)))

    def check(pdf):
        out, hubs, last = [], [], None
        a, salt, doc = (pdf[c].to_numpy(np.int64) for c in ("a", "salt", "doc_id"))
        text = pdf["text"].to_numpy()
        for i in np.lexsort((doc != a, salt, a)):
            if (a[i], salt[i]) != last:
                hubs, last = [], (a[i], salt[i])
            f = features(text[i], size)
            if doc[i] == a[i]:
                hubs.append(f)
            else:
                out.extend((a[i], doc[i], len(h), len(f), _common(h, f)) for h in hubs)
        return pd.DataFrame(out, columns=["a", "b", "na", "nb", "both"], dtype="int64")

    schema = "a long, b long, na long, nb long, both long"
    checked = sent.select("task", "a", "salt", "doc_id", "text").groupBy("task").applyInPandas(check, schema)
    return alike.union(checked)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sorted sets have in common."""
    both = np.sort(np.concatenate([x, y]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _linked(found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that reach the threshold."""
    return found.where(F.col("both") * den >= (F.col("na") + F.col("nb") - F.col("both")) * num).select("a", "b")


def hub_candidates(texts: DataFrame, size: int, num: int, den: int, buckets: int, rounds: int) -> DataFrame:
    """(a, b, n, round) pairs of different components: members of signature groups with ``rounds`` hubs chosen by hash.

    ``texts`` has doc_id, comp and text.
    """

    def entries(batches):
        for pdf in chunks(batches, _CHUNK_CHARS):
            ids, comps = pdf["doc_id"].to_numpy(np.int64), pdf["comp"].to_numpy(np.int64)
            per = [signatures(f, len(f), num, den)[0] for f in (features(t, size) for t in pdf["text"])]
            keys, owners = np.concatenate(per), np.repeat(np.arange(len(per)), [len(k) for k in per])
            rows, kept = [], np.empty(0, np.int64)
            for r in range(rounds):
                keep, hub, member = _stars(keys, owners, _place(ids, r)[owners], comps[owners])
                at, _, *blobs = _pair_row(ids[hub], ids[member], buckets)
                rows.append((at, 10 + r, *blobs))
                kept = np.union1d(kept, keep)
            packed = np.rec.fromarrays([ids, comps], names="doc,comp")
            rows += [(b, 0, *blobs) for b, *blobs in deal(keys[kept], owners[kept], np.asarray(packed), buckets, _WIDTH)]
            yield pd.DataFrame(rows, columns=["bucket", "kind", "ids", "per", "upper"])

    def join(pdf):
        sent = pdf[pdf["kind"] == 0]
        pairs_of, key = _undealt_pairs(sent)
        doc, comp = pairs_of
        out = []
        for r in range(rounds):
            _, hub, member = _stars(key, doc, _place(doc, r), comp)
            out.append(_counted(hub, member, pdf[pdf["kind"] == 10 + r]).assign(round=r))
        return pd.concat(out)

    return (
        texts.select("doc_id", "comp", "text")
        .mapInPandas(entries, _ENTRY)
        .groupBy("bucket")
        .applyInPandas(join, "a long, b long, n long, round int")
        .groupBy("a", "b", "round")
        .agg(F.sum("n").alias("n"))
    )


def _place(ids: np.ndarray, r: int) -> np.ndarray:
    """Order of documents in which round r chooses hubs."""
    return mix(ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 * (r + 1) % 2**64))


def _undealt_pairs(sent: pd.DataFrame):
    """Document, component and key of entries whose owners are (document, component)."""
    both = np.frombuffer(b"".join(sent["ids"]), np.int64).reshape(-1, 2)
    per = np.frombuffer(b"".join(sent["per"]), np.uint32)
    _, key = undeal([], [], sent["upper"], _WIDTH)
    return (np.repeat(both[:, 0], per), np.repeat(both[:, 1], per)), key


def _by_component(pdf: pd.DataFrame, keys_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components of a chunk, and distinct keys with the component's place, from ``keys_of(row)``."""
    comps, at = np.unique(pdf["comp"].to_numpy(np.int64), return_inverse=True)
    by: dict[int, list[np.ndarray]] = {}
    for c, row in zip(at, pdf.itertuples(index=False)):
        by.setdefault(int(c), []).append(keys_of(row))
    keys = [np.unique(np.concatenate(by[c])) for c in range(len(comps))]
    return comps, np.concatenate(keys), np.repeat(np.arange(len(comps)), [len(k) for k in keys])


def _distinct_entries(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Component and key of a bucket's entries, each once, in order of key and component."""
    owner, key = undeal(pdf["ids"], pdf["per"], pdf["upper"], _WIDTH)
    order = np.lexsort((owner, key))
    owner, key = owner[order], key[order]
    fresh = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])] if len(owner) else np.empty(0, bool)
    return owner[fresh], key[fresh]


def _group_pairs(comp: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (smaller, larger) of components that share a key, and how many keys they share."""
    place = np.arange(len(key)) - group_starts(key) if len(key) else np.empty(0, int)
    pairs, counts = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    for d in range(1, int(place.max(initial=0)) + 1):
        at = np.flatnonzero(place >= d)
        some, n = np.unique(np.stack([comp[at - d], comp[at]], 1), axis=0, return_counts=True)
        pairs.append(some)
        counts.append(n)
    out, at = np.unique(np.concatenate(pairs), axis=0, return_inverse=True)
    return out, np.bincount(at.ravel(), np.concatenate(counts), len(out)).astype(np.int64)


_BLOBS = "bucket int, ids binary, per binary, upper binary"


def plain_pairs(texts: DataFrame, size: int, num: int, den: int, buckets: int, few: int) -> DataFrame:
    """(a, b, n) pairs of components and groups of at most ``few`` components they share, (a, null, n) counts of larger groups per component.

    ``texts`` has comp and text.
    """

    def entries(batches):
        def keys_of(row):
            f = features(row.text, size)
            return signatures(f, len(f), num, den)[0]

        for pdf in chunks(batches, _CHUNK_CHARS):
            comps, keys, owners = _by_component(pdf, keys_of)
            yield pd.DataFrame(list(deal(keys, owners, comps, buckets, _WIDTH)), columns=["bucket", "ids", "per", "upper"])

    def join(pdf):
        comp, key = _distinct_entries(pdf)
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        large = n[at] > few
        pairs, shared = _group_pairs(comp[~large], key[~large])
        many, count = np.unique(comp[large], return_counts=True)
        out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "n": shared})
        return pd.concat([out.astype({"b": "Int64"}), pd.DataFrame({"a": many, "b": pd.array([None] * len(many), "Int64"), "n": count})])

    return (
        texts.select("comp", "text").mapInPandas(entries, _BLOBS).groupBy("bucket").applyInPandas(join, "a long, b long, n long")
    )


def across_components(texts: DataFrame, size: int, num: int, den: int, buckets: int, common: int) -> DataFrame:
    """(a, b) pairs of components with a signature in common, over features of at most ``common`` components.

    Sets that are made up of widespread features also find partners with which they
    share nothing else, if sizes and numbers of widespread features admit a link.
    Components of one document carry its size and a short parity, which rule out
    pairs. ``texts`` has comp, members (the component's rows) and text.
    """
    low = np.uint64(2 ** (64 - 8 * _WIDTH) - 1)

    def spread(batches):
        for pdf in chunks(batches, _CHUNK_CHARS):
            comps, keys, owners = _by_component(pdf, lambda row: features(row.text, size))
            yield pd.DataFrame(list(deal(keys, owners, comps, buckets, _WIDTH)), columns=["bucket", "ids", "per", "upper"])

    def widespread(pdf):
        owner, key = _distinct_entries(pdf)
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        hot = n[at] > common
        out = pd.DataFrame({"comp": owner[hot], "key": key[hot] | np.uint64(pdf["bucket"].iloc[0])})
        return pd.DataFrame([(c, g.to_numpy().tobytes()) for c, g in out.groupby("comp")["key"]], columns=["comp", "keys"])

    hot = (
        texts.select("comp", "text")
        .mapInPandas(spread, _BLOBS)
        .groupBy("bucket")
        .applyInPandas(widespread, "comp long, keys binary")
        .groupBy("comp")
        .agg(F.collect_list("keys").alias("keys"))
    )
    def entries(batches):
        for pdf in chunks(batches, _CHUNK_CHARS):
            close, sizes, marks = [], [], {}

            def keys_of(row):
                f = features(row.text, size)
                if row.members == 1:
                    marks[row.comp] = np.r_[len(f), _parity(f, _MARK_BITS).view(np.int64)]
                seen = np.zeros(len(f), bool)
                if row.keys_ is not None and len(row.keys_):
                    seen = np.isin((f & ~low) | (f % np.uint64(buckets)), np.frombuffer(b"".join(row.keys_), np.uint64))
                keys, slack = signatures(f[~seen], len(f), num, den)
                left = _prefix(len(f), num, den) - int((~seen).sum())
                if slack < 1 and left > 0:
                    close.append(mix(f[seen][:left] + _PREFIX))
                    sizes.append((row.comp, len(f), int(seen.sum())))
                return keys

            comps, keys, owners = _by_component(pdf, keys_of)
            unmarked = np.zeros(1 + (1 << _MARK_BITS) // 64, np.int64)
            packed = np.array([(c, *marks.get(c, unmarked)) for c in comps], np.int64)
            rows = [(b, 0, *blobs) for b, *blobs in deal(keys, owners, packed, buckets, _WIDTH)]
            if close:
                owners = np.repeat(np.arange(len(close)), [len(k) for k in close])
                rows += [(b, 1, *blobs) for b, *blobs in deal(np.concatenate(close), owners, np.array(sizes, np.int64), buckets, _WIDTH)]
            yield pd.DataFrame(rows, columns=["bucket", "kind", "ids", "per", "upper"])

    def join(pdf):
        pairs = _marked_pairs(pdf[pdf["kind"] == 0], num, den)
        close = pdf[pdf["kind"] == 1]
        if len(close):
            pairs = np.unique(np.concatenate([pairs, _close_pairs(close, num, den)]), axis=0)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return (
        texts.select("comp", "members", "text")
        .join(hot.withColumnRenamed("keys", "keys_"), "comp", "left")
        .mapInPandas(entries, _ENTRY)
        .groupBy("bucket")
        .applyInPandas(join, "a long, b long")
        .distinct()
    )


def _marked_pairs(sent: pd.DataFrame, num: int, den: int) -> np.ndarray:
    """Distinct pairs (smaller, larger) of components that share a key, without those that sizes and parities rule out."""
    marks = np.frombuffer(b"".join(sent["ids"]), np.int64).reshape(-1, 2 + (1 << _MARK_BITS) // 64)
    comps, place = np.unique(marks[:, 0], return_index=True)
    plain = sent.assign(ids=[np.frombuffer(x, np.int64).reshape(-1, marks.shape[1])[:, 0].tobytes() for x in sent["ids"]])
    pairs, _ = _group_pairs(*_distinct_entries(plain))
    a, b = marks[place[np.searchsorted(comps, pairs)]].transpose(1, 0, 2) if len(pairs) else (marks[:0], marks[:0])
    apart = np.bitwise_count(a[:, 2:] ^ b[:, 2:]).sum(1, dtype=np.int64)
    most = (den - num) * (a[:, 1] + b[:, 1]) // (den + num)
    sized = np.minimum(a[:, 1], b[:, 1]) * den >= np.maximum(a[:, 1], b[:, 1]) * num
    return pairs[(a[:, 1] == 0) | (b[:, 1] == 0) | ((apart <= most) & sized)]


def _close_pairs(close: pd.DataFrame, num: int, den: int) -> np.ndarray:
    """Distinct pairs (smaller, larger) of components with sets that share a key and may be linked by widespread features alone.

    Of the owners (component, size, widespread features) of a bucket's entries only
    distinct ones count. Two sets share at most the lesser number of widespread
    features, so each bounds the size of the other; the smaller set's bound is at
    least its own size, and partners are one range of sizes.
    """
    owners = np.frombuffer(b"".join(close["ids"]), np.int64).reshape(-1, 3)
    at = np.repeat(np.arange(len(owners)), np.frombuffer(b"".join(close["per"]), np.uint32))
    _, key = undeal([], [], close["upper"], _WIDTH)
    comp, n, wide = owners[at].T
    most = (num + den) * wide // num - n
    order = np.lexsort((comp, most, n, key))
    comp, n, most, key = comp[order], n[order], most[order], key[order]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (n[1:] != n[:-1]) | (most[1:] != most[:-1]) | (comp[1:] != comp[:-1])]
    comp, n, most, key = comp[fresh], n[fresh], most[fresh], key[fresh]
    span = int(max(n.max(), most.max())) + 1
    group = group_starts(key) * span
    strong = np.flatnonzero(most >= n)
    start = np.searchsorted(group + n, group[strong] + n[strong])
    end = np.searchsorted(group + n, group[strong] + most[strong], "right")
    out = [np.empty((0, 2), np.int64)]
    for i, a, b in zip(strong, start, end):
        other = np.unique(comp[a:b][(most[a:b] >= n[i]) & (comp[a:b] != comp[i])])
        if len(other):
            out.append(np.stack([np.minimum(other, comp[i]), np.maximum(other, comp[i])], 1))
    return np.unique(np.concatenate(out), axis=0)


def _open(edges: DataFrame, labels: DataFrame, needed: DataFrame) -> DataFrame:
    """(comp) of components that may have a partner in another one: ``needed`` (comp, slack) is what they share at least.

    ``edges`` (a, b, n) connect the members of each of n signature groups. A
    component that is in a group with others has an edge that leaves it, so edges
    count at least the signatures that it shares.
    """
    ends = (
        edges.join(labels.toDF("a", "ca"), "a", "left")
        .join(labels.toDF("b", "cb"), "b", "left")
        .select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"), "n")
        .where("ca <> cb")
    )
    shared = ends.select(F.explode(F.array("ca", "cb")).alias("comp"), "n").groupBy("comp").agg(F.sum("n").alias("n"))
    return shared.join(needed, "comp").where("n >= greatest(slack, 1)").select("comp")


def _links_between(texts: DataFrame, sets: DataFrame, size: int, num: int, den: int, buckets: int, few: int, common: int) -> DataFrame:
    """All links between documents of different components; ``texts`` has doc_id, comp and text."""
    found = stage(plain_pairs(texts, size, num, den, buckets, few), "plain")
    shared = found.where("b is not null").groupBy("a", "b").agg(F.sum("n").alias("n"))
    large = found.where("b is null").groupBy(F.col("a").alias("comp")).agg(F.sum("n").alias("large"))
    slack = texts.select("doc_id", "comp").join(sets.groupBy("doc_id").agg(F.min("slack").alias("slack")), "doc_id").groupBy("comp").agg(F.min("slack").alias("slack"), F.count("*").alias("members"))
    known = stage(slack.join(large, "comp", "left").select("comp", "slack", "members", F.coalesce("large", F.lit(0)).alias("large")), "known")
    unsure = known.where("large > 0 and large >= slack").select("comp", "members")
    # Partners share at least the slack of either; pairs that cannot have that many in common are no partners.
    pairs = (
        shared.join(known.drop("members").toDF("a", "sa", "la"), "a")
        .join(known.drop("members").toDF("b", "sb", "lb"), "b")
        .where(F.col("n") + F.least("la", "lb") >= F.greatest("sa", "sb"))
        .select("a", "b")
    )
    if not unsure.isEmpty():
        hard = stage(texts.select("comp", "text").join(unsure, "comp"), "hard")
        pairs = pairs.union(across_components(hard, size, num, den, buckets, common)).distinct()
    pairs = stage(pairs, "across")
    members = stage(texts.select("doc_id", "comp").join(sets.where("n > 0").groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id"), "members")
    many = members.where("doc_id <> comp").select("comp").distinct()
    mixed = pairs.join(many.toDF("a"), "a", "left_semi").union(pairs.join(many.toDF("b"), "b", "left_semi").select("a", "b")).distinct()
    alone = _linked(overlaps(texts, sets, pairs, size, num, den), num, den)

    # Distances of members to their component's first document, and of first documents to each other.
    def distance(found: DataFrame) -> DataFrame:
        d = 1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
        return found.groupBy("a", "b").agg(F.min(d).alias("d"))

    own = members.join(mixed.select(F.explode(F.array("a", "b")).alias("comp")).distinct(), "comp", "left_semi")
    inner = own.where("doc_id <> comp").select(F.col("comp").alias("a"), F.col("doc_id").alias("b"))
    apart = stage(distance(overlaps(texts, sets, inner.union(mixed), size, num, den, sized=False)), "distances")
    at = own.join(apart.toDF("comp", "doc_id", "d"), ["comp", "doc_id"], "left").select("comp", "doc_id", "n", F.coalesce("d", F.lit(0.0)).alias("d"))
    radius = at.groupBy("comp").agg(F.max("d").alias("r"))
    limit = 1 - num / den + 1e-9
    near = (
        mixed.join(apart, ["a", "b"])
        .join(radius.toDF("a", "ra"), "a")
        .join(radius.toDF("b", "rb"), "b")
        .where(F.col("d") - F.col("ra") - F.col("rb") <= limit)
        .select("a", "b", "d")
    )
    return alone.union(_member_links(near, at, texts.select("doc_id", "text"), size, num, den, limit))


def _member_links(near: DataFrame, members: DataFrame, texts: DataFrame, size: int, num: int, den: int, limit: float) -> DataFrame:
    """Links (a, b) between members of components ``near`` (a, b, d) each other: one at least for each linked pair of components.

    ``members`` has comp, doc_id, n and d, the distance to the component's first
    document. The larger component's members are dealt to blocks, and so are the
    members of all its neighbours; each two blocks meet in one task, where distances,
    sizes and the parity of hashed features rule out pairs before sets are compared.
    """
    total = members.groupBy("comp").agg(F.sum("n").alias("total"))
    swap = F.col("tb") > F.col("ta")
    pairs = (
        near.join(total.toDF("a", "ta"), "a")
        .join(total.toDF("b", "tb"), "b")
        .select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("key"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("other"), F.col("d").alias("apart"))
    )
    ours = stage(
        pairs.join(members.withColumnRenamed("comp", "other"), "other").select("key", "other", "apart", "doc_id", "n", "d"), "neighbours"
    )
    blocks = (
        ours.groupBy("key")
        .agg(F.ceil(F.sum("n") / _BLOCK_FEATURES).cast("int").alias("right"))
        .join(total.withColumnRenamed("comp", "key"), "key")
        .select("key", "right", F.ceil(F.col("total") / _BLOCK_FEATURES).cast("int").alias("left"))
    )

    def dealt(rows: DataFrame, own: str, across: str) -> DataFrame:
        at = rows.join(blocks, "key").withColumn(f"{own}_at", F.pmod(F.hash("doc_id"), own))
        at = at.withColumn(f"{across}_at", F.explode(F.sequence(F.lit(0), F.col(across) - 1))).join(texts, "doc_id")
        return at.select("key", "left_at", "right_at", "other", "apart", "doc_id", "d", "text")

    none = F.lit(None)
    left = members.withColumnRenamed("comp", "key").withColumns({"other": none.cast("long"), "apart": none.cast("double")})

    def find(pdf):
        side = pdf["other"].isna().to_numpy()
        doc, d, text = (pdf[c].to_numpy() for c in ("doc_id", "d", "text"))
        x = np.flatnonzero(side)
        sets = [features(t, size) for t in text[x]]
        n, dx = np.array([len(f) for f in sets], np.int64), d[x]
        bits = np.stack([_parity(f) for f in sets]) if len(x) else np.empty((0, 0), np.uint64)
        out, linked = [], set()
        for i in np.flatnonzero(~side):
            other, apart = pdf["other"].iat[i], pdf["apart"].iat[i]
            if other in linked:
                continue
            f = features(text[i], size)
            most = (den - num) * (n + len(f)) // (den + num)
            ok = (apart - dx - d[i] <= limit) & (np.abs(dx - d[i]) <= apart + limit) & (np.minimum(n, len(f)) * den >= np.maximum(n, len(f)) * num)
            ok = np.flatnonzero(ok)
            ok = ok[np.bitwise_count(bits[ok] ^ _parity(f)).sum(1, dtype=np.int64) <= most[ok]]
            for j in ok:
                both = _common(sets[j], f)
                if both * den >= (n[j] + len(f) - both) * num:
                    out.append((int(doc[x[j]]), int(doc[i])))
                    linked.add(other)
                    break
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    met = dealt(left, "left", "right").union(dealt(ours, "right", "left"))
    return met.groupBy("key", "left_at", "right_at").applyInPandas(find, "a long, b long")


def _parity(f: np.ndarray, bits: int = _PARITY_BITS) -> np.ndarray:
    """Bits that tell for each range of hashes whether a set has an odd number of features there; two sets differ in no fewer features than bits."""
    odd = np.bincount((f >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def ngram_components(docs: DataFrame, size: int = 5, num: int = 75, den: int = 100, few: int = 4, common: int = 16, hubs: int = 3) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    Two documents are linked when den * |intersection| >= num * |union| of their
    sets; ``num`` / ``den`` is at least one half. Component: the smallest doc_id
    reachable by links. Null and empty texts have an empty set and no link. Rows
    with the same doc_id count as one document with the links of all its rows;
    rows without doc_id have no component. Columns other than doc_id and text are
    not read. An empty table gives an empty table.
    """
    if 2 * num < den:
        raise ValueError("thresholds below one half would need bands beyond the neighbouring one")
    docs = docs.select("doc_id", "text")
    known = docs.where("doc_id is not null")
    buckets = bucket_count(known, _BUCKET_CHARS)
    found = stage(sets_and_stars(known, size, num, den, buckets), "stars")
    sets = found.where("b is null").select(F.col("a").alias("doc_id"), "n", "slack", "set_key")
    stars = stage(found.where("b is not null").groupBy("a", "b").agg(F.sum("n").alias("n")), "counts")
    sizes = sets.groupBy("doc_id").agg(F.min("n").alias("size"))
    near = stage(stars.join(sizes.withColumnRenamed("doc_id", "b"), "b").where(F.col("n") * _LIKELY >= F.col("size")), "near")
    best = near.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a"))
    first = stage(sets.where("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("first")), "first")
    copies = sets.join(first, "set_key").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = stage(_linked(overlaps(known, sets, best, size, num, den), num, den).union(copies), "links")
    labels = components(links)

    # One document of each distinct set in components that are still open.
    slack = sets.groupBy("doc_id").agg(F.min("slack").alias("slack"))

    def open_texts(labels: DataFrame, likely: DataFrame | None = None) -> DataFrame:
        each = first.select(F.col("first").alias("doc_id")).distinct().join(slack, "doc_id").join(labels, "doc_id", "left")
        at = each.select("doc_id", "slack", F.coalesce("component_id", "doc_id").alias("comp"))
        needed = at.groupBy("comp").agg(F.min("slack").alias("slack"))
        comps = _open(stars, labels, needed)
        if likely is not None:
            comps = comps.join(_open(likely, labels, needed.withColumn("slack", F.lit(0))), "comp", "left_semi")
        left = stage(at.select("doc_id", "comp").join(comps, "comp", "left_semi"), "open")
        return stage(sieve(known, left).where("maybe").join(left, "doc_id").select("doc_id", "comp", "text"), "texts")

    texts = open_texts(labels, near.select("a", "b", "n"))
    if not texts.isEmpty():
        crossed = hub_candidates(texts, size, num, den, buckets, hubs).join(sizes.withColumnRenamed("doc_id", "b"), "b")
        crossed = stage(crossed.where(F.col("n") * _LIKELY >= F.col("size")), "hubs")
        best = crossed.groupBy("b", "round").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b").distinct()
        links = stage(links.union(_linked(overlaps(texts, sets, best, size, num, den), num, den)), "links")
        labels = components(links)
    texts = open_texts(labels)
    if not texts.isEmpty():
        more = stage(_links_between(texts, sets, size, num, den, buckets, few, common), "links")
        if not more.isEmpty():
            labels = components(links.union(more))

    whole = sets.join(labels, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").select("doc_id", "text").mapInPandas(
        lambda batches: (pd.DataFrame({"n_shingles": [len(features(t, size)) for t in p["text"]]}) for p in batches), "n_shingles long"
    )
    none = F.lit(None).cast("long")
    return whole.union(nameless.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))
