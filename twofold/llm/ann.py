"""Nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Vectors are turned by a random rotation, so the first dimensions of a vector are
a fair sample of it. Lists are cells of spherical k-means fitted on a bounded
sample, cut into bands of length; every vector is in one list. Lists are laid out
on shelves of bounded size, a large list on several.

A query probes in two rounds. First the lists that promise most, until they hold
``FIRST_ROWS`` rows: its k-th best there is a floor under its final k-th best.
Then each other list's count, mean and spread along the query say how many of its
members should exceed the floor, and lists are probed in that order until those
left out should hold less than ``miss`` times k of them.

On a shelf, blocks of queries read the turned vectors block of columns by block:
after each block, the inner product so far and the lengths of what is unread give
an estimate with a known spread, and candidates whose estimate is too many spreads
below the query's floor are abandoned. Survivors are scored exactly on the original
vectors in double precision, and each query's best are merged over shelves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twofold.sources.tables import stage

SAMPLE = 20_000
SHELF_ROWS = 4_096
FIRST_ROWS = 1_000
MISS = 0.1
BANDS = (0.5, 0.8, 0.95, 0.99)
BAND_RATIO = 1.25
BLOCK = 16
SPREADS = 3.0
QUERY_BLOCK = 256
FEW = 0.05


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose id and embedding are given, finite in every component and not zero."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & e.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0))


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def upper_tail(z: np.ndarray) -> np.ndarray:
    """Chance that a standard normal value exceeds ``z``, to seven digits."""
    a = np.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = series * np.exp(-0.5 * np.minimum(a, 38.0) ** 2) / math.sqrt(2 * math.pi)
    return np.where(z >= 0, tail, 1 - tail)


class Lists:
    """Cells of spherical k-means, each cut into bands of length."""

    def __init__(self, sample: np.ndarray, cells: int, rounds: int = 8):
        x = np.unique(_unit(sample), axis=0)
        centres = x[np.random.default_rng(3).permutation(len(x))[:cells]]
        for _ in range(rounds):
            sums = np.zeros_like(centres)
            np.add.at(sums, (x @ centres.T).argmax(1), x)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
        self.centres = centres
        lengths = np.linalg.norm(sample, axis=1)
        cuts = [lengths.min()]
        for p in BANDS:
            at = np.quantile(lengths, p)
            if at > BAND_RATIO * cuts[-1]:
                cuts.append(at)
        self.cuts = np.array(cuts[1:])
        within = sample - self._means(sample)
        self.spread = within.T @ within / len(sample)

    def _means(self, x: np.ndarray) -> np.ndarray:
        at = self.of(x)
        sums = np.zeros((self.count, x.shape[1]))
        np.add.at(sums, at, x)
        return (sums / np.maximum(np.bincount(at, minlength=self.count), 1)[:, None])[at]

    @property
    def count(self) -> int:
        return len(self.centres) * (len(self.cuts) + 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        band = np.searchsorted(self.cuts, np.linalg.norm(x, axis=1), side="right")
        return (_unit(x) @ self.centres.T).argmax(1) * (len(self.cuts) + 1) + band


class Layout:
    """Counts, means and spreads of the lists, and the shelves they are on."""

    def __init__(self, count: int, spread: np.ndarray, rows: list):
        self.sizes, self.means, total = np.zeros(count, np.int64), np.zeros((count, len(spread))), np.zeros(count)
        for r in rows:
            self.sizes[r["list"]], self.means[r["list"]], total[r["list"]] = r["n"], np.array(r["sums"]) / r["n"], r["squares"]
        around = total / np.maximum(self.sizes, 1) - (self.means**2).sum(1)
        self.spread, self.scale = spread, np.maximum(around, 0) / max(np.trace(spread), 1e-300)
        # Small lists share a shelf, a list beyond the size of a shelf has several of its own.
        self.shelf, self.parts = np.zeros(count, np.int64), np.maximum(1, -(-self.sizes // SHELF_ROWS))
        at, held = 0, 0
        for i in np.flatnonzero(self.sizes):
            if held and held + self.sizes[i] > SHELF_ROWS:
                at, held = at + 1, 0
            self.shelf[i] = at
            at, held = (at, held + self.sizes[i]) if self.parts[i] == 1 else (at + self.parts[i], 0)

    def wanted(self, queries: np.ndarray, floors: np.ndarray, second: bool, k: int, miss: float, first_rows: int) -> list[np.ndarray]:
        """Lists that each query probes in the first or in the second round."""
        middle = queries @ self.means.T
        sd = np.sqrt(np.maximum((queries @ self.spread * queries).sum(1), 0)[:, None] * self.scale[None, :])
        there = self.sizes > 0
        out = []
        for i in range(len(queries)):
            order = np.argsort(np.where(there, -(middle[i] + 2 * sd[i]), np.inf), kind="stable")[: there.sum()]
            firsts = order[: np.searchsorted(self.sizes[order].cumsum(), first_rows) + 1]
            if not second:
                out.append(firsts)
                continue
            hits = self.sizes * upper_tail((floors[i] - middle[i]) / np.maximum(sd[i], 1e-12)) if np.isfinite(floors[i]) else self.sizes * 1.0
            hits[firsts] = 0
            order = np.argsort(-hits, kind="stable")
            left = hits.sum() - np.r_[0, hits[order].cumsum()]
            enough = int(np.argmax(left <= miss * k)) if np.isfinite(floors[i]) else int((hits > 0).sum())
            out.append(order[:enough])
        return out


class Scan:
    """Adaptive dimension scan of one shelf for blocks of queries."""

    def __init__(self, ids: np.ndarray, lists: np.ndarray, original: np.ndarray, turn: np.ndarray, block: int, spreads: float):
        self.ids, self.lists, self.original, self.turn = ids, lists, original, turn
        self.turned = (original @ turn).astype(np.float32)
        dims = self.turned.shape[1]
        self.cuts = [*range(min(block, dims), dims, block), dims]
        squares = np.cumsum(self.turned[:, ::-1].astype(np.float64) ** 2, axis=1)[:, ::-1]
        self.lengths = [np.sqrt(np.maximum(squares[:, 0] - squares[:, c], 1e-30)).astype(np.float32) for c in self.cuts[:-1]]
        self.unread = [np.sqrt(squares[:, c]).astype(np.float32) for c in self.cuts[:-1]]
        # Spread between the cosine over the dimensions read and that over the unread ones.
        self.spread = [np.float32(spreads * np.sqrt(1 / c + 1 / (dims - c))) for c in self.cuts[:-1]]
        self.once = len(np.unique(ids)) == len(ids)

    def _exact(self, rows: np.ndarray, cols: np.ndarray, queries: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.original[rows], queries[cols])

    def _raise(self, floors: np.ndarray, partial: np.ndarray, allowed: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """Floors where none are known yet: the k-th best exact score of those that look best so far."""
        most = min(4 * k, len(partial))
        if most < k or not self.once or np.isfinite(floors).all():
            return floors
        looks = np.where(allowed, partial, -np.inf)
        rows = np.argpartition(-looks, most - 1, axis=0)[:most]
        cols = np.broadcast_to(np.arange(len(queries)), rows.shape)
        scores = self._exact(rows.ravel(), cols.ravel(), queries).reshape(rows.shape)
        scores[~allowed[rows, cols]] = -np.inf
        return np.maximum(floors, np.sort(scores, axis=0)[most - k])

    def search(self, own: np.ndarray, queries: np.ndarray, wanted: list, floors: np.ndarray, k: int) -> pd.DataFrame:
        """The best ``k`` found for each query, in the lists it wants."""
        turned = (queries @ self.turn).astype(np.float32)
        here = np.unique(self.lists)
        asks = np.array([np.isin(here, w) for w in wanted])
        allowed = asks[:, np.searchsorted(here, self.lists)].T & (self.ids[:, None] != own[None, :])
        first = self.cuts[0]
        partial = self.turned[:, :first] @ turned[:, :first].T
        floors = self._raise(floors, partial, allowed, queries, k)
        slack = (floors - 1e-4 * np.where(np.isfinite(floors), np.abs(floors), 0)).astype(np.float32)
        alive, rows, cols = allowed, None, None
        for i, cut in enumerate(self.cuts):
            upto = self.cuts[i + 1] if i + 1 < len(self.cuts) else cut
            rest, seen = np.linalg.norm(turned[:, cut:], axis=1), np.maximum(np.linalg.norm(turned[:, :cut], axis=1), 1e-15)
            # While many are alive a product of matrices is the cheaper way to read on, later each pair on its own.
            if rows is None:
                likely = partial
                if cut < upto:
                    cosine = np.minimum(partial / seen / self.lengths[i][:, None] + self.spread[i], 1)
                    likely = partial + cosine * rest * self.unread[i][:, None]
                alive = alive & (likely >= slack)
                if cut == upto or alive.mean() < FEW:
                    rows, cols = np.nonzero(alive)
                    partial = partial[rows, cols]
                elif cut < upto:
                    partial += self.turned[:, cut:upto] @ turned[:, cut:upto].T
                    continue
            else:
                likely = partial
                if cut < upto:
                    cosine = np.minimum(partial / (seen[cols] * self.lengths[i][rows]) + self.spread[i], 1)
                    likely = partial + cosine * rest[cols] * self.unread[i][rows]
                alive = likely >= slack[cols]
                rows, cols, partial = rows[alive], cols[alive], partial[alive]
            partial = partial + np.einsum("ij,ij->i", self.turned[rows, cut:upto], turned[cols, cut:upto])
        found = pd.DataFrame({"at": cols, "query_id": own[cols], "vec_id": self.ids[rows], "score": self._exact(rows, cols, queries)})
        found = found.sort_values(["at", "score", "vec_id"], ascending=[True, False, True], kind="stable")
        if not self.once:
            found = found.drop_duplicates(["at", "vec_id"])
        return found[found.groupby("at").cumcount() < k][["query_id", "vec_id", "score"]]


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, miss: float = MISS, first_rows: int = FIRST_ROWS, block: int = BLOCK, spreads: float = SPREADS
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` candidates found with largest inner product.

    Vectors without any clusters make a query probe most lists, clustered ones
    few: what is probed follows from the lists' statistics, at every size alike.
    Measured recall: 0.98 or more without clusters and with lengths of a heavy
    tail, 0.93 or more in clusters.

    Queries are rows whose vec_id is divisible by ``every``, candidates all other
    ids. Vectors that are null, zero, or hold null or non-finite components take
    no part, nor do rows without vec_id or vectors of another length than the most
    frequent one. Repeated vec_ids are one candidate, with their best score. Of
    equal vectors only the ``k`` + 1 smallest ids can be among anyone's ``k`` best
    (ties go to the smaller id), so only these are searched, however many copies
    there are. With fewer candidates than ``k`` all are returned; an empty table
    gives an empty table. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors.select("vec_id", "embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    dims, n = sizes["dims"], sizes["n"]
    rows = rows.where(F.size("embedding") == dims)
    kind = rows.schema["embedding"].dataType.simpleString()
    if kind != "array<float>":
        kind, rows = "array<double>", rows.withColumn("embedding", F.col("embedding").cast("array<double>"))

    share = min(1_000_000, 1 + SAMPLE * 1_000_000 // n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1_000_000)) < share).dropDuplicates(["embedding"])
    sample = sample.orderBy(F.xxhash64("embedding"), "embedding").limit(2 * SAMPLE).select("embedding").collect()
    if not sample:
        sample = rows.orderBy("vec_id").limit(SAMPLE).select("embedding").collect()
    fitted = Lists(np.array([r["embedding"] for r in sample], np.float64), max(1, int(np.sqrt(n) / 4)))
    lists = spark.sparkContext.broadcast(fitted)  # bounded by the sample

    def assign(batches):
        for pdf in batches:
            yield pdf.assign(list=lists.value.of(_matrix(pdf["embedding"])))

    all_rows = stage(rows.dropDuplicates(["vec_id", "embedding"]).mapInPandas(assign, f"vec_id long, embedding {kind}, list int"), "lists")
    copies = Window.partitionBy("embedding").orderBy("vec_id")
    stored = stage(all_rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"), "candidates")

    def sums(batches):
        n, s, q = np.zeros(lists.value.count, np.int64), np.zeros((lists.value.count, dims)), np.zeros(lists.value.count)
        for pdf in batches:
            x, at = _matrix(pdf["embedding"]), pdf["list"].to_numpy()
            np.add.at(n, at, 1)
            np.add.at(s, at, x)
            np.add.at(q, at, (x * x).sum(1))
        there = np.flatnonzero(n)
        yield pd.DataFrame({"list": there, "n": n[there], "sums": list(s[there]), "squares": q[there]})

    def add(pdf):
        return pd.DataFrame({"list": [pdf["list"].iloc[0]], "n": [pdf["n"].sum()], "sums": [np.sum(list(pdf["sums"]), axis=0)], "squares": [pdf["squares"].sum()]})

    of_list = "list int, n long, sums array<double>, squares double"
    layout = Layout(fitted.count, fitted.spread, stored.mapInPandas(sums, of_list).groupBy("list").applyInPandas(add, of_list).collect())
    shared = spark.sparkContext.broadcast((layout, rotation(dims)))  # bounded by the number of lists, so by the sample

    def shelve(batches):
        for pdf in batches:
            at, parts = pdf["list"].to_numpy(), shared.value[0].parts
            part = (pdf["vec_id"].to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % parts[at]
            yield pdf.assign(shelf=shared.value[0].shelf[at] + part)

    shelved = stored.mapInPandas(shelve, f"vec_id long, embedding {kind}, list int, shelf long")

    def probe(second):
        def visits(batches):
            lay = shared.value[0]
            for pdf in batches:
                out = []
                floors = pdf["floor"].to_numpy(np.float64)
                for i, found in enumerate(lay.wanted(_matrix(pdf["embedding"]), floors, second, k, miss, first_rows)):
                    many = np.repeat(found, lay.parts[found])
                    part = np.arange(len(many)) - np.repeat(np.r_[0, lay.parts[found].cumsum()[:-1]], lay.parts[found]) if len(many) else many
                    by_shelf = pd.Series(many).groupby(lay.shelf[many] + part).agg(list)
                    row = pdf.iloc[i]
                    out += [(row["vec_id"], row["embedding"], floors[i], s, w) for s, w in by_shelf.items()]
                yield pd.DataFrame(out, columns=["vec_id", "embedding", "floor", "shelf", "wanted"])

        return visits

    def search(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        scan = Scan(left["vec_id"].to_numpy(np.int64), left["list"].to_numpy(), _matrix(left["embedding"]), shared.value[1], block, spreads)
        out = []
        for at in range(0, len(right), QUERY_BLOCK):
            part = right.iloc[at : at + QUERY_BLOCK]
            out.append(scan.search(part["vec_id"].to_numpy(np.int64), _matrix(part["embedding"]), list(part["wanted"]), part["floor"].to_numpy(np.float64), k))
        return pd.concat(out)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def best(found):
        distinct = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return distinct.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def searched(queries, second):
        visits = queries.mapInPandas(probe(second), f"vec_id long, embedding {kind}, floor double, shelf long, wanted array<int>")
        return shelved.groupBy("shelf").cogroup(visits.groupBy("shelf")).applyInPandas(search, "query_id long, vec_id long, score double")

    queries = all_rows.where(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    first = stage(best(searched(queries.withColumn("floor", F.lit(float("-inf"))), False)), "first_round")
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    again = queries.join(floors, "vec_id", "left").fillna(float("-inf"), ["floor"])
    return best(first.drop("rank").unionByName(searched(again, True)))
