"""Packing of tokenised documents into sequences of bounded length.

Bounded-space online packing: a task keeps a fixed number of open windows. Full
sequences are cut from a long document first; the rest goes to the open window
it fits best. When none has room, the fullest window is emitted and a new one is
opened. What a task has open at its end is merged with the leftovers of other
tasks by the same rule, in rounds of groups of tasks, so no task ever sees more
than a bounded number of leftovers. What stays open after the last round is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twofold.llm.token_counts import PATTERN, SPECIAL, Pieces, distribute
from twofold.sources.tables import stage

OPEN_WINDOWS = 32
MERGED_TASKS = 64
_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]


class Encoder:
    """Token ids of texts as little-endian 32-bit values, for a byte-level vocabulary file.

    A text is cut before runs of blanks, where its words end whatever follows, and
    the pieces' ids are cached. Plain western pieces go through the rank form of
    the same vocabulary if that is given; all others, and texts with a special
    string, through the vocabulary file's own library.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.plain = regex.compile(r"[ \n!-~¡-¬®-ÿ]{1,400}")
        self.pieces = Pieces(self.piece)

    def piece(self, piece: str) -> bytes:
        if self.fast is not None and self.plain.fullmatch(piece):
            ids = self.fast.encode_ordinary(piece)
        else:
            ids = self.slow.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(self.pieces.values(text))


@lru_cache(maxsize=2)
def encoder(name: str, ranks: str | None) -> Encoder:
    return Encoder(SparkFiles.get(name), SparkFiles.get(ranks) if ranks else None)


class Windows:
    """A fixed number of open windows, filled best-fit."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.used: list[int] = []
        self.held: list[list] = []

    def add(self, length: int, item) -> list | None:
        """Place an item; the contents of a window that had to be emitted, or was filled."""
        best, room = -1, self.size + 1
        for i, u in enumerate(self.used):
            free = self.size - u
            if length <= free < room:
                best, room = i, free
        out = None
        if best < 0:
            if len(self.used) == self.most:
                out = self._pop(max(range(self.most), key=self.used.__getitem__))
            self.used.append(0)
            self.held.append([])
            best = len(self.used) - 1
        self.used[best] += length
        self.held[best].append(item)
        if out is None and self.used[best] == self.size:
            out = self._pop(best)
        return out

    def _pop(self, i: int) -> list:
        self.used.pop(i)
        return self.held.pop(i)


def _sequence(level: int, task: int, serial: int) -> int:
    """Number of a sequence, from the round, the task or group within it, and a serial number there."""
    return (level << 56) | (task << 32) | serial


def _emitted(pieces: list[tuple], sequence: int) -> list[tuple]:
    """Rows of one sequence, gapless from offset 0."""
    at, rows = 0, []
    for doc, start, length, ids, total in pieces:
        rows.append((doc, start, length, zlib.crc32(ids), total, sequence, at, 0, None))
        at += length
    return rows


def pack(docs: DataFrame, path: str, size: int, ranks: str | None = None, most: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all documents in sequences of at most ``size`` tokens.

    A row of ``docs`` is its text's ids and then id 0; a null text counts as empty
    and gives that one id. Rows are (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset); each id of each row of ``docs`` is in one piece. Repeated
    rows are packed each for itself, rows without doc_id keep their null. Only
    doc_id and text are read; an empty table gives an empty table. Sequences are
    numbered by task, so they do not depend on the order in which tasks end.
    """
    name = distribute(docs, path)
    other = distribute(docs, ranks) if ranks else None
    # Leftovers keep their ids: the last round may cut them.
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open long, ids binary"

    def first(batches):
        encode = encoder(name, other).encode
        task, serial, windows = TaskContext.get().partitionId(), 0, Windows(size, most)
        for pdf in batches:
            out: list[tuple] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                raw = encode(text or "") + b"\0\0\0\0"
                total = len(raw) // 4
                whole = total - total % size
                for start in range(0, whole, size):
                    crc = zlib.crc32(memoryview(raw)[4 * start : 4 * (start + size)])
                    out.append((doc, start, size, crc, total, _sequence(0, task, serial), 0, 0, None))
                    serial += 1
                if whole < total:
                    tail = raw[4 * whole :]
                    done = windows.add(total - whole, (doc, whole, total - whole, tail, total))
                    if done:
                        out.extend(_emitted(done, _sequence(0, task, serial)))
                        serial += 1
            yield pd.DataFrame(out, columns=[*_COLUMNS, "ids"])
        left: list[tuple] = []
        for held in windows.held:
            left.extend((d, s, n, 0, t, 0, 0, 1 + task, ids) for d, s, n, ids, t in held)
        yield pd.DataFrame(left, columns=[*_COLUMNS, "ids"])

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    packed = stage(rows.mapInPandas(first, schema), "packed")
    done, left = packed.where("open = 0").drop("open", "ids"), packed.where("open > 0")

    tasks, level = left.agg(F.max("open")).first()[0] or 0, 1
    while tasks > 1:
        merged = stage(_merge(left, size, most, level), "merged")
        done = done.union(merged.where("open = 0").drop("open", "ids"))
        left, tasks, level = merged.where("open > 0"), -(-tasks // MERGED_TASKS), level + 1
    done = done.union(_closed(left, size, level))
    return done.withColumn("doc_id", F.col("doc_id").cast("long"))


def _merge(left: DataFrame, size: int, most: int, level: int) -> DataFrame:
    """One round: the leftovers of up to ``MERGED_TASKS`` tasks are packed together, largest first."""

    def run(pdf):
        group = int(pdf["part"].iloc[0])
        serial, windows, out = 0, Windows(size, most), []
        pdf = pdf.sort_values(["length", "doc_id", "start", "open"], ascending=[False, True, True, True], na_position="last")
        for doc, start, length, total, ids in zip(pdf["doc_id"], pdf["start"], pdf["length"], pdf["doc_tokens"], pdf["ids"]):
            doc = None if pd.isna(doc) else doc
            got = windows.add(length, (doc, start, length, ids, total))
            if got:
                out.extend(_emitted(got, _sequence(level, group, serial)))
                serial += 1
        for held in windows.held:
            out.extend((d, s, n, 0, t, 0, 0, 1 + group, ids) for d, s, n, ids, t in held)
        return pd.DataFrame(out, columns=[*_COLUMNS, "ids"])

    part = left.withColumn("part", F.floor((F.col("open") - 1) / MERGED_TASKS))
    return part.groupBy("part").applyInPandas(run, left.schema)


def _closed(left: DataFrame, size: int, level: int) -> DataFrame:
    """The last open windows, joined end to end and cut to full sequences and then to powers of two."""

    def run(pdf):
        serial, out = 0, []
        pdf = pdf.sort_values(["length", "doc_id", "start", "open"], ascending=[False, True, True, True], na_position="last")
        total = int(pdf["length"].sum())
        cuts = [size] * (total // size) + [1 << b for b in range(total.bit_length(), -1, -1) if (total % size) >> b & 1]
        room = cuts.pop(0)
        at = 0
        for doc, start, length, whole, ids in zip(pdf["doc_id"], pdf["start"], pdf["length"], pdf["doc_tokens"], pdf["ids"]):
            doc, taken = None if pd.isna(doc) else doc, 0
            while taken < length:
                if at == room:
                    room, at, serial = cuts.pop(0), 0, serial + 1
                n = min(length - taken, room - at)
                crc = zlib.crc32(ids[4 * taken : 4 * (taken + n)])
                out.append((doc, start + taken, n, crc, whole, _sequence(level, 0, serial), at))
                taken, at = taken + n, at + n
        return pd.DataFrame(out, columns=_COLUMNS[:-1])

    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return left.groupBy(F.lit(0).alias("part")).applyInPandas(run, schema)
