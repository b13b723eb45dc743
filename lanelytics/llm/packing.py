"""Best-fit packing whose bin counts are certified by lower bounds, with repacking across partitions.

Documents are dealt over partitions at random.  Each partition packs best-fit
decreasing and compares its bins with the best lower bound that dual-feasible
functions give for its lengths.  Where a partition meets its bound, no packing
of its pieces has fewer bins; it gives up its emptiest bin alone, which others
may fill.  One with a gap gives up as many of its emptiest bins as hold the
free space of the gap and one bin more.  The pieces given up by ``EXCHANGE``
neighbouring partitions meet in one partition of the next round and are packed
and certified again.  Rounds end when nothing is given up or one partition is
left.  Only partition-sized groups meet in a task.

Null texts count as empty and give one piece that holds the end id alone.
Every row is packed, repeated ids and rows without an id too; other columns
are ignored.  No documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lanelytics.llm.common import batch_of, rows, stored, whole_text
from lanelytics.llm.encoding import json_encoder

CAPACITY = 2048
#: Documents of a partition, partitions that exchange, and the finest of the harmonic dual-feasible functions.
PARTITION, EXCHANGE, FINEST = 40_000, 8, 24
#: Place of the round and of the partition in a sequence's number.
_ROUND, _PARTITION = 1 << 56, 1 << 32

ENDED = b"\0\0\0\0"

#: A bin below 0 is given up; it was -1 - bin.  An id that is null travels as 0 and not ``known``.
_PIECES = (
    "part long, known boolean, doc_id long, piece int, start long, length long, ids_crc32 long, "
    "bin long, offset long, gap long"
)


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; ties in length go by position."""
    order = np.argsort(-lengths, kind="stable")
    of_piece, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space
    free = 0  # bit s: some bin has s free
    for at, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            target = open_bins[space].pop()
            if not open_bins[space]:
                free ^= 1 << space
        else:
            target, space = len(fills), capacity
            fills.append(0)
        of_piece[at], offsets[at] = target, fills[target]
        fills[target] += size
        if space > size:
            open_bins[space - size].append(target)
            free |= 1 << (space - size)
    return of_piece, offsets, np.array(fills, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, finest: int = FINEST) -> int:
    """Bins that any packing needs: the best of two families of dual-feasible functions.

    One counts pieces over ``capacity - e`` as whole bins and drops those under
    ``e``, for every e up to half the capacity; the other rounds (k + 1) times
    a length down to whole k-ths of a bin unless it is a whole number already.
    """
    if not len(lengths):
        return 0
    histogram = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    below = np.concatenate([[0], np.cumsum(histogram)])  # pieces shorter than s
    volume = np.concatenate([[0], np.cumsum(histogram * size)])
    e = np.arange(0, capacity // 2 + 1)
    large = below[-1] - below[capacity - e + 1]
    middle = volume[capacity - e + 1] - volume[e]
    best = int((large + -(-middle // capacity)).max())
    for k in range(1, finest + 1):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # in 1 / (k * capacity)
        best = max(best, int(-(-(histogram * value).sum() // (k * capacity))))
    return best


def _tokenise(json_path: str, rank_path: str, pattern: str, capacity: int):
    numbers = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("salt", pa.int64()), ("n", pa.int64()), ("crcs", numbers)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_encoder(json_path, rank_path, pattern)
        salt = TaskContext.get().partitionId() << 40
        for part in rows(batches):
            counts, crcs = [], []
            for text in part["text"]:
                ids = encode(text) + ENDED
                n = len(ids) // 4
                first = (n % capacity or capacity) if n > capacity else n
                ends = [0, *range(first, n + 1, capacity)]
                counts.append(n)
                crcs.append([zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])])
            yield batch_of(schema, part["doc_id"], range(salt, salt + len(counts)), counts, crcs)
            salt += len(counts)

    return run


def _packed(part: int, pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pieces with bin, offset and the partition's gap.

    Pieces that come from given-up bins, named by ``home``, stay in those if
    packing them anew takes no fewer.
    """
    pieces = pieces.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
    lengths = pieces["length"].to_numpy(np.int64)
    bins, offsets, fills = best_fit_decreasing(lengths, capacity)
    if "home" in pieces and pieces["home"].nunique() <= len(fills):
        bins, offsets = pd.factorize(pieces["home"])[0], pieces["offset"].to_numpy()
        fills = np.bincount(bins, lengths).astype(np.int64)
    gap = len(fills) - lower_bound(lengths, capacity)
    emptiest = np.argsort(fills, kind="stable")
    free = np.cumsum(capacity - fills[emptiest])
    given_up = np.zeros(len(fills), bool)
    given_up[emptiest[: 1 + int(np.searchsorted(free, (gap + 1) * capacity)) if gap else 1]] = True
    given_up &= fills < capacity
    return pieces.assign(part=part, bin=np.where(given_up[bins], -1 - bins, bins), offset=offsets, gap=gap)[_NAMES]


def _first_round(capacity: int):
    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("salt")
        n, crcs = docs["n"].to_numpy(), docs["crcs"].to_numpy()
        count = np.array([len(c) for c in crcs])
        row = np.repeat(np.arange(len(docs)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first = (n - (count - 1) * capacity)[row]
        pieces = pd.DataFrame(
            {
                "known": docs["known"].to_numpy()[row],
                "doc_id": docs["doc_id"].to_numpy()[row],
                "piece": piece,
                "start": np.where(piece == 0, 0, first + (piece - 1) * capacity),
                "length": np.where(piece == 0, first, capacity),
                "ids_crc32": np.concatenate(crcs),
            }
        )
        return _packed(key[0], pieces, capacity)

    return run


def _later_round(capacity: int):
    return lambda key, pieces: _packed(key[0], pieces, capacity)


_NAMES = [column.split()[0] for column in _PIECES.split(", ")]


def pack_rounds(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int = CAPACITY) -> list[DataFrame]:
    """The stored result of each round; pieces with a bin below 0 go on to the next, if there is one."""
    docs = docs.select(F.col("doc_id").cast("long"), whole_text())
    counted = stored(
        docs.mapInArrow(
            _tokenise(json_path, rank_path, pattern, capacity), "doc_id long, salt long, n long, crcs array<long>"
        )
    )
    parts = max(1, -(-counted.count() // PARTITION))
    dealt = counted.select(
        F.pmod(F.xxhash64("salt"), F.lit(parts)).alias("part"),
        F.col("doc_id").isNotNull().alias("known"),
        F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
        "salt",
        "n",
        "crcs",
    )
    rounds = [stored(dealt.groupBy("part").applyInPandas(_first_round(capacity), _PIECES))]
    while parts > 1 and not rounds[-1].filter("bin < 0").isEmpty():
        parts = -(-parts // EXCHANGE)
        given_up = (
            rounds[-1]
            .filter("bin < 0")
            .withColumn("home", F.col("part") * _PARTITION - 1 - F.col("bin"))
            .withColumn("part", F.floor(F.col("part") / EXCHANGE).cast("long"))
        )
        rounds.append(stored(given_up.groupBy("part").applyInPandas(_later_round(capacity), _PIECES)))
    return rounds


def pack_documents(docs: DataFrame, json_path: str, rank_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    rounds = pack_rounds(docs, json_path, rank_path, pattern, capacity)
    results = []
    for number, frame in enumerate(rounds):
        placed = frame if number == len(rounds) - 1 else frame.filter("bin >= 0")
        bin_number = F.when(F.col("bin") < 0, -1 - F.col("bin")).otherwise(F.col("bin"))
        results.append(
            placed.select(
                F.when(F.col("known"), F.col("doc_id")).alias("doc_id"),
                "piece",
                "start",
                "length",
                "ids_crc32",
                (F.lit(number * _ROUND) + F.col("part") * _PARTITION + bin_number).alias("sequence_id"),
                "offset",
            )
        )
    return reduce(DataFrame.unionByName, results)
