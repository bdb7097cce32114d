"""Best-two-fit packing of documents into sequences.

A document is its token ids and an end id; one that is longer than a sequence is cut into full pieces and a
rest.  Pieces are dealt evenly into groups of GROUP pieces; within a group a sequence is filled greedily with
the longest piece that fits; when none fits, its smallest piece gives way to two unpacked pieces that together
fit the larger gap more tightly, if there are any.  At most one sequence in a group is left with room for more
than its pieces need, so the number of groups hardly shows in the number of sequences.

Defined results: null or empty texts are a document of the end id alone; null keys and repeated rows are packed
like others; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfare.llm.text import gathered, small_batches
from wayfare.llm.tokens import AT_ONCE, encoder
from wayfare.plans.scratch import stored

CAPACITY, GROUP = 2048, 200_000


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: documents cut to at most ``capacity`` tokens."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in gathered(batches, size=AT_ONCE):
            ids, bounds = tokens.documents(batch.column(1), end_id)
            n = np.diff(bounds)
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[doc] - start, capacity)
            at = bounds[doc] + start
            own = [ids[a:b] for a, b in zip(at.tolist(), (at + length).tolist())]
            cols = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            lists = [pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []
            yield pa.RecordBatch.from_arrays(cols + lists, names + ["ids"] * with_ids)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def best_two_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, all between 1 and ``capacity``; equal lengths are taken in their order."""
    order = np.argsort(-lengths, kind="stable")
    cuts = np.searchsorted(-lengths[order], -np.arange(capacity + 2), "left")
    # own[n]: the items of length n not yet packed, next one last
    own = [order[cuts[n] : np.searchsorted(-lengths[order], -n, "right")][::-1].tolist() for n in range(capacity + 1)]
    up = down = 0  # bit n, and bit capacity - n, is set if there are items of length n
    for n in range(1, capacity + 1):
        if own[n]:
            up |= 1 << n
            down |= 1 << (capacity - n)
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal up, down
        item = own[n].pop()
        if not own[n]:
            up &= ~(1 << n)
            down &= ~(1 << (capacity - n))
        return item

    below = [(2 << n) - 1 for n in range(capacity + 1)]
    number = 0
    while up:
        gap, bin_ = capacity, []
        while gap and (fits := up & below[gap]):
            n = fits.bit_length() - 1
            bin_.append((n, take(n)))
            gap -= n
        if gap and up and len(bin_) > 1:
            small, item = bin_[-1]
            for total in range(gap + small, small, -1):
                both = up & (down >> (capacity - total))  # bit a: there are items of lengths a and total - a
                if total % 2 == 0 and len(own[total // 2]) == 1:
                    both &= ~(1 << (total // 2))
                if both:
                    a = both.bit_length() - 1
                    bin_.pop()
                    bin_ += [(a, take(a)), (total - a, take(total - a))]
                    own[small].append(item)
                    up |= 1 << small
                    down |= 1 << (capacity - small)
                    break
        at = 0
        for n, item in bin_:
            sequence[item], offset[item] = number, at
            at += n
        number += 1
    return sequence, offset


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Rows with ``length`` between 1 and ``capacity``, and doc_id and piece, get ``sequence_id`` and ``offset``."""
    rows = stored(rows, "pieces")
    groups = max(1, round(rows.count() / group))
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = rows.columns

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = best_two_fit(table.column("length").to_numpy(), capacity)
        number = table.column("group")[0].as_py()
        return table.select(names).append_column("sequence_id", pa.array(sequence + (number << 40))).append_column("offset", pa.array(offset))

    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, vocabulary, end_id, capacity), capacity)


def sequences(placed: DataFrame, ids: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence, from the placed pieces and ``pieces(..., with_ids=True)``."""
    key = ["doc_id", "piece", "ids_crc32"]
    own = ids.select(*key, "ids").dropDuplicates(key)
    joined = placed.alias("p").join(own.alias("i"), F.expr("p.doc_id <=> i.doc_id and p.piece = i.piece and p.ids_crc32 = i.ids_crc32"))
    parts = F.array_sort(F.collect_list(F.struct("p.offset", "i.ids")))
    return joined.groupBy("p.sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
