"""Best-fit packing by large-item matching: pairs of large documents first, small ones into the gaps.

Lengths are whole numbers up to the capacity, so how many pieces have each length says
all that a packing needs to know, and that table is as small for any corpus. A plan is
made on it: large pieces (above a third of the capacity) are matched greedily, the
longest with the longest that fits beside it, at most two to a bin; smaller pieces,
longest first, go where the least room is left. The plan is a list of slots, runs of
equal pieces in equal bins. Pieces are numbered within their length by distributed
prefix sums, and the number says which slot a piece takes.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import documents, hashable, python_tasks
from strandline.llm.packing import _tokens
from strandline.operators.ranking import prefix_sums
from strandline.session import staged

CAPACITY, END_ID = 4096, 1
_PIECE = ["piece", "start", "length", "ids_crc32"]
#: A slot: the pieces ``first`` and on of a length fill bins ``bin`` and on from ``offset``, ``each`` to a bin.
SLOT = ["length", "first", "bin", "offset", "each"]


def whole_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, row_hash, piece, start, length, ids_crc32)``: a document is one piece unless it exceeds the capacity."""
    @arrow_udf(T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in _PIECE])))
    def pieces(texts: pa.Array) -> pa.Array:
        tokens, counts, rows = _tokens(tokenizer), [0], []
        raws = list(documents(texts))
        for at in range(0, len(raws), 256):
            for ids in tokens.ids(raws[at:at + 256]):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4")
                for number, start in enumerate(range(0, len(whole), capacity)):
                    part = whole[start:start + capacity]
                    rows.append((number, start, len(part), zlib.crc32(part.tobytes())))
                counts.append(len(rows))
        table = np.array(rows, np.int64).reshape(-1, len(_PIECE))
        fields = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(_PIECE))], _PIECE)
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), fields)

    python_tasks(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64(*hashable(docs)).alias("row_hash"), F.explode(pieces("text")).alias("p")).select(
        "doc_id", "row_hash", F.col("p.piece").cast("int").alias("piece"), "p.start", "p.length", "p.ids_crc32")


def matched(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """``(longer, shorter, bins)`` for the large lengths; ``shorter`` is 0 where a piece stays alone.

    The longest piece left takes the longest that fits beside it. That gives the fewest
    bins for large pieces: whatever fits beside the longest fits beside any other too.
    """
    left = {length: n for length, n in counts.items() if 3 * length > capacity and n}
    order, out = sorted(left), []
    while order:
        longer = order[-1]
        at = bisect_left(order, capacity - longer + 1) - 1  # the longest that fits
        if at < 0:
            out.append((longer, 0, left.pop(longer)))
            order.pop()
            continue
        shorter = order[at]
        if shorter == longer:
            if left[longer] > 1:
                out.append((longer, longer, left[longer] // 2))
            left[longer] %= 2
            if left[longer] and at:  # the odd one may go with a shorter piece
                order.pop(at)
                partner = order[-1]
                out.append((longer, partner, 1))
                left[partner] -= 1
                if not left[partner]:
                    order.pop()
            else:
                if left[longer]:
                    out.append((longer, 0, 1))
                order.pop(at)
            continue
        bins = min(left[longer], left[shorter])
        out.append((longer, shorter, bins))
        for length in (longer, shorter):
            left[length] -= bins
            if not left[length]:
                order.remove(length)
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """The slots of a packing of ``counts[length]`` pieces of each length, as rows of ``SLOT``.

    Bins with the same room are kept as runs ``(first bin, bins)``. A step fills a whole
    run or ends a length, so there are some runs for each length, whatever the counts.
    """
    used, slots, bins = dict.fromkeys(counts, 0), [], 0
    rooms: list[int] = []                                # sorted rooms that some bin has
    runs: dict[int, list[tuple[int, int]]] = {}          # the runs of bins with that room, lowest bin first

    def place(length: int, at: int, n_bins: int, offset: int, each: int, pieces: int) -> None:
        slots.append((length, used[length], at, offset, each))
        used[length] += pieces

    def free(room: int, at: int, n_bins: int) -> None:
        if not room or not n_bins:
            return
        if room not in runs:
            runs[room] = []
            insort(rooms, room)
        heapq.heappush(runs[room], (at, n_bins))

    for longer, shorter, n_bins in matched(counts, capacity):
        place(longer, bins, n_bins, 0, 1, n_bins)
        if shorter:
            place(shorter, bins, n_bins, longer, 1, n_bins)
        free(capacity - longer - shorter, bins, n_bins)
        bins += n_bins
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while used[length] < counts[length]:
            left = counts[length] - used[length]
            k = bisect_left(rooms, length)
            if k == len(rooms):                          # no bin has room: open as many as are needed
                each = capacity // length
                n_bins = -(-left // each)
                free(capacity, bins, n_bins)
                bins += n_bins
                continue
            room = rooms[k]
            at, n_bins = heapq.heappop(runs[room])
            if not runs[room]:
                del runs[room]
                rooms.pop(k)
            # Once a bin has taken one, it has the least room of all that still fit: it takes as many as it can.
            each = min(room // length, left)
            whole = min(n_bins, left // each)
            place(length, at, whole, capacity - room, each, whole * each)
            free(room - each * length, at, whole)
            free(room, at + whole, n_bins - whole)
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece.

    Each document is its token ids and ``end_id``; a null text has that alone. Only
    documents above the capacity are cut, into full sequences and a rest. Every
    sequence is gapless from 0. Rows that are equal throughout are documents of their
    own; no rows give no rows; other columns only tell rows apart. At most one count
    for each length reaches the driver, and some slots for each go back.
    """
    pieces = staged(whole_documents(docs, tokenizer, capacity, end_id), "whole").withColumns(
        {"key": F.xxhash64("doc_id", "row_hash", "start"), "one": F.lit(1)})
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    numbered = prefix_sums(pieces, ["length"], ["key", "doc_id", "row_hash", "start"], "one", "before").withColumn(
        "before", F.coalesce("before", F.lit(0)))
    slots = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, len(SLOT))
    # A piece's slot is the last of its length that begins at or before its number.
    begins = slots[:, 0] << 44 | slots[:, 1]

    @arrow_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def placed(length: pa.Array, before: pa.Array) -> pa.Array:
        size, number = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, before))
        _, first, bin_, offset, each = slots[np.searchsorted(begins, size << 44 | number, "right") - 1].T
        nth = number - first
        return pa.StructArray.from_arrays([pa.array(bin_ + nth // each), pa.array(offset + nth % each * size)],
                                          ["sequence_id", "offset"])

    return numbered.withColumn("place", placed("length", "before")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
