"""Harmonic packing: documents are cut to lengths of reciprocal-capacity classes, and each class fills its own bins.

Class k holds pieces of length ``capacity // k``, and a bin of that class holds k of
them. A document gives full sequences first; what is left is cut at the largest
length of a class that fits, until it is short enough to form a class by itself. Any
worker can cut its documents alone, and the number of a piece within its class says
which bin it is in and where. What a class has left over, less than a bin, is packed
first-fit decreasing; there is a constant amount of it whatever the corpus holds.
"""

from __future__ import annotations

import re
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import documents, hashable, python_tasks
from strandline.operators.ranking import prefix_sums
from strandline.session import staged

CAPACITY, END_ID = 4096, 2
#: Pieces of up to capacity // CUT_CLASSES tokens are not cut further.
CUT_CLASSES = 32
_REMEMBERED = 400_000

# What a plain word is made of: letters that are composed and have one lower-case form, then marks that
# belong to no contraction and no special token.
_LETTERS = "".join(chr(c) for c in range(65, 256) if chr(c).isalpha() and chr(c) not in "ªµº")
_MARKS = "!\"#$%&()*+,-./:;=?@[]^_{}~"
_MARK_BYTES = _MARKS.encode()
_PLAIN = re.compile(f"([{_LETTERS}]*)([{re.escape(_MARKS)}]*)")
# Byte-level vocabularies spell a byte as itself if it is printable, else as the next free letter from 256.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(b) for b in _PRINTABLE} | {
    b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def piece_lengths(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths that a document of so many tokens is cut to, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest > capacity // CUT_CLASSES:
        per_bin = capacity // rest
        exact = capacity // per_bin
        cut = rest if rest == exact else capacity // (per_bin + 1)
        out.append(cut)
        rest -= cut
    return out + [rest] if rest else out


class Tokens:
    """Token ids of whole texts by a tokenizer that never looks across white space.

    Words are tokenized once and remembered, up to a number of words. Most words are
    Latin letters and marks after them: these are lower-cased and handed to the
    tokenizer's model as its own earlier steps would do. That is checked letter by
    letter when the tokenizer is loaded; if it disagrees, and for any other word, the
    whole tokenizer is used.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.pieces = Tokenizer.from_file(path), {}, {}
        self.model = self.tokenizer.model
        self.plain = True
        probes = [w for c in _LETTERS for w in (c, f"x{c}y", f"{c}ea,")] + [f"Ab{m}" for m in _MARKS] + [_MARKS, f"e{_MARKS}"]
        self.plain = all(self._plain(w) in (None, self._whole(w)) for w in probes)
        self.pieces.clear()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        # Upper-case ASCII makes no difference to a plain word; special tokens begin with the bracket.
        split = [(raw.lower() if self.plain and b"<" not in raw else raw).split() for raw in texts]
        words = self.words
        if len(words) > _REMEMBERED:
            words.clear()
        if len(self.pieces) > _REMEMBERED:
            self.pieces.clear()
        for raw in set().union(*split).difference(words):
            words[raw] = self._word(raw)
        return [np.frombuffer(b"".join(map(words.__getitem__, part)), "<u4") for part in split]

    def _word(self, raw: bytes) -> bytes:
        if self.plain:
            stem = raw.rstrip(_MARK_BYTES)
            if stem.isalpha() and stem.islower():  # ASCII letters, as these are bytes
                return self._piece(stem.decode()) + (self._piece(raw[len(stem):].decode()) if len(stem) < len(raw) else b"")
            found = self._plain(raw.decode())
            if found is not None:
                return found
        return self._whole(raw.decode())

    def _whole(self, word: str) -> bytes:
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _plain(self, word: str) -> bytes | None:
        match = _PLAIN.fullmatch(word)
        return b"".join([self._piece(p.lower()) for p in match.groups() if p]) if match else None

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            spelled = piece if piece.isascii() else "".join(map(_BYTE_LETTERS.__getitem__, piece.encode()))
            found = self.pieces[piece] = _packed([t.id for t in self.model.tokenize(spelled)])
        return found


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


_PIECE = ["start", "length", "ids_crc32", "doc_tokens"]


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, row_hash, start, length, ids_crc32, doc_tokens)`` for each piece; a null text is an empty one."""
    @arrow_udf(T.ArrayType(T.StructType([T.StructField(name, T.LongType()) for name in _PIECE])))
    def pieces(texts: pa.Array) -> pa.Array:
        tokens, counts, rows = _tokens(tokenizer), [0], []
        raws = list(documents(texts))
        for at in range(0, len(raws), 256):
            for ids in tokens.ids(raws[at:at + 256]):
                whole = np.append(ids, np.uint32(end_id)).astype("<u4").tobytes()
                start, total = 0, len(whole) // 4
                for length in piece_lengths(total, capacity):
                    rows.append((start, length, zlib.crc32(whole[4 * start:4 * (start + length)]), total))
                    start += length
                counts.append(len(rows))
        table = np.array(rows, np.int64).reshape(-1, len(_PIECE))
        fields = pa.StructArray.from_arrays([pa.array(table[:, i]) for i in range(len(_PIECE))], _PIECE)
        return pa.ListArray.from_arrays(pa.array(counts, pa.int32()), fields)

    python_tasks(docs.sparkSession)
    # The pieces are used once: each further use of a column of Python results may run the function again.
    return docs.select("doc_id", F.xxhash64(*hashable(docs)).alias("row_hash"), F.explode(pieces("text")).alias("p")).select(
        "doc_id", "row_hash", "p.*")


def _first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece and its place there. ``lengths`` run downwards."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free, first = [], {}  # first: where to start looking for a length; bins before it have no room
    for i, length in enumerate(lengths.tolist()):
        at = first.get(length, 0)
        while at < len(free) and free[at] < length:
            at += 1
        first = {length: at}  # shorter pieces may fit earlier
        if at == len(free):
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - free[at]
        free[at] -= length
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    Each document is its token ids and ``end_id``; a null text has that alone. Every
    id is in one piece, every sequence is gapless from 0 and holds at most
    ``capacity`` ids. Rows that are equal throughout are documents of their own; no
    rows give no rows, and columns other than ``doc_id`` and ``text`` only tell rows apart.
    """
    # Written first: finding ranges reads the pieces once more.
    pieces = staged(cut_documents(docs, tokenizer, capacity, end_id), "cut").withColumns(
        {"key": F.xxhash64("doc_id", "row_hash", "start"), "one": F.lit(1)})
    numbered = staged(prefix_sums(pieces, ["length"], ["key", "doc_id", "row_hash", "start"], "one", "before")
                      .withColumn("before", F.coalesce("before", F.lit(0))), "pieces")
    # One row per length, so at most as many as the capacity.
    classes = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, bins = [], 0
    for length in sorted(classes, reverse=True):
        per_bin = capacity // length
        full = classes[length] // per_bin
        rows.append((length, per_bin, bins, full * per_bin))
        bins += full
    spark = docs.sparkSession
    plan = F.broadcast(spark.createDataFrame(rows, "length long, per_bin long, first_bin long, placed long"))
    known = numbered.join(plan, "length")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    in_full = known.where("before < placed").withColumns({
        "sequence_id": (F.col("first_bin") + F.floor(F.col("before") / F.col("per_bin"))).cast("long"),
        "offset": F.pmod("before", "per_bin") * F.col("length")})

    def fill(group):
        group = group.sort_values(["length", "before"], ascending=[False, True], ignore_index=True)
        found, offsets = _first_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.assign(sequence_id=found + bins, offset=offsets)[out]

    # Less than a bin of each class, so this group does not grow with the corpus.
    left = known.where("before >= placed").withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        fill, T.StructType([T.StructField(c, docs.schema["doc_id"].dataType if c == "doc_id" else T.LongType()) for c in out]))
    return in_full.select(out).unionAll(left)
