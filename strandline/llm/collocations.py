"""Phrase collocations by Rabin-Karp fingerprints.

A block of texts becomes one array of bytes, with words lower-cased and set apart by
one blank. A prefix polynomial over it gives the fingerprint of every n-gram by one
subtraction. A first pass counts the n-grams of each block and shuffles their
fingerprints, packed by hash range; a range's task adds up the counts and keeps those
that may be frequent. They become a filter of bounded size. A second pass collects the
occurrences (document and first word) of the n-grams that the filter lets through,
compares them word by word, so that no collision counts for another phrase, and only
then reads phrases from the text. Their counts are added by the phrase itself.

How full the filter is decides how much is shuffled, never what is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import python_tasks, utf8
from strandline.operators.ranking import prefix_sums
from strandline.session import staged

MOST_WORDS = 4
LEAST = 30
#: Texts are handled in blocks of about this many bytes, a longer text in a block of its own.
BLOCK_BYTES = 2 << 20
#: N-grams of all blocks that one range of fingerprints may hold, about.
RANGE_NGRAMS = 4_000_000
MOST_RANGES = 1 << 18
#: The filter has 32 bits for each frequent n-gram, and 64 MB at most.
FILTER_BITS = (1 << 16, 1 << 29)
SLICE_BITS = 1 << 20

_BLANK, _BREAK = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15


def _powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, … modulo 2**64."""
    out = np.full(count, base % 2**64, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


class Words:
    """The words of a block of texts, and the fingerprints of their n-grams."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, langs: np.ndarray, base: int = BASE):
        kind = _KIND[raw]
        inside = kind == 0
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        borders = ends[:-1][ends[:-1] < len(raw)]
        starts[borders] = inside[borders]
        at = np.flatnonzero(starts)
        number = np.cumsum(starts)[inside] - 1
        self.n_texts = len(ends) - 1
        self.length = np.bincount(number, minlength=len(at)).astype(np.int64)
        self.text = np.searchsorted(ends, at, "right") - 1
        # Words of one piece have no break between them and lie in one text.
        self.piece = np.cumsum(kind == _BREAK)[at] + self.text
        self.start = np.cumsum(self.length + 1) - self.length - 1
        self.bytes = np.full(int((self.length + 1).sum()), 0x20, np.uint8)
        self.bytes[np.arange(len(number)) + number] = _LOWER[raw[inside]]
        self.lang = langs[self.text] if len(at) else np.zeros(0, np.uint64)
        terms = (self.bytes.astype(np.uint64) + np.uint64(1)) * _powers(base, len(self.bytes))
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        self._scale = _powers(pow(base, -1, 2**64), len(self.bytes))[self.start] if len(at) else np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.start)

    def within(self, n: int) -> np.ndarray:
        """The first words of the n-grams that lie within a piece."""
        first = np.arange(max(0, len(self) - n + 1))
        return first[self.piece[first] == self.piece[first + n - 1]]

    def fingerprints(self, first: np.ndarray, n: int) -> np.ndarray:
        """The polynomial of the bytes of each n-gram, with its language, evenly spread over 64 bits."""
        last = first + n - 1
        sums = self._sums[self.start[last] + self.length[last]] - self._sums[self.start[first]]
        return _mixed(sums * self._scale[first] + _mixed(self.lang[first]))

    def identities(self) -> np.ndarray:
        """A number for each word of the block, equal where the bytes are equal and only there."""
        sums = (self._sums[self.start + self.length] - self._sums[self.start]) * self._scale
        _, shown, same = np.unique(sums, return_index=True, return_inverse=True)
        like = shown[same]
        if (self.length == self.length[like]).all():
            if (self._read(self.start, self.length) == self._read(self.start[like], self.length)).all():
                return same
        known: dict[bytes, int] = {}
        spans = zip(self.start.tolist(), (self.start + self.length).tolist())
        return np.array([known.setdefault(self.bytes[a:b].tobytes(), len(known)) for a, b in spans], np.int64)

    def _read(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The bytes of all spans, one span after the other."""
        return self.bytes[np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]

    def phrases(self, first: np.ndarray, n: int) -> pa.Array:
        """The n-grams that begin at these words, as texts."""
        start, last = self.start[first], first + n - 1
        length = self.start[last] + self.length[last] - start
        offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(self._read(start, length)))


def blocks(texts: pa.Array, langs: np.ndarray, base: int = BASE, size: int = BLOCK_BYTES) -> Iterator[Words]:
    """The words of whole texts, in blocks of about ``size`` bytes."""
    raw, ends = utf8(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + size, "right")) - 1)
        yield Words(raw[ends[low]:ends[high]], ends[low:high + 1] - ends[low], langs[low:high], base)
        low = high


def _langs(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("lang_hash").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _prepared(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.xxhash64(lang).alias("lang_hash"), "text")


def _packed(sorted_values: np.ndarray) -> bytes:
    """Sorted numbers as differences, one plane of bytes after the other: the upper planes are nearly all zero."""
    steps = np.diff(sorted_values, prepend=np.uint64(0))
    return steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.cumsum(steps, dtype=np.uint64)


def frequent_fingerprints(prepared: DataFrame, hash_bits: int, range_bits: int, least: int, base: int = BASE) -> DataFrame:
    """``(hash)``: the upper ``hash_bits`` of the fingerprints that ``least`` or more n-grams have."""
    kind = np.uint8 if least < 256 else np.uint32

    def counted(batches):
        for batch in batches:
            for words in blocks(batch.column("text"), _langs(batch), base):
                found = [words.fingerprints(words.within(n), n) for n in range(1, MOST_WORDS + 1)]
                values, counts = np.unique(np.concatenate(found) >> np.uint64(64 - hash_bits), return_counts=True)
                if not len(values):
                    continue
                ranges = values >> np.uint64(hash_bits - range_bits)
                rest = values & np.uint64((1 << (hash_bits - range_bits)) - 1)
                counts = np.minimum(counts, least).astype(kind)  # a count above the threshold tells no more than one at it
                cuts = np.append(np.flatnonzero(np.diff(ranges, prepend=ranges[:1] + np.uint64(1))), len(values)).tolist()
                # A row for each range that the block meets; yielded in lots, as Arrow copies what it is given.
                for lot in range(0, len(cuts) - 1, 512):
                    spans = list(zip(cuts[lot:lot + 512], cuts[lot + 1:lot + 513]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(ranges[a]) for a, _ in spans], pa.int64()),
                         pa.array([_packed(rest[a:b]) for a, b in spans], pa.binary()),
                         pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())], ["range", "rest", "counts"])

    def summed(parts: pa.Table) -> pa.Table:
        rest = [_unpacked(x.as_py()) for x in parts.column("rest")]
        counts = [np.frombuffer(x.as_py(), kind) for x in parts.column("counts")]
        values, weights = np.concatenate(rest), np.concatenate(counts)
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order].astype(np.int64)
        begins = np.flatnonzero(np.diff(values, prepend=values[:1] + np.uint64(1)))
        often = values[begins[np.add.reduceat(weights, begins) >= least]]
        upper = np.uint64(parts.column("range")[0].as_py() << (hash_bits - range_bits))
        return pa.table({"hash": (often | upper).astype(np.int64)})

    python_tasks(prepared.sparkSession)
    packed = prepared.select("lang_hash", "text").mapInArrow(counted, "range long, rest binary, counts binary")
    return packed.groupBy("range").applyInArrow(summed, "hash long")


class Filter:
    """Which fingerprints may be frequent: bits of a fixed number, two for each frequent one."""

    def __init__(self, bits: np.ndarray, hash_bits: int):
        self.bits, self.hash_bits, self.mask = bits, hash_bits, np.uint64(8 * len(bits) - 1)

    def passes(self, fingerprints: np.ndarray) -> np.ndarray:
        hashes = fingerprints >> np.uint64(64 - self.hash_bits)
        first, second = _places(hashes, self.mask)
        out = self._set(first)
        out[out] = self._set(second[out])
        return out

    def _set(self, places: np.ndarray) -> np.ndarray:
        return (self.bits[(places >> np.uint64(3)).astype(np.int64)] >> (places & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _places(hashes: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    spread = _mixed(hashes + np.uint64(1))
    return spread & mask, spread >> np.uint64(32) & mask


def build_filter(spark: SparkSession, hashes: DataFrame, hash_bits: int) -> Filter:
    """The filter of a staged table of hashes. Slices of its bits are made by tasks; the driver joins them, 64 MB at most."""
    wanted = max(1, 32 * hashes.count())
    n_bits = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (wanted - 1).bit_length()))
    mask, slice_bits = np.uint64(n_bits - 1), min(n_bits, SLICE_BITS)

    def place(batches):
        for batch in batches:
            values = batch.column("hash").to_numpy(zero_copy_only=False).astype(np.uint64)
            places = np.unique(np.concatenate(_places(values, mask))).astype(np.int64)
            cuts = np.searchsorted(places, np.arange(0, n_bits + slice_bits, slice_bits)).tolist()
            parts = [(i, places[a:b] - i * slice_bits) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in parts], pa.int32()),
                 pa.array([p.astype("<u4").tobytes() for _, p in parts], pa.binary())], ["slice", "places"])

    def joined(parts: pa.Table) -> pa.Table:
        bits = np.zeros(slice_bits, np.uint8)
        for x in parts.column("places"):
            bits[np.frombuffer(x.as_py(), "<u4")] = 1
        return pa.table({"slice": parts.column("slice").slice(0, 1),
                         "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    made = hashes.mapInArrow(place, "slice int, places binary").groupBy("slice").applyInArrow(joined, "slice int, bits binary")
    out = np.zeros(n_bits // 8, np.uint8)
    for row in made.toLocalIterator():
        out[row["slice"] * slice_bits // 8:][:slice_bits // 8] = np.frombuffer(row["bits"], np.uint8)
    return Filter(out, hash_bits)


def _occurrences(words: Words, n: int, identities: np.ndarray, wanted: Filter) -> tuple[np.ndarray, np.ndarray]:
    """The first occurrence and the count of each n-gram of the block that the filter lets through."""
    first = words.within(n)
    prints = words.fingerprints(first, n)
    passed = wanted.passes(prints)
    first, prints = first[passed], prints[passed]
    _, shown, same, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
    like = first[shown][same]
    equal = words.lang[first] == words.lang[like]
    for k in range(n):
        equal &= identities[first + k] == identities[like + k]
    if equal.all():
        return first[shown], counts
    # Different phrases share a fingerprint: tell them apart by their words.
    keys = np.stack([words.lang[first].view(np.int64), *[identities[first + k] for k in range(n)]], axis=1)
    _, shown, counts = np.unique(keys, axis=0, return_index=True, return_counts=True)
    return first[shown], counts


def phrases(prepared: DataFrame, wanted: Filter, base: int = BASE) -> DataFrame:
    """``(lang, n, phrase, count)`` per block of the n-grams that pass, and per language its words (``n`` 0, no phrase)."""
    shared = prepared.sparkSession.sparkContext.broadcast((wanted.bits.tobytes(), wanted.hash_bits))

    def found(batches):
        bits, hash_bits = shared.value
        filter_ = Filter(np.frombuffer(bits, np.uint8), hash_bits)
        for batch in batches:
            names = batch.column("lang")
            done = 0
            for words in blocks(batch.column("text"), _langs(batch), base):
                texts = words.text + done  # the block's texts follow those of earlier blocks
                done += words.n_texts
                identities = words.identities()
                _, shown, counts = np.unique(words.lang, return_index=True, return_counts=True)
                yield rows(names, texts[shown], 0, pa.nulls(len(shown), pa.string()), counts)
                for n in range(1, MOST_WORDS + 1):
                    first, counts = _occurrences(words, n, identities, filter_)
                    yield rows(names, texts[first], n, words.phrases(first, n), counts)

    def rows(names, texts, n, phrase, counts):
        return pa.RecordBatch.from_arrays(
            [names.take(pa.array(texts, pa.int64())), pa.array(np.full(len(texts), n, np.int32)), phrase,
             pa.array(counts, pa.int64())], ["lang", "n", "phrase", "count"])

    python_tasks(prepared.sparkSession)
    return prepared.mapInArrow(found, "lang string, n int, phrase string, count long")


def frequent_phrases(docs: DataFrame, least: int = LEAST, range_ngrams: int = RANGE_NGRAMS,
                     base: int = BASE) -> tuple[DataFrame, DataFrame]:
    """``(lang, n, phrase, f)`` of all phrases of one to four words with ``f >= least``, and ``(lang, words)``.

    Both are written tables. The numbers of hash bits and ranges follow the bytes of the texts.
    """
    prepared = _prepared(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    range_bits = min(MOST_RANGES.bit_length() - 1, max(6, math.ceil(math.log2(max(1.0, 0.6 * size / range_ngrams)))))
    hash_bits = range_bits + 30  # the rest of a hash within its range fits four bytes
    hashes = staged(frequent_fingerprints(prepared, hash_bits, range_bits, least, base), "fingerprints")
    wanted = build_filter(docs.sparkSession, hashes, hash_bits)
    counts = staged(phrases(prepared, wanted, base).groupBy("lang", "n", "phrase").agg(F.sum("count").alias("f"))
                    .where(f"n = 0 or f >= {int(least)}"), "phrases")
    return counts.where("n > 0"), counts.where("n = 0").select("lang", F.col("f").alias("words"))


def scored(frequent: DataFrame) -> DataFrame:
    """Candidates ``(lang, phrase, a, k, l, r, score)``, each with its lowest-scoring cut, the earliest of equal ones."""
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = (frequent.where("n > 1").select("lang", "n", "phrase", F.col("f").alias("a"),
                                           F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
            .withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
            .withColumn("right", F.expr("substring_index(phrase, ' ', k - n)")))
    # Every part of a candidate is at least as frequent, so it is in the table.
    both = (cuts.join(parts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    score = F.expr("cast((2000000 * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "n", "a").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "n", "a", "cut.*")


def uncovered(candidates: DataFrame, share: int = 80) -> DataFrame:
    """The candidates that no longer candidate holds at ``share`` per cent or more of their frequency."""
    longer = candidates.where("n > 2").select("lang", "n", F.col("a").alias("f"), F.split("phrase", " ").alias("words"))
    sizes = F.explode(F.sequence(F.lit(2), F.col("n") - 1)).alias("size")
    inner = (longer.select("lang", "n", "f", "words", sizes)
             .select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.col("n") - F.col("size") + 1)).alias("at"))
             .select("lang", "f", F.array_join(F.expr("slice(words, at, size)"), " ").alias("phrase"))
             .groupBy("lang", "phrase").agg(F.max("f").alias("longer")))
    held = F.col("longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * share
    return (candidates.join(inner, ["lang", "phrase"], "left")
            .where(~F.coalesce(held, F.lit(False))).drop("longer"))


def collocations(docs: DataFrame, most: int = 2000, least: int = LEAST, share: int = 80,
                 range_ngrams: int = RANGE_NGRAMS, base: int = BASE) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``most`` best phrases of two to four words of each language.

    ``docs`` needs ``text`` and ``lang``; other columns play no part. A null text is
    empty, a null language is ``und``. Repeated rows count each time. Equal scores go
    by frequency, then by the phrase's bytes. No phrases give no rows. Ranks come from
    distributed prefix sums, so no task sees all candidates of a language.
    """
    frequent, totals = frequent_phrases(docs, least, range_ngrams, base)
    kept = uncovered(staged(scored(frequent), "candidates"), share).withColumns(
        {"by_score": -F.col("score"), "by_count": -F.col("a"), "one": F.lit(1)})
    ranked = (prefix_sums(kept, ["lang"], ["by_score", "by_count", "phrase"], "one", "before")
              .withColumn("rank", F.coalesce("before", F.lit(0)).cast("long") + 1).where(F.col("rank") <= most))
    return (ranked.drop("n").join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score"))
