"""Best-fit packing: the plan against brute force, and pieces against the tokenizer."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandline.llm import best_fit
from strandline.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def filled(counts, capacity):
    """The bins of a plan as lists of (offset, length); every piece takes the slot its number says."""
    slots, bins = defaultdict(list), defaultdict(list)
    for slot in best_fit.plan(counts, capacity):
        slots[slot[0]].append(slot)
    for length, count in counts.items():
        for number in range(count):
            _, first, at, offset, each = [s for s in sorted(slots[length]) if s[1] <= number][-1]
            bins[at + (number - first) // each].append((offset + (number - first) % each * length, length))
    return bins


def check_bins(bins, capacity):
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


def plain_best_fit_decreasing(lengths, capacity):
    rooms = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= length]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return len(rooms)


def fewest_pairs(lengths, capacity):
    """The fewest bins for large pieces, trying every partner of the first."""
    @lru_cache(maxsize=None)
    def least(left):
        if not left:
            return 0
        first, rest = left[0], left[1:]
        best = 1 + least(rest)
        for i in range(len(rest)):
            if first + rest[i] <= capacity:
                best = min(best, 1 + least(rest[:i] + rest[i + 1:]))
        return best

    return least(tuple(sorted(lengths)))


@settings(max_examples=300, deadline=None)
@given(st.integers(3, 60), st.lists(st.integers(1, 60), max_size=60))
def test_plan_is_sound_and_no_worse_than_plain_best_fit(capacity, lengths):
    lengths = [x for x in lengths if x <= capacity]
    bins = filled(Counter(lengths), capacity)
    assert sorted(length for b in bins.values() for _, length in b) == sorted(lengths)
    check_bins(bins, capacity)
    assert all(sum(3 * x > capacity for _, x in b) <= 2 for b in bins.values())
    assert len(bins) <= plain_best_fit_decreasing(lengths, capacity) + 1


@settings(max_examples=200, deadline=None)
@given(st.integers(3, 40), st.lists(st.integers(1, 40), max_size=9))
def test_large_pieces_take_the_fewest_bins(capacity, lengths):
    large = [x for x in lengths if 3 * x > capacity and x <= capacity]
    pairs = best_fit.matched(Counter(large), capacity)
    used = Counter()
    for longer, shorter, n in pairs:
        assert longer + shorter <= capacity
        used.update({longer: n})
        used.update({shorter: n} if shorter else {})
    assert used == Counter(large) and sum(n for *_, n in pairs) == fewest_pairs(large, capacity)


def test_plans_of_huge_counts_stay_small():
    for power in (0, 1, 2):
        counts = {length: max(1, int(1e12 / length**power)) for length in range(1, 4097)}
        assert len(best_fit.plan(counts)) < 20_000


def check_rows(rows, texts, capacity=4096):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        docs[r["doc_id"]].append(r)
    check_bins(sequences, capacity)
    assert set(docs) == set(texts)
    for doc_id, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = sorted(docs[doc_id], key=lambda r: r["piece"])
        starts = list(range(0, len(ids), capacity))
        assert [(r["piece"], r["start"]) for r in pieces] == list(enumerate(starts))
        for r in pieces:
            part = ids[r["start"]:r["start"] + capacity]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    total = sum(length for s in sequences.values() for _, length in s)
    return len(sequences), total


def test_query_on_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    bins, total = check_rows(QUERIES["op13_best_fit"](spark, SF).collect(), texts)
    assert bins <= -(-total // 4096) + 1


def test_odd_documents(spark):
    texts = [None, "", "one", "word " * 30_000, "x" * 50_000, "Ä <|endoftext|> ü", "a b c", "a b c", " \n\t ", "y " * 4095, "y " * 4096]
    docs = spark.createDataFrame([(i, t, None, "s", 0) for i, t in enumerate(texts)], SCHEMA)
    check_rows(best_fit.pack(docs, tokenizer_path()).collect(), dict(enumerate(texts)))
    assert best_fit.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_equal_rows_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "same", None, None, 0)] * 5 + [(None, "no id", None, None, 0)] * 2, SCHEMA)
    docs = docs.selectExpr("*", *[f"0 as {c}" for c in ("piece", "start", "length", "key", "one", "row_hash", "before", "place")])
    rows = best_fit.pack(docs, tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 0, 1, 1, 1, 1, 1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 7 and len({r["sequence_id"] for r in rows}) == 1
