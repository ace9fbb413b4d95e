"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import collocations
from strandline.llm.common import python_tasks, utf8

SCHEMA = "doc_id long, text string, lang string"


def plain_collocations(rows, least=30, share=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = {q[i:i + k] for q, b in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                   if 100 * b >= share * often[q[i:i + k]]}
        found = []
        for p, a in often.items():
            if p in covered:
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def made_rows(seed=3, size=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "b", "ab", "ba", "New", "york", "ÄÖ", "äö", "x\x01y", " ", "日本", "'s"]
    glue = [" "] * 20 + ["  ", "\t", ". ", ",", "\n", "\r\n", " ; ", "!?"]
    return [("".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und"]))
            for _ in range(size)]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    return sorted(map(tuple, collocations.collocations(docs, **options).collect()))


@pytest.mark.parametrize("options", [{}, {"least": 5, "most": 20}, {"least": 300}, {"share": 50}, {"least": 5, "range_ngrams": 50}])
def test_equals_plain_counting(spark, options):
    rows = made_rows() * (30 if options.get("least") == 300 else 1)
    want = plain_collocations(rows, **{k: v for k, v in options.items() if k != "range_ngrams"})
    assert want and found(spark, rows, **options) == want


@pytest.mark.parametrize("base", [1, 3, 2**63 + 1])
def test_colliding_fingerprints_do_not_mix_phrases(spark, base):
    """With base 1 all orders of the same letters share a fingerprint."""
    rows = made_rows(4, 150)
    assert found(spark, rows, base=base, least=10) == plain_collocations(rows, least=10)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rows = made_rows(5, 100)
    monkeypatch.setattr(collocations, "build_filter", lambda spark, hashes, bits: collocations.Filter(np.full(8, 255, np.uint8), bits))
    assert found(spark, rows, least=10) == plain_collocations(rows, least=10)


def test_odd_rows(spark):
    long_text = "very long text indeed " * 300_000
    rows = [(None, "en"), ("", None), (" \n.,", "en"), ("word", "en"), (long_text, "en")] + [("same row here", "fr")] * 30
    want = [r for r in plain_collocations(rows)]
    assert found(spark, rows) == want and {r[0] for r in want} == {"en", "fr"}
    assert found(spark, []) == [] and found(spark, rows[:4]) == []


def test_extra_columns_play_no_part(spark):
    docs = spark.createDataFrame([(1, "pair of words", "en")] * 40, SCHEMA)
    extra = docs.select("*", *[F.lit("x").alias(c) for c in ("n", "phrase", "count", "lang_hash", "rank", "f", "one")])
    assert collocations.collocations(extra).collect() == collocations.collocations(docs).collect() != []


def test_filter_is_bounded_and_holds_all(spark):
    python_tasks(spark)
    hashes = spark.range(0, 1 << 20, 7).select(F.xxhash64("id").bitwiseAND((1 << 40) - 1).alias("hash"))
    wanted = collocations.build_filter(spark, hashes, 40)
    assert 8 * len(wanted.bits) <= collocations.FILTER_BITS[1]
    values = np.array([r[0] for r in hashes.collect()], np.uint64) << np.uint64(24)
    assert wanted.passes(values).all()
    assert wanted.passes(np.random.default_rng(0).integers(0, 2**64, 100_000, np.uint64)).mean() < 0.02


def test_blocks_do_not_change_words():
    texts = pa.array([t for t, _ in made_rows(6, 50)] + [None, "", "end"])
    langs = np.arange(len(texts)).astype(np.uint64)
    whole = [w for b in collocations.blocks(texts, langs) for w in b.phrases(np.arange(len(b)), 1).to_pylist()]
    small = [w for b in collocations.blocks(texts, langs, size=40) for w in b.phrases(np.arange(len(b)), 1).to_pylist()]
    raw, _ = utf8(texts)
    assert whole == small and len(whole) == len(re.findall(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", b" ".join(
        (t or "").encode() for t in texts.to_pylist())))
