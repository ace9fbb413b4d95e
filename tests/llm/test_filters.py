"""Quality rules and the two byte networks."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import common, language_net, quality_net, rules
from strandline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab #é\n\t\x0b\x1c\xa0 <A1!", max_size=60))
def test_statistics_equal_plain_counting(text):
    assert rules.text_statistics(text.encode())[:5] == plain_statistics(text)


def test_rules_query_equals_plain_counting(spark):
    found = {r["doc_id"]: r for r in QUERIES["op8_rules"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(found) == len(docs)
    right = []
    for d in docs:
        r, counts = found[d["doc_id"]], plain_statistics(d["text"] or "")
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])
        if d["doc_id"] in quality and not r["base_failed"]:
            right.append(r["kept"] == (quality[d["doc_id"]] == 1))
    assert np.mean(right) > 0.97


def test_a_list_is_learned_from_what_separates_the_classes():
    rng = np.random.default_rng(3)
    values = {"a": rng.random(900), "b": rng.random(900), "noise": rng.random(900)}
    bad = ((values["a"] > 0.7) & (values["b"] <= 0.5)) | (values["b"] > 0.9)
    learned = rules.learn(values, bad, rng.random(900))
    rejected = np.zeros(900, bool)
    for rule in learned.rules:
        met = np.ones(900, bool)
        for condition in rule:
            met &= condition.holds(values)
        rejected |= met
    assert (rejected == bad).mean() > 0.97
    assert "reject if" in str(learned)


def test_rules_do_not_turn_on_the_length_of_a_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = rules.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("aeiourstn"), rng.integers(2, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words, n)) + "." for n in (60, 600, 60_000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert [r["kept"] for r in rules.judge(df, learned).orderBy("doc_id").collect()] == [True] * 3


def test_rules_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "one two three " * 30, "en", "s", 5), (2, None, None, None, None),
                                  (None, "", "en", "s", 0), (1, "one two three " * 30, "en", "s", 5)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    learned = rules.fit(docs, none)
    assert learned.rules == ()
    judged = rules.judge(docs.withColumn("Counts", F.lit(1)), learned).collect()
    assert len(judged) == 4 and all(r["Counts"] == 1 and r["base_failed"] and not r["kept"] for r in judged)
    assert rules.keep_good(docs.limit(0), learned).count() == 0
    assert rules.keep_good(docs, learned).columns == docs.columns


def test_quality_network_on_rows_it_never_saw(spark):
    scored = QUERIES["op1_quality_net"](spark, SF).toPandas()
    assert scored["score"].between(0, 1).all() and len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (scored["predicted"] == (scored["score"] >= 0.7)).all()
    assert (scored["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in scored["doc_id"]]).all()
    labelled = scored.merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    held = labelled[labelled["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.9  # about 300 labels to learn from
    assert held.loc[held["quality"] == 1, "predicted"].mean() > 0.97


def test_quality_network_sees_the_whole_text_and_takes_anything(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join("".join(rng.choice(list("abcde"), 5)) for _ in range(60)) for _ in range(60)]
    docs = [(i, t if i % 2 else t + " ##$$## " * 5, None, None, None) for i, t in enumerate(clean)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    df = spark.createDataFrame(docs, SCHEMA)
    network = quality_net.fit(df, labels)
    long = "abcde " * 200_000
    odd = spark.createDataFrame([(100, None, None, None, None), (101, "", None, None, None), (None, "x", None, None, None),
                                 (102, long, None, None, None), (103, long + " ##$$## " * 5, None, None, None),
                                 (104, "é", None, None, None)], SCHEMA).withColumn("score_", F.lit(1))
    scored = {r["doc_id"]: r for r in quality_net.classify(odd, network).collect()}
    assert len(scored) == 6 and all(0 <= r["score"] <= 1 for r in scored.values())
    assert scored[100]["score"] == scored[101]["score"]
    assert scored[103]["score"] < scored[102]["score"]  # the only difference is at the very end
    assert quality_net.keep_good(odd.withColumn("score", F.lit("mine")), network).columns == [*odd.columns, "score"]
    assert quality_net.classify(odd.limit(0), network).count() == 0
    nothing = quality_net.fit(df, labels.limit(0))
    assert {round(r["score"], 9) for r in quality_net.classify(odd, nothing).collect()} == {1.0}
    bad = quality_net.fit(df, labels.where("quality = 0"))
    assert {round(r["score"], 9) for r in quality_net.classify(odd, bad).collect()} == {0.0}


def test_network_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (700, 40, 300, 1200)]
    truth = np.array([1, 0, 0, 1], np.float32)
    w = quality_net.train([b"a", b"b"], np.array([1, 1]))  # the starting weights
    w["bias"][:] = 0
    w = {k: v.astype(np.float64) for k, v in w.items()}
    w["head"] = rng.normal(0, 0.5, w["head"].shape)
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    layout = quality_net._Layout(np.frombuffer(b"".join(texts), np.uint8), ends)
    grads, loss = quality_net._gradients(layout, w, truth)
    step = 1e-4
    for name, at in (("filters", (3, 5)), ("filters", (20, 1)), ("head", (4,)), ("head", (30,)), ("head", (60,)), ("offsets", (2,)), ("bytes", (100, 2))):
        moved = {k: v.copy() for k, v in w.items()}
        moved[name][at] += step
        up = quality_net._gradients(layout, moved, truth)[1]
        moved[name][at] -= 2 * step
        down = quality_net._gradients(layout, moved, truth)[1]
        slope = (up - down) / (2 * step) + (1e-4 * w["head"][at] if name == "head" else 0)
        assert abs(slope - grads[name][at]) < 0.02 * abs(slope) + 2e-4


def test_languages_of_rows_never_seen(spark):
    found = QUERIES["op4_language_net"](spark, SF).toPandas()
    assert found["score"].between(0, 1).all()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found["doc_id"]]).all()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    both = found.merge(docs, on="doc_id")
    held = both[both["held_out"] & both["lang"].notna()]
    assert len(both) == len(docs) and (held["lang_pred"] == held["lang"]).mean() > 0.95


def test_languages_of_odd_texts(spark):
    # Keys 0 and 1 may be learned from, 2 and 3 may not.
    docs = spark.createDataFrame([(0, "der die das und " * 20, "de", None, None), (1, "the of and to " * 20, "en", None, None)] * 2
                                 + [(2, "le la les des " * 20, "fr", None, None), (3, "x", None, None, None)], SCHEMA)
    network = language_net.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? \n"), (None, "é"), (4, "the " * 100_000), (4, "the " * 100_000)],
                                "doc_id long, text string").withColumn("score", F.lit("old"))
    rows = language_net.identify(odd, network).collect()
    assert [r["lang_pred"] for r in rows][:3] == ["und"] * 3 and all(r["lang_pred"] in ("de", "en") for r in rows[3:])
    assert all(0 <= r["score"] <= 1 for r in rows) and language_net.identify(odd.limit(0), network).count() == 0
    unknown = language_net.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language_net.identify(odd, unknown).collect()} == {"und"}


def test_windows_cover_every_byte():
    texts = [b"", b"a" * 10, b"b" * language_net.WINDOW, b"c" * (3 * language_net.WINDOW + 1)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data, text, held = language_net.windows(np.frombuffer(b"".join(texts), np.uint8), ends)
    assert [bytes(data[text == i].reshape(-1)).rstrip(b"\0") for i in range(4)] == texts
    assert np.bincount(text, held, 4).tolist() == [len(t) for t in texts]


def test_language_net_learns_every_language(spark):
    words = {"long": "abacada ", "short": "zyxw ", "usual": "mnopmn qrst "}
    rows = []
    for i in range(120):
        rows += [(3 * i, words["long"] * (10_000 + i), "long"), (3 * i + 1, words["short"] * 4, "short"),
                 (3 * i + 2, words["usual"] * 30, "usual")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    network = language_net.fit(docs)
    assert network.languages == ["long", "short", "usual"]
    found = language_net.identify(docs, network)
    assert found.where("lang <> lang_pred").count() == 0


def test_labelled_samples_lose_no_class(spark, monkeypatch):
    monkeypatch.setattr(common, "MOST_LABELLED", 900)
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 600).alias("label"))
    sample = common.labelled_sample(docs, docs.select("doc_id", "label"), "label", 100, F.lit(True)).collect()
    assert len({r["label"] for r in sample}) == 600 and len(sample) < 1_500


def test_language_net_of_very_many_languages():
    texts = [bytes([97 + c % 26, 97 + c // 26, 32]) * 40 for c in range(300)]
    network = language_net.Network(language_net.train(texts, np.arange(300), 300, epochs=1), [str(c) for c in range(300)])
    assert np.abs(network.weights["head"]).sum(axis=0).min() > 0
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    whole = network.predict(raw, ends)
    language_net.SHARES, before = 3_000, language_net.SHARES
    try:
        parts = network.predict(raw, ends)
    finally:
        language_net.SHARES = before
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


LABELS = "doc_id string, quality int, toxic int"


def long_and_short(spark):
    """Good documents are long, bad ones short; keys are texts."""
    rng = random.Random(8)
    good = ["lake", "children", "story", "water", "evening", "found", "near", "the"]
    docs = [(f"g{i}", " ".join(rng.choice(good) for _ in range(14_000)), "en", "s", 0) for i in range(30)]
    docs += [(f"b{i}", " ".join(rng.choice(["$$$", "##", "buy", "now", "!!", "click"]) for _ in range(120)), "en", "s", 0) for i in range(30)]
    schema = "doc_id string, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([(d[0], int(d[0][0] == "g"), 0) for d in docs], LABELS)
    return spark.createDataFrame(docs, schema), labels


def test_quality_network_learns_a_class_of_long_documents(spark):
    docs, labels = long_and_short(spark)
    assert docs.selectExpr("max(octet_length(text))").first()[0] > quality_net.FIT_BYTES
    scored = quality_net.classify(docs, quality_net.fit(docs, labels, fit_rows=12)).collect()
    assert all((r["score"] > 0.7) == (r["doc_id"][0] == "g") for r in scored)


def test_rules_take_text_keys(spark):
    docs, labels = long_and_short(spark)
    learned = rules.fit(docs, labels)
    assert learned.rules
    kept = {r["doc_id"] for r in rules.keep_good(docs, learned).collect()}
    assert not any(k[0] == "b" for k in kept)


def test_stretches_of_long_texts(spark):
    texts = ["", "short", "0123456789" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [bytes(r[0]) for r in df.select(common.spread_bytes(F.col("text"), 160)).collect()]
    assert found[:2] == [b"", b"short"] and len(found[2]) == 160
    assert found[2][:10] == b"0123456789" and found[2][-10:] == b"0123456789"


def test_quality_scores_equal_a_direct_convolution():
    rng = np.random.default_rng(2)
    net = quality_net.Network({
        "bytes": rng.normal(size=(256, quality_net.DEPTH)).astype(np.float32),
        "filters": rng.normal(size=(quality_net.WIDTH * quality_net.DEPTH, quality_net.FILTERS)).astype(np.float32),
        "offsets": rng.normal(size=quality_net.FILTERS).astype(np.float32),
        "head": rng.normal(size=3 * quality_net.FILTERS).astype(np.float32), "bias": np.array([0.3], np.float32)})
    w, step, half = net.weights, quality_net.STEP, quality_net.SEGMENT
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (1, 5, 250, 251, 256, 700, 2000)]
    ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = net.scores(np.concatenate(texts), ends)
    for text, score in zip(texts, found):
        padded = np.concatenate([text, np.zeros(quality_net.WIDTH, np.uint8)])
        response = np.array([
            np.maximum(0, sum(w["bytes"][padded[at + j]] @ w["filters"][j * quality_net.DEPTH:(j + 1) * quality_net.DEPTH]
                              for j in range(quality_net.WIDTH)) + w["offsets"]) for at in range(0, len(text), step)])
        segments = max(1, -(-(len(text) + quality_net.WIDTH) // (half * step)))
        chunks = []  # a chunk is two neighbouring segments; windows past the end respond with nothing
        for first in range(max(1, segments - 1)):
            part = response[first * half:(first + 2) * half]
            chunks.append(np.maximum(part.max(axis=0), 0) if len(part) else np.zeros(quality_net.FILTERS))
        joined = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0)])
        assert abs(1 / (1 + np.exp(-np.clip(joined @ w["head"] + w["bias"][0], -40, 40))) - score) < 1e-4
