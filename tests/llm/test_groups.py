"""SimHash groups, link components, prefix sums, source mix and packing."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import mixing, packing, simhash
from strandline.llm.components import components
from strandline.llm.queries import QUERIES, tokenizer_path
from strandline.operators.ranking import prefix_sums

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {d["doc_id"]: plain_fingerprint(d["text"]) for d in docs}
    ids = sorted(prints)
    close = [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = plain_classes(ids, close)
    found = QUERIES["op2_simhash"](spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in found} == {
        i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_spark_and_the_library_hash_alike(spark):
    text = "ein zwei drei"
    found = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert found % (1 << 64) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_classes_of_fingerprints_for_any_blocks_and_tree_size(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(120)]
    for v in values[:30]:  # chains of near values, and one crowded neighbourhood
        for _ in range(4):
            v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            values.append(v)
    values += [values[0] ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)][:400]
    values = sorted(set(values))
    want = plain_classes(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for options in ({}, {"blocks": 5}, {"blocks": 6, "tree_nodes": 7}, {"tree_nodes": 16, "rows_of_a_shard": 20}):
        root = {v: v for v in values}
        root.update({r["node"] % (1 << 64): r["root"] % (1 << 64) for r in components(simhash.links(df, 3, **options)).collect()})
        groups, wanted = defaultdict(set), defaultdict(set)
        for v in values:
            groups[root[v]].add(v)
            wanted[want[v]].add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values())), options


def test_links_of_a_group_of_copies_stay_linear(spark):
    base = 0x0123456789ABCDEF
    values = sorted({base ^ (1 << i) ^ (1 << j) for i in range(40) for j in range(i)})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    assert simhash.links(df, 3).count() <= 4 * len(values)


def test_long_chain_becomes_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(301)}, 500: 500, 501: 500}
    assert components(links.limit(0)).count() == 0


def test_hubs_are_spread(spark):
    """Two hubs and a chain between them, their links divided among salts, are one component."""
    pairs = [(1000, i) for i in range(100, 400)] + [(i, 2000) for i in range(1001, 1300)] + [(1000, 50), (50, 51), (51, 2000)]
    pairs += [(3000, 3001), (3000, 3001), (None, 4000), (4001, None)]
    links = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    want = plain_classes({n for p in pairs[:-2] for n in p}, pairs[:-2])
    for options in ({"links_of_a_node": 9}, {}):
        found = components(links, **options).collect()
        assert len(found) == len(want) and {r["node"]: r["root"] for r in found} == want


ODD = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (None, "One two", None, None, 7),
       (5, "one  TWO", "en", "b", 8), (5, "one  TWO", "en", "b", 8), (6, "É é", "fr", None, 3), (7, "é É", "fr", "b", 3),
       (None, "alone here we are now", "en", "c", 9), (9, "word " * 30_000, "en", "a", 150_000)]


def test_groups_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("fp", F.lit("mine"))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(ODD)
    by_print = defaultdict(list)
    for r in found:
        by_print[r["fingerprint"]].append(r)
    assert {r["doc_id"] for r in by_print["0" * 16]} == {1, 2, 3} and {r["component_id"] for r in by_print["0" * 16]} == {1}
    assert {r["component_id"] for r in by_print[f"{plain_fingerprint('one two'):016x}"]} == {5}
    assert [r["component_id"] for r in found if r["fingerprint"] == f"{plain_fingerprint(ODD[8][1]):016x}"] == [None]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, [r["doc_id"] for r in kept.collect()])) == ["1", "5", "6", "7", "9", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_prefix_sums_equal_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000), i, rng.randrange(5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, id int, v long").withColumn("range", F.lit("mine"))
    found = {r["id"]: r["before"] for r in prefix_sums(df, ["g"], ["k", "id"], "v", "before").collect()}
    total = defaultdict(int)
    for g, k, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        assert (found[i] or 0) == total[g]
        total[g] += v


def plain_targets(sizes):
    named = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(named)}
    total, target, open_ = sum(sizes.values()), {}, set(named)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
    return target


def check_mix(rows):
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = plain_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + r["target"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 0.5 + 1e-6


def test_mix_meets_its_targets(spark):
    docs = {d["doc_id"]: d for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_mixing"](spark, SF).collect()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]]["text"])) for r in rows)
    assert len(rows) == len(docs)
    check_mix(rows)
    again = QUERIES["op3_mixing"](spark, SF).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("size", F.lit(-1))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ODD)
    check_mix(rows)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mix(docs.where("doc_id = 1")).collect())


def test_sources_of_every_kind_of_limit(spark):
    rows = [(i, "w " * n, None, s, None) for i, (s, n) in enumerate(
        [("a", 1000), ("b", 3), ("c", 1), ("d", 50), (None, 2), ("é", 40), ("z", 7)] * 3)]
    check_mix(mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())


def test_mixed_documents_hold_what_was_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionAll(spark.createDataFrame(ODD, SCHEMA))
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["taken"]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    held, texts = defaultdict(int), {d["text"] for d in docs.collect()}
    cut = 0
    for r in mixed.collect():
        held[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        if r["text"] not in texts:
            cut += 1
            assert any(t and t.startswith(r["text"]) for t in texts) and r["n_chars"] == len(r["text"])
    assert {s: n for s, n in taken.items() if n} == dict(held) and cut <= len(taken)


def test_first_words_keep_white_space(spark):
    df = spark.createDataFrame([("a\n b  c", 2), (" \ta b", 1), ("one", 1), ("x y", 2)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == ["a\n b", " \ta", "one", "x y"]


def check_packing(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    want = defaultdict(list)
    for x in ids:
        want[len(x)].append(x)
    assert sum(r["length"] for r in rows) == sum(map(len, ids))
    sequences = defaultdict(list)
    for r in rows:
        assert r["length"] > 0
        sequences[r["sequence_id"]].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return ids, sequences


def test_packing_holds_every_token_once_with_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op7_packing"](spark, SF).collect()
    ids, sequences = check_packing(rows, [d["text"] for d in docs])
    tokens = {d["doc_id"]: x for d, x in zip(docs, ids)}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for i, parts in pieces.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            part = tokens[i][at:at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(tokens[i])
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(tokens[i])
    full = [sum(r["length"] for r in parts) for parts in sequences.values()]
    room = sum(n if n & (n - 1) == 0 else 4096 for n in full)
    assert sum(full) / room > 0.95


def test_packing_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("length", F.lit("mine"))
    rows = packing.pack(docs, tokenizer_path()).collect()
    check_packing(rows, [r[1] for r in ODD])
    check_packing(packing.pack(docs, tokenizer_path(), capacity=64).collect(), [r[1] for r in ODD], 64)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_words_are_tokenized_as_texts_are():
    tokens = packing.Tokens(tokenizer_path())
    texts = ["a|b | c", "<|endoftext|> x<|endoftext|>y", "İstanbul ΑΣ Σ it's IT'S ́á", "​ \x85 \xa0z 12three", "", " \n"]
    found = [x.tolist() for x in tokens.ids([t.encode() for t in texts])]
    assert found == [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert tokens.plain


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abzÀßéÿĀ\u0301ªº²9_'.,#-<|> \n", max_size=30))
def test_any_text_is_tokenized_as_by_the_tokenizer(text):
    tokens = packing._tokens(tokenizer_path())
    assert tokens.ids([text.encode()])[0].tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_fill_bins_of_their_class():
    for n in range(0, 20_000, 7):
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and all(4096 // k * k > 4096 - 128 for k in lengths)
