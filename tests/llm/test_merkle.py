"""The dataset manifest against plain hashing."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.llm import merkle
from strandline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    values = [row[f] for f in merkle.FIELDS]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(leaves, arity):
    """The root, and for each leaf its (slot, siblings) at every level."""
    level, above, proofs = leaves, list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for leaf, at in enumerate(above):
            run = level[at // arity * arity:at // arity * arity + arity]
            proofs[leaf].append((at % arity, run[:at % arity] + run[at % arity + 1:]))
        above = [at // arity for at in above]
        level = [digest(*level[i:i + arity]) for i in range(0, len(level), arity)]
    return level[0], proofs


def plain_manifest(rows, arity=16):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[name] = plain_tree([plain_leaf(r) for r in groups[name]], arity)
    root, tops = plain_tree([trees[n][0] for n in names], arity)
    out = []
    for name, top in zip(names, tops):
        for row, proof in zip(groups[name], trees[name][1]):
            path = proof + top
            at = dict(row)
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0 and row["text"] is not None:
                at["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            folded = plain_leaf(at)
            for slot, siblings in path:
                folded = digest(*siblings[:slot], folded, *siblings[slot:])
            out.append((row["doc_id"], plain_leaf(row), trees[name][0], root,
                        digest(*[s for _, siblings in path for s in siblings]), folded, folded == root))
    return out


def found(spark, docs, arity=16):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    rows = merkle.manifest(docs, {"n": merkle.tampered_leaf(F.coalesce(tampered, F.lit(False)))}, arity=arity)
    hexed = [merkle.hexed(F.col(c)) for c in ("leaf", "subroot", "root")]
    folded = merkle.hexed(merkle.folded(F.col("n"), F.col("path")))
    return [tuple(r) for r in rows.select("doc_id", *hexed, merkle.proof_digest(F.col("path")), folded,
                                          folded == merkle.hexed(F.col("root"))).collect()]


def test_query_equals_plain_hashing(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op11_merkle"](spark, SF).collect()]
    assert sorted(got) == sorted(plain_manifest(rows))
    assert 0 < sum(not r[-1] for r in got) < len(got)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_odd_rows(spark, arity):
    rows = [(i, f"Text {i}", "en", "a", 6) for i in range(37)]
    rows += [(None, None, None, None, None), (5, "Äöü ÄB", None, "ä", 0), (5, "other", "de", "ä", 5), (5, "other", "de", "ä", 5),
             (7, "", "", "", 0), (8, "x" * 100_000, "en", "z", None), (9, None, "en", "z", 3)]
    rows += [(100 + i, "T", "en", f"s{i:02}", 1) for i in range(18)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = plain_manifest([r.asDict() for r in docs.collect()], arity)
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(found(spark, docs, arity), key=key) == sorted(want, key=key)


def test_one_row_no_row_and_extra_columns(spark):
    one = spark.createDataFrame([(1, "Only", "en", "a", 4)], SCHEMA)
    assert found(spark, one) == plain_manifest([r.asDict() for r in one.collect()])
    assert found(spark, one.limit(0)) == []
    clashing = one.select("*", *[F.lit(0).alias(c) for c in ("tree", "idx", "n", "digest", "path", "leaf", "slot", "one", "before", "all")])
    assert found(spark, clashing) == found(spark, one)


def test_no_two_runs_of_a_level_meet(spark):
    """A level is an equijoin on tree and index, and one task gathers at most a run."""
    rows = spark.range(2000).select(F.lit(0).cast("long").alias("tree"), "id", F.lit(2000).cast("long").alias("n"))
    nodes = rows.select("tree", F.col("id").alias("idx"), "n", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    levels, roots = merkle.grow(nodes)
    assert [x.count() for x in levels] == [2000, 125, 8, 1] and roots.count() == 1
    assert max(r[0] for r in levels[0].select(F.octet_length("siblings")).collect()) == 15 * 32
