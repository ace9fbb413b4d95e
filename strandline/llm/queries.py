"""One query per text operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import (
    best_fit,
    collocations,
    extraction,
    language_net,
    merkle,
    mixing,
    packing,
    quality_net,
    quotes,
    rules,
    simhash,
    topk,
    warc,
)
from strandline.llm.common import remainder_is, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_quality_net(spark, sf):
    docs = table(spark, sf, "documents")
    network = quality_net.fit(docs, table(spark, sf, "labels"))
    scored = quality_net.classify(docs.select("doc_id", "text"), network)
    return scored.select("doc_id", remainder_is(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


@query
def op2_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op3_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


@query
def op4_language_net(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    network = language_net.fit(docs)
    found = language_net.identify(docs.select("doc_id", "text"), network)
    return found.select("doc_id", remainder_is(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")


@query
def op5_quotes(spark, sf):
    return quotes.threaded(table(spark, sf, "conversations"))


@query
def op6_warc(spark, sf):
    records = warc.archived(table(spark, sf, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path())


@query
def op8_rules(spark, sf):
    docs = table(spark, sf, "documents")
    learned = rules.fit(docs, table(spark, sf, "labels"))
    return rules.judge(docs.select("doc_id", "text"), learned).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op9_extraction(spark, sf):
    pages = table(spark, sf, "pages")
    return extraction.extracted(pages, extraction.fit(pages)).select("page_id", "url", "text", "n_chars")


@query
def op10_topk(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op11_merkle(spark, sf):
    tampered = remainder_is(F.col("doc_id"), 5, 0)
    found = merkle.manifest(table(spark, sf, "documents"), {"given": merkle.tampered_leaf(tampered)})
    return found.select(
        "doc_id", *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        merkle.hexed(merkle.folded(F.col("given"), F.col("path"))).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_collocations(spark, sf):
    return collocations.collocations(table(spark, sf, "documents"))


@query
def op13_best_fit(spark, sf):
    return best_fit.pack(table(spark, sf, "documents"), tokenizer_path())


ORACLE_SQL["op5_quotes"] = r"""
WITH RECURSIVE messages AS (SELECT *, row_number() OVER () AS m FROM conversations),
lines AS (
    SELECT m, conv_id, turn, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
    FROM (SELECT *, regexp_split_to_array(text, '\r?\n') AS parts FROM messages WHERE regexp_matches(text, '(^|\n)[ \t]*>'))),
leveled AS (
    SELECT m, conv_id, turn, pos, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, substr(line, length(marks) + 1) AS content
    FROM (SELECT *, regexp_extract(line, '^[ \t]*(>[ \t]?)+') AS marks FROM lines)),
kept AS (
    SELECT * FROM (SELECT *, lead(level, 1, 0) OVER (PARTITION BY m ORDER BY pos) AS next_level FROM leveled)
    WHERE NOT (next_level > level AND regexp_matches(content,
        '(?i)^\s*(on\b.*\bwrote|am\b.*\bschrieb\b.*|le\b.*a écrit|el\b.*escribió)\s*:\s*$'))),
marked AS (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY m ORDER BY pos))::INT AS changed FROM kept),
numbered AS (SELECT *, sum(changed) OVER (PARTITION BY m ORDER BY pos) AS run FROM marked),
runs AS (
    SELECT m, conv_id, turn, run, level, string_agg(content, chr(10) ORDER BY pos) AS content
    FROM numbered GROUP BY m, conv_id, turn, run, level),
parsed AS (
    SELECT m, string_agg(content, chr(10) ORDER BY run) FILTER (level = 0) AS own, count(*) FILTER (level > 0) AS n_quoted
    FROM runs GROUP BY m),
texts AS (
    SELECT x.m, conv_id, turn, role, coalesce(n_quoted, 0) AS n_quoted,
           regexp_replace(CASE WHEN p.m IS NULL THEN text ELSE coalesce(own, '') END, '^\s+|\s+$', '', 'g') AS own_text
    FROM messages x LEFT JOIN parsed p ON x.m = p.m),
sources AS (
    SELECT conv_id, turn, level, content FROM runs WHERE level > 0
    UNION ALL SELECT conv_id, turn, 0, own_text FROM texts WHERE turn IS NOT NULL),
units AS (
    SELECT conv_id, turn, level, unnest(list_distinct(list_transform(
        [content] || regexp_split_to_array(content, '\n\s*\n') || regexp_split_to_array(content, '\n'),
        lambda t: lower(trim(regexp_replace(t, '\s+', ' ', 'g')))))) AS unit
    FROM sources),
firsts AS (SELECT conv_id, unit, min(turn) AS said FROM units WHERE level = 0 AND unit <> '' GROUP BY conv_id, unit),
met AS (
    SELECT q.conv_id, q.turn, q.level, length(q.unit) AS size, o.said
    FROM units q JOIN firsts o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.unit = o.unit AND o.said < q.turn
    WHERE q.level > 0),
links AS (
    SELECT conv_id, turn, first(said ORDER BY level, size DESC, said DESC) AS reply_to, count(*) AS n_linked
    FROM met GROUP BY conv_id, turn),
chain AS (
    SELECT conv_id, turn, reply_to AS root, 1 AS depth FROM links
    UNION ALL
    SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1
    FROM chain c JOIN links l ON l.conv_id IS NOT DISTINCT FROM c.conv_id AND l.turn = c.root),
roots AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM chain GROUP BY conv_id, turn),
threads AS (
    SELECT t.*, l.reply_to, coalesce(r.root, t.turn) AS root, coalesce(r.depth, 0)::INT AS depth, coalesce(l.n_linked, 0) AS n_linked
    FROM texts t
    LEFT JOIN links l ON l.conv_id IS NOT DISTINCT FROM t.conv_id AND l.turn = t.turn
    LEFT JOIN roots r ON r.conv_id IS NOT DISTINCT FROM t.conv_id AND r.turn = t.turn)
SELECT conv_id, turn, role, own_text AS text, reply_to, root, depth,
       row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS LAST, turn, m) - 1 AS position, n_quoted, n_linked,
       '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(own_text, '') AS chat
FROM threads
"""

ORACLE_SQL["op6_warc"] = """
WITH hashed AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hexed FROM pages),
digests AS (
    SELECT page_id, octet_length(payload) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(hexed, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)),
        'string_agg', '') AS payload_digest
    FROM hashed)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = max(page_id) OVER same THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = max(page_id) OVER same THEN NULL ELSE max(page_id) OVER same END AS refers_to
FROM digests WINDOW same AS (PARTITION BY payload_digest)
"""

ORACLE_SQL["op10_topk"] = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

ORACLE_SQL["op11_merkle"] = """
WITH RECURSIVE fielded AS (
    SELECT doc_id, source, text,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
               lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda x, step:
                   xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
    FROM documents),
hashed AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
    FROM fielded),
leaves AS (
    SELECT doc_id, leaf, coalesce(changed, leaf) AS given, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
           count(*) OVER (PARTITION BY source) AS n
    FROM hashed),
nodes AS (
    SELECT tree, 0 AS level, idx, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 16, n),
tops AS (
    SELECT 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM leaves) AS n, digest FROM nodes WHERE n = 1
    UNION ALL
    SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx))
    FROM tops WHERE n > 1 GROUP BY level, idx // 16, n),
heights AS (SELECT tree, max(level) AS height FROM nodes GROUP BY tree),
every AS (
    SELECT tree, level, idx, digest FROM nodes WHERE n > 1
    UNION ALL SELECT -1, level, idx, digest FROM tops WHERE n > 1),
siblings AS (
    SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
           coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
    FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // 16 = b.idx // 16
    GROUP BY a.tree, a.level, a.idx),
climb AS (
    SELECT tree, idx AS leaf_idx, 0 AS step, tree AS at_tree, 0 AS at_level, idx AS at_idx, given AS digest, '' AS proof FROM leaves
    UNION ALL
    SELECT c.tree, leaf_idx, step + 1,
           CASE WHEN s.before IS NULL THEN -1 ELSE at_tree END, CASE WHEN s.before IS NULL THEN 0 ELSE at_level + 1 END,
           CASE WHEN s.before IS NULL THEN c.tree ELSE at_idx // 16 END,
           CASE WHEN s.before IS NULL THEN c.digest ELSE sha256(s.before || c.digest || s.after) END,
           proof || coalesce(s.before || s.after, '')
    FROM climb c LEFT JOIN siblings s ON c.at_tree = s.tree AND c.at_level = s.level AND c.at_idx = s.idx
    WHERE s.before IS NOT NULL OR at_tree >= 0),
ends AS (SELECT tree, leaf_idx, arg_max(digest, step) AS folded_root, arg_max(proof, step) AS proof FROM climb GROUP BY tree, leaf_idx)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = r.digest AS verified
FROM leaves l JOIN ends e ON l.tree = e.tree AND l.idx = e.leaf_idx
JOIN nodes s ON s.tree = l.tree AND s.n = 1 JOIN tops r ON r.n = 1
"""

ORACLE_SQL["op12_collocations"] = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
    FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
spans AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, sizes WHERE len(words) >= k),
counted AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spans GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
often AS (SELECT *, string_split(phrase, ' ') AS words FROM counted WHERE f >= 30),
cuts AS (
    SELECT lang, k, phrase, f AS a, words, unnest(range(1, k)) AS cut FROM often WHERE k > 1),
scores AS (
    SELECT c.lang, c.k, c.phrase, a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
    FROM cuts c
    JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(words[1:cut], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(words[cut + 1:c.k], ' ')),
lowest AS (
    SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_spans AS (
    SELECT lang, words, f, size, unnest(range(1, k - size + 2)) AS i
    FROM (SELECT *, unnest(range(2, k)) AS size FROM often WHERE k > 2)),
held AS (SELECT lang, array_to_string(words[i:i + size - 1], ' ') AS phrase, max(f) AS f FROM inner_spans GROUP BY ALL),
ranked AS (
    SELECT c.*, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank
    FROM lowest c LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase
    WHERE NOT coalesce(100 * h.f >= 80 * a, false))
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
