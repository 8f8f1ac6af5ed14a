"""The registered queries of the training-data operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabuloom.llm import bpe, decontaminate, fingerprint, language_model, line_dedup, merkle, metric_join, quality, quotes, simhash, url_filter, warc, whitening
from tabuloom.llm.common import table

#: host, path, action
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the line windows that an earlier one holds."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def remainder(key: str, n: int) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a bigram model of nine tenths of them."""
    return language_model.score(table(spark, sf_dir, "documents"), held_out=remainder("doc_id", 10) == 0)


def op5_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message without its quotes, under the message that it replies to."""
    return quotes.reply_order(table(spark, sf_dir, "conversations"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return metric_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document."""
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels of two thirds of the keys."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learned=remainder("doc_id", 3) != 1)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    spec = bpe.load(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), spec)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives say of every page."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they are."""
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading components of the distinct vectors, whitened."""
    vectors = table(spark, sf_dir, "embeddings")
    white = whitening.whiten(vectors, whitening.fit(vectors))
    return white.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, root and proof of every document, and what it folds to without line ends in half of the texts."""
    tampered = F.when(remainder("doc_id", 2) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    proven = merkle.prove(table(spark, sf_dir, "documents"), changed={"text": tampered})
    return proven.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_url_filter": op2_url_filter,
    "op3_line_dedup": op3_line_dedup,
    "op4_language_model": op4_language_model,
    "op5_quotations": op5_quotations,
    "op6_embeddings": op6_embeddings,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_fingerprint": op11_fingerprint,
    "op12_whitening": op12_whitening,
    "op13_merkle": op13_merkle,
}

SQL: dict[str, str] = {}

SQL["op2_url_filter"] = f"""
WITH rules(r_host, r_path, action) AS (VALUES {", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in URL_RULES)}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r_host || r_path) DESC NULLS LAST, length(r_host) DESC, action DESC) = 1
"""

SQL["op3_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
n AS (
  SELECT doc_id, pos, t, count(*) OVER (PARTITION BY doc_id) AS m
  FROM (SELECT doc_id, pos, trim(regexp_replace(line, '[\x09-\x0D\x20]+', ' ', 'g')) AS t FROM l) WHERE t <> ''),
w AS (
  SELECT * FROM (
    SELECT doc_id, pos AS f, lead(pos, 2) OVER p AS z, t || chr(10) || lead(t, 1) OVER p || chr(10) || lead(t, 2) OVER p AS win
    FROM n WHERE m >= 3 WINDOW p AS (PARTITION BY doc_id ORDER BY pos)) WHERE z IS NOT NULL
  UNION ALL
  SELECT doc_id, min(pos), max(pos), string_agg(t, chr(10) ORDER BY pos) FROM n WHERE m < 3 GROUP BY doc_id),
a AS (SELECT win, min({'d': doc_id, 'f': f, 'z': z}) AS a FROM w GROUP BY win HAVING count(*) > 1),
s AS (
  SELECT doc_id, CASE WHEN doc_id = a.d THEN greatest(f, a.z + 1) ELSE f END AS f, z
  FROM w JOIN a USING (win) WHERE NOT (doc_id = a.d AND f = a.f)),
gone AS (SELECT DISTINCT doc_id, unnest(range(f, z + 1)) AS pos FROM s WHERE f <= z),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.pos) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL), '') AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

SQL["op5_quotations"] = r"""
WITH RECURSIVE rows AS (SELECT *, row_number() OVER () AS rid FROM conversations),
lines AS (
  SELECT rid, conv_id AS c, turn AS t, role AS r, unnest(a) AS x, unnest(range(len(a))) AS pos
  FROM (SELECT *, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS a FROM rows)),
marked AS (SELECT *, regexp_extract(x, '^(?:[ \t]*>)+[ \t]?') AS marks FROM lines),
l AS (
  SELECT rid, c, t, r, pos, length(replace(replace(marks, ' ', ''), chr(9), '')) AS level, substr(x, length(marks) + 1) AS line,
         lower(trim(regexp_replace(substr(x, length(marks) + 1), '[\x09-\x0D\x20]+', ' ', 'g'))) AS passage FROM marked),
starts AS (
  SELECT *, passage <> '' AND (coalesce(lag(passage) OVER w, '') = '' OR lag(level) OVER w <> level) AS fresh
  FROM l WHERE c IS NOT NULL AND t IS NOT NULL WINDOW w AS (PARTITION BY rid ORDER BY pos)),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY rid ORDER BY pos) AS blk FROM starts),
blocks AS (
  SELECT c, t, level, rid, blk, string_agg(passage, ' ' ORDER BY pos) AS passage, count(*) AS n FROM numbered
  WHERE passage <> '' GROUP BY ALL),
wrote AS (SELECT c, t, passage FROM blocks WHERE level = 0 UNION SELECT c, t, passage FROM l WHERE level = 0 AND passage <> '' AND c IS NOT NULL AND t IS NOT NULL),
inside AS (SELECT passage, c, min(t) AS f FROM wrote GROUP BY ALL),
everywhere AS (SELECT passage, min({'c': c, 't': f}) AS o FROM inside GROUP BY passage),
q AS (
  SELECT b.*, CASE WHEN f < b.t THEN {'c': b.c, 't': f} WHEN len(string_split(b.passage, ' ')) >= 12 AND o < {'c': b.c, 't': b.t} THEN o END AS dst
  FROM blocks b LEFT JOIN inside i ON i.passage = b.passage AND i.c = b.c LEFT JOIN everywhere e ON e.passage = b.passage WHERE level > 0),
found AS (
  SELECT c, t, level, n, dst FROM q WHERE dst IS NOT NULL
  UNION ALL
  SELECT q.c, q.t, q.level, 1, CASE WHEN f < q.t THEN {'c': q.c, 't': f} END
  FROM q JOIN numbered m ON m.rid = q.rid AND m.blk = q.blk AND m.passage <> '' LEFT JOIN inside i ON i.passage = m.passage AND i.c = q.c
  WHERE q.dst IS NULL),
counted AS (SELECT c, t, level, dst, sum(n) AS n FROM found GROUP BY ALL),
replies AS (
  SELECT c, t, sum(n)::BIGINT AS quoted, coalesce(sum(n) FILTER (dst IS NOT NULL), 0)::BIGINT AS linked,
         struct_extract(max({'l': -level, 'n': n, 'd': dst}) FILTER (dst IS NOT NULL), 'd') AS dst FROM counted GROUP BY c, t),
chain AS (
  SELECT c, t, dst.c AS rc, dst.t AS rt, 1 AS depth FROM replies WHERE dst IS NOT NULL
  UNION ALL
  SELECT a.c, a.t, b.dst.c, b.dst.t, depth + 1 FROM chain a JOIN replies b ON b.c = a.rc AND b.t = a.rt WHERE b.dst IS NOT NULL),
ends AS (SELECT * FROM chain QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY depth DESC) = 1),
own AS (
  SELECT c, t, coalesce(any_value(r), '') AS role,
         regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0), ''), '\A[\x09-\x0D\x20]+|[\x09-\x0D\x20]+\z', '', 'g') AS text
  FROM l GROUP BY rid, c, t)
SELECT o.c AS conv_id, o.t AS turn, role, text, '<|' || role || '|>' || chr(10) || text || chr(10) AS formatted,
       coalesce(quoted, 0) AS quoted, coalesce(linked, 0) AS linked, dst.c AS reply_conv, dst.t AS reply_turn,
       coalesce(rc, o.c) AS thread_conv, coalesce(rt, o.t) AS thread_turn, coalesce(depth, 0) AS depth
FROM own o LEFT JOIN replies p ON p.c = o.c AND p.t = o.t LEFT JOIN ends e ON e.c = o.c AND e.t = o.t
"""

SQL["op10_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS origin FROM pages)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id > origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > origin THEN origin END AS refers_to
FROM p
"""

SQL["op13_merkle"] = r"""
WITH RECURSIVE crc AS (
  SELECT *, doc_id IS NOT NULL AND xor(4294967295, list_reduce(
    [4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
    lambda c, d: list_reduce([xor(c, d)] || range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) % 2 = 0 AS tampered
  FROM documents),
f AS (
  SELECT doc_id, source, tampered, text, concat(
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS front,
    CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM crc),
h AS (
  SELECT doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(front || coalesce(strlen(changed) || ':' || changed, '-')) AS now FROM f),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, now) - 1 AS place,
         dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n FROM h),
built AS (
  SELECT tree, 0 AS level, place AS pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM built WHERE n > 1 GROUP BY tree, level, pos // 3),
subroots AS (SELECT tree, node, count(*) OVER () AS n FROM built WHERE n = 1),
top AS (
  SELECT -1 AS tree, 0 AS level, tree AS pos, node, n FROM subroots
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3)
  FROM top WHERE n > 1 GROUP BY tree, level, pos // 3),
runs AS (
  SELECT tree, level, pos // 3 AS run, list(node ORDER BY pos) AS c FROM (SELECT * FROM built UNION ALL SELECT * FROM top)
  WHERE n > 1 GROUP BY ALL),
inside AS (
  SELECT tree AS origin, place, tree, 0 AS level, place AS pos, now, '' AS proof FROM leaves
  UNION ALL
  SELECT origin, place, r.tree, i.level + 1, pos // 3, sha256(array_to_string(c[1:pos % 3] || [now] || c[pos % 3 + 2:], '')),
         proof || array_to_string(c[1:pos % 3] || c[pos % 3 + 2:], '')
  FROM inside i JOIN runs r ON r.tree = i.tree AND r.level = i.level AND r.run = i.pos // 3),
outside AS (
  SELECT origin, place, -1 AS tree, 0 AS level, origin AS pos, now, proof FROM inside QUALIFY row_number() OVER (PARTITION BY origin, place ORDER BY level DESC) = 1
  UNION ALL
  SELECT origin, place, r.tree, i.level + 1, pos // 3, sha256(array_to_string(c[1:pos % 3] || [now] || c[pos % 3 + 2:], '')),
         proof || array_to_string(c[1:pos % 3] || c[pos % 3 + 2:], '')
  FROM outside i JOIN runs r ON r.tree = i.tree AND r.level = i.level AND r.run = i.pos // 3),
ends AS (SELECT * FROM outside QUALIFY row_number() OVER (PARTITION BY origin, place ORDER BY level DESC) = 1)
SELECT doc_id, leaf, s.node AS subroot, root, sha256(proof) AS proof_sha256, e.now AS folded_root, e.now = root AS verified
FROM leaves l JOIN ends e ON e.origin = l.tree AND e.place = l.place JOIN subroots s ON s.tree = l.tree CROSS JOIN (SELECT node AS root FROM top WHERE n = 1)
"""

SQL["op11_fingerprint"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r FROM documents),
x AS (
  SELECT d.*, d.t[1:n - n // 2] || e.t[1:n // 2] AS edited
  FROM d JOIN (SELECT r AS r2, t FROM d) e ON e.r2 = CASE WHEN d.r = (SELECT max(r) FROM d) THEN 1 ELSE d.r + 1 END),
v AS (SELECT r, 0 AS e, t AS s FROM x UNION ALL SELECT r, 1, edited FROM x),
p AS (SELECT r, e, unnest(string_split(s, chr(10))) AS q FROM v),
u AS (SELECT r, e, true AS whole, q FROM p UNION ALL SELECT r, e, false, unnest(regexp_extract_all(q, '[^.!? ][^.!?]{0,59}')) FROM p),
w AS (SELECT r, e, whole, unnest(range(4)) AS k, unnest([('0x' || substr(sha256(q), 15 * i + 1, 15))::BIGINT for i in range(4)]) AS w FROM u),
h AS (
  SELECT r, e, k, sum(w & 1073741823) % 1073741824 AS lo, sum(w >> 30) % 1073741824 AS hi, count(*) AS n
  FROM w WHERE whole GROUP BY ALL),
b AS (
  SELECT r, e, k, i, sum((w >> i) & 1)::BIGINT AS ones, count(*) AS n
  FROM w, (SELECT unnest(range(60)) AS i) WHERE NOT whole GROUP BY ALL),
l AS (
  SELECT r, e, k, i, n, ones % 32768 AS lane, CASE WHEN c >= 16384 THEN c - 32768 ELSE c END AS c
  FROM (SELECT *, ((2 * ones - n) % 32768 + 32768) % 32768 AS c FROM b)),
m AS (SELECT r, e, k, i % 15 AS j, any_value(n) AS n, sum(lane << (15 * (i // 15)))::BIGINT AS x FROM l GROUP BY ALL),
head AS (
  SELECT r, e, format('{:015x}', any_value(n)) || string_agg(format('{:015x}', (lo + (hi * 1073741824))::BIGINT), '' ORDER BY k) AS s FROM h GROUP BY ALL),
tail AS (SELECT r, e, format('{:015x}', any_value(n)) || string_agg(format('{:015x}', x), '' ORDER BY k, j) AS s FROM m GROUP BY ALL),
f AS (SELECT h.r, h.e, h.s || coalesce(t.s, repeat('0', 15 * 61)) AS s FROM head h LEFT JOIN tail t ON t.r = h.r AND t.e = h.e),
norm AS (SELECT r, e, sum(c * c) AS cc FROM l GROUP BY ALL),
edge AS (
  SELECT a.r, a.s, b.s AS se, c.s AS sn, coalesce(na.cc, 0) AS aa, coalesce(nb.cc, 0) AS bb, coalesce(nc.cc, 0) AS nn, c.r AS nr
  FROM f a JOIN f b ON b.r = a.r AND b.e = 1 JOIN f c ON c.e = 0 AND c.r = CASE WHEN a.r = (SELECT max(r) FROM d) THEN 1 ELSE a.r + 1 END
  LEFT JOIN norm na ON na.r = a.r AND na.e = 0 LEFT JOIN norm nb ON nb.r = a.r AND nb.e = 1 LEFT JOIN norm nc ON nc.r = c.r AND nc.e = 0
  WHERE a.e = 0),
near AS (
  SELECT a.r, sum(a.c * b.c) AS ab FROM l a JOIN l b ON b.r = a.r AND b.e = 1 AND b.k = a.k AND b.i = a.i WHERE a.e = 0 GROUP BY ALL),
next AS (
  SELECT g.r, sum(a.c * b.c) AS an FROM edge g JOIN l a ON a.r = g.r AND a.e = 0 JOIN l b ON b.r = g.nr AND b.e = 0 AND b.k = a.k AND b.i = a.i GROUP BY ALL)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, g.s AS fingerprint, g.se AS edited_fingerprint,
       CASE WHEN g.s = g.se THEN 1.0 WHEN aa + bb > 0 THEN least(greatest((2 * coalesce(ab, 0))::DOUBLE / (aa + bb)::DOUBLE, 0), 1) ELSE 0 END::DOUBLE AS near_edited,
       CASE WHEN g.s = g.sn THEN 1.0 WHEN aa + nn > 0 THEN least(greatest((2 * coalesce(an, 0))::DOUBLE / (aa + nn)::DOUBLE, 0), 1) ELSE 0 END::DOUBLE AS near_next
FROM x JOIN edge g ON g.r = x.r LEFT JOIN near ON near.r = x.r LEFT JOIN next ON next.r = x.r
"""
