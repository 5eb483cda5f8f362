"""One query per operator over the benchmark tables, with its production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from kittally.llm import bpe, classlm, decontam, embeddings, language, lines, merkle, quality, simhash, spans, toxicity, warc, whitening
from kittally.llm.common import remainder, table
from kittally.session import cut


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents")).drop("shares")


def op9_classlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classlm.perplexity(table(spark, sf_dir, "documents"))


def op10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = spans.remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.duplicate_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")))
    sized = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    done = warc.resolve(cut(sized.drop("payload")), "payload_bytes", "digest")
    return done.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url", "intact")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(table(spark, sf_dir, "embeddings"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the rows claim one character more than they have; their proofs must fail."""
    more = F.when(F.col("doc_id").isNotNull() & (remainder("doc_id", 7) == 0), F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    done = merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), altered={"n_chars": more}), "claimed")
    return done.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {"op3_simhash": op3_simhash, "op6_bpe": op6_bpe, "op8_quality": op8_quality, "op7_language": op7_language, "op9_classlm": op9_classlm, "op10_spans": op10_spans, "op5_toxicity": op5_toxicity, "op2_decontamination": op2_decontamination, "op1_lines": op1_lines, "op4_embeddings": op4_embeddings, "op12_merkle": op12_merkle, "op11_warc": op11_warc, "op13_whitening": op13_whitening}
_WORDS = r"list_filter(string_split_regex(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_LINES = f"""
WITH texts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM texts),
marked AS (SELECT doc_id, i, list_sort(list_distinct({_WORDS.format("line")})) AS s FROM lines),
sets AS (SELECT s, len(s) AS n, min((doc_id, i)) AS first FROM marked WHERE len(s) > 0 GROUP BY s),
late AS (
  SELECT DISTINCT b.s FROM sets a JOIN sets b
  ON a.n * 5 >= b.n * 4 AND b.n * 5 >= a.n * 4 AND a.first < b.first
  WHERE len(list_intersect(a.s, b.s)) * 9 >= (a.n + b.n) * 4
),
gone AS (
  SELECT m.doc_id, count(*) AS n, string_agg(CAST(m.i AS varchar), ',' ORDER BY m.i) AS removed
  FROM marked m JOIN sets ON m.s = sets.s LEFT JOIN late ON m.s = late.s
  WHERE late.s IS NOT NULL OR (m.doc_id, m.i) <> sets.first
  GROUP BY m.doc_id
)
SELECT t.doc_id, CAST(coalesce(len(parts), 0) AS int) AS n_lines, CAST(coalesce(n, 0) AS int) AS n_removed, coalesce(removed, '') AS removed
FROM texts t LEFT JOIN gone ON gone.doc_id = t.doc_id
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS double[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS bigint) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN parts ON parts.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""

_SPANS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS bigint) AS n_words, CAST(len(ws) - coalesce(n, 0) AS bigint) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

_WARC = """
WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS bytes, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, bytes AS payload_bytes, digest AS payload_digest, url, true AS intact,
  CASE WHEN bytes >= 100 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN bytes >= 100 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

_MERKLE = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') AS size, coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 7 = 0 AS bad
  FROM documents
),
leaves AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS run, sha256(head || size || tail) AS leaf, CASE WHEN bad THEN sha256(head || more || tail) ELSE sha256(head || size || tail) END AS claimed
  FROM fields
),
placed AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY run) AS n FROM leaves),
low(run, lvl, pos, n, h) AS (
  SELECT run, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT run, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY run, lvl, pos // 2, n
),
subroots AS (SELECT run, lvl, h, row_number() OVER (ORDER BY run) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY lvl, pos // 2, n
),
sides AS (
  SELECT p.doc_id, p.leaf, l.lvl, (p.pos >> l.lvl) % 2 AS odd, s.h
  FROM placed p JOIN (SELECT DISTINCT run, lvl FROM low WHERE n > 1) l ON l.run = p.run
  LEFT JOIN low s ON s.run = p.run AND s.lvl = l.lvl AND s.pos = xor(p.pos >> l.lvl, 1)
  UNION ALL
  SELECT p.doc_id, p.leaf, r.lvl + l.lvl, (r.pos >> l.lvl) % 2, s.h
  FROM placed p JOIN subroots r ON r.run = p.run CROSS JOIN (SELECT DISTINCT lvl FROM high WHERE n > 1) l
  LEFT JOIN high s ON s.lvl = l.lvl AND s.pos = xor(r.pos >> l.lvl, 1)
),
paths AS (SELECT doc_id, leaf, list({'odd': odd, 'h': coalesce(h, '')} ORDER BY lvl) AS path, string_agg(h, '' ORDER BY lvl) AS proof FROM sides GROUP BY doc_id, leaf),
folded(doc_id, leaf, k, path, h) AS (
  SELECT p.doc_id, p.leaf, 1, path, claimed FROM placed p LEFT JOIN paths q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf
  UNION ALL
  SELECT doc_id, leaf, k + 1, path, sha256(CASE WHEN path[k].odd = 1 THEN path[k].h || h ELSE h || path[k].h END) FROM folded WHERE k <= len(path)
)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots r ON r.run = p.run CROSS JOIN (SELECT h FROM high WHERE n = 1) t
LEFT JOIN paths q ON q.doc_id IS NOT DISTINCT FROM p.doc_id AND q.leaf = p.leaf
JOIN folded f ON f.doc_id IS NOT DISTINCT FROM p.doc_id AND f.leaf = p.leaf AND f.k = coalesce(len(f.path), 0) + 1
"""

#: The other operators can't be put in SQL; tests hold them against plain loops, libraries or held-out labels.
ORACLES: dict[str, str] = {"op1_lines": _LINES, "op4_embeddings": _VECTORS, "op10_spans": _SPANS, "op12_merkle": _MERKLE, "op11_warc": _WARC}
