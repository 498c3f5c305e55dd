"""The corpus operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chorus.llm import (exact, langid, licences, lines, merkle, mixing, neighbours, packing,
                        passages, simhash, tokens, warc, whitening)
from chorus.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


#: Target shares of the mixture. Its budget is the expected good tokens over 0.8, not the corpus.
MIXTURE = {"good": 0.8, "poor": 0.15, "toxic": 0.05}


@_query
def op1_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(load(spark, folder, "documents"), load(spark, folder, "labels"), MIXTURE)


@_query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.dedup_passages(load(spark, folder, "documents"), with_text=False)


SQL["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps
  FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (s) WHERE m < doc_id)
  GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""


@_query
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, folder, "documents"))


@_query
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(load(spark, folder, "documents"))


SQL["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
k AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


@_query
def op5_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(load(spark, folder, "embeddings"))


@_query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_counts(load(spark, folder, "documents"),
                               _tokenizer_file("word_bpe_49k.json"))


@_query
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents").select("doc_id", "text")
    kept = lines.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: Real word lists instead of hashes, and no pruning by halves.
SQL["op7_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
places AS (
  SELECT doc_id, pos, line, {'d': doc_id, 'p': pos} AS rk,
         list_filter(string_split_regex(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS ws
  FROM lines),
firsts AS (SELECT ws, min(rk) AS rk FROM places WHERE len(ws) > 0 GROUP BY ws),
long AS (SELECT ws, rk FROM firsts WHERE len(ws) >= 5),
variants AS (
  SELECT rk, i, list_concat(ws[1:i - 1], ws[i + 1:]) AS v
  FROM (SELECT ws, rk, unnest(range(1, len(ws) + 1)) AS i FROM long)),
near AS (
  SELECT a.rk FROM variants a JOIN (SELECT v, i, min(rk) AS e FROM variants GROUP BY v, i) b
    ON a.v = b.v AND a.i = b.i WHERE b.e < a.rk
  UNION SELECT a.rk FROM variants a JOIN long b ON a.v = b.ws WHERE b.rk < a.rk
  UNION SELECT b.rk FROM variants a JOIN long b ON a.v = b.ws WHERE a.rk < b.rk),
stay AS (
  SELECT p.doc_id, p.pos, p.line FROM places p LEFT JOIN firsts f ON p.rk = f.rk
  WHERE len(p.ws) = 0 OR (f.rk IS NOT NULL AND p.rk NOT IN (SELECT rk FROM near))),
texts AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS t
          FROM stay GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
       CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END
         - coalesce(n, 0) AS n_dropped,
       sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN texts USING (doc_id)
"""


@_query
def op8_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_scan(load(spark, folder, "documents"))


@_query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    return langid.languages(docs, langid.fit(docs))


@_query
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(load(spark, folder, "documents"), _tokenizer_file("byte_bpe_50k.json"))


@_query
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents; every fifth is tampered with by lower-casing its text."""
    docs = load(spark, folder, "documents")
    return merkle.manifest(docs, merkle.one_in(5), {"text": merkle.lower_ascii("text")}).drop("copies")


def _encoded(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_LEAF = " || ".join(_encoded(c) for c in merkle.FIELDS)
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TAMPERED = " || ".join(_encoded(_LOWERED if c == "text" else c) for c in merkle.FIELDS)

#: CRC-32 bit by bit; levels by recursion, first in each source, then over the sources.
SQL["op11_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_LEAF}) AS leaf, sha256({_TAMPERED}) AS lowered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda s, b: list_reduce(list_prepend(xor(s, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
               lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)),
           4294967295::BIGINT) AS crc
  FROM documents),
up AS (
  SELECT source, 0 AS lvl, pos, n, leaf AS h FROM d
  UNION ALL
  SELECT source, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM up WHERE n > 1 GROUP BY source, lvl, pos // 16, n),
sub AS (
  SELECT source, h, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS pos,
         count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, h FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM top WHERE n > 1 GROUP BY lvl, pos // 16, n),
beside AS (
  SELECT a.source, a.lvl, a.pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl
                     AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY ALL),
topside AS (
  SELECT a.lvl, a.pos,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16
  WHERE a.n > 1 GROUP BY ALL),
fold AS (
  SELECT doc_id, source, 0 AS lvl, pos, n,
         CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END AS h, '' AS proof FROM d
  UNION ALL
  SELECT doc_id, f.source, f.lvl + 1, f.pos // 16, (n + 15) // 16, sha256(l || h || r),
         proof || l || r
  FROM fold f JOIN beside b ON f.source IS NOT DISTINCT FROM b.source AND f.lvl = b.lvl
                           AND f.pos = b.pos WHERE n > 1),
topfold AS (
  SELECT doc_id, 0 AS lvl, s.pos, s.n, f.h, proof
  FROM fold f JOIN sub s ON f.source IS NOT DISTINCT FROM s.source WHERE f.n = 1
  UNION ALL
  SELECT doc_id, f.lvl + 1, f.pos // 16, (n + 15) // 16, sha256(l || h || r), proof || l || r
  FROM topfold f JOIN topside b ON f.lvl = b.lvl AND f.pos = b.pos WHERE n > 1)
SELECT d.doc_id, leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256,
       topfold.h AS folded_root, topfold.h = top.h AS verified
FROM d JOIN sub ON d.source IS NOT DISTINCT FROM sub.source JOIN top ON top.n = 1
JOIN topfold ON topfold.doc_id = d.doc_id AND topfold.n = 1
"""


@_query
def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(load(spark, folder, "pages"))


SQL["op12_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT *, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS last FROM p),
r AS (SELECT *, n >= 1000 AND page_id <> last AS again FROM q)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to
FROM r
"""


@_query
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(load(spark, folder, "embeddings"))
