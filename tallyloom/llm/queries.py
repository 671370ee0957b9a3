"""Registered queries of the subpackage, one per operator, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, hilbert_shards, jpeg, language_id, licenses, merkle, minhash_join, mixing, pii, secrets, token_counts, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.op1_url_filter(_table(spark, sf_dir, "pages"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.op2_ngram_join(_table(spark, sf_dir, "documents"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3_decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op4_licenses(_table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op5_secrets(_table(spark, sf_dir, "documents"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op6_language_id(_table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7_mixing(_table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.op8_jpeg(_table(spark, sf_dir, "documents"))


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.op9_hilbert_shards(_table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10_pii(_table(spark, sf_dir, "documents"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11_whitening(_table(spark, sf_dir, "embeddings"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op12_token_counts(_table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13_merkle_manifest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": _op1,
    "op2_ngram_join": _op2,
    "op3_decontaminate": _op3,
    "op4_licenses": _op4,
    "op5_secrets": _op5,
    "op6_language_id": _op6,
    "op7_mixing": _op7,
    "op8_jpeg": _op8,
    "op9_hilbert_shards": _op9,
    "op10_pii": _op10,
    "op11_whitening": _op11,
    "op12_token_counts": _op12,
    "op13_merkle_manifest": _op13,
}

_OP1_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule, CASE
    WHEN contains(host, 'casino') THEN '*casino*' WHEN contains(host, 'viagra') THEN '*viagra*' WHEN contains(host, 'payday') THEN '*payday*'
    WHEN contains(host, 'pills') THEN '*pills*' WHEN contains(host, 'spam') THEN '*spam*' WHEN contains(host, 'porn') THEN '*porn*'
  END AS method_rule FROM parts
)
SELECT page_id, host, path, rule, method_rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host = '' THEN 'block'
            WHEN method_rule IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, 10 AS m, array_to_string(list_slice(w, i, i + 9), ' ') AS g FROM b, unnest(range(1, len(w) - 8)) t(i) WHERE len(w) >= 10
  UNION
  SELECT item, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9
), lens AS (SELECT DISTINCT m FROM win
), dw AS (
  SELECT doc_id, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g FROM d, lens, unnest(range(1, len(w) - m + 2)) t(i) WHERE len(w) >= m
), occ AS (SELECT doc_id, i, dw.m, item FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + m)) t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_LEAF = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in merkle.FIELDS) + ")"
_CRC32 = """(list_reduce(list_prepend(4294967295::UBIGINT, [ord(x)::UBIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda c, b: xor(c >> 8, list_reduce(list_prepend(xor(c & 255, b), [0::UBIGINT FOR _ IN range(8)]), lambda v, _: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END))))"""
_OP13_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_LEAF} AS leaf,
         CASE WHEN n_chars IS NOT NULL AND xor({_CRC32}, 4294967295::UBIGINT) % 7 = 0 THEN {_LEAF.replace("n_chars", "(n_chars + 1)")} END AS changed FROM documents
), leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes AS (
  SELECT lang, 0 AS lev, pos AS i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, lev, i // 2
), subroots AS MATERIALIZED (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, lev AS height FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS lev, i, h, n FROM subroots
  UNION ALL
  SELECT lev + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value(n + 1) // 2 FROM tops WHERE n > 1 GROUP BY lev, i // 2
), tree AS MATERIALIZED (
  SELECT s.i AS grp, nodes.lev, nodes.i, nodes.h, nodes.n FROM nodes JOIN subroots s ON s.lang IS NOT DISTINCT FROM nodes.lang
  UNION ALL
  SELECT -1, lev, i, h, n FROM tops
), steps AS MATERIALIZED (  -- a row for each leaf and level on its way up
  SELECT l.pos, s.i AS grp, t.lev, (l.pos >> t.lev) & 1 AS odd, o.h AS other FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
    JOIN tree t ON t.grp = s.i AND t.i = l.pos >> t.lev AND t.n > 1 LEFT JOIN tree o ON o.grp = t.grp AND o.lev = t.lev AND o.i = xor(t.i, 1)
  UNION ALL
  SELECT l.pos, s.i, s.height + t.lev, (s.i >> t.lev) & 1, o.h FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
    JOIN tree t ON t.grp = -1 AND t.i = s.i >> t.lev AND t.n > 1 LEFT JOIN tree o ON o.grp = -1 AND o.lev = t.lev AND o.i = xor(t.i, 1)
), folded AS (
  SELECT s.i AS grp, l.pos, 0 AS lev, coalesce(l.changed, l.leaf) AS h FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  UNION ALL
  SELECT f.grp, f.pos, f.lev + 1, sha256(CASE WHEN odd = 1 THEN coalesce(other, '') || h ELSE h || coalesce(other, '') END) FROM folded f JOIN steps USING (grp, pos, lev)
), proofs AS (SELECT grp, pos, sha256(coalesce(string_agg(other, '' ORDER BY lev), '')) AS proof_sha256, count(*) AS height FROM steps GROUP BY 1, 2
), root AS (SELECT h FROM tops WHERE n = 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, root.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = root.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang CROSS JOIN root LEFT JOIN proofs p ON p.grp = s.i AND p.pos = l.pos
JOIN folded f ON f.grp = s.i AND f.pos = l.pos AND f.lev = coalesce(p.height, 0)
"""

ORACLE_SQL: dict[str, str] = {"op1_url_filter": _OP1_SQL, "op3_decontaminate": _OP3_SQL, "op13_merkle_manifest": _OP13_SQL}
