"""The operators' queries: each applies one to its whole table with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_tree, decontaminate, disclosure, html_wrapper, packing, simhash, sparse_suffix, toxicity, url_filter, winnow

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.blocked(pages, url_filter.build(url_filter.spam_entries(pages)))


def op2_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.forest(_table(spark, sf_dir, "conversations"))


def op3_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(_table(spark, sf_dir, "documents"))


def op4_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract(_table(spark, sf_dir, "pages"))


def op5_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return disclosure.sanitise(docs, disclosure.fit(docs))


def op6_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse_suffix.by_document(sparse_suffix.repeated_passages(_table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxic_documents(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    all_ = (op1_url_filter, op2_chat_tree, op3_winnow, op4_html_wrapper, op5_disclosure, op6_sparse_suffix, op7_simhash, op8_toxicity, op9_decontaminate, op10_packing)
    return {f.__name__: f for f in all_}


#: The other operators can't be said in SQL (hashes, a tokenizer, inference or a search); their tests hold them against brute force.
OP1_SQL = r"""
WITH h AS (
  SELECT page_id, url, html,
    regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '^www\.', '') AS host,
    regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/:?#]*(?::[^/@?#]*@[^/:?#]*)?([^#]*)', 1), '^:(80|443)($|[/?])', '\2') AS r0
  FROM pages WHERE url IS NOT NULL
), c AS (
  SELECT page_id, url, html, host, host || regexp_replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(r0, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&&+', '&', 'g'), '\?&', '?', 'g'), '[?&]+$', ''),
    '/+$', '') AS canon
  FROM h WHERE host <> ''
), e AS (
  SELECT canon AS entry FROM c WHERE contains(html, '%%%')
  UNION
  SELECT host FROM c GROUP BY host HAVING avg(CASE WHEN contains(html, '%%%') THEN 1 ELSE 0 END) >= 0.2
), l AS (
  SELECT page_id, url, [canon] || list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) AS cand
  FROM c
), u AS (
  SELECT page_id, url, unnest(cand) AS entry, generate_subscripts(cand, 1) AS rank FROM l
)
SELECT page_id, url, arg_min(u.entry, rank) AS entry FROM u JOIN e ON u.entry = e.entry GROUP BY page_id, url
"""


_IN_WORD = r"0-9A-Za-z\x{C0}-\x{1FFF}\x{2080}-\x{2FFF}\x{3040}-\x{10FFFF}"


def _listed(words: str) -> str:
    return ", ".join(f"'{w}'" for w in words.split())


OP9_SQL = rf"""
WITH t AS (
  SELECT 'd' AS src, doc_id AS id, regexp_extract_all(text, '[^{_IN_WORD}]*[{_IN_WORD}]+') AS l FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(text, '[^{_IN_WORD}]*[{_IN_WORD}]+') FROM benchmark WHERE text IS NOT NULL
), w AS (
  SELECT src, id, i, piece, regexp_extract(piece, '^[^{_IN_WORD}]*') AS gap, regexp_extract(piece, '[{_IN_WORD}]+$') AS word
  FROM (SELECT src, id, unnest(l) AS piece, unnest(range(1, len(l) + 1)) AS i FROM t)
), k AS (
  SELECT *, CASE
    WHEN regexp_full_match(word, '[0-9]+') OR lower(word) IN ({_listed(decontaminate.NUMBERS)}) THEN 'NUM'
    WHEN lower(word) IN ({_listed(decontaminate.UNITS)}) THEN 'UNIT'
    WHEN i > 1 AND NOT regexp_matches(gap, '[.!?:\n]') AND regexp_matches(word, '^[A-Z\x{{C0}}-\x{{DE}}](?:[a-z]|[^\x00-\x{{DE}}])') THEN 'NAME' END AS kind
  FROM w
), g AS (
  SELECT *, sum(fresh) OVER (PARTITION BY src, id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, CASE WHEN kind IN ('NUM', 'NAME') AND kind = lag(kind) OVER (PARTITION BY src, id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM k)
), tok AS (
  SELECT src, id, (g - 1)::BIGINT AS pos, CASE WHEN any_value(kind) IS NULL THEN lower(any_value(word)) ELSE any_value(kind) END AS token,
    CASE WHEN any_value(kind) IS NOT NULL THEN lower(string_agg(CASE WHEN fresh = 1 THEN word ELSE piece END, '' ORDER BY i)) END AS slot
  FROM g GROUP BY src, id, g
), l8 AS (
  SELECT src, id, pos, count(*) OVER (PARTITION BY src, id) AS n, list(token) OVER v AS tokens, list(slot) OVER v AS slots, list(coalesce(slot, token)) OVER v AS vals
  FROM tok WINDOW v AS (PARTITION BY src, id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)
), bo AS (
  SELECT *, least(n, 8) AS w, n >= 4 AND len(list_filter(slots[1:least(n, 8)], lambda x: x IS NULL)) >= 0.5 * least(n, 8) AS loose FROM l8 WHERE src = 'b' AND len(tokens) >= least(n, 8)
), bw AS (
  SELECT id AS item, pos AS item_pos, n, w, loose, array_to_string(CASE WHEN loose THEN tokens[1:w] ELSE vals[1:w] END, chr(1)) AS key,
    CASE WHEN loose THEN list_filter(slots[1:w], lambda x: x IS NOT NULL) ELSE [] END AS item_slots
  FROM bo
), do_ AS (
  SELECT *, w >= 4 AND len(list_filter(slots[1:w], lambda x: x IS NULL)) >= 0.5 * w AS loose
  FROM l8, (SELECT DISTINCT w FROM bw) WHERE src = 'd' AND len(tokens) >= w AND (w > 1 OR n = 1)
), dw AS (
  SELECT id, pos, w, loose, array_to_string(CASE WHEN loose THEN tokens[1:w] ELSE vals[1:w] END, chr(1)) AS key,
    CASE WHEN loose THEN list_filter(slots[1:w], lambda x: x IS NOT NULL) ELSE [] END AS slots
  FROM do_
), m AS (
  SELECT id, item, n, pos - item_pos AS shift, item_pos, w, item_slots, slots FROM dw JOIN bw USING (w, loose, key)
), z AS (
  SELECT id, item, shift, count(DISTINCT (a, b)) = count(DISTINCT a) AND count(DISTINCT (a, b)) = count(DISTINCT b) AS sound, coalesce(bool_or(a <> b), false) AS differs
  FROM (SELECT id, item, shift, unnest(item_slots) AS a, unnest(slots) AS b FROM m) GROUP BY ALL
), p AS (
  SELECT id, item, n, coalesce(sound, true) AND coalesce(differs, false) AS changed,
    CASE WHEN coalesce(sound, true) OR len(item_slots) = 0 THEN range(item_pos, item_pos + w) ELSE [] END AS places
  FROM m LEFT JOIN z USING (id, item, shift)
)
SELECT id AS doc_id, item AS item_id, len(list_distinct(flatten(list(places)))) AS covered, max(n) AS item_tokens, bool_or(changed) AS changed
FROM p GROUP BY id, item
HAVING len(list_distinct(flatten(list(places)))) >= least(13, ceil(max(n) / 2)) AND len(list_distinct(flatten(list(places)))) > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op9_decontaminate": OP9_SQL}
