"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.bpe import op9_bpe
from sparkloom.llm.chat import op8_chat
from sparkloom.llm.decontaminate import op10_decontaminate
from sparkloom.llm.lines import op2_line_dedup
from sparkloom.llm.merkle import op4_merkle
from sparkloom.llm.pii import op6_pii
from sparkloom.llm.quality import op5_quality
from sparkloom.llm.simhash import op1_simhash
from sparkloom.llm.token_counts import op7_token_counts
from sparkloom.llm.warc import op3_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_line_dedup, op3_warc, op4_merkle, op5_quality, op6_pii, op7_token_counts, op8_chat, op9_bpe, op10_decontaminate)}


#: By definition: every window of ten words of every item, at every place of every document. The other operators have
#: no SQL (hashes that DuckDB lacks, components, models, tokenizers); tests compare them with brute force.
OP10 = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
item AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS said
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM item WHERE len(w) > 0)),
place AS (
  SELECT rid, n, p, list_slice(w, p, p + n - 1) AS said
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT rid, p, place.n AS n, item_id FROM place JOIN win ON place.said = win.said AND place.n = win.n),
hits AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM found)) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS said FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS i FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (rid) LEFT JOIN ids USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_decontaminate": OP10}
