"""The corpus operators' queries: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chainframe.llm import conversations, decontaminate, html_extract, licenses, media, near_dup, packing, phrases, quality, secret_scan, substring_dedup, token_count, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_spans(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversation_repair(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_near_duplicates": op3_near_duplicates,
    "op8_licenses": op8_licenses,
    "op5_main_text": op5_main_text,
    "op2_media": op2_media,
    "op4_packing": op4_packing,
    "op1_token_counts": op1_token_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_toxicity": op7_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_collocations": op11_collocations,
    "op12_secrets": op12_secrets,
    "op13_conversations": op13_conversations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _runs(n: str) -> str:
    """All runs of n words of lists w, joined by blanks (which no word has), with the places k where they begin."""
    return f"unnest(range(1, greatest(len(w) - {n} + 2, 1))) AS k, unnest(list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda k: array_to_string(w[k:k + {n} - 1], ' '))) AS s"


#: CRC-32 of a short ASCII text, bit by bit.
_CRC = lambda x: f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda z: ascii(z)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1)))), 4294967295)"
_TRIM = "rtrim(text, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13)))"
#: One edit of a row, or one insertion, a step: grammar states 0 nothing, 1 after system, 2 after user, 3 after assistant; v counts insertions in a row.
_REPAIR = f"""WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, dense_rank() OVER (ORDER BY conv_id) AS c, {_CRC("concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' '))")} % 20 AS hit FROM conversations),
dm AS (SELECT c, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE hit WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS o FROM h),
r0 AS (SELECT c, turn, role, text, left(role, 1) AS i, right({_TRIM}, 1) AS e, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, o) AS k FROM dm),
r AS (SELECT *, CASE WHEN e = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY k) > 1 THEN 'd' WHEN e NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f, lag(i) OVER (PARTITION BY c ORDER BY k) AS w FROM r0),
q AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'b') AS blank, count_if(f = 'd') AS duplicate, count_if(f = 't') AS truncated, count_if(w IS NOT NULL AND concat(w, i) NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n FROM r GROUP BY c),
keep(i, g, t) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)), nx(g, t) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
s AS (SELECT DISTINCT c, 0::BIGINT AS k, 0 AS v, 0 AS g, 0::BIGINT AS cost, '' AS audit FROM h UNION ALL
SELECT c, k, v, g, b.cost, b.audit FROM (SELECT c, k, v, g, min({{'cost': cost, 'audit': audit}}) AS b FROM (
SELECT s.c, s.k, s.v + 1 AS v, nx.t AS g, cost + 2 AS cost, audit || 'I' AS audit FROM s JOIN nx ON nx.g = s.g WHERE s.v < 2
UNION ALL SELECT s.c, r.k, 0, s.g, cost + 3, audit || 'D' FROM s JOIN r ON r.c = s.c AND r.k = s.k + 1
UNION ALL SELECT s.c, r.k, 0, nx.t, cost + 2 + (f = 't')::INT, audit || 'R' FROM s JOIN r ON r.c = s.c AND r.k = s.k + 1 AND f NOT IN ('b', 'd') JOIN nx ON nx.g = s.g
UNION ALL SELECT s.c, r.k, 0, keep.t, cost + (f = 't')::INT, audit || 'K' FROM s JOIN r ON r.c = s.c AND r.k = s.k + 1 AND f NOT IN ('b', 'd') JOIN keep ON keep.g = s.g AND keep.i = r.i) GROUP BY c, k, v, g)),
z AS (SELECT s.c, min({{'cost': cost, 'audit': audit}}) AS b FROM s LEFT JOIN q USING (c) WHERE k = coalesce(n, 0) AND g IN (0, 3) GROUP BY s.c),
l AS (SELECT c, unnest(range(1, len(b.audit) + 1)) AS p, unnest(string_split(b.audit, '')) AS x FROM z WHERE b.audit <> ''),
m AS (SELECT *, count_if(x <> 'I') OVER o AS k, count_if(x <> 'D') OVER o AS e FROM l WINDOW o AS (PARTITION BY c ORDER BY p)),
y AS (SELECT m.c, p, x, m.e, role, text, max(CASE WHEN x = 'K' AND m.e = 1 AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.c) AS y FROM m LEFT JOIN r ON r.c = m.c AND r.k = m.k WHERE x <> 'D'),
g AS (SELECT c, string_agg(concat(CASE WHEN x = 'K' THEN role WHEN (e - y) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', CASE WHEN x = 'I' THEN '' ELSE text END), chr(10) ORDER BY p) AS t FROM y GROUP BY c)
SELECT h.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(coalesce(t, '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id, c FROM h) h JOIN z USING (c) LEFT JOIN q USING (c) LEFT JOIN g USING (c)"""

#: What SQL can express. Tokenizers, pictures, trained models and packing can't; tests compare these with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_near_duplicates": f"WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents), sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, {_runs('5')} FROM d) UNION SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL), ln AS (SELECT x, y FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)), ed AS (SELECT x, y FROM ln UNION SELECT y, x FROM ln), rc AS (SELECT x, y FROM ed UNION SELECT rc.x, ed.y FROM rc JOIN ed ON rc.y = ed.x), cm AS (SELECT x AS doc_id, min(y) AS low FROM rc GROUP BY x) SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, coalesce(low, d.doc_id) >= d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN cm USING (doc_id)",
    "op6_substring_dedup": f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents), wn AS (SELECT r, {_runs('35')} FROM d), rp AS (SELECT s FROM wn GROUP BY s HAVING count(*) > 1), gone AS (SELECT DISTINCT r, k + o AS p FROM wn SEMI JOIN rp USING (s) CROSS JOIN range(0, 35) t(o)), ws AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d), kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM ws ANTI JOIN gone USING (r, p) GROUP BY r) SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)",
    "op9_decontamination": f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents), b0 AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark), b1 AS (SELECT item_id, w, least(10, len(w)) AS n FROM b0 WHERE len(w) > 0), bw AS (SELECT DISTINCT item_id, n, s FROM (SELECT item_id, n, {_runs('n')} FROM b1)), ns AS (SELECT DISTINCT n FROM bw), dw AS (SELECT r, n, {_runs('n')} FROM d CROSS JOIN ns), hits AS (SELECT r, n, k, item_id FROM dw JOIN bw USING (n, s)), pl AS (SELECT r, count(DISTINCT k + o) AS c FROM (SELECT DISTINCT r, n, k FROM hits) JOIN range(0, 10) t(o) ON o < n GROUP BY r), it AS (SELECT r, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r) SELECT doc_id, len(w) AS n_words, coalesce(pl.c, 0) AS n_hit, coalesce(it.c, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(pl.c, 0) > 0 AS contaminated FROM d LEFT JOIN pl USING (r) LEFT JOIN it USING (r)",
    "op11_collocations": f"WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents), w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p), g AS (SELECT lang, n, s, count(*) AS f FROM (SELECT lang, n, {_runs('n')} FROM w CROSS JOIN (VALUES (1), (2), (3)) t(n)) GROUP BY ALL), c AS (SELECT lang, n, s, f AS a, string_split(s, ' ') AS x FROM g WHERE n > 1 AND f >= 10), ct AS (SELECT c.lang, c.s, c.n, a, k, array_to_string(x[:k], ' ') AS p, array_to_string(x[k + 1:], ' ') AS q FROM c JOIN (VALUES (1), (2)) t(k) ON k < c.n), sc AS (SELECT ct.lang, ct.s, a, k, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score FROM ct JOIN g l ON l.lang = ct.lang AND l.s = p JOIN g r ON r.lang = ct.lang AND r.s = q), bs AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1), inn AS (SELECT lang, array_to_string(x[k:k + 1], ' ') AS s, max(a) AS m FROM c JOIN (VALUES (1), (2)) t(k) ON n = 3 GROUP BY ALL), kept AS (SELECT bs.* FROM bs LEFT JOIN inn USING (lang, s) WHERE m IS NULL OR 100 * m < 50 * a), tot AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE n = 1 GROUP BY lang) SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, tot.n, score::BIGINT AS score FROM kept JOIN tot USING (lang) QUALIFY rank <= 2000",
    "op13_conversations": _REPAIR,
}
