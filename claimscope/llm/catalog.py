"""The registered queries of this subpackage, over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimscope.llm import (chat_format, decontaminate, fill_middle, language, licences, near_dedup, paragraph_dedup, periodic_runs, pieces, pii,
                            quality_rules, substring_dedup, wrappers)
from claimscope.llm.common import table

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda s: array_to_string(list_slice(w, s, s + 9), ' '))) AS g
        FROM iw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS s,
               unnest(list_transform(range(1, len(w) - n + 2), lambda s: array_to_string(list_slice(w, s, s + n - 1), ' '))) AS g FROM dw, sizes WHERE len(w) >= n),
m AS (SELECT DISTINCT p.doc_id, p.s, p.n, win.item_id FROM pos p JOIN win ON win.n = p.n AND win.g = p.g),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def op1_suffix_array_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op2_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tag")


def op4_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark, sf_dir):
    return paragraph_dedup.repeated_paragraphs(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents"))


def op7_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op8_quality_rules(spark, sf_dir):
    return quality_rules.measure(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(*chat_format.prefix_tree(rows.unionByName(chat_format.special_conversation(rows))))


def op10_minhash_near_dedup(spark, sf_dir):
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.report(periodic_runs.collapse_runs(table(spark, sf_dir, "documents"), plant=True))


def op12_fill_middle(spark, sf_dir):
    out = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


def op13_html_extraction(spark, sf_dir):
    return wrappers.main_text(table(spark, sf_dir, "pages"))


FILL_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2,
             ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid,
             array_to_string(list_slice(w, b + 1, n), '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""

CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '<(\|im_start\|>|\|im_end\|>|/?s>|/?SYS>|<SYS>>|</SYS>>)', '<\\-\1', 'g') AS t1 FROM c),
f AS (SELECT *, regexp_replace(t1, '\[(/?INST\])', '[\\-\1', 'g') AS t2 FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(t2) + length(role) + 24) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

QUERIES = {f.__name__: f for f in (
    op1_suffix_array_dedup, op2_pii, op3_decontamination, op4_license_scan, op5_substring_dedup, op6_sentencepiece,
    op7_language_id, op8_quality_rules, op9_chat_formatting, op10_minhash_near_dedup,
    op11_periodic_runs, op12_fill_middle, op13_html_extraction)}
ORACLES = {"op3_decontamination": DECONTAMINATION_SQL, "op9_chat_formatting": CHAT_SQL, "op12_fill_middle": FILL_MIDDLE_SQL}
