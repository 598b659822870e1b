"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliograph.llm.contamination import op1_decontaminate
from foliograph.llm.exact import op8_exact_dedup
from foliograph.llm.langid import op7_langid
from foliograph.llm.licenses import PHRASES, TEMPLATES, op10_licenses
from foliograph.llm.mixing import op4_mixing
from foliograph.llm.packing import op6_packing
from foliograph.llm.pii import op2_pii
from foliograph.llm.sharding import op5_sharding
from foliograph.llm.simhash import op3_simhash
from foliograph.llm.toxicity import op9_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_pii,
        op3_simhash,
        op4_mixing,
        op5_sharding,
        op6_packing,
        op7_langid,
        op8_exact_dedup,
        op9_toxicity,
        op10_licenses,
    )
}


def _license_sql() -> str:
    """The license scan in SQL: base phrases by position, templates by containment in a line or in a window of words.

    A window has as many words as the template's text. Lines and windows are
    made of those documents alone whose words together hold enough of a
    template, for no part of any other document can.
    """
    listed = lambda text: "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"
    distinct = lambda text: listed(" ".join(dict.fromkeys(text.split())))
    phrases = ", ".join(f"('{label}', {listed(p)})" for p, label in PHRASES)
    templates = ", ".join(f"('{label}', {distinct(t)}, {len(t.split())})" for label, t in TEMPLATES)
    split = "list_filter(regexp_split_to_array(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    held = "10 * len(list_intersect(t.words, {w})) >= 8 * len(t.words)"
    return f"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS body FROM documents),
        w AS (SELECT row, doc_id, body, {split.format(c="body")} AS words FROM d),
        p(label, phrase) AS (VALUES {phrases}),
        b AS (SELECT row, label, unnest(list_filter(range(len(words)), lambda i: words[i + 1:i + len(phrase)] = phrase)) AS place FROM w, p),
        bases AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY row),
        t(label, words, length) AS (VALUES {templates}),
        near AS (SELECT row, body, w.words AS own, t.* FROM w, t WHERE {held.format(w="w.words")}),
        l AS (SELECT row, label, words, unnest(string_split(body, chr(10))) AS line FROM near),
        parts AS (
            SELECT row, label, words, {split.format(c="line")} AS block FROM l
            UNION ALL
            SELECT row, label, words, unnest(list_transform(range(greatest(len(own) - length, 0) + 1), lambda i: own[i + 1:i + length])) AS block FROM near WHERE contains(body, chr(10))
        ),
        m AS (SELECT row, label, len(list_intersect(t.words, block)) / len(t.words) AS share FROM parts AS t WHERE {held.format(w="block")}),
        held AS (SELECT row, list_distinct(list(label)) AS labels, max(share) AS share FROM m GROUP BY row)
        SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bases.labels, ','), '') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(bases.labels, []), coalesce(held.labels, [])))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
        FROM w LEFT JOIN bases USING (row) LEFT JOIN held USING (row)
    """


ORACLE: dict[str, str] = {
    "op10_licenses": _license_sql(),
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.body) AS text_sha256
        FROM d JOIN g USING (body)
    """,
}
