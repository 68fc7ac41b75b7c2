"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postern.llm import langid, leakage, packing, pii, setjoin, unify
from postern.session import table

CASE_ITEMS = ("domains", "urls", "addresses", "hopaddresses")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(pii.mail_texts(table(spark, d, "parts"), table(spark, d, "cases")))


def p1_masked(spark: SparkSession, d: str) -> DataFrame:
    """Bodies and subjects with placeholders."""
    return pii.masked(pii.mail_texts(table(spark, d, "parts"), table(spark, d, "cases")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.changed_values(table(spark, d, "cases"), table(spark, d, "confusables"))


def p2_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Every subject with its consistent form."""
    look, _ = unify.load_lookalikes(table(spark, d, "confusables"))
    return unify.consistent(table(spark, d, "cases").select("case_no", "subject"), "subject", look)


def p2_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Entries of confusables that disagree with another one or with the character's own form."""
    return unify.conflict_rows(table(spark, d, "confusables"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.similar_pairs(table(spark, d, "cases"), "case_no", setjoin.item_set(*CASE_ITEMS))
    return pairs.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per case: its class of equal sets and the number of similar classes."""
    out = setjoin.class_links(table(spark, d, "cases"), "case_no", setjoin.item_set(*CASE_ITEMS))
    return out.select(F.col("id").alias("case_no"), "cid", "copies", "links")


def p7_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row: posts in sequences, sequences over the capacity, pieces in no or two sequences, posts split needlessly."""
    s = packing.pack(table(spark, d, "documents"))
    over = s.groupBy("seq_id").agg(F.sum("length").alias("load")).agg(F.count(F.when(F.col("load") > 2048, 1)).alias("overfull"))
    post = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("k"), F.sum("length").alias("tokens"))
    n = lambda c: F.count(F.when(c, 1))
    return post.agg(F.count(F.lit(1)).alias("posts"), n(F.col("n") != F.col("k")).alias("doubled"), n((F.col("k") > 1) & (F.col("tokens") <= 2048 * (F.col("k") - 1))).alias("split")).crossJoin(over)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.mislabelled(table(spark, d, "documents"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every passage with its language and confidence."""
    documents = table(spark, d, "documents")
    return langid.segments(documents, langid.fit_documents(documents))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every post with each of its languages, the confidence and the language's share of its words."""
    documents = table(spark, d, "documents")
    return langid.post_languages(documents, langid.fit_documents(documents))


QUERIES = {f.__name__: f for f in (p1_found, p1_masked, p2_found, p2_subjects, p2_conflicts, p4_found, p4_classes, p7_sequences, p7_invariants, p8_found, p9_found, p9_segments, p9_languages)}

_SETS = """
    WITH raw AS (
        SELECT case_no, unnest(coalesce(domains, []) || coalesce(urls, []) || coalesce(addresses, []) || coalesce(hopaddresses, [])) AS v FROM cases),
    items AS (SELECT DISTINCT case_no, lower(trim(v)) AS item FROM raw WHERE trim(v) <> ''),
    sizes AS (SELECT case_no, count(*) AS n FROM items GROUP BY case_no),
    shared AS (
        SELECT a.case_no AS case_a, b.case_no AS case_b, count(*) AS c
        FROM items a JOIN items b ON a.item = b.item AND a.case_no < b.case_no GROUP BY 1, 2)"""

# Entities of the test texts, each decoded once; the ampersand last, so that nothing is decoded twice.
_ENTITIES = {"&gt;": ">", "&lt;": "<", "&quot;": '"', "&#39;": "\'\'", "&nbsp;": "\u00a0", "&auml;": "ä", "&ouml;": "ö", "&uuml;": "ü", "&eacute;": "é", "&amp;": "&"}
_PLAIN = "text"
for _k, _v in _ENTITIES.items():
    _PLAIN = f"replace({_PLAIN}, '{_k}', '{_v}')"
_WORDS = f"regexp_extract_all(lower(regexp_replace({_PLAIN}, '<[^<>]*>|[[]/?[A-Za-z]+(?:=[^][]*)?[]]', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_GRAMS = lambda key, source: f"(SELECT DISTINCT {key}, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {source})))"

def _class(test) -> str:
    """The characters that pass a test, as ranges of a character class: made by rule from the character database."""
    out, start, last = [], None, None
    for c in (c for c in range(0xA9, 0x1FC00) if test(chr(c))):
        if start is None or c != last + 1:
            if start is not None:
                out.append((start, last))
            start = c
        last = c
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in [*out, (start, last)])


def _unified_sql(values: str) -> str:
    """Problem 2 in SQL over (fieldname, rec_no, pos, value): every character's form by a join, whole texts composed by the engine, look-alikes by word."""
    picture = _class(lambda c: unify.EMOJI.fullmatch(c) is not None)
    forms = ", ".join(f"('{a}', '{b.replace(chr(39), chr(39) * 2)}')" for a, b in unify.tables().single.items())
    emoji = f"[{picture}](?:[\\x{{FE0F}}\\x{{20E3}}\\x{{1F1E6}}-\\x{{1F1FF}}\\x{{1F3FB}}-\\x{{1F3FF}}\\x{{E0020}}-\\x{{E007F}}\\pM]|\\x{{200D}}[{picture}]?)*"
    mapped = lambda source, key, text: f"(SELECT {key}, nfc_normalize(string_agg(coalesce(f, ch), '' ORDER BY i)) AS m, string_agg(CASE WHEN f = '' THEN '' ELSE ch END, '' ORDER BY i) AS kept FROM (SELECT {key}, unnest(regexp_extract_all({text}, '(?s).')) AS ch, unnest(range(length({text}))) AS i FROM {source}) LEFT JOIN form USING (ch) GROUP BY {key})"
    ends = "'^[\\s\\pZ\\x{85}]+|[\\s\\pZ\\x{85}]+$', '', 'g'"
    return f"""WITH form(ch, f) AS (VALUES {forms}), vals AS ({values}), odd AS (SELECT *, row_number() OVER () AS id FROM vals WHERE regexp_matches(value, '[^\\x00-\\x7F]')),
    named AS (SELECT row_no, c1, CASE WHEN regexp_matches(trim(m, ' '), '^[Uu]\\+[0-9A-Fa-f]{{4,6}}$') THEN chr(CAST('0x' || trim(m, ' ')[3:] AS INTEGER)) WHEN length(trim(kept, ' ')) = 1 THEN trim(kept, ' ') END AS source FROM {mapped('(SELECT row_no, c1, c0 FROM confusables WHERE c0 <> {0})'.format("''"), 'row_no, c1', 'c0')}),
    look AS (SELECT source AS ch, arg_min(c1, row_no) AS target FROM named WHERE c1 <> '' AND ord(source) > 127 GROUP BY 1),
    seg AS (SELECT id, fieldname, unnest(s) AS s, unnest(range(len(s))) AS k FROM (SELECT id, fieldname, regexp_extract_all(value, '{emoji}|[^{picture}]+') AS s FROM odd)),
    plain AS (SELECT id, k, fieldname, CASE WHEN regexp_matches(s, '^[{picture}]') THEN s ELSE m END AS m, regexp_matches(s, '^[{picture}]') AS whole FROM seg LEFT JOIN {mapped('seg', 'id, k', 's')} USING (id, k)),
    word AS (SELECT id, k, unnest(w) AS w, unnest(range(len(w))) AS j, whole FROM (SELECT id, k, whole, CASE WHEN whole THEN [m] WHEN fieldname = 'domains' THEN regexp_extract_all(m, '[\\pL\\pN\\pM_-]+|[^\\pL\\pN\\pM_-]+') ELSE regexp_extract_all(m, '[\\pL\\pN\\pM]+|[^\\pL\\pN\\pM]+') END AS w FROM plain)),
    chars AS (SELECT id, k, j, whole, unnest(regexp_extract_all(w, '(?s).')) AS ch, unnest(range(length(w))) AS i FROM word),
    judged AS (SELECT id, k, j, i, ch, target, NOT whole AND bool_or(target IS NOT NULL) OVER p AND bool_or(target IS NULL AND regexp_matches(ch, '\\p{{Latin}}')) OVER p AS turn FROM chars LEFT JOIN look USING (ch) WINDOW p AS (PARTITION BY id, k, j)),
    done AS (SELECT id, nfc_normalize(string_agg(CASE WHEN turn AND target IS NOT NULL THEN CASE WHEN ch <> lower(ch) THEN upper(target) ELSE target END ELSE ch END, '' ORDER BY k, j, i)) AS unified FROM judged GROUP BY id)
    SELECT fieldname, rec_no, pos, unified, regexp_replace(lower(unified), {ends}) AS clean, regexp_replace(lower(value), {ends}) AS before FROM odd JOIN done USING (id)"""


SQL: dict[str, str] = {
    "p2_found": f"""SELECT fieldname, rec_no, pos, clean FROM ({_unified_sql("SELECT 'subject' AS fieldname, case_no AS rec_no, -1 AS pos, subject AS value FROM cases UNION ALL SELECT 'domains', case_no, CAST(i AS INTEGER), v FROM (SELECT case_no, unnest(domains) AS v, unnest(range(len(domains))) AS i FROM cases) UNION ALL SELECT 'c0', row_no, -1, c0 FROM confusables WHERE length(c0) > 1")}) WHERE clean <> before""",
    "p2_subjects": f"""SELECT case_no, subject, CASE WHEN regexp_matches(subject, '[^\\x00-\\x7F]') THEN u ELSE subject END AS unified FROM cases LEFT JOIN (SELECT rec_no AS case_no, unified AS u FROM ({_unified_sql("SELECT 'subject' AS fieldname, case_no AS rec_no, -1 AS pos, subject AS value FROM cases")})) USING (case_no)""",
    "p8_found": f"SELECT DISTINCT doc_id, item_id FROM {_GRAMS('doc_id', 'documents')} JOIN {_GRAMS('item_id', 'eval_items')} USING (g)",
    "p4_classes": _SETS.split("shared AS")[0] + """
    sets AS (SELECT case_no, md5('{"items":[' || string_agg(CAST(to_json(item) AS VARCHAR), ',' ORDER BY item) || ']}') AS cid FROM items GROUP BY case_no),
    class AS (SELECT cid, min(case_no) AS case_no, count(*) AS copies FROM sets GROUP BY cid), member AS (SELECT cid, item FROM class JOIN items USING (case_no)),
    n AS (SELECT cid, count(*) AS n FROM member GROUP BY cid), both_ AS (SELECT a.cid AS x, b.cid AS y, count(*) AS c FROM member a JOIN member b ON a.item = b.item AND a.cid <> b.cid GROUP BY 1, 2),
    link AS (SELECT x AS cid, count(*) AS links FROM both_ JOIN n p ON p.cid = x JOIN n q ON q.cid = y WHERE c / (p.n + q.n - c) >= 0.6 - 1e-9 GROUP BY 1)
    SELECT case_no, cid, copies, coalesce(links, 0) AS links FROM sets JOIN (SELECT cid, copies FROM class) USING (cid) LEFT JOIN link USING (cid)""",
    "p7_invariants": "SELECT count(DISTINCT doc_id) AS posts, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS split, CAST(0 AS BIGINT) AS overfull FROM documents WHERE text <> ''",
    "p4_found": _SETS
    + """
    SELECT case_a, case_b FROM shared JOIN sizes x ON x.case_no = case_a JOIN sizes y ON y.case_no = case_b
    WHERE c / (x.n + y.n - c) >= 0.6 - 1e-9""",
}
