"""Text measures over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditmill.functions import text as T
from auditmill.plans.registry import query, table

_W = r"len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{Nd}]+'))"
_N = lambda p: f"len(regexp_extract_all(coalesce(text, ''), '{p}'))"
_SCRIPT = rf"""(SELECT doc_id, lang, text, {_N(r'\p{Han}')} + {_N(r'\p{Hiragana}')} + {_N(r'\p{Katakana}')} AS c, {_N(r'\p{Hangul}')} AS h,
  {_N(r'\p{Thai}')} + {_N(r'\p{Lao}')} + {_N(r'\p{Khmer}')} + {_N(r'\p{Myanmar}')} AS s, {_N(r'\p{L}')} AS l FROM documents)"""


def docs(spark, d):
    return table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))


@query(rf"SELECT doc_id, {_W} AS words FROM documents")
def doc_word_count(spark, d):
    return docs(spark, d).select("doc_id", T.count_words(F.col("text")).alias("words"))


@query(rf"SELECT doc_id, {_N(r'[\p{L}\p{Nd}]')} AS chars FROM documents")
def doc_char_count(spark, d):
    return docs(spark, d).select("doc_id", T.count_chars(F.col("text")).alias("chars"))


@query(f"""SELECT doc_id, CASE WHEN s > l - c - h - s AND s > c AND s > h THEN 'no-space' WHEN h > l - c - h - s AND h > c THEN 'hangul' WHEN c > l - c - h - s THEN 'cjk' ELSE 'latin' END AS script FROM {_SCRIPT}""")
def doc_script(spark, d):
    return docs(spark, d).select("doc_id", T.classify(F.col("text")).alias("script"))


@query(f"SELECT l - c - h - s > 0 AS latin, c > 0 AS cjk, h > 0 AS hangul, s > 0 AS nospace, count(*) AS docs, CAST(sum(l) AS BIGINT) AS letters FROM {_SCRIPT} GROUP BY ALL")
def doc_script_letters(spark, d):
    latin, cjk, hangul, nospace = T.script_counts(F.col("text"))
    rows = docs(spark, d).select((latin > 0).alias("latin"), (cjk > 0).alias("cjk"), (hangul > 0).alias("hangul"), (nospace > 0).alias("nospace"), (latin + cjk + hangul + nospace).alias("n"))
    return rows.groupBy("latin", "cjk", "hangul", "nospace").agg(F.count("*").alias("docs"), F.sum("n").cast("long").alias("letters"))


@query("""SELECT lang, CASE lang WHEN 'ja' THEN 'cjk' WHEN 'zh' THEN 'cjk' WHEN 'ko' THEN 'hangul' WHEN 'th' THEN 'no-space' ELSE 'none' END AS hint, 'latin' AS script, count(*) AS docs FROM documents GROUP BY ALL""")
def doc_script_hint(spark, d):
    rows = docs(spark, d).select("lang", F.coalesce(T.script_of_lang(F.col("lang")), F.lit("none")).alias("hint"), T.classify_with_hint(F.col("text"), F.col("lang")).alias("script"))
    return rows.groupBy("lang", "hint", "script").agg(F.count("*").alias("docs"))


@query(f"SELECT doc_id, CAST({_W} // 220 + CASE WHEN {_W} % 220 > 110 THEN 1 ELSE 0 END AS BIGINT) AS minutes FROM documents")
def doc_reading_time(spark, d):
    rows = docs(spark, d).withColumn("script", T.classify_with_hint(F.col("text"), F.col("lang")))
    return rows.select("doc_id", T.reading_minutes(T.length(F.col("text"), F.col("script")), F.col("script")).alias("minutes"))


@query(f"SELECT doc_id, CASE WHEN {_W} < 150 THEN 'CRITICAL' WHEN {_W} < 300 THEN 'WARNING' ELSE 'PASS' END AS depth FROM documents")
def doc_thin_content(spark, d):
    rows = docs(spark, d).withColumn("script", T.classify_with_hint(F.col("text"), F.col("lang")))
    n, thin = T.length(F.col("text"), F.col("script")), T.by_script(F.col("script"), T.THIN)
    return rows.select("doc_id", F.when(n < F.floor(thin / 2), "CRITICAL").when(n < thin, "WARNING").otherwise("PASS").alias("depth"))


@query(f"SELECT lang, count(*) AS docs, count(*) FILTER (WHERE {_W} < 300) AS thin, CAST(sum({_W}) AS BIGINT) AS words FROM documents GROUP BY lang")
def thin_content_by_lang(spark, d):
    rows = docs(spark, d).withColumn("script", T.classify_with_hint(F.col("text"), F.col("lang"))).withColumn("n", T.length(F.col("text"), F.col("script")))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("n") < T.by_script(F.col("script"), T.THIN)).alias("thin"), F.sum("n").alias("words"))


@query(rf"SELECT doc_id, CASE WHEN {_W} <= 100 THEN coalesce(text, '') ELSE array_to_string(regexp_extract_all(text, '[\p{{L}}\p{{Nd}}]+')[1:100], ' ') END AS lede FROM documents")
def doc_first_100_words(spark, d):
    return docs(spark, d).select("doc_id", T.first_units(F.col("text"), T.classify(F.col("text")), 100).alias("lede"))


_HITS = r"len(list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+', ' ', 'g'), ' '), lambda x: x = 'the'))"


@query(f"SELECT doc_id, {_HITS} AS hits, CASE WHEN {_W} > 0 THEN round(100.0 * {_HITS} / {_W}, 6) ELSE 0.0 END AS density FROM documents")
def doc_keyword_density(spark, d):
    rows = docs(spark, d).select("doc_id", T.count_ascii_keyword(F.col("text"), "the").alias("hits"), T.count_words(F.col("text")).alias("n"))
    return rows.select("doc_id", "hits", F.when(F.col("n") > 0, F.round(F.col("hits") * 100.0 / F.col("n"), 6)).otherwise(0.0).alias("density"))


@query(f"SELECT doc_id, {_HITS} AS hits, {_HITS} > 0 AS found FROM documents")
def doc_keyword_folded(spark, d):
    rows = docs(spark, d).select("doc_id", T.count_keyword(F.col("text"), F.lit("The")).alias("hits"))
    return rows.withColumn("found", F.col("hits") > 0)


@query(f"SELECT doc_id, {_HITS} AS hits, {_HITS} > 0 AS found FROM documents")
def doc_keyword_all(spark, d):
    """doc_keyword_folded by the query's former name, when that one read English documents alone."""
    return docs(spark, d).select("doc_id", T.count_keyword(F.col("text"), F.lit("The")).alias("hits")).withColumn("found", F.col("hits") > 0)


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN text[1:40] || '...' ELSE coalesce(text, '') END AS shortened, CASE WHEN length(text) > 40 THEN text[1:37] || '...' ELSE coalesce(text, '') END AS fitted,
  coalesce(text[1:10], '') AS cut FROM documents""")
def doc_truncate(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.shorten(t, 40).alias("shortened"), T.fit(t, 40).alias("fitted"), T.truncate(t, 10).alias("cut"))


@query(rf"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}\x{{85}}]+', ' ', 'g'))) AS collapsed FROM documents")
def doc_collapse_space(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(T.collapse_space(F.col("text")), 256).alias("collapsed"))


@query(rf"SELECT doc_id, CAST(length(coalesce(text, '')) - {_N(r'\p{Mn}')} AS BIGINT) AS width FROM documents")
def doc_display_width(spark, d):
    return docs(spark, d).select("doc_id", T.display_width(F.col("text")).alias("width"))


@query("""SELECT sha256(text) AS text_hash, count(*) AS docs, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents WHERE length(text) >= 200 GROUP BY text_hash HAVING count(*) > 1""")
def content_hash_dupes(spark, d):
    rows = docs(spark, d).select("doc_id", T.text_hash(F.col("text")).alias("text_hash")).where("text_hash <> ''")
    return rows.groupBy("text_hash").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("docs > 1")


@query(r"""WITH p AS (SELECT doc_id, len(regexp_extract_all(line, '[\p{L}\p{Nd}]+')) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')
SELECT doc_id, count(*) AS paragraphs, count(*) FILTER (WHERE n BETWEEN 40 AND 80) AS answers, count(*) FILTER (WHERE n BETWEEN 130 AND 180) AS citations, count(*) FILTER (WHERE n > 150) AS long FROM p GROUP BY doc_id""")
def para_shapes(spark, d):
    rows = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").select("doc_id", T.count_words(F.col("line")).alias("n"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.count_if(F.col("n").between(40, 80)).alias("answers"), F.count_if(F.col("n").between(130, 180)).alias("citations"), F.count_if(F.col("n") > T.LONG_PARAGRAPH[0]).alias("long"))


@query("""WITH x AS (SELECT doc_id, text AS body, doc_id % 3 = 0 AS has_full FROM documents), m AS (SELECT *, body LIKE '#%' AS titled, len(regexp_extract_all(body, '\\[[^\\]]+\\]\\(https?://[^)\\s]+\\)')) AS links,
  len(string_split(body, chr(10) || '#')) - 1 + len(string_split(body, chr(10) || '##')) - 1 AS sections FROM x)
SELECT doc_id, CAST(sections AS BIGINT) AS sections, links, CAST(100 - CASE WHEN titled THEN 0 ELSE 10 END - CASE WHEN links = 0 THEN 15 ELSE 0 END - CASE WHEN has_full THEN 0 ELSE 5 END AS BIGINT) AS score FROM m""")
def llms_audit(spark, d):
    from auditmill.operators import rules

    return rules.llms(docs(spark, d).select("doc_id", F.col("text").alias("body"), (F.col("doc_id") % 3 == 0).alias("has_full"))).select("doc_id", "sections", "links", "score")


_K = "(doc_id % 30 + 1)"
#: Texts of four scripts, of a length that follows from doc_id: units and display columns of one repeat, and the first three units.
_SCRIPTS = {"latin": ("word ", 1, 5, "word word word"), "cjk": ("日本語文abc ", 5, 12, "日本語"), "hangul": ("한국어 단어 ", 2, 12, "한국어 단어 한국어"), "no-space": ("ภาษาไทย ab ", 8, 11, "ภาษ")}
_OF = "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(4)) + " END"


def _pick(values) -> str:
    return _OF.format(*values)


_WIDE_TEXT = _pick(f"repeat('{t}', CAST({_K} AS INTEGER))" for t, *_ in _SCRIPTS.values())


@query(f"""SELECT doc_id, {_pick(f"'{s}'" for s in _SCRIPTS)} AS script, CAST({_pick(f"{u} * {_K}" for _, u, *_ in _SCRIPTS.values())} AS BIGINT) AS units, CAST({_pick(f"{w} * {_K}" for *_, w, _ in _SCRIPTS.values())} AS BIGINT) AS width,
 {_pick(f"CASE WHEN {u} * {_K} <= 3 THEN {_WIDE_TEXT} ELSE '{f}' END" for _, u, _, f in _SCRIPTS.values())} AS opening, {_pick(f"{u} * {_K} < {n}" for (_, u, *_), n in zip(_SCRIPTS.values(), T.THIN))} AS thin,
 {_pick(f"{w} * {_K} BETWEEN {lo} AND {hi}" for (_, _, w, _), lo, hi in zip(_SCRIPTS.values(), T.DESCRIPTION_MIN, T.DESCRIPTION_MAX))} AS fits, CAST({_pick(f"{u} * {_K} // {n} + CASE WHEN {u} * {_K} % {n} > {n} // 2 THEN 1 ELSE 0 END" for (_, u, *_), n in zip(_SCRIPTS.values(), T.SPEED))} AS BIGINT) AS minutes FROM documents""")
def text_of_scripts(spark, d):
    """Length, width, opening and thresholds of texts in four scripts."""
    t, s = F.col("t"), F.col("script")
    rows = table(spark, d, "documents").select("doc_id", F.expr(_WIDE_TEXT).alias("t")).withColumn("script", T.classify(F.col("t")))
    rows = rows.withColumns({"units": T.length(t, s), "width": T.display_width(t), "opening": T.first_units(t, s, 3)})
    fits = F.col("width").between(T.by_script(s, T.DESCRIPTION_MIN), T.by_script(s, T.DESCRIPTION_MAX))
    return rows.select("doc_id", "script", "units", "width", "opening", (F.col("units") < T.by_script(s, T.THIN)).alias("thin"), fits.alias("fits"), T.reading_minutes(F.col("units"), s).alias("minutes"))
