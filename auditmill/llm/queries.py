"""The queries opN_<name> over whole tables, their SQL where SQL can express them, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import ann, chat, extract, fingerprint, kmeans, licenses, minhash, mixing, packing, paragraphs, repair, suffix, toxicity
from auditmill.llm.conversation_sql import FORMATTED, REPAIRED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at 85 %; kept is true for the smallest doc_id of a group."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), num=85, den=100)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte that a repeated 400-byte string covers is removed from all documents."""
    found = suffix.repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated paragraphs of all documents, and whose they repeat."""
    return paragraphs.by_document(table(spark, sf_dir, "documents"))


def op4_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract.extract(table(spark, sf_dir, "pages"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.edit_test(table(spark, sf_dir, "documents"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th embedding among all."""
    return ann.search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' target weights."""
    return mixing.mix_table(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by a hash, and the cheapest repair of each."""
    return repair.digest(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted, and what is read back from the output."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_table(rows.unionByName(chat.marked_conversation(spark))))


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters after five rounds."""
    return kmeans.cluster_table(table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_mixing aims at: sizes and targets, which SQL can express."""
    found = mixing.mix_table(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10_licenses finds of the base phrases, which SQL can express."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("labels", "score")


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_suffix": op2_suffix,
    "op3_paragraphs": op3_paragraphs,
    "op4_extract": op4_extract,
    "op5_fingerprint": op5_fingerprint,
    "op6_ann": op6_ann,
    "op7_mixing": op7_mixing,
    "op8_toxicity": op8_toxicity,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_repair": op11_repair,
    "op12_chat": op12_chat,
    "op13_kmeans": op13_kmeans,
    "mixing_targets": mixing_targets,
    "license_places": license_places,
}



def centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round as two tables: every vector's nearest centroid, and the centroids after it."""
    floor = lambda s, n: f"(({s}) - ((({s}) % ({n})) + ({n})) % ({n})) // ({n})"
    parts = [
        "x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, v AS c FROM x ORDER BY sha256('2:' || vec_id) LIMIT {k})",
    ]
    for r in range(rounds + 1):
        # whole numbers below 2^53: inner products of doubles are exact
        parts.append(f"a{r} AS (SELECT vec_id, v, min({{'d': d, 'j': j}}) AS n FROM (SELECT vec_id, v, j, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d FROM x, c{r}) GROUP BY ALL)")
        if r < rounds:
            parts.append(
                f"m{r} AS (SELECT j, list({floor('s', 'n')} ORDER BY i)::DOUBLE[] AS c FROM (SELECT n.j AS j, i, sum(v[i]::BIGINT)::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL) GROUP BY j), "
                f"c{r + 1} AS (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))"
            )
    head = ", ".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts)
    return (
        f"WITH {head} SELECT vec_id, CAST(n.j AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.j) AS BIGINT) AS cluster_inertia, CAST(sum(n.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c::BIGINT[], ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = n.j"
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"
_NAMES = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PHRASE = lambda *ws: f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{x}{chr(39)}' for k, x in enumerate(ws))})"

ORACLE_SQL: dict[str, str] = {
    # sets of shingles, links by their full intersections, components by walking the links
    "op1_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM d),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
 r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id),
 m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    # every window of 400 bytes as 800 hexadecimal digits, out of overlapping pieces so that long texts stay cheap
    "op2_suffix": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
 p AS (SELECT doc_id, k, substr(h, CAST(2000 * k + 1 AS BIGINT), 2798) AS piece FROM (SELECT doc_id, h, unnest(range(0, 1 + length(h) // 2000)) AS k FROM d)),
 w AS (SELECT doc_id, 1000 * k + i AS pos, hash(substr(piece, CAST(2 * i + 1 AS BIGINT), 800)) AS v FROM (SELECT doc_id, k, piece, unnest(range(0, least(1000, length(piece) // 2 - 399))) AS i FROM p WHERE length(piece) >= 800)),
 t AS (SELECT v FROM w GROUP BY v HAVING count(*) > 1),
 f AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM w WHERE v IN (SELECT v FROM t)),
 g AS (SELECT doc_id, pos, sum(CASE WHEN step IS NULL OR step > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM f),
 s AS (SELECT doc_id, span, min(pos) AS a, max(pos) + 400 AS b FROM g GROUP BY ALL),
 o AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans FROM s GROUP BY doc_id),
 e AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM s UNION ALL SELECT doc_id, max(b), 1000000000000 FROM s GROUP BY doc_id),
 c AS (SELECT doc_id, string_agg(substr(h, CAST(2 * lo + 1 AS BIGINT), CAST(2 * least(hi - lo, length(h)) AS BIGINT)), '' ORDER BY lo) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id) LEFT JOIN c USING (doc_id)""",
    # sources with the least room for their weight fill up first; the rest share one level
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
 s AS (SELECT source, sum(size) AS size, 2.0 * sum(size) AS cap, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3] AS w FROM d GROUP BY source),
 o AS (SELECT *, (SELECT 1.5 * sum(size) FROM s) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over, sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM s),
 l AS (SELECT coalesce(arg_min(over / weights, cap / w) FILTER (WHERE over / weights <= cap / w), 1e300) AS level FROM o)
SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(s.size AS BIGINT) AS source_size, round(least(cap, level * w), 3)::DOUBLE AS target FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, l""",
    "license_places": f"""WITH d AS (SELECT doc_id, {_NAMES} AS w FROM documents),
 p AS (SELECT doc_id, len(w) AS n, {_PHRASE("mit", "license")} AS mit, {_PHRASE("apache", "license")} AS apache, {_PHRASE("general", "public", "license")} AS gpl FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base, list_min(mit || apache || gpl) AS first_word, list_max(mit || apache || gpl) AS last_word,
 array_to_string(list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p""",
    "op11_repair": REPAIRED,
    "op12_chat": FORMATTED,
    "op13_kmeans": centroid_sql(),
}
