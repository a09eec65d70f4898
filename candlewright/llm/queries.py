"""The registered queries of the training-data operators, at production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, delta_lloyd, quality, token_counts, vector_codes, warc
from ._common import fresh, prepare, table
from .fingerprints import fingerprint_successors
from .html_extract import extract
from .minhash import near_components
from .mixing import DOMAINS, mix
from .packing import pack
from .pitman_yor import score
from .suffix_dedup import dedup_substrings


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), length=100)
    return found.select(F.col("row.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, b[i + 1 : i + 100] AS s FROM d, unnest(range(0, n - 99)) AS t(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS place FROM w) WHERE place > 1),
island AS (SELECT doc_id, i, sum(apart) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS apart FROM again)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM island GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS e FROM runs
         UNION ALL SELECT d.doc_id, coalesce(r.e, 0), n FROM d LEFT JOIN (SELECT doc_id, max(e) AS e FROM runs GROUP BY 1) r ON d.doc_id = r.doc_id),
kept AS (SELECT g.doc_id, sha256(unhex(string_agg(hex(b[g.a + 1 : g.e]), '' ORDER BY g.a))) AS kept_sha256 FROM gaps g JOIN d ON g.doc_id = d.doc_id GROUP BY 1),
r AS (SELECT doc_id, sum(e - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN r ON d.doc_id = r.doc_id
"""


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"), num=85, den=100)
    return found.selectExpr("id doc_id", "n_shingles", "component component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM t, unnest(range(1, len(w) - 3)) AS u(i) WHERE len(w) >= 5
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM t WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
half AS MATERIALIZED (SELECT x, y FROM common JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * k >= 85 * (a.n + b.n - k)),
link AS MATERIALIZED (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
c AS (SELECT a, min(b) AS component FROM reach GROUP BY 1)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, component = t.doc_id AS kept FROM t JOIN c ON t.doc_id = c.a LEFT JOIN n ON t.doc_id = n.doc_id
"""


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_successors(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ledger(table(spark, sf_dir, "documents"), carry=["doc_id"])
    base_failed = ~quality.kept("base-1")
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), quality.kept("web-1").alias("kept"), "failures")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
place AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM place),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (
  SELECT *, CAST((CASE WHEN n_words < 50 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END) + (CASE WHEN n_words = 0 THEN 32 ELSE 0 END) AS BIGINT) AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, (failures & 15) = 0 AS kept, failures FROM f
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    prepare(spark)
    path = fresh(spark, "warc")
    warc.write_archives(warc.convert(warc.to_arc(pages)), path)
    found = warc.read_archives(spark, path)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "date")


#: A name's UUID of version 5 is 16 bytes of a SHA-1, six bits of them fixed.
OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(url, 'urn:none') AS url, encode(coalesce(html, '')) AS b, make_timestamp((820454400 + page_id % 1000000000) * 1000000) AS born FROM pages),
q AS (SELECT page_id, url, born, octet_length(b) AS n, sha256(b) AS digest FROM p),
f AS (SELECT *, n >= 100 AND page_id > min(page_id) OVER (PARTITION BY digest) AS again, min(page_id) OVER (PARTITION BY digest) AS first FROM q),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url || ' ' || strftime(born, '%Y%m%d%H%M%S') || ' ' || digest || ' ' || page_id)) AS h FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
  '<urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', (instr('0123456789abcdef', h[17]) - 1) % 4 + 1, 1) || h[18:20] || '-' || h[21:32] || '>' AS record_id, strftime(born, '%Y-%m-%dT%H:%M:%SZ') AS date
FROM h
"""


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT -1L AS conv_id, t.* FROM VALUES (0L, 'user', '</s>[INST] ok [/INST]'), (1L, 'assistant', '</s>[INST] ok [/INST]') AS t(turn, role, text)")
    found = chat.read_back(chat.render(chat.fold(chat.log_of(rows.unionByName(probe), revisions=True))))
    return found.selectExpr(
        "conversation conv_id",
        "cast(size(turns) as long) n_turns",
        r"sha2(array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), ''), 256) turns_sha256",
        "cast(length(array_join(loss, '')) as long) loss_chars",
        "sha2(array_join(loss, ''), 256) loss_sha256",
        "formatted_chars",
    )


OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, length(role) + length(regexp_replace(role, '[^\\<\[\]\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g'))
    + CASE WHEN role = 'assistant' THEN 13 ELSE 17 END AS chars FROM rows),
t AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t
"""


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("row.id").alias("doc_id"), "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "residual")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    stored = token_counts.prefix_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    found = token_counts.totals(stored, limits=(2048,))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_chars", "fits_2048")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_lloyd.cluster(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


FINITE = "len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
INTEGERS = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"


def op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds: every vector against every centroid."""
    square = "list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {INTEGERS} AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM e WHERE vec_id IS NOT NULL QUALIFY k < {k})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, min({{'d': CAST({square} AS BIGINT), 'k': c.k}}) AS m FROM e, c{n} c GROUP BY r)")
        if n < rounds:
            mean = f"SELECT k, list(x ORDER BY i) AS v FROM (SELECT k, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT m.k AS k, unnest(e.v) AS x, unnest(range(64)) AS i FROM a{n} JOIN e ON a{n}.r = e.r) GROUP BY k, i) GROUP BY k"
            steps.append(f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN ({mean}) m ON c.k = m.k)")
    return f"WITH {', '.join(steps)} SELECT e.vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN e ON a.r = e.r JOIN c{rounds} c ON a.m.k = c.k"


def op13_sql(rounds: int = 2) -> str:
    """Plain rounds: every part against every entry of its codebook."""
    square = " + ".join(f"(q.v[{i}] - b.v[{i}]) * (q.v[{i}] - b.v[{i}])" for i in (1, 2, 3, 4))
    steps = [
        f"w AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {INTEGERS} AS v FROM embeddings WHERE len(embedding) = 64 AND {FINITE})",
        "q AS MATERIALIZED (SELECT r, p, list_slice(v, 4 * p + 1, 4 * p + 4) AS v FROM w, range(16) t(p))",
        "b0 AS MATERIALIZED (SELECT p, e, list_slice(v, 4 * p + 1, 4 * p + 4) AS v FROM (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS e, v FROM w WHERE vec_id IS NOT NULL QUALIFY e < 64), range(16) t(p))",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, q.p AS p, min({{'d': {square}, 'e': b.e}}) AS m FROM q JOIN b{n} b ON q.p = b.p GROUP BY r, q.p)")
        if n < rounds:
            mean = ", ".join(f"CAST(floor(sum(q.v[{i}]) / count(*)) AS BIGINT)" for i in (1, 2, 3, 4))
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{n} b LEFT JOIN (SELECT a.p AS p, a.m.e AS e, [{mean}] AS v FROM a{n} a JOIN q ON a.r = q.r AND a.p = q.p GROUP BY ALL) m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"c AS (SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS sha FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT w.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM c JOIN w ON c.r = w.r, s"


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit() and not name.endswith("_sql")}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": OP1_SQL, "op2_minhash_dedup": OP2_SQL, "op4_quality_ledger": OP4_SQL, "op5_warc": OP5_SQL, "op7_chat_format": OP7_SQL, "op12_delta_lloyd": op12_sql(), "op13_vector_codes": op13_sql()}
