"""Registered queries of the corpus operators, one ``opN_<name>`` each, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oreflow.llm import chat_format as chat
from oreflow.llm import mixing
from oreflow.llm import toxicity as tox
from oreflow.llm.decontaminate import contaminated
from oreflow.llm.hmm_lm import hmm_scores
from oreflow.llm.ngram_join import ngram_components
from oreflow.llm.quality import quality
from oreflow.llm.scratch import kept, new_path
from oreflow.llm.substring_dedup import kept_digest, substring_dedup
from oreflow.llm.url_filter import Rule, url_verdicts
from oreflow.llm.warc import registered

URL_RULES = [Rule.parse("allow", "org/"), Rule.parse("block", "example.org/es/"), Rule.parse("block", "example.org/en/1"), Rule.parse("allow", "com/fr/"), Rule.parse("block", "com/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), k=5, percent=75)


def _remainder(column: str, by: int) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(by))


def op2_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = hmm_scores(_table(spark, sf_dir, "documents"), _remainder("doc_id", 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"), URL_RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_digest(substring_dedup(_table(spark, sf_dir, "documents"), window=13))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = tox.trained(docs, labels.filter(_remainder("doc_id", 5) != 0))
    held = F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False))
    return tox.toxicity(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_offending"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = kept(mixing.sized(_table(spark, sf_dir, "documents")), "sizes")
    sources = kept(mixing.source_table(docs), "sources")
    out = mixing.mixed(docs, mixing.cyclic_weights(sources), sources, max_epochs=3.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(turns))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as WARC archives in the shared folder and reads these back."""
    registered(spark)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    large = F.col("payload_bytes") >= 1000
    # only payloads that stand more than once need a row here
    last = pages.filter(large).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("c")).filter("c > 1").drop("c")
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    records = pages.join(last, ["payload_digest", "payload_bytes"], "left").select(
        urn("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.when(again, urn("last")).alias("refers_to"), "payload_digest", "payload_bytes", F.when(~again, F.col("payload")).alias("payload"),
    )
    path = new_path(spark, "warc")
    records.write.format("warc").mode("append").save(path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 12) AS BIGINT)")
    responses = spark.read.format("warc").load(path).filter("record_type = 'response'").select(page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = spark.read.format("warc").option("payload", "false").load(path).filter("record_type = 'revisit'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [op1_ngram_join, op2_hmm_scoring, op3_url_filter, op4_substring_dedup, op5_decontamination, op6_toxicity, op7_mixing, op8_quality_rules, op9_chat_format, op10_warc]
    return {f.__name__: f for f in every}


_WORD = r"[^\x20\x09-\x0D]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

_OP3 = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT h.page_id, h.host, h.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS k FROM h LEFT JOIN rules r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

_OP4 = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
one AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
kept AS (SELECT one.doc_id, count(*) FILTER (gone.i IS NOT NULL) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY one.i) FILTER (gone.i IS NULL), '') AS kept FROM one LEFT JOIN gone USING (doc_id, i) GROUP BY one.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_OP8 = f"""
WITH w AS (SELECT doc_id, source, text, {_WORDS} AS w, hash(text) AS fp FROM documents),
one AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: array_to_string(w[j:j + 2], ' '))) AS g FROM w WHERE len(w) >= 3),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM one) WHERE c > 1) GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM raw WHERE trim(line, {_BLANKS}) <> '' GROUP BY doc_id),
ln AS (SELECT doc_id, source, text, trim(translate(line, {_DIGITS}), {_BLANKS}) AS line, len(regexp_extract_all(line, '{_WORD}')) AS k FROM raw),
often AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT text) AS n FROM ln WHERE line <> '' GROUP BY source, line) JOIN (SELECT source, count(DISTINCT text) AS d FROM documents GROUP BY source) USING (source) WHERE n > 10 AND 100 * n > 2 * d),
lost AS (SELECT doc_id, sum(k) AS n FROM ln JOIN often USING (source, line) GROUP BY doc_id),
st AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS gone FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * (n_words - gone) < 50 * n_words) AS kept FROM st
"""

_CONTROLS = "|".join("".join("\\" + c if not c.isalnum() else c for c in x) for x in chat.Template().controls)
_EXTRA = lambda c: f"(length({c}) + length({c}) - length(replace({c}, chr(92), '')) + len(regexp_extract_all({c}, '{_CONTROLS}')))"
_ARCS = "(" + ", ".join(f"('{a}', '{b}')" for a, bs in chat.Template().follows.items() for b in bs) + ")"
_OP9 = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, row_number() OVER o - 1 AS pos, lag(role, 1, '') OVER o AS state, lead(role) OVER o IS NULL AS is_last FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
m AS (SELECT *, (state, role) IN {_ARCS} AS fits FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum({_EXTRA('role')} + {_EXTRA('text')} + {len(chat.Template().open + chat.Template().mid + chat.Template().close)}) AS BIGINT) AS formatted_chars,
coalesce(min(pos) FILTER (NOT fits), max(pos + 1) FILTER (is_last AND role <> 'assistant')) IS NULL AS valid, CAST(coalesce(min(pos) FILTER (NOT fits), max(pos + 1) FILTER (is_last AND role <> 'assistant')) AS INT) AS error_turn FROM m GROUP BY conv_id
"""

_OP10 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to FROM m
"""


def oracle_sql() -> dict[str, str]:
    """Scoring, decontamination, toxicity and mixing have none: their results come from fitted models,
    hashed draws or regular expressions that SQL engines read differently."""
    return {"op1_ngram_join": _OP1, "op3_url_filter": _OP3, "op4_substring_dedup": _OP4, "op8_quality_rules": _OP8, "op9_chat_format": _OP9, "op10_warc": _OP10}
