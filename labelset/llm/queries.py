"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.llm import (
    conversation_repair, decontaminate, exact_search, jaccard_join, language_model, line_dedup, packing, periodic_runs,
    personal_data, quality_classifier, quality_rules, repeats, url_filter)
from labelset.llm.registry import LLM_QUERIES, Query, register, table  # noqa: F401

_SQL_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_SQL_MEASURES = rf"""
t AS (SELECT doc_id, coalesce(text, '') AS x, {_SQL_WORDS.format("coalesce(text, '')")} AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
      FROM documents),
p AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
r AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, sum(least(3, coalesce(nxt - i, 3))) AS k FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(k, 0) AS BIGINT) AS n_repeat_words,
             length(regexp_replace(x, '[^A-ZÀ-ÖØ-Þ]', '', 'g')) AS n_capitals, length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclamations
      FROM t LEFT JOIN c USING (doc_id))"""
_SQL_FAILS = " + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, (_, cond) in enumerate(quality_rules.RULES))


@register("op2_quality_rules", f"""
WITH {_SQL_MEASURES}, f AS (SELECT *, {_SQL_FAILS} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       failures & {quality_rules.policy_mask(quality_rules.CURRENT_POLICY)} = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM f""")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.lit(quality_rules.policy_mask("base-1")).cast("long")
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      (F.col("failures").bitwiseAND(base) != 0).alias("base_failed"),
                      quality_rules.passes().alias("kept"), "failures")


@register("op10_line_dedup", rf"""
WITH l AS (SELECT doc_id, unnest(range(len(x))) AS no, unnest(x) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
w AS (SELECT doc_id, no, raw, doc_id * 10000000 + no AS place, {_SQL_WORDS.format("raw")} AS w FROM l),
t AS (SELECT *, array_to_string(w, ' ') AS line, len(w) AS n FROM w),
f AS (SELECT line, any_value(w) AS w, any_value(n) AS n, min(place) AS place FROM t WHERE n > 0 GROUP BY line),
v AS (SELECT place, n, i, array_to_string(w[1:i - 1] || w[i + 1:n], ' ') AS rest
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM f WHERE n >= {line_dedup.MIN_WORDS})),
swap AS (SELECT place FROM v QUALIFY min(place) OVER (PARTITION BY n, i, rest) < place),
cut AS (SELECT v.place AS a, f.place AS b FROM v JOIN f ON f.line = v.rest AND f.n >= {line_dedup.MIN_WORDS}),
near AS (SELECT place FROM swap UNION SELECT greatest(a, b) FROM cut),
gone AS (SELECT t.doc_id, t.no FROM t JOIN f USING (line) WHERE t.place <> f.place
         UNION SELECT t.doc_id, t.no FROM t JOIN near USING (place)),
kept AS (SELECT t.doc_id, string_agg(raw, chr(10) ORDER BY t.no) AS kept, count(*) AS n
         FROM t ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.no = gone.no GROUP BY t.doc_id)
SELECT d.doc_id, CAST(coalesce(g.k, 0) AS BIGINT) AS n_lines_removed,
       sha256(coalesce(CASE WHEN g.k IS NULL THEN d.text ELSE kept END, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id) g USING (doc_id)""")
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def vocabulary() -> str:
    """The public vocabulary file that the packing query counts tokens with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())


@register("op7_jaccard_join")
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op1_substring_dedup", rf"""
WITH w AS (SELECT doc_id, {_SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {repeats.SPAN - 2})) AS i, w FROM w),
g AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + {repeats.SPAN - 1}], ' ')) AS g FROM s),
late AS (SELECT doc_id, i FROM g QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range({repeats.SPAN})) AS k FROM late)),
kept AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY t.i) AS kept, count(*) AS n
         FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w) t
         ANTI JOIN gone ON t.doc_id = gone.doc_id AND t.i = gone.i GROUP BY t.doc_id)
SELECT w.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Host labels whose pages make up the list of the URL query (fixed values).
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
_SQL_LABELS = "|".join(LISTED_LABELS)
_SQL_RULES = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.verdict} {r.host}{r.path}'"
    for r in sorted(url_filter.RULES, key=lambda r: -len(r.host + r.path)))


@register("op9_url_filter", rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
c AS (SELECT *, CASE {_SQL_RULES} END AS hit,
             regexp_replace(regexp_replace(host, '^.*@|:[0-9]*$', '', 'g'), '^(www|m)\.', '') || regexp_replace(path, '/+$', '') AS key FROM u),
listed AS (SELECT DISTINCT key FROM c WHERE regexp_matches(host, '(^|\.)({_SQL_LABELS})\.'))
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
       CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1) WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM c""")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of().rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})\."))
    return url_filter.judge(pages, listed).drop("url")


@register("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


@register("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


@register("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs).withColumn("best", periodic_runs.strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damage(conversations), conversations)


@register("op13_exact_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""")
def op13_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
