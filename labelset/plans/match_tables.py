"""Canonicalisation stages on the driver tables.

Names are spellings derived from every ``part`` row (the name itself, with its type, in
plural, shouted, a brand label, type first); the universe is the distinct ``p_name``.
Document near-copies exercise the token stage at table scale: every document against
every earlier document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelset.functions import text as T
from labelset.operators import match as MT
from labelset.operators import metrics as M
from labelset.operators.rule_index import match_rule_table
from labelset.plans.registry import r6, register, table
from labelset.plans.text_tables import sql_normalize, sql_token_list

# Ordered rules of these queries (pattern matched at the start of the normalised name).
PART_RULES: tuple[tuple[str, str], ...] = (
    (r"hot rods?$", "hot rod"),
    (r"cold .*gizmo", "cold gizmo"),
    (r".*\bwidgets?\b.*\beconomy$", "new widget"),
)
LISTED = "%o%"  # part names in the universe of in_universe / match_exact; the others are rejected

_VARIANTS = (
    "p_name",
    "concat(p_name, ' ', p_type)",
    "concat(p_name, 's')",
    "concat(upper(p_name), '!')",
    "concat('Brand ', p_brand)",
    "concat(p_type, ' ', p_name)",
)


def part_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct normalised spellings built from all part rows."""
    part = table(spark, sf_dir, "part").select("p_name", "p_type", "p_brand")
    arr = F.array(*[F.expr(v) for v in _VARIANTS])
    raw = part.select(F.explode(arr).alias("raw"))
    return raw.select(T.normalize_text(F.col("raw")).alias("name")).distinct()


def _sql_variants() -> str:
    parts = " UNION ".join(f"SELECT {sql_normalize(v)} AS name FROM part" for v in _VARIANTS)
    return f"names AS (SELECT DISTINCT name FROM ({parts}))"


def _sql_rules(col: str) -> str:
    whens = " ".join(f"WHEN regexp_matches({col}, '^(?:{p})') THEN '{MT.py_normalize(t)}'"
                     for p, t in PART_RULES)
    return f"CASE {whens} END"


@register("match_rules", sql=f"""
WITH n AS (SELECT {sql_normalize("concat(p_name, ' ', p_type)")} AS name FROM part)
SELECT coalesce({_sql_rules('name')}, 'none') AS target, count(*) AS n FROM n GROUP BY 1
""")
def q_match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_name", "p_type")
    n = part.select(T.normalize_text(F.concat_ws(" ", "p_name", "p_type")).alias("name"))
    t = n.select(F.coalesce(MT.match_rules(F.col("name"), PART_RULES), F.lit("none")).alias("target"))
    return t.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@register("match_rule_table", sql="""
WITH n AS (SELECT p_partkey AS k, lower(p_name || ' ' || replace(p_brand, '#', ' ') || ' ' || p_partkey) AS name FROM part),
h AS (SELECT name, 'customer ' || c_custkey AS target, 10 + c_custkey AS rule_order FROM n JOIN customer
        ON k // 10 = c_custkey AND k % 10 IN (0, 5)
      UNION ALL SELECT name, 'nation ' || n_nationkey, n_nationkey - 100 FROM n JOIN nation ON k = n_nationkey
      UNION ALL SELECT name, 'any', 1000000000 FROM n WHERE name LIKE '%1')
SELECT name, arg_min(target, rule_order) AS target, CAST(min(rule_order) AS BIGINT) AS rule_order FROM h GROUP BY name
""")
def q_match_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for every customer and nation, and one without a needed literal, over the names of all parts."""
    part = table(spark, sf_dir, "part")
    names = part.select(T.normalize_text(F.concat_ws(" ", "p_name", "p_brand", F.col("p_partkey").cast("string"))).alias("name"))
    key = lambda c: F.col(c).cast("string")
    of_customer = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 10).alias("rule_order"), F.concat(F.lit("[a-z ]+ brand [0-9]+ "), key("c_custkey"), F.lit("(?:0|5)$")).alias("pattern"),
        F.concat(F.lit("customer "), key("c_custkey")).alias("target"))
    of_nation = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") - 100).cast("long").alias("rule_order"),
        F.concat(F.lit("(?:.* |never )brand [0-9]+ "), key("n_nationkey"), F.lit("$")).alias("pattern"),
        F.concat(F.lit("nation "), key("n_nationkey")).alias("target"))
    rest = spark.range(1).select(F.lit(1_000_000_000).cast("long").alias("rule_order"), F.lit(".*1$").alias("pattern"), F.lit("any").alias("target"))
    return match_rule_table(names, of_customer.unionByName(of_nation).unionByName(rest))


def _small_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter(F.col("p_name").like(LISTED)).select(F.col("p_name").alias("norm"))


@register("in_universe", sql=f"""
SELECT p.p_name, count(*) AS n_lines
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
WHERE p.p_name IN (SELECT p_name FROM part WHERE p_name LIKE '{LISTED}')
GROUP BY p.p_name
""")
def q_in_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = li.join(part, li.l_partkey == part.p_partkey).select("p_name")
    kept = M.in_universe(named, _small_universe(spark, sf_dir), item="p_name")
    return kept.groupBy("p_name").agg(F.count(F.lit(1)).alias("n_lines"))


@register("match_exact", sql=f"""
WITH {_sql_variants()}
SELECT name, name AS canon FROM names
WHERE name IN (SELECT p_name FROM part WHERE p_name LIKE '{LISTED}')
""")
def q_match_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_name_variants(spark, sf_dir)
    return MT.match_exact(names, _small_universe(spark, sf_dir), "name", "norm")


@register("match_tokens", sql=f"""
WITH n AS (SELECT doc_id, {sql_token_list(sql_normalize('text'))} AS toks FROM documents),
t AS (SELECT doc_id, unnest(toks) AS tok, len(toks) AS sz FROM n WHERE len(toks) > 0),
p AS (SELECT a.doc_id, b.doc_id AS match_id, count(*) AS inter,
             any_value(a.sz) AS sa, any_value(b.sz) AS sb
      FROM t a JOIN t b ON a.tok = b.tok AND b.doc_id < a.doc_id GROUP BY 1, 2),
s AS (SELECT doc_id, match_id,
             inter / CAST(sa + sb - inter AS DOUBLE)
             + CASE WHEN inter = least(sa, sb) THEN 0.1 ELSE 0.0 END AS score FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, match_id) AS rn
      FROM s WHERE score >= 0.6)
SELECT doc_id, match_id, round(score, 6) AS score FROM r WHERE rn = 1
""")
def q_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    toks = docs.select("doc_id", T.token_set(F.col("text")).alias("tokens"))
    best = MT.best_earlier_match(toks, "doc_id", "tokens", "match_id")
    return best.select("doc_id", "match_id", r6("score").alias("score"))


def _sql_lev_best(names_cte: str, out_cols: str = "name, canon, score") -> str:
    return f"""
lv AS (SELECT n.name, u.norm,
              1 - levenshtein(n.name, u.norm) / CAST(greatest(length(n.name), length(u.norm)) AS DOUBLE) AS score
       FROM {names_cte} n CROSS JOIN (SELECT DISTINCT p_name AS norm FROM part) u
       WHERE length(n.name) > 0),
lvb AS (SELECT name, norm AS canon, score,
               row_number() OVER (PARTITION BY name ORDER BY score DESC, norm DESC) AS rn
        FROM lv WHERE score >= 0.85)"""


@register("match_strings", sql=f"""
WITH {_sql_variants()},
rest AS (SELECT name FROM names WHERE name NOT IN (SELECT p_name FROM part)),
{_sql_lev_best('rest')}
SELECT name, canon, round(score, 6) AS score FROM lvb WHERE rn = 1
""")
def q_match_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_name_variants(spark, sf_dir)
    universe = table(spark, sf_dir, "part").select(F.col("p_name").alias("norm"))
    rest = names.join(universe.select(F.col("norm").alias("name")), "name", "left_anti")
    best = MT.match_strings(rest, universe, "name", "norm", method="levenshtein")
    return best.select("name", "canon", r6("score").alias("score"))


@register("match_strings_ratio", sql=f"""
WITH u AS (SELECT DISTINCT p_name FROM part),
n AS (SELECT p_name || 's' AS name, p_name AS canon FROM u
      UNION SELECT left(p_name, length(p_name) - 1), p_name FROM u)
SELECT name, canon, round(2.0 * least(length(name), length(canon)) / (length(name) + length(canon)), 6) AS score FROM n
WHERE name NOT IN (SELECT p_name FROM u)
""")
def q_match_strings_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a letter more and a letter less against all part names, by the sequence-matcher ratio."""
    universe = table(spark, sf_dir, "part").select(F.col("p_name").alias("norm")).distinct()
    plural, cut = F.concat("norm", F.lit("s")), F.expr("left(norm, length(norm) - 1)")
    names = universe.select(F.explode(F.array(plural, cut)).alias("name"))
    rest = names.join(universe.select(F.col("norm").alias("name")), "name", "left_anti")
    best = MT.match_strings(rest, universe, "name", "norm", method="ratio")
    return best.select("name", "canon", r6("score").alias("score"))


@register("canonicalize", sql=f"""
WITH {_sql_variants()},
u AS (SELECT DISTINCT p_name AS norm FROM part),
r AS (SELECT name, {_sql_rules('name')} AS canon FROM names),
rules AS (SELECT name, canon, 'rules' AS stage FROM r WHERE canon IS NOT NULL AND name <> ''),
rest1 AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM rules)),
exact AS (SELECT name, name AS canon, 'exact' AS stage FROM rest1 WHERE name IN (SELECT norm FROM u)),
rest2 AS (SELECT name, {sql_token_list('name')} AS toks FROM rest1
          WHERE name NOT IN (SELECT name FROM exact)),
ut AS (SELECT norm, {sql_token_list('norm')} AS toks FROM u),
tp AS (SELECT n.name, v.norm, len(list_intersect(n.toks, v.toks)) AS inter,
              len(n.toks) AS sa, len(v.toks) AS sb
       FROM rest2 n CROSS JOIN ut v WHERE len(n.toks) > 0 AND len(v.toks) > 0),
ts AS (SELECT name, norm, inter / CAST(sa + sb - inter AS DOUBLE)
              + CASE WHEN inter = least(sa, sb) THEN 0.1 ELSE 0.0 END AS score FROM tp),
tb AS (SELECT name, norm, row_number() OVER (PARTITION BY name ORDER BY score DESC, norm) AS rn
       FROM ts WHERE score >= 0.6),
tokens AS (SELECT name, norm AS canon, 'tokens' AS stage FROM tb WHERE rn = 1),
rest3 AS (SELECT name FROM rest2 WHERE len(toks) > 0 AND name NOT IN (SELECT name FROM tokens)),
{_sql_lev_best('rest3')},
strings AS (SELECT name, canon, 'strings' AS stage FROM lvb WHERE rn = 1),
unchanged AS (
  SELECT name, name AS canon, 'unchanged' AS stage FROM rest2 WHERE len(toks) = 0
  UNION ALL
  SELECT name, name AS canon, 'unchanged' AS stage FROM rest3 WHERE name NOT IN (SELECT name FROM strings))
SELECT * FROM rules UNION ALL SELECT * FROM exact UNION ALL SELECT * FROM tokens
UNION ALL SELECT * FROM strings UNION ALL SELECT * FROM unchanged
""")
def q_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_name_variants(spark, sf_dir)
    universe = table(spark, sf_dir, "part").select(F.col("p_name").alias("norm"))
    return MT.canonicalize(names, universe, "name", "norm", rules=PART_RULES,
                           string_method="levenshtein")
