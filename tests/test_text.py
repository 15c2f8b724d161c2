"""Text normalisation, tokens, abbreviations, slugs (edge cases and NFKD equivalence)."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from labelset.functions import text as T


def py_norm(s):
    t = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9]+", " ", t.lower()).strip())


def one(spark, col_expr, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(col_expr.alias("x")).collect()[0].x


def test_normalize_edge_cases(spark):
    s = F.col("s")
    assert one(spark, T.normalize_text(s), "Conversão Trial → Pago") == "conversao trial pago"
    assert one(spark, T.normalize_text(s), "a→b") == "ab"
    assert one(spark, T.normalize_text(s), "DAU/MAU") == "dau mau"
    assert one(spark, T.normalize_text(s), None) == ""
    assert one(spark, T.normalize_text(s), "  Ação\n\tÉ  ") == "acao e"


def test_normalize_matches_nfkd_on_random_text(spark):
    rnd = random.Random(3)
    alphabet = ("abcXYZ019 -/().,éèÇñßİẞ½ﬁ™"
                "́ 　→\U0001d400ÅŁø")
    rows = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 30))) for _ in range(300)]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    got = {r.i: r.n for r in T.normalize_text_df(df, "s", "n").collect()}
    assert got == {i: py_norm(r) for i, r in enumerate(rows)}


def test_token_set(spark):
    assert one(spark, T.token_set(F.col("s")), "taxa de abertura") == []
    assert sorted(one(spark, T.token_set(F.col("s")), "Lead Time for Changes")) == \
        ["changes", "for", "lead", "time"]
    assert one(spark, T.token_set(F.col("s")), "") == []


def test_abbreviations_and_universe(spark):
    assert one(spark, T.extract_abbreviations(F.col("s")), "x (CPC) y (a b)") == ["CPC"]
    names = spark.createDataFrame([("Taxa de Cliques (CTR)",), ("CTR",), ("Custo por Lead",)], "n string")
    u = {r.norm: r for r in T.expand_universe(names, "n").collect()}
    assert u["ctr"].canon == "CTR"
    assert "taxa de cliques ctr" in u and "custo por lead" in u
    assert "dau mau" in u and u["roi"].canon == "ROI"
    assert u["taxa de cliques ctr"].tokens == ["ctr"]          # "taxa", "de", "cliques" are stopwords


def test_slug_sheet_and_repair(spark):
    assert one(spark, T.sheet_name(F.col("s")), "a/b:c") == "a_b_c"
    assert one(spark, T.sheet_name(F.col("s")), "x" * 40) == "x" * 31
    assert one(spark, T.slug(F.col("s")), "llama3.1:8b") == "llama3_1_8b"
    assert one(spark, T.slug(F.col("s")), "::") == "unknown"
    assert one(spark, T.repair_trailing_commas(F.col("s")), '["a", "b",\n ]') == '["a", "b"]'
    assert one(spark, T.coerce_numeric(F.col("s")), " 1e3 ") == 1000.0
    assert one(spark, T.coerce_numeric(F.col("s")), "abc") is None
    assert one(spark, T.coalesce_truthy(F.col("s"), F.lit("b")), "  ") == "b"


def test_normalize_is_idempotent(spark):
    rnd = random.Random(9)
    alphabet = "aB9 -_/ÉéçÑñß½ﬁ→\t\n"
    rows = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 20))) for _ in range(200)]
    df = spark.createDataFrame([(r,) for r in rows], "s string")
    once = T.normalize_text_df(df, "s", "n1")
    twice = T.normalize_text_df(once, "n1", "n2")
    assert all(r.n1 == r.n2 for r in twice.collect())
