"""Text normalisation as Spark column expressions.

Everything here returns a ``Column`` built from built-in functions, so it stays inside
whole-stage codegen. The one exception is :func:`normalize_text_df`, which routes the rare
rows holding characters that a one-to-one ``translate`` cannot fold (ligatures, fractions,
characters outside the BMP) through an Arrow UDF and keeps every other row native.
"""

from __future__ import annotations

import functools
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the scored tool's for identical results.
# ---------------------------------------------------------------------------
# Stopwords removed from token sets (as listed there, duplicates included).
STOPWORDS: tuple[str, ...] = (
    "taxa", "indice", "de", "do", "da", "das", "dos", "por", "para", "no", "na", "nos", "nas",
    "em", "o", "a", "os", "as", "geral", "rate", "score", "percentual", "percent", "mediana",
    "media", "medio", "promoter", "net", "cliente", "clientes", "usuario", "usuarios",
    "confirmado", "confirmada", "confirmados", "confirmadas", "aberto", "abertura", "open",
    "click", "clique", "clicks", "cliques", "true", "false", "value", "valores", "tempo", "medio",
    "médio", "min", "segundos", "s", "dias", "dia", "meses", "mes", "horas", "hora", "d7", "d30",
    "mrr", "kpi",
)
# Abbreviations always added to a universe; display form is the upper-case spelling.
UNIVERSE_ABBREVIATIONS: tuple[str, ...] = (
    "cpc", "cpa", "cpl", "ctr", "cpm", "roas", "roi", "mrr", "arpu", "arppu", "mape", "fcr",
    "csat", "nps", "dau mau", "daumau",
)
# Codes written in parentheses after a name, e.g. "Taxa de Cliques (CTR)".
ABBREVIATION_PATTERN = r"\(([A-Za-z0-9\-/]+)\)"
# Characters replaced in sheet / table names, and their maximum length.
SHEET_NAME_PATTERN = r"[:\\/?*\[\]]"
SHEET_NAME_MAX = 31

# Whitespace as Python's str.strip() sees it (Java's \s is ASCII only).
WS_CLASS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# ---------------------------------------------------------------------------
# Accent folding table, generated from the Unicode database (NFKD + ASCII filter).
# ---------------------------------------------------------------------------
def _nfkd_ascii(s: str) -> str:
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode("ascii")


@functools.lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, str]:
    """(src, dst, multi), generated from the Unicode database.

    src/dst: the BMP characters whose NFKD form keeps exactly one ASCII character, for a
    one-to-one ``translate``; characters that keep none need no entry (the non-ASCII
    deletion that follows removes them). ``multi``: BMP characters that keep two or more
    ASCII characters (ligatures, fractions, ...); rows holding one, or a character outside
    the BMP, take the exact UDF path.
    """
    src, dst, multi = [], [], []
    for cp in range(0x80, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        folded = _nfkd_ascii(ch)
        if len(folded) == 1:
            src.append(ch)
            dst.append(folded)
        elif len(folded) > 1:
            multi.append(ch)
    return "".join(src), "".join(dst), "".join(multi)


def strip_ws(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def _translate(c: Column) -> Column:
    src, dst, _ = _fold_tables()
    return F.translate(c, src, dst)


def fold_accents(c: Column) -> Column:
    """NFKD fold to ASCII for one-to-one characters, then delete what is left non-ASCII."""
    return F.regexp_replace(_translate(c), r"[^\x00-\x7F]", "")


def normalize_text(c: Column) -> Column:
    """Fold accents, lower-case, runs of non-alphanumerics to one space, trim.

    Leftover non-ASCII is deleted before the punctuation step, so "a→b" becomes "ab".
    NULL input gives "".
    """
    s = F.lower(fold_accents(c))
    s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    return F.coalesce(s, F.lit(""))


def needs_unicode_fallback(c: Column) -> Column:
    """True where ``normalize_text`` could differ from full NFKD: a character that folds
    to several ASCII characters, or one outside the BMP."""
    multi = _fold_tables()[2]
    rare = F.regexp_replace(c, r"[\x00-\x7F]+", "")  # empty for ASCII texts, the rest is short
    marked = F.translate(rare, multi, "\x01" * len(multi))
    return F.coalesce(c.rlike(r"[^\x00-\x7F]") & marked.rlike(r"[\x01\x{10000}-\x{10FFFF}]"), F.lit(False))


@F.pandas_udf(T.StringType())
def _normalize_text_exact(s: pd.Series) -> pd.Series:
    import re

    def one(x):
        if not isinstance(x, str):
            return ""
        t = _nfkd_ascii(x).lower()
        return re.sub(r"[^a-z0-9]+", " ", t).strip()

    return s.map(one)


def normalize_text_df(df: DataFrame, col: str, out: str) -> DataFrame:
    """``normalize_text`` with exact NFKD semantics for every character.

    Rows without rare characters take the native expression; the others go through an
    Arrow UDF, which receives NULL for every other row (cheap Arrow batches).
    """
    flag = needs_unicode_fallback(F.col(col))
    # one pass: the UDF only receives the text of flagged rows (NULL elsewhere)
    exact = _normalize_text_exact(F.when(flag, F.col(col)))
    return df.withColumn(out, F.when(flag, exact).otherwise(normalize_text(F.col(col))))


def stopword_array(stopwords=STOPWORDS) -> Column:
    return F.array(*[F.lit(w) for w in list(stopwords) + [""]])


def token_set(c: Column, stopwords=STOPWORDS, normalized: bool = False) -> Column:
    """Distinct words of the normalised text minus stopwords (first-seen order)."""
    n = c if normalized else normalize_text(c)
    return F.array_except(F.split(n, " "), stopword_array(stopwords))


def extract_abbreviations(c: Column) -> Column:
    """Codes in parentheses without spaces: ``x (CPC) y (a b)`` -> ``[CPC]``."""
    return F.regexp_extract_all(c, F.lit(ABBREVIATION_PATTERN), 1)


def expand_universe(df: DataFrame, col: str, constants=UNIVERSE_ABBREVIATIONS,
                    stopwords=STOPWORDS) -> DataFrame:
    """Names -> one row per normal form ``(norm, canon, tokens)``.

    Sources: each name, each code in parentheses inside a name, and the constant
    abbreviations. The display form ``canon`` is the smallest raw spelling of a normal
    form (the scored tool keeps an arbitrary one).
    """
    raw = df.select(F.col(col).cast("string").alias("canon")).filter(F.col("canon").isNotNull())
    names = normalize_text_df(raw, "canon", "norm").select("norm", "canon")
    abbrs = normalize_text_df(raw.select(F.explode(extract_abbreviations(F.col("canon"))).alias("canon")),
                              "canon", "norm").select("norm", "canon")
    spark = df.sparkSession
    consts = spark.createDataFrame([(a, a.upper()) for a in constants], "norm string, canon string")
    allrows = names.unionByName(abbrs).unionByName(consts).filter(F.col("norm") != "")
    return (allrows.groupBy("norm").agg(F.min("canon").alias("canon"))
            .withColumn("tokens", token_set(F.col("norm"), stopwords, normalized=True)))


def slug(c: Column) -> Column:
    """Non-alphanumerics to ``_``, trimmed of ``_``, ``unknown`` when empty."""
    s = F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def sheet_name(c: Column) -> Column:
    """Replace ``: \\ / ? * [ ]`` by ``_`` and cut to 31 characters."""
    return F.substring(F.regexp_replace(c.cast("string"), SHEET_NAME_PATTERN, "_"), 1, SHEET_NAME_MAX)


def repair_trailing_commas(c: Column) -> Column:
    """Remove a comma (and whitespace) right before ``]`` or ``}`` (not string-aware)."""
    return F.regexp_replace(c, f",{WS_CLASS}*(\\]|\\}})", "$1")


def coalesce_truthy(*cols: Column) -> Column:
    """First value that is neither NULL nor blank after stripping."""
    return F.coalesce(*[F.nullif(strip_ws(c.cast("string")), F.lit("")) for c in cols])


def coerce_numeric(c: Column) -> Column:
    """To double; anything unparsable becomes NULL (``pd.to_numeric(errors='coerce')``)."""
    return strip_ws(c.cast("string")).try_cast("double")
