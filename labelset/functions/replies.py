"""Salvaging label lists from free-text model replies, as column expressions.

A reply is turned into typed items ``array<struct<kpi, importancia, formula, metricas>>``
plus a validity flag and issue codes:

1. strip a Markdown code fence around the text (F6);
2. take the first balanced ``[...]`` (string- and escape-aware scan, F7);
3. parse it; a JSON array -> normalise its object elements (F10-F12);
4. otherwise salvage every top-level balanced ``{...}`` (F8) and normalise those;
5. cap the items when the condition is limited (O4) and render compact JSON (F15).

The two bracket scans (F7, F8) are Arrow UDFs; all else stays in the JVM. Objects are parsed into ``map<string, variant>``, which keeps
document key order and duplicate keys (later wins after key normalisation) and the JSON
kind of every value.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelset.functions.text import fold_accents, strip_ws

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
# Key aliases of a reply item (applied to keys folded to ASCII, lower-cased, stripped).
KEY_ALIASES: dict[str, str] = {
    "kpi": "kpi",
    "importancia": "importancia", "importância": "importancia",
    "formula": "formula", "fórmula": "formula",
    "metricas": "metricas", "métricas": "metricas", "metrica": "metricas", "métrica": "metricas",
}
ISSUE_ARRAY_PARSE_FAILED = "array_parse_failed"
ISSUE_EMPTY_ARRAY = "empty_array_after_normalize"
ISSUE_UNRECOVERABLE = "unrecoverable_objects"
LIST_SPLIT_PATTERN = r"[,\|;]+"
ITEM_FIELDS = ("kpi", "importancia", "formula", "metricas")
ITEM_TYPE = "struct<kpi:string,importancia:string,formula:string,metricas:array<string>>"
ITEMS_TYPE = f"array<{ITEM_TYPE}>"

#: JSON as the strict parsers read it: single-quoted strings are an error.
STRICT_JSON = {"allowSingleQuotes": "false"}

_NUMERIC_KINDS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _chars(s: Column) -> Column:
    return F.split(s, "")


def let(value: Column, body) -> Column:
    """Evaluate ``body(x)`` with ``x`` bound once to ``value``.

    Column helpers that use their input several times would otherwise copy the input's
    expression tree into every use; nested helpers would grow it exponentially.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# --- F6 ----------------------------------------------------------------------------------
def strip_fences(c: Column) -> Column:
    """Strip; when the text starts with a code fence, drop the opening fence (with its
    language tag and following whitespace) and a closing fence at the end; strip again."""
    def body(s):
        inner = F.regexp_replace(F.regexp_replace(s, r"^```[a-zA-Z0-9_+-]*\s*", ""), r"\s*```$", "")
        return F.when(s.startswith("```"), strip_ws(inner)).otherwise(s)

    return let(strip_ws(F.coalesce(c.cast("string"), F.lit(""))), body)


# --- F7 ----------------------------------------------------------------------------------
def _string_step(st: Column, c: Column) -> tuple[Column, Column]:
    """(in_string, escape) after reading ``c`` inside a JSON string."""
    return st["e"] | (c != F.lit('"')), ~st["e"] & (c == F.lit("\\"))


def _array_end(s: Column) -> Column:
    """1-based end offset of the first balanced ``[...]`` measured from the first ``[``,
    0 when it never closes."""
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("d"), F.lit(False).alias("q"),
                    F.lit(False).alias("e"), F.lit(0).alias("end"))

    def step(st, c):
        q_in, e_in = _string_step(st, c)
        inside = F.struct((st["i"] + 1).alias("i"), st["d"].alias("d"), q_in.alias("q"),
                          e_in.alias("e"), F.lit(0).alias("end"))
        delta = F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        outside = F.struct((st["i"] + 1).alias("i"), (st["d"] + delta).alias("d"),
                           (c == F.lit('"')).alias("q"), F.lit(False).alias("e"),
                           F.when((c == "]") & (st["d"] == 1), st["i"] + 1).otherwise(0).alias("end"))
        return F.when(st["end"] > 0, st).when(st["q"], inside).otherwise(outside)

    tail = F.substring(s, F.instr(s, "["), F.length(s) + 1)
    return F.aggregate(_chars(tail), init, step, lambda st: st["end"])


def extract_json_array_native(c: Column) -> Column:
    """Native-fold form of :func:`extract_json_array` (JVM only, slower per character).

    First balanced ``[...]`` of the fence-stripped text; the text itself when there is
    no ``[`` or the bracket never closes. Brackets inside JSON strings are ignored."""
    def body(s):
        start = F.instr(s, "[")
        return let(_array_end(s), lambda end: F.when(start == 0, s)
                   .when(end > 0, F.substring(s, start, end))
                   .otherwise(s))

    return let(strip_fences(strip_fences(c)), body)


# --- F8 ----------------------------------------------------------------------------------
def salvage_json_objects_native(c: Column) -> Column:
    """Native-fold form of :func:`salvage_json_objects`.

    Every top-level balanced ``{...}`` of the fence-stripped text, in order.

    A quote outside an object also toggles the string state (as the scanned tool does).
    """
    s = strip_fences(c)
    span_t = "array<struct<a:int,b:int>>"
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("d"), F.lit(False).alias("q"),
                    F.lit(False).alias("e"), F.lit(0).alias("st"),
                    F.array().cast(span_t).alias("spans"))

    def step(st, c):
        q_in, e_in = _string_step(st, c)
        inside = F.struct((st["i"] + 1).alias("i"), st["d"].alias("d"), q_in.alias("q"),
                          e_in.alias("e"), st["st"].alias("st"), st["spans"].alias("spans"))
        opens = c == "{"
        closes = (c == "}") & (st["d"] > 0)
        done = closes & (st["d"] == 1)
        outside = F.struct(
            (st["i"] + 1).alias("i"),
            (st["d"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("d"),
            (c == F.lit('"')).alias("q"), F.lit(False).alias("e"),
            F.when(opens & (st["d"] == 0), st["i"] + 1).when(done, 0).otherwise(st["st"]).alias("st"),
            F.when(done & (st["st"] > 0),
                   F.concat(st["spans"], F.array(F.struct(st["st"].alias("a"), (st["i"] + 1).alias("b")))))
            .otherwise(st["spans"]).alias("spans"))
        return F.when(st["q"], inside).otherwise(outside)

    def body(s):
        spans = F.aggregate(_chars(s), init, step, lambda st: st["spans"])
        return F.transform(spans, lambda p: F.substring(s, p["a"], p["b"] - p["a"] + 1))

    return let(s, body)


# --- F7 / F8 as Arrow UDFs -----------------------------------------------------------------
# A JSON string literal (possibly unterminated) or one bracket character.
_TOKENS_ARRAY = re.compile(r'"(?:\\.|[^"\\])*"?|[\[\]]', re.S)
_TOKENS_OBJECT = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.S)


def _first_array(s: str) -> str:
    start = s.find("[")
    if start < 0:
        return s
    depth = 0
    for m in _TOKENS_ARRAY.finditer(s, start):
        tok = m.group()
        if tok == "[":
            depth += 1
        elif tok == "]":
            depth -= 1
            if depth == 0:
                return s[start:m.end()]
    return s


def _top_objects(s: str) -> list[str]:
    spans, depth, begin = [], 0, -1
    for m in _TOKENS_OBJECT.finditer(s):
        tok = m.group()
        if tok == "{":
            if depth == 0:
                begin = m.start()
            depth += 1
        elif tok == "}" and depth > 0:
            depth -= 1
            if depth == 0:
                spans.append(s[begin:m.end()])
    return spans


@F.pandas_udf(T.StringType())
def _first_array_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _first_array(x) if isinstance(x, str) else "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _top_objects_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: _top_objects(x) if isinstance(x, str) else [])


def extract_json_array(c: Column) -> Column:
    """First balanced ``[...]`` of the fence-stripped text; the text itself when there is
    no ``[`` or the bracket never closes. Brackets inside JSON strings are ignored.

    The scan runs on Arrow batches (one pass per text, string literals skipped whole by a
    regex tokenizer); fence stripping stays native.
    """
    return _first_array_udf(strip_fences(strip_fences(c)))


def salvage_json_objects(c: Column) -> Column:
    """Every top-level balanced ``{...}`` of the fence-stripped text, in order (Arrow UDF
    scan). A quote outside an object also opens a string."""
    return _top_objects_udf(strip_fences(c))


# --- JSON values held as variants ----------------------------------------------------------
def kind(v: Column) -> Column:
    """JSON kind of a variant: STRING, BOOLEAN, NUMBER, ARRAY, OBJECT or NULL."""
    def body(k):
        return (F.when(k.isNull() | (k == "VOID"), F.lit("NULL"))
                .when(k == "STRING", F.lit("STRING"))
                .when(k == "BOOLEAN", F.lit("BOOLEAN"))
                .when(k.startswith("DECIMAL") | k.isin(*_NUMERIC_KINDS), F.lit("NUMBER"))
                .when(k.startswith("ARRAY"), F.lit("ARRAY"))
                .when(k.startswith("OBJECT"), F.lit("OBJECT"))
                .otherwise(F.lit("OTHER")))

    return let(F.schema_of_variant(v), body)


def py_str(v: Column) -> Column:
    """``str(value)`` of a JSON scalar as Python renders it (True/False for booleans)."""
    def body(x):
        k = kind(x)
        s = F.try_variant_get(x, "$", "string")
        return (F.when(k == "BOOLEAN", F.when(s == "true", F.lit("True")).otherwise(F.lit("False")))
                .when(k.isin("ARRAY", "OBJECT"), F.to_json(x))
                .otherwise(s))

    return let(v, body)


def truthy(v: Column) -> Column:
    """Python truthiness of a JSON value."""
    def body(x):
        return let(kind(x), lambda k: (
            F.when(k == "STRING", F.length(F.try_variant_get(x, "$", "string")) > 0)
            .when(k == "BOOLEAN", F.try_variant_get(x, "$", "string") == "true")
            .when(k == "NUMBER", F.try_variant_get(x, "$", "double") != 0)
            .when(k == "ARRAY", F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
            .when(k == "OBJECT", F.size(F.try_variant_get(x, "$", "map<string,variant>")) > 0)
            .otherwise(F.lit(False))))

    return let(v, body)


def parse_object(text: Column) -> Column:
    """JSON object text -> ``map<string, variant>`` in document order (NULL if not an
    object). Duplicate keys are kept."""
    return let(strip_ws(text), lambda t: F.when(t.startswith("{"), F.from_json(t, "map<string,variant>", STRICT_JSON)))


def entry_last(m: Column, key: str) -> Column:
    """Value of the last entry with exactly this key (Python dicts keep the last)."""
    return F.try_element_at(F.filter(F.map_entries(m), lambda e: e["key"] == F.lit(key)), F.lit(-1))["value"]


def get_ci(m: Column, key: str) -> Column:
    """Value of the first entry whose key equals ``key`` ignoring case (document order)."""
    hits = F.filter(F.map_entries(m), lambda e: F.lower(e["key"]) == F.lit(key.lower()))
    return F.try_element_at(hits, F.lit(1))["value"]


def first_truthy(values: list[Column]) -> Column:
    """``a or b or c``: the first truthy value (a variant) or NULL."""
    return F.coalesce(*[let(v, lambda x: F.when(truthy(x), x)) for v in values])


# --- F10 ---------------------------------------------------------------------------------
def normalize_key(k: Column) -> Column:
    """Fold accents, lower-case, strip, then map aliases."""
    amap = F.create_map(*[x for a, b in KEY_ALIASES.items() for x in (F.lit(a), F.lit(b))])
    return let(strip_ws(F.lower(fold_accents(k))), lambda k2: F.coalesce(F.try_element_at(amap, k2), k2))


# --- F11 ---------------------------------------------------------------------------------
def to_string_list(v: Column) -> Column:
    """Any JSON value -> list of strings: a list keeps its scalars (as str), a string is
    split on , | ; and stripped, NULL is empty, anything else is one element."""
    def body(x):
        elems = F.try_variant_get(x, "$", "array<variant>")
        from_list = F.transform(F.filter(elems, lambda e: kind(e).isin("STRING", "NUMBER", "BOOLEAN")),
                                lambda e: py_str(e))
        s = F.try_variant_get(x, "$", "string")
        from_str = F.filter(F.transform(F.split(s, LIST_SPLIT_PATTERN), lambda p: strip_ws(p)),
                            lambda p: p != "")
        return let(kind(x), lambda k: (F.when(k == "NULL", F.array().cast("array<string>"))
                                       .when(k == "ARRAY", from_list)
                                       .when(k == "STRING", from_str)
                                       .otherwise(F.array(py_str(x)))))

    return let(v, body)


# --- F12 ---------------------------------------------------------------------------------
def normalize_item(m: Column) -> Column:
    """Object map -> item struct (kpi, importancia, formula, metricas); kpi "" when absent.

    Keys are normalised; when several keys normalise alike the later one wins. Scalars are
    rendered as Python ``str`` would, falsy values as "".
    """
    def body(entries):
        def last(key: str) -> Column:
            return F.try_element_at(F.filter(entries, lambda e: e["key"] == F.lit(key)), F.lit(-1))["value"]

        def text(key: str) -> Column:
            return let(last(key), lambda v: F.when(truthy(v), strip_ws(py_str(v))).otherwise(F.lit("")))

        met = let(last("metricas"), lambda v: F.when(v.isNull(), F.array().cast("array<string>"))
                  .otherwise(to_string_list(v)))
        return F.struct(text("kpi").alias("kpi"), text("importancia").alias("importancia"),
                        text("formula").alias("formula"), met.alias("metricas"))

    entries = F.transform(F.map_entries(m), lambda e: F.struct(normalize_key(e["key"]).alias("key"),
                                                               e["value"].alias("value")))
    return let(entries, body)


def json_array_elements(text: Column) -> Column:
    """Elements of a JSON array text as ``struct<raw string, kind string>``; NULL when the
    text is not a JSON array. ``raw`` is the element's own text (strings unquoted)."""
    def guess(r: Column) -> Column:
        return (F.when(r.isNull(), F.lit("NULL")).when(strip_ws(r).startswith("{"), F.lit("OBJECT"))
                .when(strip_ws(r).startswith("["), F.lit("ARRAY")).otherwise(F.lit("STRING")))

    def body(t):
        raws = F.from_json(t, "array<string>", STRICT_JSON)
        kinds = F.transform(F.try_variant_get(F.try_parse_json(t), "$", "array<variant>"),
                            lambda e: kind(e))
        elems = let(kinds, lambda ks: F.transform(raws, lambda r, i: F.struct(
            r.alias("raw"), F.coalesce(F.try_element_at(ks, i + 1), guess(r)).alias("kind"))))
        return F.when(t.startswith("["), elems)

    return let(strip_ws(text), body)


def items_from_objects(texts: Column) -> Column:
    """Object texts -> normalised items with a non-empty kpi."""
    maps = F.transform(texts, lambda t: parse_object(t))
    items = F.transform(F.filter(maps, lambda m: m.isNotNull()), lambda m: normalize_item(m))
    return F.filter(items, lambda it: it["kpi"] != "")


# --- F13 ---------------------------------------------------------------------------------
def sanitize_reply(text: Column, limited: Column | None = None) -> Column:
    """Reply text -> ``struct<items, valid, issues, output>``.

    * a JSON array: its object elements with a kpi; none -> not valid,
      ``empty_array_after_normalize``;
    * otherwise ``array_parse_failed`` and every top-level object is salvaged; valid when
      one has a kpi, else also ``unrecoverable_objects``;
    * limited: the first 4 items (after validity is decided); ``output`` is compact JSON.
    """
    def body(st):
        elems = st["elems"]
        is_list = elems.isNotNull()
        obj_texts = F.transform(F.filter(elems, lambda e: e["kind"] == "OBJECT"), lambda e: e["raw"])
        list_items = items_from_objects(obj_texts)
        salvaged = items_from_objects(st["objs"])
        chosen = F.when(is_list, list_items).otherwise(salvaged)

        def on_items(items):
            valid = F.size(items) > 0
            issues = (F.when(is_list, F.when(valid, F.array()).otherwise(F.array(F.lit(ISSUE_EMPTY_ARRAY))))
                      .otherwise(F.when(valid, F.array(F.lit(ISSUE_ARRAY_PARSE_FAILED)))
                                 .otherwise(F.array(F.lit(ISSUE_ARRAY_PARSE_FAILED),
                                                    F.lit(ISSUE_UNRECOVERABLE))))).cast("array<string>")
            capped = items
            if limited is not None:
                capped = F.when(st["limited"] & (F.size(items) > 4), F.slice(items, 1, 4)).otherwise(items)
            return let(capped.cast(ITEMS_TYPE), lambda out: F.struct(
                out.alias("items"), valid.alias("valid"), issues.alias("issues"),
                F.to_json(out).alias("output")))

        return let(chosen, on_items)

    # the two scans are Python UDFs: evaluated outside any lambda
    bound = F.struct(json_array_elements(extract_json_array(text)).alias("elems"),
                     salvage_json_objects(text).alias("objs"),
                     (limited if limited is not None else F.lit(False)).alias("limited"))
    return let(bound, body)


# --- F16 ---------------------------------------------------------------------------------
NAME_KEYS = ("kpi", "nome", "metric", "name")
FIRST_ARRAY_PATTERN = r"\[[\s\S]*?\]"


def _name_of(m: Column) -> Column:
    """First truthy of kpi | nome | metric | name (case-insensitive keys); kept only when
    it is a string that is not blank, stripped."""
    def body(mm):
        return let(first_truthy([get_ci(mm, k) for k in NAME_KEYS]), lambda v: let(
            strip_ws(F.try_variant_get(v, "$", "string")),
            lambda s: F.when((kind(v) == "STRING") & (F.length(s) > 0), s)))

    return let(m, body)


def extract_items(parsed_items_json: Column, output: Column) -> Column:
    """Item names of a result record (``array<string>``).

    From ``parsed_items`` (a JSON array text) when it yields any name; otherwise from the
    first ``[...]`` of ``output`` found by a non-greedy regex (stops at the first ``]``),
    where bare strings are accepted too.
    """
    empty = F.array().cast("array<string>")

    def name_of_elem(e):
        return (F.when(e["kind"] == "OBJECT", _name_of(parse_object(e["raw"])))
                .when(e["kind"] == "STRING",
                      let(strip_ws(e["raw"]), lambda x: F.when(F.length(x) > 0, x))))

    def from_output(o):
        usable = o.isNotNull() & (F.length(strip_ws(o)) > 0)
        return let(F.regexp_extract(o, FIRST_ARRAY_PATTERN, 0), lambda match: F.coalesce(
            F.filter(F.transform(F.when(usable & (match != ""), json_array_elements(match)), name_of_elem),
                     lambda x: x.isNotNull()), empty))

    pe = json_array_elements(parsed_items_json)
    from_parsed = F.coalesce(F.filter(
        F.transform(F.filter(pe, lambda e: e["kind"] == "OBJECT"), lambda e: _name_of(parse_object(e["raw"]))),
        lambda x: x.isNotNull()), empty)
    return let(from_parsed, lambda fp: F.when(F.size(fp) > 0, fp).otherwise(
        let(output, lambda o: from_output(o))))


# --- names used by the blueprint ----------------------------------------------------------
def parse_strict(text: Column) -> Column:
    """the whole text as a JSON value (variant), NULL when it does not parse."""
    return F.try_parse_json(strip_ws(text))


def to_compact_json(items: Column) -> Column:
    """items as compact JSON (no spaces, non-ASCII kept)."""
    return F.to_json(items)


normalize_keys = normalize_key          # F10
normalize_items = items_from_objects    # F12: object texts -> items with a kpi


def sanitize_replies(df, text: str, limited: str | None = None, out: str = "reply"):
    """F13 on a DataFrame: adds ``out`` = struct<items, valid, issues, output>."""
    lim = F.col(limited) if limited else None
    return df.withColumn(out, sanitize_reply(F.col(text), lim))
