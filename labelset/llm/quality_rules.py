"""Rule bitmask ledger for document quality (DataFrame functions only).

``measure`` computes every measurement of a text once, ``ledger`` turns the measurements into
one failure bit per rule, ``apply_policy`` keeps the rows that fail none of a policy's rules
and ``ablation`` counts, from the bits alone, what each rule rejects by itself.

Defined results: null text counts as empty (no words, so ``too_few_words`` fails); equal rows
are measured independently; texts have no length limit; an empty table gives an empty ledger;
other columns are carried unless a measurement has the same name, which it then replaces.

3-word windows are compared by 64 hash bits, sorted with their positions: two windows of a text
of a million words collide with a chance below 1e-7 per text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Rules in bit order: name, failing condition over the measurements.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    ("capitals", "10 * n_capitals > 5 * word_chars"),
    ("exclamations", "10 * n_exclamations > 3 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: A policy is the set of rules that reject; versions stay as they are once published.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("too_few_words", "repeated_words"),
    "web-1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines"),
    "web-2": tuple(BITS),
}
CURRENT_POLICY = "web-2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_capitals", "n_exclamations")


def policy_mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def _windows(hashes: Column) -> Column:
    """Struct (``h``, ``at``) of hash and position per 3-word window."""
    def one(x: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(x, F.get(hashes, i + 1), F.get(hashes, i + 2)).alias("h"), i.cast("long").alias("at"))

    return F.transform(F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - 2, F.lit(0))), one)


def _repeated_positions(win: Column) -> Column:
    """Sorted positions of the windows whose hash occurs twice or more (``win`` is sorted)."""
    def twin(w: Column, i: Column) -> Column:
        same = lambda o: w["h"] == o["h"]  # noqa: E731 - null past either end
        return same(F.get(win, i - 1)) | same(F.get(win, i + 1))

    return F.sort_array(F.transform(F.filter(win, twin), lambda w: w["at"]))


def _covered(pos: Column, width: int) -> Column:
    """Number of places covered by windows of ``width`` at the sorted positions."""
    steps = F.transform(pos, lambda p, i: F.least(F.lit(width).cast("long"), F.coalesce(F.get(pos, i + 1) - p, F.lit(width).cast("long"))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns MEASURES, each a long."""
    row = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    body = F.col("_text")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    d = row.withColumns({"_words": F.filter(F.split(body, WORD_BREAK), lambda w: w != ""), "_lines": lines})
    d = d.withColumns({
        "n_words": long(F.size("_words")),
        "word_chars": long(F.char_length(F.array_join("_words", ""))),
        "n_symbols": long(F.regexp_count(body, F.lit(r"[#*$%&|<>]"))),
        "n_lines": long(F.size("_lines")),
        "n_dup_lines": long(F.size("_lines") - F.size(F.array_distinct("_lines"))),
        "n_capitals": long(F.regexp_count(body, F.lit("[A-ZÀ-ÖØ-Þ]"))),
        "n_exclamations": long(F.char_length(body) - F.char_length(F.replace(body, F.lit("!"), F.lit("")))),
        "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
    })
    d = d.withColumn("_win", F.sort_array(_windows(F.col("_hashes"))))
    d = d.withColumn("_pos", _repeated_positions(F.col("_win")))
    d = d.withColumn("n_repeat_words", _covered(F.col("_pos"), 3))
    # the generator keeps filters on measurements above it: pushed below, the optimiser would inline
    # the arrays into the lambdas over them and compute them again for every element
    kept = [c for c in docs.columns if c not in MEASURES]
    own = [F.col("_row").getField(c).alias(c) for c in kept]
    return d.select("_row", F.explode(F.array(F.struct(*MEASURES))).alias("_m")).select(*own, "_m.*")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its measurements and ``failures``, a long with one bit per failed rule."""
    bits = [F.when(F.expr(cond), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, cond) in enumerate(RULES)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return measure(docs, text).withColumn("failures", out)


def passes(policy: str = CURRENT_POLICY) -> Column:
    return F.col("failures").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0


def apply_policy(led: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """Rows of a ledger that fail no rule of the policy."""
    return led.where(passes(policy))


def ablation(led: DataFrame, policy: str = CURRENT_POLICY) -> DataFrame:
    """Per rule of the policy: rows that fail it, rows that only it rejects, rows kept without it.

    The ledger is first reduced to one row per distinct bitmask (at most 2**len(RULES)).
    """
    mask = policy_mask(policy)
    masks = led.groupBy(F.col("failures").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = masks.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    return each.groupBy("rule").agg(count(hit).alias("n_failed"), count(hit & (rest == 0)).alias("n_only"),
                                    count(rest == 0).alias("n_kept_without"))
