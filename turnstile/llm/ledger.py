"""Quality rules as a bitmask ledger.

``measure`` reads every text once, ``ledger`` stores the measurements and one
failure bit per rule. Policies are versioned masks over these bits, so that a
new policy, or one without a given rule, needs no second look at the text:
``apply_policy`` is a bitwise test per row and ``ablations`` runs on the counts
of distinct bit patterns. Built from DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A named test over the measurements; ``fails`` is an SQL condition."""

    name: str
    fails: str


#: Bit i of a ledger belongs to rule i. Append only: stored ledgers keep their bits.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    Rule("capitals", "100 * n_capitals > 50 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    """Rows fail on any ``hard`` rule, or on more than ``slack`` of the ``soft`` ones."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    slack: int = 0


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = (
    BASE,
    Policy("v1", ("few_words", "repeated_windows", "symbols"), ("short_words", "long_words", "repeated_lines", "capitals"), 1),
    Policy("v2", ("few_words", "repeated_windows", "symbols", "capitals", "short_words", "long_words"), ("repeated_lines",), 0),
)


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in set(names))


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measurements of a text; null counts as empty and gives zeros.

    n_words and word_chars (code points) of the words, n_symbols, n_capitals,
    n_lines (lines with a word), n_dup_lines (such lines equal to an earlier
    one) and n_repeat_words (words in runs of three that occur twice or more in
    the text). Runs are compared by a 64-bit hash inside one text. Work per text
    is that of a sort. Input columns of these names are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")
    kept = [c for c in df.columns if c not in names]
    source = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(
        F.struct(*kept).alias("_row"),
        F.filter(F.split(source, GAP), lambda w: w != "").alias("_words"),
        F.filter(F.split(source, "\n"), lambda x: x.rlike(WORD)).alias("_lines"),
        F.length(F.translate(source, BLANKS, "")).alias("_chars"),
        (F.length(source) - F.length(F.translate(source, SYMBOLS, ""))).alias("_symbols"),
        (F.length(source) - F.length(F.translate(source, CAPITALS, ""))).alias("_capitals"),
    )
    words = F.col("_words")
    runs = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("run"), i.alias("at")),
    )
    rows = rows.withColumn("_runs", F.sort_array(runs))
    sorted_runs = F.col("_runs")
    twice = F.filter(
        sorted_runs,
        lambda r, i: r["run"].eqNullSafe(F.get(sorted_runs, i - 1)["run"])
        | r["run"].eqNullSafe(F.get(sorted_runs, i + 1)["run"]),
    )
    rows = rows.withColumn("_places", F.sort_array(F.transform(twice, lambda r: r["at"])))
    places = F.col("_places")
    gaps = F.transform(places, lambda p, i: F.least(F.lit(3), F.get(places, i + 1) - p))
    return rows.select(
        "_row.*",
        F.size("_words").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        F.col("_capitals").cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap).cast("long").alias("n_repeat_words"),
    )


def ledger(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Measurements and ``failure_bits``: bit i is set where rule i fails; all rules are evaluated once."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits + F.when(F.expr(rule.fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long"))
    return measure(df, text).withColumn("failure_bits", bits)


def passes(bits: Column, policy: Policy, rules: Sequence[Rule] = RULES, without: str | None = None) -> Column:
    """Whether failure bits satisfy a policy, optionally with one of its rules left out."""
    hard = mask([n for n in policy.hard if n != without], rules)
    soft = mask([n for n in policy.soft if n != without], rules)
    clean = bits.bitwiseAND(F.lit(hard).cast("long")) == 0
    return clean & (F.bit_count(bits.bitwiseAND(F.lit(soft).cast("long"))) <= policy.slack)


def apply_policy(rows: DataFrame, policy: Policy, column: str = "kept", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Adds the policy's verdict to a stored ledger; null bits count as no failure."""
    return rows.withColumn(column, passes(F.coalesce("failure_bits", F.lit(0).cast("long")), policy, rules))


def ablations(rows: DataFrame, policies: Sequence[Policy] = POLICIES, rules: Sequence[Rule] = RULES) -> DataFrame:
    """For each policy and each of its rules: rows, rows kept, rows kept without the rule.

    A ledger is first reduced to the counts of its bit patterns, at most two to
    the power of the number of rules; an empty ledger gives no rows.
    """
    patterns = rows.groupBy(F.coalesce("failure_bits", F.lit(0).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    cases = [
        F.struct(
            F.lit(p.version).alias("version"),
            F.lit(r).alias("rule"),
            passes(F.col("bits"), p, rules).alias("kept"),
            passes(F.col("bits"), p, rules, r).alias("kept_without"),
        )
        for p in policies
        for r in (*p.hard, *p.soft)
    ]
    return (
        patterns.select("n", F.explode(F.array(*cases)).alias("c"))
        .groupBy("c.version", "c.rule")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(F.col("c.kept"), F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when(F.col("c.kept_without"), F.col("n")).otherwise(0)).alias("n_kept_without"),
        )
    )
