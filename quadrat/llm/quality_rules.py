"""Quality rules as a bitmask ledger (native).

``ledger`` evaluates every rule once: it keeps each rule's measurement and one ``fail_bits`` long (bit i: rule i failed).
Policies are versioned sets of rules, applied later with one bitwise AND; ``ablation`` counts, in a single aggregation
over the bits, what each rule of a policy removes in all and what it alone removes.

Defined results: a null or blank text has no words, so it fails ``few_words``; a repeated row is measured for itself;
an empty table gives an empty ledger and one ablation row per rule with zeros; columns besides id and text are passed over.
Two different five-word windows are taken as equal only if 64-bit hashes of one document collide (about 1e-11 for a
text of 20,000 words).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm import common as C

SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """fails: over the measured columns. bit: its place in fail_bits; a bit is never given to another rule."""

    name: str
    bit: int
    fails: Callable[[], Column]


#: Ratios are in integers, so that no rounding moves a document over a limit.
RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 10),
    Rule("repeated_windows", 1, lambda: 100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    Rule("symbol_share", 2, lambda: 100 * F.col("n_symbols") > 30 * F.col("n_words")),
    Rule("repeated_lines", 3, lambda: 100 * F.col("n_dup_lines") > 60 * F.col("n_lines")),
    Rule("word_length", 4, lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 25 * F.col("n_words"))),
    Rule("shouting", 5, lambda: 100 * F.col("n_exclamations") > 60 * F.col("n_words")),
)

#: Policies by version. "base" is the contract's; later ones add rules and never change an earlier one.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "2024-1": ("few_words", "repeated_windows", "symbol_share"),
    "2024-2": ("few_words", "repeated_windows", "symbol_share", "repeated_lines", "word_length", "shouting"),
}
CURRENT = "2024-2"


def mask(policy: str) -> int:
    bits = {r.name: r.bit for r in RULES}
    return sum(1 << bits[name] for name in POLICIES[policy])


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the array, the first one included."""

    def covered(grams: Column) -> Column:
        def over(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (F.try_element_at(s, k + 2)["h"] == x["h"]) | ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])

        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(C.let(placed, over))

    def grams(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))

    return C.let(words, lambda w: F.when(F.size(w) <= window, F.lit(0)).otherwise(C.let(grams(w), covered))).cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, fail_bits: a row for each row of docs. A narrow plan: one scan, no shuffle."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(C.SPACE)) != "")
    of_words = C.let(C.words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = C.let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text")).select(
        id_col,
        of_words.alias("_w"),
        of_lines.alias("_l"),
        (F.length(text) - C.count_of(text, C.SPACE)).cast("long").alias("word_chars"),
        C.count_of(text, SYMBOLS).alias("n_symbols"),
        C.count_of(text, "!").alias("n_exclamations"),
    )
    out = out.select(id_col, "_w.n_words", "word_chars", "n_symbols", "_l.n_dup_lines", "_w.n_repeat_words", "_l.n_lines", "n_exclamations")
    bits = [F.when(r.fails(), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in RULES]
    fail = bits[0]
    for b in bits[1:]:
        fail = fail.bitwiseOR(b)
    return out.withColumn("fail_bits", fail)


def failed(policy: str) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) != 0


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A row for each rule of the policy: documents it fails, those that it alone fails, and those that still fail without it."""
    m = mask(policy)
    left = F.col("fail_bits").bitwiseAND(F.lit(m))
    rules = [r for r in RULES if r.name in POLICIES[policy]]
    aggs = [F.count_if(left != 0).alias("_all"), F.count(F.lit(1)).alias("_n")]
    for r in rules:
        aggs += [F.count_if(left.bitwiseAND(F.lit(1 << r.bit)) != 0).alias(f"_f{r.bit}"), F.count_if(left == (1 << r.bit)).alias(f"_o{r.bit}")]
    one = entries.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.col(f"_f{r.bit}").alias("n_failed"), F.col(f"_o{r.bit}").alias("n_only"), (F.col("_all") - F.col(f"_o{r.bit}")).alias("n_removed_without"), F.col("_n").alias("n_docs")) for r in rules])
    return one.select(F.lit(policy).alias("policy"), F.inline(rows))


def judge(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under the policy."""
    return entries.withColumn("base_failed", failed("base")).withColumn("kept", ~failed("base") & ~failed(policy))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(ledger(C.table(spark, sf_dir, "documents")))
