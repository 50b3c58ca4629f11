"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

A document has the values of RULES (symbols, repeated lines, repeated words, letters in capitals: all in percent). For
each rule and stratum (language), labelled good documents test every cutoff of GRID: the exact binomial tail
P(Bin(n, risk) <= k) of k good documents above the cutoff among n is the p-value of "it rejects more than `risk` of
the good ones". Holm's correction over all cutoffs, rules and strata keeps the chance that any chosen cutoff breaks
its promise at `delta`. The lowest cutoff that passes is used; a rule without one isn't used. The risk is parted
evenly among the rules, so that all rules together reject at most `risk` of a stratum's good documents.

With `in_sequence` the cutoffs of a rule and stratum are tested from the loosest down to the first that fails. The 19
cutoffs then share one level, delta / (rules x strata), by Bonferroni's inequality over rules and strata: the same
promise from fewer labels (`least_labels`). `uncertified` lists the strata and rules that still have no cutoff.

Null texts have no words and fail the base rules. Null strata are one stratum. Labels that name no document, or whose
quality is null, don't count; a document labelled twice counts twice. Repeated rows keep a row each; an empty table
gives an empty result; without labels only the base rules act. Extra columns are dropped by `judge` and kept by
`keep`. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ._store import fresh, written

RULES = ("symbols", "dup_lines", "repeats", "capitals")
GRID = (1, 2, 3, 4, 5, 6, 8, 10, 12, 15, 20, 25, 30, 40, 50, 60, 70, 80, 90)
RISK, DELTA = 0.01, 0.05
#: Repeated windows up to which a text's windows are looked up in a list; with more they are sorted with their places.
FEW = 24
_PART = "[\\x20\\x09-\\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = F.filter(F.split("t", _PART), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(F.translate(x, _SPACES, " ")) != "")
    hashes = F.when(F.size("w") >= 3, F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    # hashes found twice or more
    again = let(F.sort_array("h"), lambda s: F.array_distinct(F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1)))))
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("again", x), i).otherwise(F.lit(-1))), lambda p: p >= 0)
    many = let(
        F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("p")))),
        lambda s: F.sort_array(F.transform(F.filter(F.transform(s, lambda x, i: F.struct(x["p"].alias("p"), ((x["h"] == F.get(s, i + 1)["h"]) | F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False))).alias("d"))), lambda y: y["d"]), lambda y: y["p"])),
    )
    places = F.when(F.size("again") == 0, F.array().cast("array<int>")).when(F.size("again") <= FEW, few).otherwise(many)
    covered = F.aggregate(F.transform("places", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("places", i + 1) - x, F.lit(3)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), text.alias("t"))
    out = out.select("id", "stratum", "t", words.alias("w"), lines.alias("l"))
    counts = {
        "n_words": F.size("w"), "word_chars": F.length(F.translate("t", _SPACES, "")), "n_symbols": F.length("t") - F.length(F.translate("t", "#*$%&|<>", "")),
        "n_lines": F.size("l"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l")), "n_capitals": F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "")),
    }
    out = out.select("id", "stratum", *(c.cast("bigint").alias(k) for k, c in counts.items()), hashes.alias("h"))
    out = out.withColumn("again", again).withColumn("places", places)
    return out.select("id", "stratum", *counts, covered.alias("n_repeat_words"))


def values() -> dict[str, Column]:
    """The rules' values in whole percent."""
    share = lambda a, b: F.when(F.col(b) > 0, F.expr(f"cast(100 * {a} div {b} as bigint)")).otherwise(F.lit(0).cast("bigint"))
    return dict(zip(RULES, (share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"), share("n_capitals", "word_chars")), strict=True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed from its terms' logarithms; 1 without looking when k is above the mean."""
    import math

    odds = math.log(p) - math.log1p(-p)
    start = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))
    step = lambda a, i: let(a["log"] + F.log((n - i + 1) / i) + odds, lambda x: F.struct(x.alias("log"), (a["sum"] + F.exp(x)).alias("sum")))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(terms, start, step, lambda a: a["sum"]))


def cutoffs(feats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, grid: tuple[int, ...] = GRID, id_col: str = "doc_id", quality_col: str = "quality", in_sequence: bool = False) -> DataFrame:
    """(stratum, rule, cutoff): the lowest cutoff of each rule and stratum that Holm's test, or the test in sequence, passes."""
    good = labels.where(F.col(quality_col) == 1).select(F.col(id_col).alias("id"))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), v.alias("v")) for r, v in values().items())))
    held = feats.where(~base_failed()).join(good, "id").select("stratum", each.alias("x")).select("stratum", "x.*")
    tests = held.groupBy("stratum", "rule").agg(F.count("v").alias("n"), *(F.count_if(F.col("v") > c).alias(f"c{c}") for c in grid))
    tests = tests.select("stratum", "rule", "n", F.explode(F.array(*(F.struct(F.lit(c).cast("bigint").alias("cutoff"), F.col(f"c{c}").alias("k")) for c in grid))).alias("x")).select("stratum", "rule", "n", "x.*")
    tests = tests.withColumn("p", binomial_tail(F.col("k"), F.col("n"), risk / len(RULES)))
    if in_sequence:
        down = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
        tests = tests.withColumn("bad", (F.col("p") > F.lit(delta) * len(grid) / F.count("p").over(Window.partitionBy())).cast("int"))
        return tests.withColumn("stop", F.max("bad").over(down)).where("stop = 0").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    # Holm: from the least p on, all pass until one is above delta / (tests left); the table has a row per test
    order = Window.orderBy("p", "stratum", "rule", "cutoff")
    tests = tests.withColumn("bad", (F.col("p") > F.lit(delta) / (F.count("p").over(Window.partitionBy()) - F.row_number().over(order) + 1)).cast("int"))
    passed = tests.withColumn("stop", F.max("bad").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("stop = 0")
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def least_labels(strata: int, risk: float = RISK, delta: float = DELTA, in_sequence: bool = False) -> int:
    """The good labels that a stratum needs before a cutoff that rejects none of them can be chosen first."""
    import math

    tests = strata * len(RULES) * (1 if in_sequence else len(GRID))
    return math.ceil(math.log(delta / tests) / math.log1p(-risk / len(RULES)))


def uncertified(feats: DataFrame, chosen: DataFrame) -> DataFrame:
    """(stratum, rule): of `features`, those without a cutoff in `chosen`; there the rule rejects nothing."""
    every = feats.select("stratum").distinct().select("stratum", F.explode(F.array(*map(F.lit, RULES))).alias("rule"))
    return every.join(chosen, ["stratum", "rule"], "left_anti")


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", in_sequence: bool = False) -> DataFrame:
    """(id_col, the counts, base_failed, failed_rules, kept) of every document."""
    feats = written(features(docs, id_col, text_col, stratum_col), "features")
    chosen = cutoffs(feats, labels, risk, delta, id_col=id_col, in_sequence=in_sequence).groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))
    df = feats.join(chosen, "stratum", "left")
    failed = F.array_compact(F.array(*(F.when(v > F.col(f"cut_{r}"), F.lit(r)) for r, v in values().items())))
    df = df.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return df.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **more) -> DataFrame:
    """The documents that pass, with all their columns. Rows that share an id stay only if all of them pass; rows without an id go."""
    verdict = judge(docs, labels, id_col=id_col, **more)
    name = fresh(docs.columns, "bad_id")
    bad = verdict.where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return docs.where(F.col(id_col).isNotNull()).join(bad, F.col(id_col) == F.col(name), "left_anti")
