"""Stages of text scoring that each add one struct to a text, and metrics of sentences.

A stage is an expression over the lower-cased text `low`; any list of stages runs in one pass. The term lists are
parameters with the defaults below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.metrics import matched

# The terms of the stages.
VARIABLES = {
    "G": ["grace", "mercy", "restore", "redemption", "forgive", "draw", "attract"], "M": ["will", "repentance", "moral", "alignment", "choice", "conversion", "decision"],
    "E": ["truth", "evidence", "source", "measure", "citation", "data", "observation"], "S": ["entropy", "judgment", "decay", "consequence", "collapse", "disorder", "heat"],
    "T": ["time", "kairos", "sequence", "history", "threshold", "epoch", "timeline"], "K": ["knowledge", "information", "logos", "signal", "model", "channel", "encoding"],
    "R": ["relationship", "family", "covenant", "binding", "community", "love", "neighbor"], "Q": ["quantum", "faith", "observer", "measurement", "uncertainty", "collapse", "wave"],
    "F": ["force", "action", "motion", "momentum", "conservation", "moral force"], "C": ["coherence", "christ", "integration", "shalom", "kingdom", "unity", "wholeness"],
}
DOMAINS = {
    "physics": ["physics", "quantum", "field", "entropy", "relativity", "gravity", "mass", "energy"], "theology": ["god", "christ", "jesus", "spirit", "grace", "sin", "salvation", "scripture", "logos"],
    "epistemology": ["truth", "knowledge", "ground", "regress", "assumption", "falsifiability", "method"], "formal_math": ["equation", "theorem", "proof", "lean", "operator", "function", "variable", "axiom"],
    "information": ["information", "signal", "noise", "channel", "shannon", "compression", "encoding"], "ethics": ["good", "evil", "justice", "ought", "virtue", "responsibility", "accountability"],
    "psychology": ["behavior", "emotion", "anxiety", "habit", "trauma", "identity", "willpower"], "sociology": ["society", "institution", "culture", "community", "family", "civilization"],
    "history": ["historical", "century", "document", "record", "timeline", "era", "period"],
}
JUSTICE = ["accountability", "consequence", "judgment", "restitution", "boundary", "violation", "debt", "responsibility", "sentence", "penalty", "punishment", "standard"]
MERCY = ["grace", "mercy", "forgiveness", "patience", "restoration", "reconciliation", "repair", "compassion", "dignity", "healing", "redemption", "second chance"]
COST = ["pay", "cost", "absorb", "bear", "carry", "sacrifice", "restitution", "atone", "repair", "compensate", "substitute", "mediator", "voluntary", "cross", "price"]
COERCION = ["force", "coerce", "dominate", "manipulate", "scapegoat", "blame", "externalize", "displace", "demand", "compel"]
EVIDENCE = ["source", "citation", "data", "study", "measurement", "observed", "figure", "table", "peer-reviewed", "replication", "statistical", "sample", "empirical"]
OVERCLAIM = ["proves", "undeniable", "impossible", "always", "never", "every", "no one can deny", "without exception", "absolute", "definitively"]


def found(terms: list[str]) -> Column:
    """How many different terms are in `low`."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains("low", t)))


def composition(terms: dict[str, list[str]], other: str) -> Column:
    """(primary, shares): the key with the most terms, the first of equals, and all keys' shares in percent."""
    raw = F.array(*(found(ts) for ts in terms.values()))
    let = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    names = F.array(*map(F.lit, terms))

    def shares(r: Column) -> Column:
        total = F.aggregate(r, F.lit(0), lambda a, x: a + x)
        primary = F.when(total > 0, F.element_at(names, F.array_position(r, F.array_max(r)).cast("int"))).otherwise(other)
        return F.struct(primary.alias("primary"), F.transform(r, lambda x: F.when(total > 0, F.round(100 * x / total, 1)).otherwise(round(100 / len(terms), 1))).alias("shares"))

    return let(raw, shares)


def justice() -> Column:
    """(justice, mercy, cost, coercion, coherence, diagnosis)."""
    let = lambda v, f: F.get(F.transform(F.array(v), f), F.lit(0))
    scores = F.struct(*(F.least(F.lit(100), found(ts) * k).alias(n) for n, ts, k in (("j", JUSTICE, 12), ("m", MERCY, 12), ("c", COST, 14), ("x", COERCION, 16))))

    def judged(s: Column) -> Column:
        j, m, c, x = (s[n] for n in "jmcx")
        diagnosis = (
            F.when((j > 60) & (m < 20), "terminal justice").when((m > 60) & (j < 20), "false mercy").when((j > 40) & (m > 40) & (c < 15), "no cost-bearer")
            .when((j > 40) & (m > 40) & (c > 30), "coherent").when(x > 40, "coercive").otherwise("low signal")
        )
        return F.struct(j.alias("justice"), m.alias("mercy"), c.alias("cost"), x.alias("coercion"), F.greatest(F.lit(0), F.least(F.lit(100), F.least(j, m) + c - x)).alias("coherence"), diagnosis.alias("diagnosis"))

    return let(scores, judged)


def evidence() -> Column:
    """(evidence, overclaim, balance, risk)."""
    ev, oc = F.least(F.lit(100), found(EVIDENCE) * 12), F.least(F.lit(100), found(OVERCLAIM) * 18)
    return F.struct(ev.alias("evidence"), oc.alias("overclaim"), F.greatest(F.lit(0), ev - oc).alias("balance"), F.when(oc > ev + 20, "high").when(oc > ev, "medium").otherwise("low").alias("risk"))


STAGES: dict[str, Callable[[], Column]] = {
    "variables": lambda: composition(VARIABLES, "UC"), "domains": lambda: composition(DOMAINS, "unknown"), "justice": justice, "evidence": evidence,
}


def run(docs: DataFrame, names: list[str], stages: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(doc_id, one struct for each stage, stages): the named stages in order, in one pass over the texts."""
    stages = stages or STAGES
    low = docs.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", *(stages[n]().alias(n) for n in names), F.lit(",".join(names)).alias("stages"))


def claims(kinds: DataFrame) -> DataFrame:
    """(doc_id, n, what, how, why, mixed): mean shares of a document's claims (doc_id, what, how, why), scaled to 100; a null doc_id for all."""
    top = F.greatest("what", "how", "why")
    sums = kinds.rollup("doc_id").agg(F.count("*").alias("n"), *(F.avg(k).alias(k) for k in ("what", "how", "why")), F.count_if(top < 60).alias("mixed"))
    total = F.col("what") + F.col("how") + F.col("why")
    return sums.select("doc_id", "n", *(F.round(100 * F.col(k) / total, 3).alias(k) for k in ("what", "how", "why")), "mixed")


def stage_records(files: DataFrame, claims_: DataFrame, names: list[str]) -> DataFrame:
    """(label, source_type, stages, one struct for each stage) of texts of files (path, text), and of raw claims (label, text)."""
    both = files.select(F.col("path").alias("label"), F.lit("file").alias("source_type"), "text").unionByName(claims_.select("label", F.lit("claim").alias("source_type"), "text"))
    return run(both.select(F.struct("label", "source_type").alias("doc_id"), "text"), names).select("doc_id.*", "stages", *names)


def batch_report(records: DataFrame, verdicts: dict[str, str]) -> DataFrame:
    """(source_type, stage, verdict, n, share) of stage records; verdicts names the field of each stage that is counted."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("stage"), F.col(f"{k}.{f}").cast("string").alias("verdict")) for k, f in verdicts.items())))
    counts = records.select("source_type", each.alias("x")).groupBy("source_type", "x.stage", "x.verdict").agg(F.count("*").alias("n"))
    total = records.groupBy("source_type").agg(F.count("*").alias("total"))
    return counts.join(total, "source_type").select("source_type", "stage", "verdict", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


# What a hit of each category is worth, and the diagnoses in order.
SCALES = {"justice": 12, "mercy": 12, "cost_bearer": 14, "coercion": 16, "evidence": 12, "overclaim": 18, "positive": 12, "negative": 12}
NEUTRAL = "neutral -- insufficient signal to diagnose"


def profiled(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, profile, the eight scores of SCALES, coherence, ratio, balance, evidence_ratio, diagnosis) of texts under each profile of a lexicon (profile, category, term).

    A word counts once for a text, a phrase with a blank each time; scores end at 100. Texts without a hit have a row
    for each profile too.
    """
    uses = lexicon.select("profile", "category", F.lower("term").alias("term"))
    places = matched(docs.select("doc_id", F.lit(0).alias("nth"), F.col("text").alias("sentence")), uses.select("term"))
    counts = places.groupBy("doc_id", "term").agg(F.count("*").alias("n")).withColumn("n", F.when(F.contains("term", F.lit(" ")), F.col("n")).otherwise(1))
    raw = counts.join(uses, "term").groupBy("doc_id", "profile").pivot("category", list(SCALES)).agg(F.sum("n"))
    every = docs.select("doc_id").distinct().withColumn("profile", F.explode(F.lit([r.profile for r in uses.select("profile").distinct().orderBy("profile").limit(1000).collect()])))
    df = every.join(raw, ["doc_id", "profile"], "left").select("doc_id", "profile", *(F.least(F.lit(100), F.coalesce(F.col(k), F.lit(0)) * v).cast("int").alias(k) for k, v in SCALES.items()))
    j, m, c, x, ev, oc, pos, neg = map(F.col, SCALES)
    rules = [
        ((j > 50) & (m < 15), "terminal justice -- mercy absent"), ((m > 50) & (j < 15), "false mercy -- justice absent"), ((j > 30) & (m > 30) & (c < 10), "contradiction -- both demanded, no payer"), ((j > 30) & (m > 30) & (c > 25), "resolution path present"),
        (x > 40, "coercion pressure detected"), ((c > 40) & (m < 10), "cost language without restoration target"), (oc > ev + 15, "overclaim exceeds evidence"), (ev > oc + 20, "evidence-grounded"), (neg > pos + 20, "negative signal dominant"), (pos > neg + 20, "positive signal dominant"),
        ((j < 10) & (m < 10), "low moral signal overall"),
    ]
    signals = F.array_compact(F.array(*(F.when(test, name) for test, name in rules)))
    return df.withColumns({
        "coherence": F.greatest(F.lit(0), F.least(F.lit(100), F.least(j, m) + c - x)), "ratio": F.round(j / F.greatest(F.lit(1), m), 2), "balance": j - m, "evidence_ratio": F.round(ev / F.greatest(F.lit(1), oc), 2),
        "diagnosis": F.when(F.size(signals) == 0, F.array(F.lit(NEUTRAL))).otherwise(signals),
    })


def compared(rows: DataFrame, profiles: list[str]) -> DataFrame:
    """(doc_id, <profile>_coherence .., best, spread): each text's coherence under the profiles side by side, the profile with the most, the first of equals, and how far they are apart."""
    wide = rows.groupBy("doc_id").pivot("profile", profiles).agg(F.first("coherence"))
    top = F.greatest(*profiles)
    best = F.lit(profiles[-1])
    for p in profiles[-2::-1]:
        best = F.when(F.col(p) == top, p).otherwise(best)
    return wide.select("doc_id", *(F.col(p).alias(f"{p}_coherence") for p in profiles), best.alias("best"), (top - F.least(*profiles)).alias("spread"))
