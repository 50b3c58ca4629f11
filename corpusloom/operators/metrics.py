"""Metrics of sentences by a lexicon: spans, strength, support and counter-signals, symptoms, repairs and routing.

The lexicon is a table (collection, term, weight, polarity, danger), the metrics a table (metric, family, object, role,
collection) with the roles `term`, `support` and `counter`. All terms are found in one pass over a sentence by an
automaton that each task builds; the rest is joins and sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weights of danger levels, polarities that count as counter, words of a text, and thresholds.
DANGER = {"low": 1.0, "medium": 1.15, "high": 1.35, "critical": 1.65}
WORDS = r"[A-Za-z][A-Za-z0-9_\-']+|[χΧΩΣΘΛΨΦ]\w*"
QUALIFIERS = [(85, "dominant"), (65, "strong"), (35, "moderate"), (10, "weak")]
REPAIRS = ["No immediate repair required; preserve and compare to rivals.", "Add clearer terms, evidence spans, or downgrade this label.", "Split claim or add boundary language before promoting."]
PRESSURE = " Counter-signal pressure is high; inspect contradiction or mixed category."
#: Terms that fit in one automaton; more are refused.
MOST_TERMS = 1_000_000


def matched(units: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, nth, term, start, end) of units (doc_id, nth, sentence): every place of the terms, upper and lower case alike, `term` in lower case.

    A term without a blank must be a whole word, one with a blank may begin or end inside words; a term's own places
    don't overlap.
    """
    names = [r.term for r in terms.select(F.lower("term").alias("term")).where("term <> ''").distinct().limit(MOST_TERMS + 1).collect()]
    if len(names) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    shared = units.sparkSession.sparkContext.broadcast(sorted(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        machine = ahocorasick.Automaton()
        for i, w in enumerate(words):
            machine.add_word(w, i)
        if words:
            machine.make_automaton()
        for batch in batches:
            rows, which, starts = [], [], []
            for row, text in enumerate(batch.column("low").to_pylist()):
                last: dict[int, int] = {}
                n = len(text or "")
                inside = lambda i: 0 <= i < n and (text[i].isalnum() or text[i] == "_")  # noqa: B023, E731
                for at, i in machine.iter(text) if words and n else ():
                    end = at + 1
                    start = end - len(words[i])
                    if start < last.get(i, 0) or (" " not in words[i] and (inside(start - 1) == inside(start) or inside(end - 1) == inside(end))):
                        continue
                    last[i] = end
                    rows.append(row)
                    which.append(i)
                    starts.append(start)
            at = pa.array(rows, pa.int64())
            found = pa.array([words[i] for i in which], pa.string())
            ends = pa.array([s + len(words[i]) for s, i in zip(starts, which, strict=True)], pa.int32())
            yield pa.record_batch([batch.column("doc_id").take(at), batch.column("nth").take(at), found, pa.array(starts, pa.int32()), ends], ["doc_id", "nth", "term", "start", "end"])

    kinds = dict(units.dtypes)
    return units.select("doc_id", "nth", F.lower("sentence").alias("low")).mapInArrow(run, f"doc_id {kinds['doc_id']}, nth {kinds['nth']}, term string, start int, end int")


def measured(units: DataFrame, lexicon: DataFrame, specs: DataFrame, spans: int = 5) -> DataFrame:
    """A row for each unit and metric with a hit or a score of 10 or more.

    (doc_id, nth, metric, family, hits, weighted, terms, density, support, counter, score, confidence, qualifier,
    evidence_support, boundary_support, symptom, severity, repair, route, spans); spans are the first few places, each
    (start, end, term, contribution).
    """
    lexicon = lexicon.select(F.lower("term").alias("term"), "collection", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.lower(F.coalesce("danger", F.lit("low"))).alias("danger"))
    modifier = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DANGER.items() for x in kv)), F.col("danger")), F.lit(1.0))
    uses = lexicon.join(specs, "collection").select("term", "metric", "family", "object", "role", (F.greatest(F.lit(0.25), F.col("weight")) * modifier).alias("contribution"))
    places = matched(units, lexicon.select("term"))
    hits = places.join(uses, "term")
    is_ = lambda role: F.col("role") == role
    many = lambda role: F.countDistinct(F.when(is_(role), F.col("term")))
    sums = hits.groupBy("doc_id", "nth", "metric", "family", "object").agg(
        F.count_if(is_("term")).alias("hits"), F.round(F.coalesce(F.sum(F.when(is_("term"), F.col("contribution"))), F.lit(0.0)), 9).alias("weighted"), many("term").alias("terms"),
        F.least(F.lit(100.0), many("support") * 14).alias("support"), F.least(F.lit(100.0), many("counter") * 16).alias("counter"),
    )
    words = units.select("doc_id", "nth", F.greatest(F.lit(1), F.regexp_count("sentence", F.lit(WORDS))).alias("words"))
    # to hundredths, halves up; a little more, so that the order of a sum doesn't show
    pct = lambda v: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)) * 100 + 0.5 + 1e-7) / 100
    df = sums.join(words, ["doc_id", "nth"]).withColumn("density", 1000 * F.col("weighted") / F.col("words"))
    df = df.withColumn("score", pct(0.35 * F.least(F.lit(100.0), F.col("weighted") * 12) + 0.20 * F.least(F.lit(100.0), F.col("density") * 10) + 0.20 * F.col("support") + F.when(F.col("hits") > 0, 15.0).otherwise(0.0) - 0.20 * F.col("counter")))
    df = df.withColumn("confidence", pct(0.55 * F.col("score") + 0.25 * F.least(F.lit(100), F.col("terms") * 20) + 0.20 * (100 - F.col("counter")))).where("hits > 0 or score >= 10")
    s, counter = F.col("score"), F.col("counter")
    qualifier = F.lit("absent")
    for least, name in reversed(QUALIFIERS):
        qualifier = F.when(s >= least, name).otherwise(qualifier)
    symptom = F.concat(F.when(s < 10, "No meaningful signal detected.").otherwise(F.concat("object", F.lit(" signal is "), qualifier, F.lit(" at sentence level."))), F.when(counter > 40, PRESSURE).otherwise(""))
    df = df.withColumns({
        "qualifier": qualifier, "symptom": symptom, "severity": F.when(counter > 60, "high").when((s < 35) & (F.col("hits") > 0), "medium").otherwise("low"),
        "repair": F.when(counter > 40, REPAIRS[2]).when(s < 35, REPAIRS[1]).otherwise(REPAIRS[0]), "route": (s >= 70) | (counter >= 50) | ((s >= 45) & (F.col("confidence") < 55)),
        "evidence_support": F.when(F.col("family").isin("evidence", "domain", "law"), F.col("support")).otherwise(0.0), "boundary_support": F.when(F.contains("metric", F.lit("boundary")), F.col("support")).otherwise(0.0),
        "weighted": F.round("weighted", 4), "density": F.round(F.round("density", 9), 4),
    })
    nth = F.row_number().over(Window.partitionBy("doc_id", "nth", "metric").orderBy("start", "end", "term", "contribution"))
    first = hits.where(is_("term")).withColumn("place", nth).where(F.col("place") <= spans).groupBy("doc_id", "nth", "metric").agg(F.array_sort(F.collect_list(F.struct("start", "end", "term", F.round("contribution", 4).alias("contribution")))).alias("spans"))
    columns = ["doc_id", "nth", "metric", "family", "hits", "weighted", "terms", "density", "support", "counter", "score", "confidence", "qualifier", "evidence_support", "boundary_support", "symptom", "severity", "repair", "route"]
    return df.join(first, ["doc_id", "nth", "metric"], "left").select(*columns, "spans")


def report(scored: DataFrame, units: int = 300, most: int = 100, reasons: int = 10) -> DataFrame:
    """(doc_id, n, top, deep_audit, reasons): of each document's first units the number of results, its best ones in order, whether it needs a second look, and why.

    A second look is due if a result is routed, has a counter-signal over 50, or scores 70 or more; the reasons are the
    different symptoms of the first few such results (limits of a report).
    """
    risky = F.col("route") | (F.col("counter") > 50)
    first = scored.where(F.col("nth") < units).withColumn("risky", risky)
    by = Window.partitionBy("doc_id")
    ranked = first.withColumns({"place": F.row_number().over(by.orderBy(F.desc("score"), F.desc("confidence"), "nth", "metric")), "turn": F.row_number().over(by.orderBy(F.desc("risky"), "nth", "metric"))})
    best = F.array_sort(F.collect_list(F.when(F.col("place") <= most, F.struct("place", "metric", "nth"))))
    why = F.array_sort(F.collect_set(F.when(F.col("risky") & (F.col("turn") <= reasons), F.col("symptom"))))
    return ranked.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(best, lambda x: F.concat_ws("@", x["metric"], x["nth"].cast("string"))), ",").alias("top"),
        (F.bool_or("risky") | (F.max("score") >= 70)).alias("deep_audit"), F.array_join(why, "|").alias("reasons"),
    )
