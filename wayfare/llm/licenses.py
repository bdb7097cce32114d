"""Licence scan with column functions only.

Texts are counted in words where they are; only those with a word of a licence in them are normalised and tried
against the rules, each rule only if its keyword is there.  Places are counted in words.  A detection gives way to
one that contains its interval and has a higher priority, or the same priority and a longer interval (ties: the
earlier rule).  Detections are resolved by a window over the detections of one document, in order of place.

``score`` is the best evidence left: 1, 0.9, 0.7 and 0.5 for priorities 4 to 1, and 0.5 for a base phrase.

Defined results: a null or empty text has no words, no labels and score 0; null keys and repeated rows each give
their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.license_rules import BASE, rules

_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every rule and base phrase needs one of these; a superset test on the text as it is.
_HINT = r"(?i)licen[cs]e|spdx|permission|redistribution|unencumbered|domain|cc[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+by|creative|released|distributed|available|published|provided|authorization"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCORES = {1: 0.5, 2: 0.7, 3: 0.9, 4: 1.0}


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _spans(text: Column, r: Column) -> Column:
    """The matches of a rule: words in the part of the text before each (``gap``), and in the match itself (``n``)."""
    parts, found = F.split(text, r["pattern"], -1), F.regexp_extract_all(text, r["pattern"], F.lit(0))
    spans = F.when(F.size(found) > 0, F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(_spaces(p).alias("gap"), _spaces(m).alias("n")))).otherwise(F.array())
    return F.transform(spans, lambda s, k: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["priority"].alias("priority"), k.alias("k"), s["gap"].alias("gap"), s["n"].alias("n")))


def _detections(text: Column) -> Column:
    """All matches in a normalised text: of base phrases (rule -1, -2, ...) and of the rules whose keyword is there."""
    table = [(k, label, p, word, rx) for k, (label, p, word, rx) in enumerate(rules())]
    table = [(-1 - k, label, 0, f" {phrase}", f" {phrase}(?= )") for k, (label, phrase) in enumerate(BASE)] + table
    names = ("rule", "label", "priority", "pattern")
    by: dict[str, list[Column]] = {}  # each keyword is looked for once, whatever the number of its rules
    for rule, label, priority, keyword, pattern in table:
        by.setdefault(keyword, []).append(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, (rule, label, priority, pattern)))))
    groups = F.array(*(F.struct(F.lit(k).alias("keyword"), F.array(*rows).alias("rules")) for k, rows in by.items()))
    tried = F.flatten(F.transform(F.filter(groups, lambda g: F.contains(text, g["keyword"])), lambda g: g["rules"]))
    return F.flatten(F.transform(tried, lambda r: _spans(text, r)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(_WORD)).cast("long")).withColumn("hinted", F.col("text").rlike(_HINT))
    none = F.lit("")
    plain = rows.where("not hinted").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), none.alias("base_labels"), none.alias("labels"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_detections"))

    normal = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate("text", _UP, _LOW), _GAP, " ")), F.lit(" "))
    hits = rows.where("hinted").select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", normal.alias("text"))
    hits = hits.select("row", "doc_id", "n_words", F.explode_outer(_detections(F.col("text"))).alias("hit")).select("row", "doc_id", "n_words", "hit.*").repartition("row")
    upto = Window.partitionBy("row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(upto)).withColumn("start", F.col("end") - F.col("n"))
    before = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in SCORES:
        reach = F.max(F.when(F.col("priority") >= level, F.col("end"))).over(before)
        covered = covered | ((F.col("priority") == level) & (F.coalesce(reach, F.lit(-1)) >= F.col("end")))
    kept = hits.withColumn("base", F.col("rule") < 0).withColumn("left", ~F.col("base") & ~covered)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    prior = F.element_at(F.create_map(*(F.lit(x) for kv in SCORES.items() for x in kv)), F.col("priority"))
    found = kept.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.when(F.col("base") | F.col("left"), F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(F.col("left"), prior).when(F.col("base"), F.lit(0.5))), F.lit(0.0)).alias("score"),
        F.count(F.when(F.col("left"), 1)).alias("n_detections"),
    )
    return plain.unionByName(found.drop("row"))
