"""Quality rules as a bitmask ledger.

Every rule is evaluated once; a document's row keeps the measurements and one bit a failed rule.  Policies are
versioned bit masks over that ledger, so a new policy, or an ablation of one, never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words`` alone; a null ``doc_id`` is passed on;
repeated rows each get their own row; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.text import NOT_SPACE, U64, Words, by_document, chunks, mix, small_batches, utf8

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters"]
#: (rule, when it fails), in the order of the bits.  Every condition is SQL that Spark and others read alike.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_words", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("shouting", "n_letters >= 100 and 10 * n_upper > 6 * n_letters"),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
#: Version -> rules that reject.
POLICIES = {
    "base": ["few_words", "repeated_words"],
    "v1": [name for name, _ in RULES],
    "v2-no-shouting": [name for name, _ in RULES if name != "shouting"],
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DOC = U64(0x9FB21C651E98DF25)


def _twice(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    s = np.sort(keys)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(again, keys)
    return again[np.minimum(at, len(again) - 1)] == keys


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of a chunk of texts."""
    n = len(offsets) - 1
    w = Words(data, offsets, NOT_SPACE, lower=False)
    head = (data & 0xC0) != 0x80
    heads = np.concatenate([[0], np.cumsum(head)])
    out = {"n_words": w.count, "word_chars": by_document(heads[w.end] - heads[w.start], w.first), "n_symbols": by_document(_SYMBOL[data], offsets)}
    out["n_upper"] = by_document((data >= 65) & (data <= 90), offsets)
    out["n_letters"] = out["n_upper"] + by_document((data >= 97) & (data <= 122), offsets)

    word, doc = np.arange(len(w.hash)), np.repeat(np.arange(n), w.count)
    window = np.flatnonzero(word + 5 <= np.repeat(w.first[1:], w.count))
    cover = np.zeros(len(word) + 6, np.int64)
    if len(window):
        again = window[_twice(mix(w.runs(5)[window] + doc[window].astype(np.uint64) * _DOC))]
        np.add.at(cover, again, 1)
        np.add.at(cover, again + 5, -1)
    out["n_repeat_words"] = by_document((np.cumsum(cover) > 0)[: len(word)], w.first)

    breaks = np.flatnonzero(data == 10)
    start = np.union1d(offsets[:-1], breaks + 1)
    start = start[start < len(data)]
    end = np.minimum(np.append(start[1:], len(data)), len(data))
    end = end - ((end > start) & (data[end - 1] == 10)) if len(end) else end
    words = np.searchsorted(w.start, end) - np.searchsorted(w.start, start)
    start, end = start[words > 0], end[words > 0]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    key = mix(w.span_hash(start, end) + line_doc.astype(np.uint64) * _DOC)
    first = np.zeros(len(key), bool)
    first[np.unique(key, return_index=True)[1]] = True
    out["n_dup_lines"] = np.bincount(line_doc[~first], minlength=n)
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets)]
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate([p[m] for p in parts]), pa.int64()) for m in MEASURES)], ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements, and ``failures``: one bit for each of RULES that the document fails."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"case when {cond} then {BITS[name]} else 0 end" for name, cond in RULES)
    return rows.withColumn("failures", F.expr(f"cast({bits} as long)"))


def mask(rules: list[str]) -> int:
    """The bits of the named rules."""
    return sum(BITS[r] for r in rules)


def passes(policy: str, failures: str | Column = "failures") -> Column:
    """True for documents that fail none of the policy's rules."""
    return F.col(failures).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0 if isinstance(failures, str) else failures.bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    Documents are first counted by their failure bits, at most two to the number of rules many patterns.
    """
    names, whole = POLICIES[policy], mask(POLICIES[policy])
    patterns = rows.groupBy("failures").agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in names))
    each = patterns.select("failures", "n", F.explode(rules).alias("r")).select("n", "r.rule", "r.bit", F.col("failures").bitwiseAND(F.lit(whole)).alias("bad"))
    fails = F.col("bad").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bad") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bad").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
