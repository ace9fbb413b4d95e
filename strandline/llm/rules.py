"""Quality rules: an ordered list of threshold conjunctions learned from labelled text statistics.

Statistics are counted over whole texts. Rules are learned by sequential covering:
each rule is grown conjunct by conjunct on two thirds of the labelled rows, pruned
on the other third, and what it covers is set aside before the next rule. The list
becomes one Spark conditional expression, which anyone can read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from strandline.llm.common import documents, fresh, labelled_sample, python_tasks, remainder_is

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
PLAIN_MARKS = b".,;:'\"?()-"
ODD_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in PLAIN_MARKS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_echoes", "n_lines", "n_upper", "n_digits", "n_odd_marks"]
#: Labelled rows of each class that a list is learned from.
FIT_ROWS = 4000


def text_statistics(raw: bytes) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` of one text in UTF-8. An echo is a word equal to the one before it."""
    words = raw.split()
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(words)
    word_chars = len(raw) - int(per_byte[0x80:0xC0].sum()) - int(per_byte[list(SPACES)].sum())
    seen, repeated, n_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            n_lines += 1
            if line in seen:
                repeated += 1
            else:
                seen.add(line)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    return (n, word_chars, int(per_byte[list(SYMBOLS)].sum()), repeated, _repeat_words(ids, len(numbers)),
            int((ids[1:] == ids[:-1]).sum()), n_lines, int(per_byte[65:91].sum()), int(per_byte[48:58].sum()),
            int(per_byte[list(ODD_MARKS)].sum()))


def _repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a window of three words which the text has at least twice."""
    if len(ids) < 4:
        return 0
    pairs, base = ids[:-1] * distinct + ids[1:], distinct
    if distinct > 2_000_000:  # the triples would not fit 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    triples = pairs[:-1] * base + ids[2:]
    ordered = np.sort(triples)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    found = np.isin(triples, twice)
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= found
    return int(covered.sum())


_COUNT_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])


@arrow_udf(_COUNT_TYPE)
def count_texts(texts: pa.Array) -> pa.Array:
    rows = np.array([text_statistics(raw) for raw in documents(texts)], np.int64).reshape(-1, len(COUNTS))
    return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(COUNTS))], COUNTS)


def _ratio(counts: Column, part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(counts[part].cast("double"), counts[whole].cast("double")), F.lit(0.0))


#: What the rules may test, as (numerator, denominator) of counts. None of them drifts with the length of a text,
#: as the share of distinct words does: long clean documents would fall to it.
FEATURES = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "word_chars"),
    "repeated_line_share": ("n_dup_lines", "n_lines"),
    "repeated_word_share": ("n_repeat_words", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "digit_share": ("n_digits", "word_chars"),
    "odd_mark_share": ("n_odd_marks", "word_chars"),
}


def features(counts: Column) -> dict[str, Column]:
    return {name: _ratio(counts, *parts) for name, parts in FEATURES.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        value = values[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.4g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a document that meets all conditions of one is rejected, others are kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def rejects(self, values: dict[str, Column]) -> Column:
        """The list as one ordered conditional expression."""
        out = None
        for rule in self.rules:
            met = F.lit(True)
            for condition in rule:
                met = met & condition.column(values)
            out = F.when(met, True) if out is None else out.when(met, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules) + "\nelse keep"


def _best_condition(values, bad, inside) -> tuple[Condition | None, float]:
    """The condition with the largest information gain (FOIL) among the rows inside the rule so far."""
    p0, n0 = float((inside & bad).sum()), float((inside & ~bad).sum())
    base = np.log2(p0 / (p0 + n0))
    best, most = None, 0.0
    for name in sorted(values):
        v = values[name][inside]
        order = np.argsort(v, kind="stable")
        v, b = v[order], bad[inside][order]
        cut = np.flatnonzero(v[1:] > v[:-1])  # between two different values
        if not len(cut):
            continue
        p_low, all_low = np.cumsum(b)[cut].astype(float), (cut + 1).astype(float)
        middle = (v[cut] + v[cut + 1]) / 2
        for above, p, t in ((False, p_low, all_low), (True, p0 - p_low, p0 + n0 - all_low)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / t) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > most + 1e-12:
                best, most = Condition(name, above, float(middle[k])), float(gain[k])
    return best, most


def learn(values: dict[str, np.ndarray], bad: np.ndarray, draw: np.ndarray, max_rules: int = 16,
          max_conditions: int = 4, least_precision: float = 0.8) -> DecisionList:
    """Sequential covering over labelled rows.

    ``draw`` in [0, 1) sends a row to the growing (under 2/3) or the pruning set. A
    rule that is right for less than ``least_precision`` of what it covers in the
    pruning set, or covers nothing there, ends the list. Without rows of both
    classes the list is empty and keeps everything.
    """
    growing, left, rules = draw < 2 / 3, np.ones(len(bad), bool), []
    while len(rules) < max_rules:
        grow, prune = left & growing, left & ~growing
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        rule, inside = [], grow.copy()
        while len(rule) < max_conditions and (inside & ~bad).any():
            condition, _ = _best_condition(values, bad, inside)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(values)
        worth, kept = -2.0, 0
        covered = prune.copy()
        for k, condition in enumerate(rule, 1):
            covered = covered & condition.holds(values)
            p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
            value = (p - n) / (p + n) if p + n else -1.0
            if value > worth + 1e-9:
                worth, kept = value, k
        if not kept or worth < 2 * least_precision - 1:
            break
        rule = tuple(rule[:kept])
        met = left.copy()
        for condition in rule:
            met &= condition.holds(values)
        rules.append(rule)
        left &= ~met
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DecisionList:
    """Learn a list from at most about ``fit_rows`` labelled documents of each class.

    Rows whose crc32 of the key leaves 2 when divided by 4 are never learned from.
    Only statistics of the sample reach the driver, not texts. Keys may be of any type
    that has an order and a hash; rows with a null key are not learned from.
    """
    python_tasks(docs.sparkSession)
    sample = labelled_sample(docs, labels, "quality", fit_rows, ~remainder_is(F.col("doc_id"), 4, 2))
    counts = sample.select("doc_id", "quality", count_texts("text").alias("counts"))
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    rows = (counts.select("doc_id", F.col("quality").cast("int").alias("quality"),
                          (F.col("doc_id").cast("long") if whole else F.xxhash64("doc_id")).alias("number"),
                          *[v.alias(name) for name, v in features(F.col("counts")).items()])
            .toPandas().sort_values(["doc_id", "quality"], ignore_index=True))
    values = {name: rows[name].to_numpy(float) for name in FEATURES}
    draw = (rows["number"].to_numpy(np.int64).astype(np.uint64) * np.uint64(11400714819323198485) >> np.uint64(40)) / 2.0**24
    return learn(values, (rows["quality"] != 1).to_numpy(bool), draw)


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """``docs`` with the counts of the text, ``base_failed`` and ``kept``.

    A null text counts as empty, and fails by its length. Columns of ``docs`` that
    bear the name of a result are replaced by it.
    """
    python_tasks(docs.sparkSession)
    [counts] = fresh(docs, "counts")
    counted = docs.withColumn(counts, count_texts("text"))
    n_words, repeated = F.col(counts)["n_words"], F.col(counts)["n_repeat_words"]
    failed = (n_words < 50) | (100 * repeated > 50 * n_words)
    out = counted.withColumns({c: F.col(counts)[c] for c in COUNTS} | {
        "base_failed": failed, "kept": ~failed & ~rules.rejects(features(F.col(counts)))})
    return out.drop(counts)


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that pass, with the columns they had."""
    python_tasks(docs.sparkSession)
    [counts] = fresh(docs, "counts")
    counted = docs.withColumn(counts, count_texts("text"))
    n_words, repeated = F.col(counts)["n_words"], F.col(counts)["n_repeat_words"]
    failed = (n_words < 50) | (100 * repeated > 50 * n_words)
    return counted.where(~failed & ~rules.rejects(features(F.col(counts)))).drop(counts)
