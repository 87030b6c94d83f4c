"""Quality rules learned as a decision list: sequential covering over statistics, emitted as Spark conditionals.

A rule is a conjunction of thresholds on statistics that says a document is bad. Rules grow condition by condition on
two thirds of the labelled statistics, are pruned on the rest, and are taken in order while they stay precise; the rows
a rule covers leave the sample before the next is grown. The list ends in a default: keep.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.llm.text_stats import COUNTS, counts, shares
from vectile.session import cut

TRAIN_ROWS = 20_000  # labelled rows the list is learned from, drawn by a hash of the id
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbol_share", "bar_share", "mark_share", "upper_share", "digit_share", "dup_line_share", "repeat_share", "distinct_share", "top_share", "mean_word")
FEATURES = ("n_words", "n_dup_lines", *SHARES)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool  # value >= bound, else value < bound
    bound: float

    def column(self) -> Column:
        return F.col(self.name) >= F.lit(self.bound) if self.above else F.col(self.name) < F.lit(self.bound)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.name] >= self.bound if self.above else x[self.name] < self.bound


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, shares) of every whole text; a null text has no words. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                _, c = counts(part.column("text"))
                s = shares(c)
                yield pa.RecordBatch.from_pydict(
                    {"id": part.column("id")} | {k: pa.array(c[k], pa.int64()) for k in COUNTS} | {k: pa.array(s[k], pa.float64()) for k in SHARES}
                )

    schema = [f"id {rows.schema['id'].dataType.simpleString()}", *(f"{c} bigint" for c in COUNTS), *(f"{c} double" for c in SHARES)]
    return rows.mapInArrow(run, ", ".join(schema)).withColumnRenamed("id", id_col)


def learn_list(
    x: dict[str, np.ndarray], bad: np.ndarray, *, precision: float = 0.97, support: int = 20, max_rules: int = 12,
    max_conditions: int = 4, seed: int = 0,
) -> list[Rule]:
    """Ordered rules from labelled statistics.

    A rule is taken if, on the rows held back for pruning, at least ``precision`` of what it covers is bad, and over
    all rows it covers ``support`` or more; the first one that fails ends the list. No rows, or none bad: no rule.
    """
    held = np.random.default_rng(seed).random(len(bad)) < 1 / 3
    left = np.ones(len(bad), dtype=bool)
    out: list[Rule] = []
    while len(out) < max_rules:
        grow, prune = left & ~held, left & held
        if bad[grow].sum() < support // 2:
            break
        rule = _pruned(_grown(x, bad, grow, max_conditions), x, bad, prune)
        if not rule:
            break
        on = np.logical_and.reduce([c.holds(x) for c in rule])
        seen, wrong = (on & prune).sum(), (on & prune & ~bad).sum()
        if (on & left).sum() < support or seen == 0 or wrong > (1 - precision) * seen or (on & left & ~bad).sum() > (1 - precision) * (on & left).sum():
            break
        out.append(rule)
        left &= ~on
    return out


def _grown(x, bad, rows, max_conditions) -> Rule:
    """Add the condition of highest information gain until only bad rows are covered."""
    on, rule = rows.copy(), []
    while len(rule) < max_conditions and (on & ~bad).any():
        p, n = (on & bad).sum(), (on & ~bad).sum()
        old, best = np.log2(p / (p + n)), (0.0, None)
        for name in FEATURES:
            v, good = x[name][on], ~bad[on]
            order = np.argsort(v, kind="stable")
            v, good = v[order], good[order]
            cuts = np.flatnonzero(np.diff(v) > 0) + 1  # a threshold lies halfway between different values
            if not len(cuts):
                continue
            below_n = np.cumsum(good)[cuts - 1]
            below_p = cuts - below_n
            for above, pp, nn in ((True, p - below_p, n - below_n), (False, below_p, below_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - old), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (gain[k], Condition(name, above, float((v[cuts[k] - 1] + v[cuts[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        on &= best[1].holds(x)
    return tuple(rule)


def _pruned(rule: Rule, x, bad, rows) -> Rule:
    """Drop final conditions while (bad - good) / covered on the rows held back doesn't fall."""
    def worth(r: Rule) -> float:
        on = rows & np.logical_and.reduce([c.holds(x) for c in r])
        return (on & bad).sum() / on.sum() * 2 - 1 if on.any() else -1.0

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def as_column(rules: list[Rule]) -> Column:
    """Index of the first rule that holds as an ordered conditional, null where none does."""
    out = None
    for k, rule in enumerate(rules):
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(None).cast("int") if out is None else out


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    train_rows: int = TRAIN_ROWS, **options,
) -> tuple[DataFrame, list[Rule]]:
    """(a row per document with its statistics, base_failed, rule, kept; the rules).

    base_failed: under 10 words, or over a fifth of the words repeat (``n_repeat_words``); such rows teach nothing.
    kept: false if base_failed or a learned rule holds. Labels: 0 is bad; several for an id count as their least, null
    ones not at all; of an id's rows the one with the least statistics teaches. Without labels the list is empty. Equal rows are judged alike and each kept.
    """
    stats = cut(statistics(docs, id_col=id_col, text_col=text_col)).withColumnRenamed(id_col, "id")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = stats.withColumn("base_failed", failed)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    drawn = known.orderBy(F.xxhash64("id"), "id").limit(train_rows)  # train_rows rows, small enough to send everywhere
    taught = stats.where(~F.col("base_failed")).join(F.broadcast(drawn), "id")
    taught = taught.groupBy("id").agg(F.min(F.struct("label", *FEATURES)).alias("x")).select("x.*")  # one row an id, the least
    rows = taught.toPandas()
    x = {c: rows[c].to_numpy(dtype=float) for c in FEATURES}
    rules = learn_list(x, rows["label"].to_numpy() == 0, **options)
    judged = stats.withColumn("rule", as_column(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return judged.withColumnRenamed("id", id_col), rules
