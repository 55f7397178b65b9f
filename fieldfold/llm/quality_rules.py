"""Quality rules: a learned decision list over statistics of each text, as ordered Spark conditions.

Sequential covering: a rule (a conjunction of thresholds) is grown on two thirds of the labelled rows by
information gain, pruned on the other third, and kept while it is precise; the rows that it covers are then
taken away and the next one is grown. What comes out is a list of (conditions, verdict) that anyone can read
and that runs as one CASE expression; statistics and verdict use built-in functions only.

Defined cases: a null text has no words; a null label or a label without a document isn't used for training;
with no usable labels, or labels of one class, the list is empty and only the base rule decides; repeated
documents each get their own row, and count once in training (the text of least hash where texts differ); columns beyond doc_id and text are ignored by `judge` and kept by
`keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, space_words, text_of

#: Most labelled documents that the driver fits on; the sample is the ids of least hash, so it is the same each time.
MAX_LABELLED = 20_000
#: The least share of rejected rows that must be bad on the pruning rows.
MIN_PRECISION = 0.97

FEATURES = ("chars_a_word", "symbols_a_word", "dup_line_share", "repeat_share", "shouts_a_word", "exclaims_a_word", "digits_a_word", "words_a_line", "same_next_share")


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that stand twice or more in the text."""

    def places(grams: Column) -> Column:
        ranked = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
        return F.sort_array(F.transform(let(ranked, same), lambda x: x.i))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.lit(5), F.coalesce(F.get(at, j + 1) - p, F.lit(5))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def of_grams(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(places(grams), covered))

    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 4, F.lit(0))), lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, 5))))
    return let(grams, of_grams).cast("long")


def statistics(text: Column) -> Column:
    """The statistics of a text as one struct, so that no rewrite of the plan computes them twice."""
    line_words = "[^\\x20\\x09-\\x0D]"

    def of(w: Column, lines: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.regexp_count(text, F.lit("[A-Z]{2,}")).cast("long").alias("n_shouts"),
            F.regexp_count(text, F.lit("!+")).cast("long").alias("n_exclaims"),
            F.regexp_count(text, F.lit("[0-9]+")).cast("long").alias("n_digits"),
            F.size(F.filter(w, lambda x, i: x == F.get(w, i + 1))).cast("long").alias("n_same_next"),
        )

    return let(space_words(text), lambda w: let(F.filter(F.split(text, "\n"), lambda x: x.rlike(line_words)), lambda lines: of(w, lines)))


def features(s: Column) -> dict[str, Column]:
    c = lambda name: s[name].cast("double")
    n, lines = F.greatest(c("n_words"), F.lit(1.0)), F.greatest(c("n_lines"), F.lit(1.0))
    return {
        "chars_a_word": c("word_chars") / n, "symbols_a_word": c("n_symbols") / n, "dup_line_share": c("n_dup_lines") / lines,
        "repeat_share": c("n_repeat_words") / n, "shouts_a_word": c("n_shouts") / n, "exclaims_a_word": c("n_exclaims") / n,
        "digits_a_word": c("n_digits") / n, "words_a_line": n / lines, "same_next_share": c("n_same_next") / n,
    }


def base_failed(s: Column) -> Column:
    return (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.threshold if self.above else of[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Rules in order: the first that holds rejects; with none, the text is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, s: Column) -> Column:
        of, out = features(s), None
        for rule in self.rules:
            holds = rule[0].column(of)
            for c in rule[1:]:
                holds = holds & c.column(of)
            out = F.when(holds, True) if out is None else out.when(holds, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) or "keep all"


def _covers(x: np.ndarray, rule: list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        v = x[:, FEATURES.index(c.feature)]
        out &= v > c.threshold if c.above else v <= c.threshold
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int = 4) -> list[Condition]:
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < most and (~bad & inside).any():
        p0, n0 = (bad & inside).sum(), inside.sum()
        best = (1e-9, None, None)
        for j, name in enumerate(FEATURES):
            v = np.unique(x[inside, j])
            if len(v) < 2:
                continue
            cuts = v[np.unique(np.linspace(0, len(v) - 2, 96).astype(int))]
            cuts = (cuts + v[np.searchsorted(v, cuts) + 1]) / 2
            order = np.argsort(x[inside, j], kind="stable")
            vs, ys = x[inside, j][order], np.concatenate([[0], np.cumsum(bad[inside][order])])
            k = np.searchsorted(vs, cuts, side="right")
            for above, n, p in ((False, k, ys[k]), (True, n0 - k, p0 - ys[k])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, above, float(cuts[i])), None)
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers(x, rule[-1:])
    return rule


def _prune(x: np.ndarray, bad: np.ndarray, rule: list[Condition]) -> list[Condition]:
    def worth(r):
        c = _covers(x, r)
        p, n = (c & bad).sum(), (c & ~bad).sum()
        return (p - n) / max(p + n, 1)

    while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
        rule = rule[:-1]
    return rule


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7, most_rules: int = 12) -> DecisionList:
    """The decision list for statistics x (rows by FEATURES) and labels bad."""
    out, part = DecisionList(), np.random.default_rng(seed).random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    for _ in range(most_rules):
        g, p = left & part, left & ~part
        if (bad & g).sum() < 3 or not (~bad & g).any():
            break
        rule = _prune(x[p], bad[p], _grow(x[g], bad[g]))
        if not rule:
            break
        held, seen = _covers(x[p], rule), _covers(x[left], rule)
        hits = (held & bad[p]).sum()
        if hits < MIN_PRECISION * held.sum() or (seen & bad[left]).sum() < max(3, MIN_PRECISION * seen.sum()):
            break
        out.rules.append(rule)
        left &= ~_covers(x, rule)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns from at most max_labelled labelled documents that pass the base rule."""
    sample = (labels.select(F.col("doc_id"), F.col("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    s = let(statistics(text_of()), lambda s: F.struct(base_failed(s).alias("base"), F.array(*features(s).values()).alias("x")))
    # of rows that share a labelled id the text of least hash is taken, so that no more rows are gathered than were sampled
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64(text_of())).alias("text"))
    rows = texts.select((F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("h"), s.alias("s"))
    got = [(r.h, r.s.x, r.bad) for r in rows.collect() if not r.s.base]
    if not got:
        return DecisionList()
    got.sort()
    bad = np.array([r[2] for r in got])
    return learn(np.array([r[1] for r in got], float), bad) if bad.any() and not bad.all() else DecisionList()


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept, and the number of the rule that rejected (else null)."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = let(statistics(text_of()), lambda s: F.struct(*(s[n].alias(n) for n in names), base_failed(s).alias("base_failed"), (~base_failed(s) & ~rules.rejects(s)).alias("kept")))
    return docs.select("doc_id", out.alias("s")).select("doc_id", "s.*")


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The documents that neither the base rule nor the list rejects, with all their columns."""
    return docs.where(let(statistics(text_of()), lambda s: ~base_failed(s) & ~rules.rejects(s)))
