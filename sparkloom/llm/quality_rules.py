"""Quality rules: decision lists learned by sequential covering.

Statistics of each text are DataFrame expressions. ``learn_rules`` finds rules
that describe rejected documents, on labelled statistics: a rule grows one
threshold condition at a time, by information gain on two thirds of the
sample; it is pruned on the last third to the leading conditions that tell
best; rows that it covers are taken out, and the next rule grows. A rule that
isn't precise enough is dropped, and the next grows from another statistic.
Thresholds lie between quantiles of either label by itself, so that a fault
that few texts have can be told too. Each step is one Spark aggregation to
counts by statistic, threshold interval, label and part; only these few hundred
counts reach the driver. The rules become one ordered ``when ... otherwise``
expression.

The sample's bound is ``per_class`` documents of each label. Rules apply to
every row and need no shuffle; of the statistics only those that the learned
rules name are computed there.

Windows of three words are compared by a 64-bit hash within one text.

Defined cases: null and empty texts have no words and zero statistics, and
fail the base rule; without labels of both kinds, no rules are learned and
only the base rule rejects; a threshold is met or not by equal values alike;
repeated rows are judged alike; an empty table gives no rows; other columns
pass through ``keep_good`` whatever their names.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import SPACE_CLASS, checkpointed
from sparkloom.llm.labelled import document_labels, sampled, with_sample

#: Labelled documents of each label, at most, that rules are learned from.
PER_CLASS = 5000
STATISTICS = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "mark_share", "digit_share", "distinct_share", "line_words", "ended_share")
_P = "__quality_"


class Condition(NamedTuple):
    statistic: str
    above: bool  # above the threshold, else up to it
    threshold: float

    def column(self, of) -> Column:
        return of(self.statistic) > self.threshold if self.above else of(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


class Rule(NamedTuple):
    conditions: tuple[Condition, ...]
    precision: float

    def column(self, of) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


_BREAKS = "\t\n\x0b\x0c\r"


def with_statistics(docs: DataFrame, text: str = "text", statistics=STATISTICS, prefix: str = _P) -> DataFrame:
    """``docs`` and a struct column (``prefix`` and "s") with the counts of the
    contract and those of the ``statistics`` that are asked for.

    Columns that later ones use more than once are kept apart, so that the
    optimizer computes each once, and those that nothing uses not at all.
    """
    c = lambda n: F.col(prefix + n)
    # One-byte characters, by the bytes that are missing without them: plain searches, no pattern.
    count = lambda chars: F.octet_length(c("text")) * len(chars) - sum((F.octet_length(F.replace(c("text"), F.lit(x), F.lit(""))) for x in chars), F.lit(0))
    of_class = lambda pattern: F.length(c("text")) - F.length(F.regexp_replace(c("text"), pattern, ""))
    d = docs.withColumn(prefix + "text", F.coalesce(F.col(text), F.lit("")))
    spaced = c("text")
    for x in _BREAKS:
        spaced = F.replace(spaced, F.lit(x), F.lit(" "))
    d = d.withColumns({
        prefix + "words": F.array_remove(F.split(spaced, " ", -1), ""),
        prefix + "lines": F.filter(F.split(c("text"), "\n", -1), lambda x: F.btrim(x, F.lit(" " + _BREAKS)) != ""),
    })
    w = c("words")
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    d = d.withColumns({
        prefix + "n_words": F.size(w),
        prefix + "word_chars": F.length(c("text")) - count(" " + _BREAKS),
        prefix + "n_lines": F.size(c("lines")),
        prefix + "n_dup": F.size(c("lines")) - F.size(F.array_distinct(c("lines"))),
        prefix + "n_symbols": count("#*$%&|<>"),
        prefix + "windows": windows,
    })
    # Hash and place of each window in one number, sorted, so that equal ones are neighbours; only where some repeat.
    # The place takes the low bits that the number of windows needs; whole hashes are compared where the rest agrees.
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(c("windows"))))) - 1
    d = d.withColumn(prefix + "low", F.when(F.size(F.array_distinct(c("windows"))) < F.size(c("windows")), low))
    placed = F.sort_array(F.transform(c("windows"), lambda h, i: h.bitwiseAND(F.bitwise_not(c("low"))).bitwiseOR(i.cast("long"))))
    d = d.withColumn(prefix + "placed", F.when(c("low").isNotNull(), placed))
    place = lambda k: F.get(c("placed"), k).bitwiseAND(c("low")).cast("int")
    same = lambda x, k: (x.bitwiseXOR(F.get(c("placed"), k + 1)) <= c("low")) & (x.bitwiseXOR(F.get(c("placed"), k + 1)) >= 0) & (F.get(c("windows"), place(k)) == F.get(c("windows"), place(k + 1)))
    # Neighbours that are equal give both their places; each place once, in order.
    pairs = F.flatten(F.array_compact(F.transform(c("placed"), lambda x, k: F.when(same(x, k), F.array(place(k), place(k + 1))))))
    d = d.withColumn(prefix + "places", F.when(c("placed").isNotNull(), F.sort_array(F.array_distinct(pairs))))
    begin = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(c("places"), begin, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    d = d.withColumn(prefix + "n_repeat", F.coalesce(covered, F.lit(0)))
    values = {
        "n_words": lambda: c("n_words").cast("double"),
        "mean_word": lambda: _share(c("word_chars"), c("n_words")),
        "symbol_share": lambda: _share(c("n_symbols"), c("n_words")),
        "dup_line_share": lambda: _share(c("n_dup"), c("n_lines")),
        "repeat_share": lambda: _share(c("n_repeat"), c("n_words")),
        "upper_share": lambda: _share(of_class(r"\p{Lu}"), c("word_chars")),
        "mark_share": lambda: _share(count("!?"), c("n_words")),
        "digit_share": lambda: _share(of_class(r"\p{Nd}"), c("word_chars")),
        "distinct_share": lambda: _share(F.size(F.array_distinct(w)), c("n_words")),
        "line_words": lambda: _share(c("n_words"), c("n_lines")),
        "ended_share": lambda: _share(F.size(F.filter(c("lines"), lambda x: x.rlike(f"[.!?][{SPACE_CLASS}]*$"))), c("n_lines")),
    }
    counts = {"words": c("n_words"), "word_chars": c("word_chars"), "n_symbols": c("n_symbols"), "n_dup_lines": c("n_dup"), "n_repeat_words": c("n_repeat")}
    whole = F.struct(*(v.cast("long").alias(f"count_{k}") for k, v in counts.items()), *(values[k]().alias(k) for k in statistics))
    # One row in, one row out; as a generator, so that a filter on the result isn't pushed below and computed twice.
    return d.select(*(F.col(f"`{x}`") for x in docs.columns), F.explode(F.array(whole)).alias(prefix + "s"))


def _of(statistic: str, prefix: str = _P) -> Column:
    return F.col(f"{prefix}s")[statistic]


def base_failed(min_words: int = 50, repeat_percent: int = 50, prefix: str = _P) -> Column:
    """Too few words, or over ``repeat_percent`` of them in repeated windows."""
    n = _of("count_words", prefix)
    return (n < min_words) | (100 * _of("count_n_repeat_words", prefix) > repeat_percent * n)


def _gain(p: float, n: float, whole_p: float, whole_n: float) -> float:
    if p <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(whole_p / (whole_p + whole_n)))


def learn_rules(labelled: DataFrame, weight: dict[int, float] | None = None, statistics=STATISTICS, bins: int = 32, max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.9, min_rows: int = 8) -> list[Rule]:
    """Rules for label 0. ``labelled``: doc_id, label and the statistics.
    ``weight`` of a row of each label, where the sample's shares are not those
    of the population. A rule must have ``min_precision``, weighted, in both
    parts, and cover ``min_rows`` rows to grow on."""
    weight = weight or {0: 1.0, 1: 1.0}
    steps = [k / bins for k in range(1, bins)]
    quantiles = lambda s, label: F.percentile_approx(F.when(F.col("label") == label, F.col(s)), steps, 10_000)
    found = labelled.agg(*(quantiles(s, k).alias(f"{s}{k}") for s in statistics for k in (0, 1))).first()
    values = {s: sorted({*(found[f"{s}0"] or []), *(found[f"{s}1"] or [])}) for s in statistics}
    cuts = {s: [(a + b) / 2 for a, b in zip(v, v[1:])] for s, v in values.items()}  # halfway: clear of either side
    place = lambda s: F.array(*(F.when(F.col(s) > t, 1) for t in cuts[s]), F.lit(None).cast("int"))
    part = F.when(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(3)) == 0, "prune").otherwise("grow")
    rows = checkpointed(labelled.select(part.alias("part"), "label", *statistics, F.array(*(F.size(F.array_compact(place(s))) for s in statistics)).alias("at")))

    def counts(chosen: DataFrame) -> dict:
        """(part, label, statistic, interval) to rows, from one aggregation."""
        return {(r["part"], r["label"], r["pos"], r["col"]): r["count"] for r in chosen.select("part", "label", F.posexplode("at")).groupBy("part", "label", "pos", "col").count().collect()}

    rules: list[Rule] = []
    left, barred = rows, set()  # statistics that gave no precise rule on the rows left
    while len(rules) < max_rules:
        grown: list[tuple[Condition, dict]] = []
        chosen = left
        while len(grown) < max_conditions:
            have = counts(chosen)
            total = lambda part, label: sum(v for (a, b, s, _), v in have.items() if (a, b, s) == (part, label, 0)) * weight[label]  # noqa: B023, E731
            whole = {(a, b): total(a, b) for a in ("grow", "prune") for b in (0, 1)}
            if not whole["grow", 0] or not whole["grow", 1]:
                break
            best = (1e-9, None, None)
            for s, name in enumerate(statistics):
                if not grown and name in barred:
                    continue
                up_to = {k: 0.0 for k in whole}
                for k, cut in enumerate(cuts[name]):
                    for a, b in whole:
                        up_to[a, b] += have.get((a, b, s, k), 0) * weight[b]
                    for above in (False, True):
                        covers = {x: whole[x] - up_to[x] if above else up_to[x] for x in whole}
                        if covers["grow", 0] >= min_rows * weight[0]:
                            best = max(best, (_gain(covers["grow", 0], covers["grow", 1], whole["grow", 0], whole["grow", 1]), Condition(name, above, cut), covers), key=lambda x: x[0])
            if best[1] is None:
                break
            grown.append((best[1], best[2]))
            chosen = chosen.where(best[1].column(F.col))
            if not best[2]["grow", 1]:
                break
        # Prune: the leading conditions that tell best on the other part.
        worth = lambda covers: (covers["prune", 0] - covers["prune", 1]) / (covers["prune", 0] + covers["prune", 1] + 1e-9)
        kept = max(range(1, len(grown) + 1), key=lambda k: (worth(grown[k - 1][1]), -k), default=0)
        if not kept:
            break
        covers = grown[kept - 1][1]
        precise = [(covers[a, 0] + 1e-9) / (covers[a, 0] + covers[a, 1] + 2e-9) for a in ("grow", "prune")]
        if min(precise) < min_precision or not covers["prune", 0]:
            barred.add(grown[0][0].statistic)
            continue
        rule = Rule(tuple(c for c, _ in grown[:kept]), precise[1])
        rules.append(rule)
        barred.clear()
        left = left.where(~rule.column(F.col))
    return rules


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[Rule]:
    """Rules from a bounded sample of the labelled documents."""
    sample, totals = sampled(document_labels(labels), per_class)
    if len(totals) < 2:
        return []
    stats = with_statistics(with_sample(docs, sample)).where(~base_failed()).select("doc_id", "label", *(_of(s).alias(s) for s in STATISTICS))
    stats = checkpointed(stats)
    weight = {k: n / min(n, per_class) for k, n in totals.items()}
    return learn_rules(stats, weight)


def verdict(rules: list[Rule], prefix: str = _P) -> Column:
    """The ordered expression: number of the first rule that rejects, from 1; 0 if none does."""
    out = F.when(F.lit(False), 0)
    for k, rule in enumerate(rules):
        out = out.when(rule.column(lambda s: _of(s, prefix)), k + 1)
    return out.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], prefix: str = _P) -> DataFrame:
    """``docs`` with the columns s, failed, rule and kept, each behind ``prefix``."""
    named = {c.statistic for r in rules for c in r.conditions}
    d = with_statistics(docs, statistics=[s for s in STATISTICS if s in named], prefix=prefix)
    d = d.withColumns({prefix + "failed": base_failed(prefix=prefix), prefix + "rule": verdict(rules, prefix)})
    return d.withColumn(prefix + "kept", ~F.col(prefix + "failed") & (F.col(prefix + "rule") == 0))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` without the documents that the base rule or a learned rule rejects."""
    prefix = _P
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    judged = judge(docs, fit(docs, labels, per_class), prefix)
    return judged.where(F.col(prefix + "kept")).select(*(F.col(f"`{x}`") for x in docs.columns))
