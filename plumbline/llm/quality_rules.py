"""Quality rules as learned decision lists (operator 4). DataFrame and SQL functions only.

Features of a text are Spark expressions. A decision list is a sequence of conjunctions of thresholds over features; a text
that meets one is rejected, all others stay. It is learned by sequential covering from labelled statistics: each step
aggregates, for the training rows not yet covered, the good and bad rows below and above every candidate threshold (the
quantiles of the bad and of the good rows), adds the threshold with the best FOIL gain to the rule that is growing, and
stops when the rule covers no good row of the growing half or no threshold gains; then the rule is pruned on the other
half by taking off its last conditions while that doesn't lower (bad - good) / (bad + good). A rule whose precision on both
halves is under min_precision ends the list. Only counts come to the driver, their number being features x thresholds.

The training rows are the labelled rows of least hash, at most max_training of them (a documented bound); the rules apply
to every row. Defined results: a null text has no words and no lines; texts without words get ratio features of 0; with no
bad or no good training rows the list is empty and every text is kept; every row stays, repeated rows and null ids
included; columns of the features' names are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WS_CHARS, WS_CLASS
from plumbline.runtime import materialize

#: The symbols that the contract counts.
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def base_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of the whole text.

    Repeated windows are found within the row: window hashes (64 bits) are compared as a set first, and only rows with a
    repetition sort theirs, so no window leaves its row and nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.split(F.trim(text, F.lit(WS_CHARS)), WS_CLASS + "+")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.trim(line, F.lit(WS_CHARS))) > 0)
    # Never false, and not deterministic for the optimizer: filters stay above, where each array is computed once a row.
    once = F.monotonically_increasing_id() >= 0
    out = df.withColumns({"__pl_w": F.when(once, words), "__pl_l": lines})
    n_words = F.when(F.col("__pl_w")[0] == "", 0).otherwise(F.size("__pl_w"))
    windows = F.expr(f"transform(sequence(0, size(__pl_w) - {WINDOW}), i -> xxhash64(__pl_w[i], __pl_w[i + 1], __pl_w[i + 2]))")
    out = out.withColumns({
        "n_words": n_words.cast("long"),
        "word_chars": F.length(F.translate(text, WS_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__pl_l") - F.size(F.array_distinct("__pl_l"))).cast("long"),
        "__pl_g": F.when(F.size("__pl_w") >= WINDOW, windows),
    })
    repeated = """size(array_distinct(flatten(transform(
      filter(transform(array(array_sort(transform(__pl_g, (g, i) -> named_struct('g', g, 'i', i)))), s ->
        transform(s, (x, j) -> if((j > 0 and s[greatest(j - 1, 0)].g = x.g) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].g = x.g), x.i, -1)))[0], i -> i >= 0),
      i -> array(i, i + 1, i + 2)))))"""
    some = F.col("__pl_g").isNotNull() & (F.size(F.array_distinct("__pl_g")) < F.size("__pl_g"))
    return out.withColumn("n_repeat_words", F.when(once & some, F.expr(repeated)).otherwise(0).cast("long")).drop("__pl_w", "__pl_l", "__pl_g")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Feature name: expression over the base features and the text.
def rule_features(text_col: str = "text") -> dict[str, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.length(text), F.lit(1))
    count = lambda symbols: F.length(text) - F.length(F.translate(text, symbols, ""))
    return {
        "f_words": F.col("n_words").cast("double"),
        "f_mean_word": F.col("word_chars") / words,
        "f_symbols": F.col("n_symbols") / words,
        "f_pipes": count("|") / words,
        "f_marks": count("!?") / words,
        "f_stops": count(".,;:") / words,
        "f_digits": count("0123456789") / chars,
        "f_capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / chars,
        "f_repeats": F.col("n_repeat_words") / words,
        "f_dup_lines": F.col("n_dup_lines") / words,
        "f_line_words": words / (count("\n") + 1),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.above else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:g}"


def both(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that a row meets, or null."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        out = F.when(both(rule), i).otherwise(out)
    return out


def _thresholds(train: DataFrame, names: list[str], per_feature: int) -> dict[str, list[float]]:
    at = [(i + 1) / (per_feature + 1) for i in range(per_feature)]
    found: dict[str, set[float]] = {n: set() for n in names}
    for row in train.groupBy("bad").agg(*[F.percentile_approx(n, at, 1000).alias(n) for n in names]).collect():
        for n in names:
            found[n].update(v for v in row[n] or [] if v is not None)
    out = {}
    for n in names:  # between neighbouring quantiles, so that no threshold sits on a common value
        v = sorted(found[n])
        out[n] = sorted({float(f"{(a + b) / 2:.4g}") for a, b in zip(v, v[1:], strict=False)})
    return out


def _grow_counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[float, float]]:
    """(bad, good) rows that meet each candidate condition, from one aggregation."""
    sums = []
    for name, values in cuts.items():
        for i, v in enumerate(values):
            for bad in (1, 0):
                sums.append(F.sum(F.when((F.col(name) >= v) & (F.col("bad") == bad), 1).otherwise(0)).alias(f"{name}_{i}_{bad}"))
    sums += [F.sum(F.when(F.col("bad") == bad, 1).otherwise(0)).alias(f"all_{bad}") for bad in (1, 0)]
    row = rows.agg(*sums).first().asDict()
    all_ = [row["all_1"] or 0, row["all_0"] or 0]
    out = {}
    for name, values in cuts.items():
        for i, v in enumerate(values):
            up = (row[f"{name}_{i}_1"] or 0, row[f"{name}_{i}_0"] or 0)
            out[Condition(name, True, v)] = up
            out[Condition(name, False, v)] = (all_[0] - up[0], all_[1] - up[1])
    return out


def learn_rules(train: DataFrame, names: list[str], max_rules: int = 8, max_conditions: int = 3, per_feature: int = 12, min_precision: float = 0.9, min_share: float = 0.01) -> list[list[Condition]]:
    """A decision list from rows with the features, bad (0 or 1) and half (0: grow, 1: prune)."""
    cuts = _thresholds(train, names, per_feature)
    rules: list[list[Condition]] = []
    if not any(cuts.values()):
        return rules
    all_bad = train.where("bad = 1").count()
    while len(rules) < max_rules:
        open_ = train.where(verdict(rules).isNull()) if rules else train
        rule: list[Condition] = []
        grow = open_.where("half = 0")
        before = None
        while len(rule) < max_conditions:
            counts = _grow_counts(grow.where(both(rule)), cuts)
            if before is None:
                some = next(iter(counts))
                other = Condition(some.feature, not some.above, some.threshold)
                before = tuple(a + b for a, b in zip(counts[some], counts[other], strict=True))
            p0, n0 = before
            if not p0 or not n0:
                break
            gain = lambda pn: pn[0] * (math.log2(pn[0] / (pn[0] + pn[1])) - math.log2(p0 / (p0 + n0))) if pn[0] else 0.0
            best = max(counts, key=lambda c: (gain(counts[c]), str(c)))
            if gain(counts[best]) <= 1e-9 or counts[best] == before:
                break
            rule.append(best)
            before = counts[best]
        if not rule:
            break
        worth = {}
        prefixes = [rule[: i + 1] for i in range(len(rule))]
        row = open_.agg(*[F.sum(F.when(both(p) & (F.col("bad") == bad) & (F.col("half") == half), 1).otherwise(0)).alias(f"p{i}_{bad}_{half}") for i, p in enumerate(prefixes) for bad in (1, 0) for half in (0, 1)]).first().asDict()
        for i in range(len(prefixes)):
            b, g = row[f"p{i}_1_1"] or 0, row[f"p{i}_0_1"] or 0
            worth[i] = (b - g) / (b + g) if b + g else -1.0
        keep = max(worth, key=lambda i: (worth[i], -i))
        bad, good = (sum(row[f"p{keep}_{v}_{h}"] or 0 for h in (0, 1)) for v in (1, 0))
        if bad < min_precision * (bad + good) or bad < max(2, min_share * all_bad):
            break
        rules.append(prefixes[keep])
    return rules


def learn_quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_training: int = 20_000) -> list[list[Condition]]:
    """Rules that reject the texts labelled 0. The training ids, bounded by max_training, are broadcast: no text moves."""
    few = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).alias("__pl_q"))
    few = few.orderBy(F.xxhash64(id_col), id_col).limit(max_training)
    rows = base_features(docs.select(id_col, text_col).join(F.broadcast(few), id_col), text_col)
    features = rule_features(text_col)
    train = rows.select(base_failed().alias("failed"), (1 - F.col("__pl_q")).alias("bad"), F.pmod(F.xxhash64(id_col, F.lit(7)), F.lit(2)).alias("half"), *[c.alias(n) for n, c in features.items()])
    return learn_rules(materialize(train, "features").where("not failed"), list(features))


def quality_verdicts(df: DataFrame, rules: list[list[Condition]], text_col: str = "text", rule_col: str = "rule", kept_col: str = "kept") -> DataFrame:
    """Add the base features, base_failed, the number of the rule that rejects the text (or null) and the verdict."""
    features = {f"__pl_{n}": c for n, c in rule_features(text_col).items()}
    own = [[Condition(f"__pl_{c.feature}", c.above, c.threshold) for c in rule] for rule in rules]
    out = base_features(df, text_col).withColumns(features)
    out = out.withColumns({"base_failed": base_failed(), rule_col: verdict(own)})
    return out.withColumn(kept_col, ~F.col("base_failed") & F.col(rule_col).isNull()).drop(*features)
