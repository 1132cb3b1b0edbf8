"""Quality rules: text statistics and a decision list learned from labels, all in DataFrame functions.

``text_stats`` counts inside each row (no explode, no shuffle). ``learn`` is sequential covering: a rule grows one threshold
condition at a time on two thirds of the labelled rows, is pruned on the last third, and is kept if it is precise there;
rows it covers are taken out before the next rule. Every step is one aggregation of conditional counts over all labelled
rows (binned and counted beforehand), so only counts reach the driver. The rules become ordered conditions of a CASE.

Null text has no words. Ids may be null or repeated: rows are independent, and rows without a label only take no part in
learning. Without labels of both kinds the list is empty and nothing more than the base rule rejects.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
WINDOW = 8


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` reads it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of eight that occur twice or more. Windows are compared by 64-bit hashes of their words' hashes."""
    def covered(pos: Column) -> Column:
        gaps = F.zip_with(F.slice(pos, 2, F.size(pos) - 1), F.slice(pos, 1, F.size(pos) - 1), lambda b, a: F.least(F.lit(WINDOW), b - a))
        return F.aggregate(gaps, F.lit(WINDOW), lambda t, g: t + g).cast("long")

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        same = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (s[j]["h"] == s[F.greatest(j - 1, F.lit(0))]["h"]))
                        | ((j < last) & (s[j]["h"] == s[F.least(j + 1, last)]["h"])))
        return let(F.sort_array(F.transform(same, lambda j: s[j]["i"])), covered)

    def windows(hashes: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(hashes) - WINDOW), lambda i: F.xxhash64(*(hashes[i + k] for k in range(WINDOW))))
        return let(made, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), repeated)))

    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), windows))


def text_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``STATS``, ``base_failed`` and the columns they are made from removed again."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    removed = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"_words": words, "_lines": lines})
    out = out.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": removed(BLANKS),
        "n_symbols": removed(r"[^#*$%&|<>]+"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("_words")),
        "n_lines": F.size("_lines").cast("long"),
        "n_upper": removed(r"\P{Lu}+")})
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_words", "_lines")


def features() -> dict[str, Column]:
    """Ratios that the rules test, from ``STATS``."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "upper_share": F.col("n_upper") / chars}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, feats: dict[str, Column] | None = None) -> Column:
        value = (feats or features())[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, feats: dict[str, Column] | None = None) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(feats)
        return out


CUTS = [0.01, 0.1, 0.5, 0.9, 0.99, 1.0]  # of bad and of good rows


def learn(stats: DataFrame, labels: DataFrame, cache, id_col: str = "doc_id", label_col: str = "quality", min_precision: float = 0.97,
          min_covered: int = 4, max_rules: int = 8, max_conditions: int = 3) -> list[Rule]:
    """Ordered rules for rejecting documents (label 0), learned from all labelled rows that pass the base rule.

    ``cache(df)`` keeps a small table that each step reads (distinct feature vectors with counts).
    """
    # A rule list is small by design: at most max_rules * max_conditions thresholds.
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).where(F.col("_label").isin(0, 1))
    rows = (stats.where(~F.col("base_failed")).join(marked, F.col(id_col) == F.col("_id"))
            .select(*(c.alias(k) for k, c in features().items()), (F.col("_label") == 0).alias("bad"),
                    (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("pruning")))
    names = list(features())
    cells = cache(rows.groupBy(*names, "bad", "pruning").count())
    cuts = cells.groupBy("bad").agg(*(F.percentile_approx(n, F.array(*map(F.lit, CUTS)), 1000).alias(n) for n in names)).collect()
    own = {n: F.col(n) for n in names}
    options = [Condition(n, above, float(t)) for n in names for t in sorted({x for r in cuts for x in r[n] or []}) for above in (True, False)]

    def counts(taken: list[Rule], conditions: list[Column], pruning: bool) -> list[tuple[int, int]]:
        """Bad and good rows that meet each condition, of the rows no rule has taken yet."""
        left = cells.where(F.col("pruning") == pruning)
        for r in taken:
            left = left.where(~r.column(own))
        sums = [F.sum(F.when(c & (F.col("bad") == bad), F.col("count"))) for c in conditions for bad in (True, False)]
        got = [x or 0 for x in left.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()]
        return list(zip(got[::2], got[1::2]))

    rules: list[Rule] = []
    while len(rules) < max_rules and options:
        rule, best = Rule(()), None
        for _ in range(max_conditions):
            found = counts(rules, [rule.column(own) & o.column(own) for o in options], False)
            # Laplace precision times the share of bad rows kept, so that a condition does not chase a handful of rows.
            base_bad = max(1, max(p for p, _ in found))
            scored = [((p + 1) / (p + n + 2) * (p / base_bad) ** 0.25 if p >= min_covered else 0.0, o, p, n) for (p, n), o in zip(found, options)]
            score, option, p, n = max(scored, key=lambda s: s[0])
            if score <= 0 or (best is not None and p / (p + n) <= best):
                break
            # Halfway to the next value seen, so that the border does not lie on a value of the training rows.
            above = cells.where(F.col(option.feature) > option.threshold).agg(F.min(option.feature)).first()[0]
            option = Condition(option.feature, option.above, option.threshold if above is None else (option.threshold + above) / 2)
            rule, best = Rule((*rule.conditions, option)), p / (p + n)
            if n == 0:
                break
        if not rule.conditions:
            break
        # Prune from the end: the shortest prefix that is as good on rows not used for growing.
        prefixes = [Rule(rule.conditions[:k]) for k in range(1, len(rule.conditions) + 1)]
        judged = counts(rules, [r.column(own) for r in prefixes], True)
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in judged]
        k = max(range(len(prefixes)), key=lambda i: (worth[i], -i))
        p, n = judged[k]
        if p < min_covered or p / (p + n) < min_precision:
            k = max(range(len(prefixes)), key=lambda i: worth[i] if judged[i][0] >= min_covered else -2)
            p, n = judged[k]
            if p < min_covered or p / (p + n) < min_precision:
                break
        rules.append(prefixes[k])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list over ``STATS``: number of the rule that rejects a document, or NULL where none does."""
    out = None
    for i, rule in enumerate(rules):
        out = F.when(rule.column(), F.lit(i)) if out is None else out.when(rule.column(), F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with ``rejected_by`` and ``kept``."""
    return stats.withColumn("rejected_by", verdict(rules)).withColumn("kept", ~F.col("base_failed") & F.col("rejected_by").isNull())
