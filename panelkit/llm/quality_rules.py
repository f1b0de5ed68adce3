"""Quality rules learned as a decision list, as DataFrame expressions throughout.

Text statistics are computed inside the row. Rules are learned from labelled
statistics by sequential covering: a rule grows one threshold condition at a
time by information gain on one part of the labels, is pruned on the other
part, and the rows it covers leave before the next rule grows. The result is an
ordered conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stage

_GAP = r"[\x20\x09-\x0D]+"
#: Words of a window whose second occurrence counts as a repeat.
RUN = 5
FEATURES = ("symbol_share", "dup_line_share", "repeat_share", "mean_word", "n_words")
CUTS = 15
MOST_RULES = 8
MOST_CONDITIONS = 4
#: A rule must be this often right, and cover this many rows, on the part it was not grown on.
LEAST_PRECISION = 0.8
LEAST_COVER = 5


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with word, symbol, line and repeat counts of the whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``; ``word_chars`` are the code points in
    them, ``n_symbols`` the characters of ``[#*$%&|<>]``, ``n_dup_lines`` the
    lines with a word that equal an earlier line, ``n_repeat_words`` the words
    in five-word windows that stand in the text twice or more. Null and empty
    texts count zero. Columns of these names are replaced.
    """
    out = df.withColumn("__text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.withColumn("__words", F.filter(F.split("__text", _GAP), lambda w: w != ""))
    out = out.withColumn("__lines", F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    window = F.transform(F.sequence(F.lit(1), F.size("__words") - (RUN - 1)), lambda i: F.xxhash64(F.slice("__words", i, RUN)))
    out = out.withColumn("__runs", F.when(F.col("n_words") >= RUN, window).otherwise(F.expr("cast(array() AS array<bigint>)")))
    symbols = F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))
    placed = "array_sort(transform(__runs, (h, i) -> named_struct('h', h, 'i', i)))"
    repeats = F.expr(f"""
        CASE WHEN size(array_distinct(__runs)) = size(__runs) THEN 0L ELSE
          transform(array({placed}), s ->
            transform(array(array_sort(transform(
                filter(s, (x, j) -> coalesce(get(s, j - 1).h = x.h, false) OR coalesce(get(s, j + 1).h = x.h, false)), x -> x.i))), p ->
              aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({RUN}, b - a)), 0L, (n, x) -> n + x))[0])[0]
        END""")
    return (
        out.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
        .withColumn("n_symbols", symbols.cast("long"))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn("n_repeat_words", repeats)
        .drop("__text", "__words", "__lines", "__runs")
    )


def _share(a: str, b: str) -> str:
    return f"({a} / greatest({b}, 1L))"


_SQL = {
    "symbol_share": _share("n_symbols", "word_chars"),
    "dup_line_share": _share("n_dup_lines", "n_lines"),
    "repeat_share": _share("n_repeat_words", "n_words"),
    "mean_word": _share("word_chars", "n_words"),
    "n_words": "cast(n_words AS double)",
}


def feature(name: str) -> Column:
    return F.expr(_SQL[name])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def sql(self) -> str:
        return f"{_SQL[self.feature]} {'>=' if self.above else '<='} {self.cut!r}D"


Rule = tuple[Condition, ...]


def _sql(conditions: Rule) -> str:
    return "(" + (" AND ".join(c.sql() for c in conditions) or "true") + ")"


def _all(conditions: Rule) -> Column:
    return F.expr(_sql(conditions))


def learn(stats: DataFrame, label: str, id: str) -> list[Rule]:
    """Rules that mark rows with label 0, in order.

    ``stats`` holds ``statistics`` and the label of the labelled rows; rows
    with a null label are left out. Each step is one aggregation over counts
    of equal rows and returns one row, bounded by features and cuts.
    """
    stats = stats.where(F.col(label).isNotNull()).withColumn("held", F.pmod(F.xxhash64(F.col(id)), F.lit(3)) == 0)
    cuts = stats.agg(
        *(F.percentile_approx(F.when(F.col(label) == 0, feature(f)), [(i + 0.5) / CUTS for i in range(CUTS)], 10_000).alias(f) for f in FEATURES)
    ).first()
    options = [Condition(f, above, float(c)) for f in FEATURES for c in sorted(set(cuts[f] or [])) for above in (True, False)]
    columns = ("n_symbols", "word_chars", "n_dup_lines", "n_lines", "n_repeat_words", "n_words")
    left = stage(stats.groupBy("held", label, *columns).agg(F.count("*").alias("rows")), "statistics")

    def counts(rows: DataFrame, rules: list[Rule]) -> list[tuple[int, int]]:
        # One text for all cells: an expression object a cell costs the driver far more than the job.
        cells = (f"coalesce(sum(CASE WHEN {_sql(r)} AND `{label}` = {v} THEN `rows` END), 0L)" for r in rules for v in (0, 1))
        found = rows.agg(F.expr(f"array({', '.join(cells)})").alias("n")).first()["n"]
        return list(zip(found[::2], found[1::2]))

    rules: list[Rule] = []
    while len(rules) < MOST_RULES and options:
        rest = left
        for rule in rules:
            rest = rest.where(~_all(rule))
        grow, held = rest.where("not held"), rest.where("held")
        rule: Rule = ()
        ((p, n),) = counts(grow, [()])
        while n and p and len(rule) < MOST_CONDITIONS:
            found = counts(grow, [(*rule, o) for o in options])
            base = math.log2(p / (p + n))
            gain = [a * (math.log2(a / (a + b)) - base) if a else 0.0 for a, b in found]
            best = max(range(len(options)), key=gain.__getitem__)
            if gain[best] <= 1e-9:
                break
            rule, (p, n) = (*rule, options[best]), found[best]
        if not rule:
            break
        cut = [rule[:k] for k in range(1, len(rule) + 1)]
        found = counts(held, cut)
        worth = [(a - b) / (a + b) if a + b else -1.0 for a, b in found]
        best = max(range(len(cut)), key=worth.__getitem__)
        right, wrong = found[best]
        if right < LEAST_COVER or right < LEAST_PRECISION * (right + wrong):
            break
        rules.append(cut[best])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional expression; true keeps."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(df: DataFrame, labels: DataFrame, text: str = "text", id: str = "doc_id", label: str = "quality") -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row, by rules learned from ``labels``.

    ``base_failed``: fewer than ten words, or more than a fifth of them in
    repeats. Repeated ids are judged each by its own text; several labels of
    an id count by the lowest. Without labels of both kinds no rule is learned
    and all that pass the base are kept. Columns other than id and text are
    not carried.
    """
    docs = df.select(F.col(id).alias("__id"), F.col(text).alias("__body"))
    stats = stage(statistics(docs, "__body").drop("__body"), "quality")
    known = labels.groupBy(F.col(id).alias("__id")).agg(F.min(label).alias("__label"))
    rules = learn(stats.join(known, "__id"), "__label", "__id")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~failed & verdict(rules)).withColumnRenamed("__id", id)
