"""Per-document text statistics, and a learned rule list that tells natural prose from the rest.

The statistics are native expressions over the lines of a text: lines are exploded, measured in
generated code and summed per document by a partial aggregation, so the shuffle carries one row
of numbers per document and no text.

No statistic decides by itself what prose is: shares of lines are given for a ladder of densities,
and which of them matter, and from where on, is learned. The rules are induced by incremental
reduced-error pruning on labelled documents (IREP, with the rule value of RIPPER): a rule is grown
on two thirds of the labels by the gain of its conditions, its last conditions are pruned on the
last third, what it covers is set aside, and so on until the next rule errs on half of what it
covers. Then each threshold in turn is moved to where the whole list errs least. The list becomes
one SQL CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the rules are learned from; beyond it those of least hash are taken.
MAX_LABELS = 20_000

_CJK = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
# Patterns begin with one class of characters, which most characters of a text are not in.
# An end of a sentence or clause: up to three marks before white space (a longer row of dots leads to a page number), or a CJK mark.
_END = f"[.!?…。！？，：；](?:(?<=[。！？，])|(?<=[：；])(?=[{_CJK}])|(?<=[.!?…])(?<![.!?…]{{4}})(?=[\"'”’»)]*(?:\\s|$)))"
_LINE_END = r"[.!?…:;,。！？：；，、][\"'”’»)）」』]*[^\S\n]*(?:\n|\z)"
_MARKER = r"^\s*(?:[-*•·▪◦–—]|\(?(?:\d{1,3}|[a-zA-Z]|[一二三四五六七八九十]{1,2})[.)）、]|\d{1,3}(?:\.\d{1,3})+)\s*\S"
# the break of a hard-wrapped line: after 28 characters or more, gone on with in small letters
_WRAP = r"\n(?:(?<=[^\n]{28}[\p{Ll},]\r?\n)(?=[\p{Ll}\p{N}(])|(?<=[^\n]{28}[\p{N})]\r?\n)(?=\p{Ll}))"

#: One common word, or common character, in so many of a line.
DENSITIES = (4, 8, 16, 32)
#: Statistics that the rules may use, all between documents of any length comparable.
FEATURES = (
    "mean_word_length",
    "symbol_ratio",
    "digit_ratio",
    "punctuated_lines",
    "common_share",
    *(f"common_{k}" for k in DENSITIES),
    "ended_share",
    "item_share",
    "repeated_share",
    "mean_line_length",
)


def text_statistics(df: DataFrame, row_id: str, text: str, common_words: DataFrame) -> DataFrame:
    """``row_id, chars, words, lines`` and the ``FEATURES``, one row for each id.

    ``common_words`` has a column ``word``, all of which count; words of one CJK character are matched as characters.
    Words are runs of letters, and single CJK characters; ratios are of non-space characters,
    shares of lines are of lines that are not blank. A null, empty or blank text has counts of 0
    and ratios of null. An id with several rows is measured over all of them, repeated rows
    count once in effect (all figures but the counts are ratios, and counts are per row). Rows
    with a null id are one document. Other columns are not read.
    """
    listed = common_words.where("word IS NOT NULL").select(F.lower(F.trim("word")).alias("word")).distinct()
    words = [r["word"] for r in listed.collect()]  # the whole list, a set in the plan: it does not grow with the documents
    single = "".join(sorted(w for w in words if len(w) == 1 and "㐀" <= w <= "鿿"))
    # single Latin letters are left out: they occur in any noise
    spelled = sorted(w for w in words if w not in single and (len(w) > 1 or "Ѐ" <= w <= "ӿ"))
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    line = F.col("line.own")
    # everything that is no letter, and ideographs, divides words
    tokens = F.filter(F.split(F.lower(line), rf"[[^\p{{L}}\p{{M}}'’]{_CJK}]+"), lambda w: w != "")
    # the lines as stored are counted in the text; for running text, hard-wrapped lines are joined first
    rows = df.select(
        F.col(row_id).alias("id"),
        F.regexp_count(whole, F.lit(r"(?m)^.*\S")).alias("lines"),
        F.regexp_count(whole, F.lit(_LINE_END)).alias("punctuated"),
        F.regexp_count(whole, F.lit(r"[^\p{L}\p{M}\p{N}\s\p{Z}\p{Co}]")).alias("symbols"),
        F.regexp_count(whole, F.lit(r"\p{N}")).alias("digits"),
        F.split(F.regexp_replace(whole, _WRAP, " "), r"\r?\n").alias("own"),
    )
    neighbours = F.arrays_zip("own", F.concat(F.array(F.lit(None).cast("string")), F.col("own")).alias("before"), F.slice("own", 2, 1 << 30).alias("after"))
    rows = rows.select("id", "lines", "punctuated", "symbols", "digits", F.posexplode(neighbours).alias("no", "line")).where("line.own IS NOT NULL")
    measured = rows.select(
        "id",
        "no",
        *[F.when(F.col("no") == 0, F.col(c)).otherwise(0).alias(c) for c in ("lines", "punctuated", "symbols", "digits")],
        (F.length(line) - F.regexp_count(line, F.lit(r"[\s\p{Z}]"))).alias("ink"),
        (F.coalesce(line == F.col("line.before"), F.lit(False)) | F.coalesce(line == F.col("line.after"), F.lit(False))).alias("repeated"),
        tokens.alias("tokens"),
        F.regexp_count(line, F.lit(f"[{_CJK}]")).alias("cjk"),
        (F.regexp_count(line, F.lit(f"[{single}]")) if single else F.lit(0)).alias("cjk_common"),
        # a sentence may end on the next line
        F.concat_ws("\n", line, F.col("line.after")).rlike(_END).alias("ended"),
        line.rlike(_MARKER).alias("item"),
    )
    counted = measured.select(
        "*",
        (F.size("tokens") + F.col("cjk")).alias("n_words"),
        F.aggregate("tokens", F.lit(0), lambda n, w: n + F.length(w)).alias("letters"),
        (F.col("cjk_common") + (F.size(F.filter("tokens", lambda w: w.isin(spelled))) if spelled else F.lit(0))).alias("common"),
    )
    ink = F.sum("ink")

    def over(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b)

    def part(condition: Column) -> Column:
        return over(F.sum(F.when(condition, F.col("ink")).otherwise(0)), ink)

    lines = F.sum("lines")
    copies = F.greatest(F.count_if(F.col("no") == 0), F.lit(1))
    all_words = F.sum("n_words")
    return counted.groupBy("id").agg(
        (ink / copies).cast("bigint").alias("chars"),
        (all_words / copies).cast("bigint").alias("words"),
        (lines / copies).cast("bigint").alias("lines"),
        over(F.sum(F.col("letters") + F.col("cjk")), all_words).alias("mean_word_length"),
        over(F.sum("symbols"), ink).alias("symbol_ratio"),
        over(F.sum("digits"), ink).alias("digit_ratio"),
        over(F.sum("punctuated"), lines).alias("punctuated_lines"),
        over(F.sum("common"), all_words).alias("common_share"),
        *[part((F.col("common") > 0) & (F.col("common") * k >= F.col("n_words"))).alias(f"common_{k}") for k in DENSITIES],
        part(F.col("ended")).alias("ended_share"),
        part(F.col("item")).alias("item_share"),
        part(F.col("repeated")).alias("repeated_share"),
        over(ink, lines).alias("mean_line_length"),
    ).withColumnRenamed("id", row_id)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_most: bool
    value: float

    def covers(self, data: pd.DataFrame) -> np.ndarray:
        x = data[self.feature].to_numpy()
        return x <= self.value if self.at_most else x >= self.value

    def sql(self) -> str:
        return f"coalesce({self.feature}, 0D) {'<=' if self.at_most else '>='} {self.value!r}D"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, data: pd.DataFrame) -> np.ndarray:
    inside = np.ones(len(data), dtype=bool)
    for condition in rule:
        inside &= condition.covers(data)
    return inside


def _best_condition(data: pd.DataFrame, y: np.ndarray, features: tuple[str, ...]) -> tuple[float, Condition | None]:
    """The condition of greatest FOIL gain; thresholds lie between neighbouring values."""
    p, n = int(y.sum()), int((~y).sum())
    base = math.log2(p / (p + n))
    best, chosen = 1e-9, None
    for feature in features:
        x = data[feature].to_numpy()
        order = np.argsort(x, kind="stable")
        xs, ys = x[order], y[order]
        cut = np.flatnonzero(xs[1:] > xs[:-1])
        if not len(cut):
            continue
        ps = np.cumsum(ys)[cut].astype(float)
        ns = (cut + 1) - ps
        values = (xs[cut] + xs[cut + 1]) / 2
        for at_most, a, b in ((True, ps, ns), (False, p - ps, n - ns)):
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(a > 0, a * (np.log2(a / (a + b)) - base), 0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, chosen = float(gain[i]), Condition(feature, at_most, round(float(values[i]), 6))
    return best, chosen


def induce_rules(data: pd.DataFrame, label: str, features: tuple[str, ...] = FEATURES, seed: int = 7, max_rules: int = 30, tries: int = 3) -> list[Rule]:
    """An ordered list of rules for ``label`` being true; no rule applying means false.

    The list ends when the rules of so many ``tries``, each with a split of its own, were no good:
    of few labels one split may leave nothing to learn the next rule from.
    """
    data = data.reset_index(drop=True).copy()
    data[list(features)] = data[list(features)].astype(float).fillna(0.0)
    rules: list[Rule] = []
    random, left = np.random.default_rng(seed), tries
    while len(rules) < max_rules and data[label].any() and not data[label].all():
        shuffled = random.permutation(len(data))
        cut = max(1, (2 * len(data)) // 3)
        grow, prune = data.iloc[shuffled[:cut]], data.iloc[shuffled[cut:]]
        rule: Rule = ()
        inside = grow
        while len(rule) < 8:
            y = inside[label].to_numpy(dtype=bool)
            if not y.any() or y.all():
                break
            _, condition = _best_condition(inside, y, features)
            if condition is None:
                break
            rule += (condition,)
            inside = inside[condition.covers(inside)]

        def value(r: Rule, prune: pd.DataFrame = prune) -> float:
            hit = prune[label].to_numpy(dtype=bool)[_covers(r, prune)]
            return (2 * hit.sum() - len(hit)) / len(hit) if len(hit) else -1.0

        lengths = range(1, len(rule) + 1)
        if not rule:
            left -= 1
            if not left:
                break
            continue
        rule = rule[: max(lengths, key=lambda k: (value(rule[:k]), -k))]
        covered = _covers(rule, data)
        if value(rule) <= 0 or not covered.any():
            left -= 1
            if not left:
                break
            continue
        left = tries
        rules.append(rule)
        data = data[~covered]
    return rules


def revise(rules: list[Rule], data: pd.DataFrame, label: str, rounds: int = 2) -> list[Rule]:
    """The rules with each threshold in turn where the list as a whole errs least; of equally good ones the nearest."""
    data = data.fillna({f: 0.0 for f in FEATURES if f in data})
    y = data[label].to_numpy(dtype=bool)
    revised = [list(r) for r in rules]
    for _ in range(rounds):
        for i, rule in enumerate(revised):
            others = np.zeros(len(data), dtype=bool)
            for other in revised[:i] + revised[i + 1 :]:
                others |= _covers(tuple(other), data)
            for k, condition in enumerate(rule):
                # only what this condition alone decides
                left = _covers(tuple(rule[:k] + rule[k + 1 :]), data) & ~others
                x, wrong = data[condition.feature].to_numpy()[left], np.where(y[left], -1, 1)
                if not len(x):
                    continue
                order = np.argsort(x, kind="stable")
                x, below = x[order], np.concatenate([[0], np.cumsum(wrong[order])])
                errors = below if condition.at_most else below[-1] - below
                cuts = np.flatnonzero(np.concatenate([[True], x[1:] > x[:-1], [True]]))
                cuts = cuts[(cuts > 0) & (cuts < len(x))]
                if not len(cuts):
                    continue
                now = int(np.searchsorted(x, condition.value, "right" if condition.at_most else "left"))
                if errors[cuts].min() >= errors[now]:
                    continue
                best = cuts[errors[cuts] == errors[cuts].min()]
                values = (x[best - 1] + x[best]) / 2
                rule[k] = Condition(condition.feature, condition.at_most, round(float(values[np.argmin(np.abs(values - condition.value))]), 6))
    return [tuple(r) for r in revised]


def rules_sql(rules: list[Rule]) -> str:
    """The list as one SQL CASE: the number of the first rule that applies, or 0."""
    if not rules:
        return "0"
    cases = [f"WHEN {' AND '.join(c.sql() for c in rule)} THEN {i}" for i, rule in enumerate(rules, 1)]
    return f"CASE {' '.join(cases)} ELSE 0 END"


def clean_labels(labels: DataFrame, row_id: str, kind: str, prose: str = "prose", most: int = MAX_LABELS) -> DataFrame:
    """``row_id, not_prose``: labels in any case, null ones and documents with differing ones left out."""
    known = labels.where(f"{row_id} IS NOT NULL AND {kind} IS NOT NULL").select(row_id, (F.lower(F.trim(F.col(kind))) != prose).alias("y"))
    agreed = known.groupBy(row_id).agg(F.min("y").alias("a"), F.max("y").alias("b")).where("a = b").select(row_id, F.col("a").alias("not_prose"))
    return agreed.orderBy(F.xxhash64(row_id), row_id).limit(most)


def learn_rules(statistics: DataFrame, labels: DataFrame, row_id: str) -> list[Rule]:
    """Rules from the labelled rows of ``statistics``; only those, a bounded number, come to the driver."""
    data = statistics.join(labels, row_id).where("chars > 0").orderBy(row_id).toPandas()
    return revise(induce_rules(data, "not_prose"), data, "not_prose")
