"""Quality rules: a decision list learned by sequential covering, applied as ordered Spark conditions, beside fixed base rules.

Measures of a text are counts and ratios (``MEASURES``). From labelled texts, rules that reject are grown one after the other: threshold
conditions are added to a conjunction as long as they gain information (FOIL's measure) on two thirds of the rows; on the other third
the conjunction is cut back to the prefix with the best (p - n) / (p + n); it enters the list if its precision there is at least
``PRECISION``, and the rows it covers go. The list is read in order, as one CASE expression; what no rule rejects is kept.

The statistics come from at most ``MOST_LABELLED`` labelled rows, those with the smallest hashes, which is what reaches the driver.

A null text is empty: it has no words, fails the base rule and is not kept. Repeated rows are judged alike. Without labelled rows the
list is empty and only the base rules judge. A label that is null counts as none; a document labelled twice counts twice.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ID, TEXT, text_function

MOST_LABELLED, PRECISION, LEAST_COVER, MOST_RULES, MOST_CONDITIONS, THRESHOLDS = 20_000, 0.97, 5, 20, 4, 64
WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("chars_per_word", "symbols_per_word", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digits_per_word", "bangs_per_word", "distinct_ratio", "words_per_line")
MEASURES = ("n_words", *RATIOS)


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """(words within 3-word windows found twice or more, distinct words)."""
    n, first = len(words), {}
    x = np.fromiter(map(first.setdefault, words, range(n)), np.int64, n)
    if n < 4:
        return 0, len(first)
    if n < 1 << 21:
        window = (x[:-2] * n + x[1:-1]) * n + x[2:]
    else:
        window = np.unique(x[:-2] * n + x[1:-1], return_inverse=True)[1] * n + x[2:]
    ordered = np.sort(window)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0, len(first)
    at = np.flatnonzero(np.isin(window, twice))
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[at + k] = True
    return int(cover.sum()), len(first)


def measure(text: str) -> dict:
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    repeats, distinct = repeated_words(words)
    n = len(words)
    out = {"n_words": n, "word_chars": len(text) - sum(map(text.count, WHITE)), "n_symbols": sum(map(text.count, SYMBOLS)),
           "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats}
    upper, lower, digits = (len(raw) - len(raw.translate(None, x)) for x in (UPPER, LOWER, DIGITS))
    some = max(1, n)
    return out | {"chars_per_word": out["word_chars"] / some, "symbols_per_word": out["n_symbols"] / some, "dup_line_ratio": out["n_dup_lines"] / max(1, len(lines)),
                  "repeat_ratio": repeats / some, "upper_ratio": upper / max(1, upper + lower), "digits_per_word": digits / some, "bangs_per_word": text.count("!") / some,
                  "distinct_ratio": distinct / some, "words_per_line": n / max(1, len(lines))}


KIND = "struct<" + ", ".join([f"{c}: bigint" for c in COUNTS] + [f"{c}: double" for c in RATIOS]) + ">"


def measures(text: Column) -> Column:
    return text_function(lambda: lambda texts: [measure(t) for t in texts], KIND)(text)


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def holds(self, m: Column) -> Column:
        return m[self.name] > self.cut if self.above else m[self.name] <= self.cut

    def __str__(self):
        return f"{self.name} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, bool)
    for c in rule:
        out &= (x[c.name] > c.cut) == c.above
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while len(rule) < MOST_CONDITIONS and (inside & ~bad).any():
        p, n = (inside & bad).sum(), (inside & ~bad).sum()
        best, gain = None, 0.0
        for name, v in x.items():
            values = np.unique(v[inside])
            if len(values) < 2:
                continue
            middles = (values[1:] + values[:-1]) / 2
            for cut in np.unique(middles[np.linspace(0, len(middles) - 1, min(THRESHOLDS, len(middles))).astype(int)]):
                high = inside & (v > cut)
                for above, part in ((True, high), (False, inside & ~high)):
                    q, m = (part & bad).sum(), (part & ~bad).sum()
                    if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain + 1e-9:
                        best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule += (best,)
        inside &= _covers((best,), x, len(bad))
    return rule


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 3) -> list[Rule]:
    """The ordered rules that reject."""
    rules: list[Rule] = []
    order = np.random.default_rng(seed).permutation(len(bad))
    x, bad = {k: v[order] for k, v in x.items()}, bad[order]
    while len(rules) < MOST_RULES and bad.sum() >= LEAST_COVER:
        third = np.arange(len(bad)) % 3 == 2
        part = lambda mask: {k: v[mask] for k, v in x.items()}
        if not (bad & ~third).any() or not (bad & third).any():
            break
        rule, best = _grow(part(~third), bad[~third]), None
        held, held_bad = part(third), bad[third]
        for k in range(1, len(rule) + 1):
            got = _covers(rule[:k], held, len(held_bad))
            p, n = (got & held_bad).sum(), (got & ~held_bad).sum()
            if p + n and (best is None or (p - n) / (p + n) > best[0]):
                best = ((p - n) / (p + n), k)
        if best is None:
            break
        rule = rule[:best[1]]
        got = _covers(rule, x, len(bad))
        if got.sum() < LEAST_COVER or (got & bad).sum() < PRECISION * got.sum() or best[0] < 2 * PRECISION - 1:
            break
        rules.append(rule)
        x, bad = {k: v[~got] for k, v in x.items()}, bad[~got]
    return rules


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    labelled = labels.where("quality is not null").select(F.col(ID).alias("_id"), "quality").orderBy(F.xxhash64("_id"), "_id", "quality").limit(most)
    rows = docs.select(ID, TEXT).join(F.broadcast(labelled), F.col(ID) == F.col("_id")).select("quality", measures(F.col(TEXT)).alias("m")).select("quality", *(F.col("m")[c].alias(c) for c in MEASURES)).toPandas()
    return learn({c: rows[c].to_numpy(float) for c in MEASURES}, rows["quality"].to_numpy() == 0)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def rejected_by(rules: list[Rule], m: Column) -> Column:
    """The first rule that holds, as text; null if none does."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.holds(m)
        name = F.lit(" and ".join(map(str, rule)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(None).cast("string") if out is None else out


def judge(docs: DataFrame, rules: list[Rule], id_col: str = ID, text_col: str = TEXT) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule)`` of every row."""
    m = F.col("m")
    out = docs.select(F.col(id_col).alias(ID), measures(F.col(text_col)).alias("m")).select(ID, *(m[c].alias(c) for c in COUNTS), base_failed(m).alias("base_failed"), rejected_by(rules, m).alias("rule"))
    return out.select(ID, *COUNTS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows that neither the base rules nor the list rejects, all columns kept."""
    m = F.col("_measures")
    return docs.withColumn("_measures", measures(F.col(TEXT))).where(~base_failed(m) & rejected_by(rules, m).isNull()).select(docs.columns)
