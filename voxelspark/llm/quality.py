"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, let

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from had has have he her his i in is it not of on or she that the their they this to was were which with you",
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous on ou par pas plus pour qui que sa se son sur un une",
    "als am auch auf aus bei das dem den der des die ein eine einer er es für hat ich im in ist mit nicht sich sie sind und von war zu zum",
    "al como con de del el en es este fue ha la las lo los más no o para pero por que se su sus un una y",
)
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: the ratio num / den must lie in [low, high]; a zero denominator passes."""

    name: str
    num: str
    den: str
    low: float | None = None
    high: float | None = None


#: The threshold table in use. Metrics: see metrics().
RULES = (
    Rule("too_short", "n_words", "one", low=20),
    Rule("word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols", "n_symbols", "n_words", high=0.25),
    Rule("stop_words", "n_stop_words", "n_words", low=0.05),
    Rule("shouting", "n_capitals", "word_chars", high=0.4),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.6),
)


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of `window` words that occur twice or more; hashes: one long per word.

    window is a power of two. Windows are compared by a 64-bit hash. Only a text with a repeated window is sorted, in n log n.
    """

    def covered(starts: Column) -> Column:
        last = F.size(starts) - 1
        step = lambda j: F.when(j == last, F.lit(window)).otherwise(
            F.least(F.lit(window), F.get(starts, j + 1) - F.get(starts, j))
        )
        return F.when(last < 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda acc, j: acc + step(j)))

    def marked(ranked: Column) -> Column:
        same = lambda j, k: F.coalesce(F.get(ranked, j)["h"] == F.get(ranked, k)["h"], F.lit(False))
        twin = F.filter(F.sequence(F.lit(0), F.size(ranked) - 1), lambda j: (same(j, j + 1)) | ((j > 0) & same(j, F.greatest(j - 1, F.lit(0)))))
        return let(F.array_sort(F.transform(twin, lambda j: F.get(ranked, j)["i"])), covered)

    def of_windows(keys: Column) -> Column:
        pairs = F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(let(F.sort_array(pairs), marked))

    def doubled(h: Column, half: int) -> Column:
        n = F.size(h) - half
        return F.zip_with(F.slice(h, 1, n), F.slice(h, half + 1, n), lambda x, y: F.xxhash64(x, y))

    def grown(h: Column, width: int) -> Column:
        return let(h, of_windows) if width == window else let(doubled(h, width), lambda x: grown(x, 2 * width))

    # Hashes of windows of 2, 4, 8, ... words, each from two of the half width.
    return let(hashes, lambda h: F.when(F.size(h) <= window, F.lit(0)).otherwise(grown(h, 1)))


def metrics(text: Column) -> dict[str, Column]:
    """Name -> long column, for a text; null counts as the empty text.

    words: `[^\\x20\\x09-\\x0D]+`; lines: \\n-split parts that have a word; stop words: of the
    lower-cased text, also split at punctuation; capitals: code points in runs of two or more. Whole texts are read.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    plain = F.split(F.lower(text), r"[\x20\x09-\x0D.,;:!?]+")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted({w for group in STOP_WORDS for w in group.split()})
    joined = lambda pattern: F.length(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), "")).cast("long")
    counted = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(F.transform(w, lambda x: F.xxhash64(x))).cast("long").alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return {
        "counted": counted,
        "by_line": by_line,
        "n_stop_words": F.size(F.filter(plain, lambda w: w.isin(stop))).cast("long"),
        "n_symbols": joined(f"[{SYMBOLS}]+"),
        "n_capitals": joined(r"\p{Lu}{2,}"),
        "one": F.lit(1).cast("long"),
    }


def compile_rules(rules: tuple[Rule, ...] = RULES, metric: Callable[[str], Column] = F.col) -> Column:
    """The threshold table as one array column: the names of the rules that a row of metrics breaks."""
    broken = []
    for r in rules:
        num, den = metric(r.num), metric(r.den)
        out = F.lit(False)
        if r.low is not None:
            out = out | (num < den * F.lit(float(r.low)))
        if r.high is not None:
            out = out | (num > den * F.lit(float(r.high)))
        broken.append(F.when((den > 0) & out, F.lit(r.name)))
    return F.filter(F.array(*broken), lambda x: x.isNotNull())


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id_col, the metrics, base_failed, kept and the broken rules.

    base_failed: fewer than 20 words, or over 30 % of the words in repeated windows. kept: neither base_failed nor any
    rule broken. A null or empty text has zeros and fails; a null id stays null; equal rows give equal rows; columns
    other than the two are ignored. One narrow projection: no shuffle and no user function.
    """
    m = metrics(F.col("__text"))
    measured = (
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
        .select("__id", *(c.alias(k) for k, c in m.items()))
        .select("__id", "counted.*", "by_line.*", *(k for k in m if k not in ("counted", "by_line")))
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.select("*", failed.alias("base_failed"), compile_rules(rules).alias("broken"))
    return judged.select(
        F.col("__id").alias(id_col),
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"),
        "n_stop_words", "n_capitals", "n_lines", "broken",
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with all their columns, in one projection and filter.

    A row is judged by its text alone, so ids, null or repeated, do not matter, and equal rows stay or go together; null,
    empty and blank texts have no words and go. No rows give no rows.
    """
    # One expression, or the filter would be pushed below the metrics and compute them once for each use.
    m = metrics(F.col(text_col))

    def good(all_metrics: Column) -> Column:
        group = {"n_words": "counted", "word_chars": "counted", "n_repeat_words": "counted", "n_lines": "by_line", "n_dup_lines": "by_line"}
        metric = lambda name: all_metrics[group[name]][name] if name in group else all_metrics[name]
        failed = (metric("n_words") < 20) | (100 * metric("n_repeat_words") > 30 * metric("n_words"))
        return ~failed & (F.size(compile_rules(rules, metric)) == 0)

    return docs.where(let(F.struct(*(c.alias(k) for k, c in m.items())), good))
