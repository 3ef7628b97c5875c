"""Quality rules: a table of thresholds compiled into one Spark projection.

Counts come from one pass over the words of a row (arrays and lambdas inside the JVM, no Python on executors, no shuffle).
Null and empty texts have no words: every count is 0 and the row is rejected. Repeated rows are judged one by one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD

#: Words of a window whose repeats count, and the base rule's limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20

#: Frequent function words of the corpus's four languages.
STOP_WORDS = {
    "en": "the of and a to in is was that for it with as on are by be this from at or an not have which but".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un une du que qui est dans pour par sur au plus pas ne se avec il elle".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo es como más".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document of at least `words` words fails where `metric` lies outside [low, high]; metrics are columns that measures() makes."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    words: int = 0


#: Production thresholds.
RULES = (
    Rule("word_length", "mean_word_chars", low=1.5, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("stop_words", "stop_ratio", low=0.05, words=40),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(WINDOW)]


def _repeated(words: Column) -> Column:
    """Words covered by windows that occur twice or more; exact, by sorting (window, start) pairs of the row."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    pairs = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("k"), i.alias("i"))))

    def covered(s: Column) -> Column:
        key = lambda j: F.get(s, j)["k"]
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (key(j) == key(j - 1)) | (key(j) == key(j + 1)))
        at = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(
            at, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
        )

    return _let(pairs, covered)


def repeat_words(words: Column) -> Column:
    """As _repeated, which runs only for rows where two windows have the same hash: equal windows always have."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*_window(words, i)))
    some = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _repeated(words)).otherwise(0))
    return F.when(F.size(words) < WINDOW, 0).otherwise(some).cast("long")


def measures(text: Column) -> Column:
    """A struct of the counts and ratios of one text; ratios of an empty text are 0."""
    text = F.coalesce(text, F.lit(""))
    stops = sorted({w for ws in STOP_WORDS.values() for w in ws})
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))

    def counts(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stops))).cast("long").alias("n_stop_words"),
        )

    raw = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: _let(lines, lambda x: counts(w, x)))
    ratio = lambda m, a, b: F.when(m[b] > 0, m[a] / m[b]).otherwise(0.0)
    return _let(
        raw,
        lambda m: F.struct(
            *[m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")],
            ratio(m, "word_chars", "n_words").alias("mean_word_chars"),
            ratio(m, "n_symbols", "n_words").alias("symbol_ratio"),
            ratio(m, "n_stop_words", "n_words").alias("stop_ratio"),
            ratio(m, "n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)


def failures(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one array expression: names of the rules that a row breaks."""
    broken = []
    for r in rules:
        if r.low is not None:
            broken.append(F.when((m["n_words"] >= r.words) & (m[r.metric] < r.low), F.lit(r.name)))
        if r.high is not None:
            broken.append(F.when((m["n_words"] >= r.words) & (m[r.metric] > r.high), F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """m (measures), base_failed, failed (rule names) and kept as one struct. One expression: Spark copies an expression to each place that
    refers to it, such as a filter that it pushes down, and the measures must be taken once."""

    def judge(m: Column) -> Column:
        failed = failures(m, rules)
        return F.struct(m.alias("m"), base_failed(m).alias("base_failed"), failed.alias("failed"), (~base_failed(m) & (F.size(failed) == 0)).alias("kept"))

    return _let(measures(text), judge)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """row (all columns of docs as a struct, whatever their names), m (measures), base_failed, failed (rule names), kept."""
    return docs.select(F.struct("*").alias("row"), verdict(F.col(text), rules).alias("v")).select("row", "v.m", "v.base_failed", "v.failed", "v.kept")


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs without the rows that the rules reject; same columns."""
    return docs.where(verdict(F.col(text), rules)["kept"])
