"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a built-in expression, so the whole operator is one projection
over the scan: no shuffle, no user function.  A text of any length is read whole.

Defined results: a null or empty text has no words and fails `n_words`; a text
of blanks alone likewise; repeated rows are judged each for itself; an empty
table gives an empty one.  Only the id and the text are read, so other columns
may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of a word, symbols counted, and frequent words of the supported languages.
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "with", "be",
    "de", "la", "le", "les", "et", "des", "un", "une", "que", "en",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "ein", "ist",
    "el", "los", "las", "y", "se", "del", "por", "con", "una", "al",
]


@dataclass(frozen=True)
class Rule:
    """Fails where `measure` lies outside [least, most]; None is no bound."""

    measure: str
    least: float | None = None
    most: float | None = None


#: The first two rows are the base; a document is kept if no row fails.
BASE_RULES = (Rule("n_words", least=50), Rule("repeat_ratio", most=0.5))
RULES = (
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbol_ratio", most=0.1),
    Rule("stop_words", least=2),
    Rule("dup_line_ratio", most=0.3),
    Rule("letter_ratio", least=0.6),
)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def measures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the ratios of RULES."""
    t = F.coalesce(F.col("_t"), F.lit(""))
    gone = ""
    d = df.select(F.col(key), F.col(text).alias("_t"))
    d = d.withColumn("_w", words_of(t))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    n = F.size("_w")
    # windows of three words by hash, each with its place; equal hashes stand together once sorted
    d = d.withColumn(
        "_win",
        F.when(n >= 3, F.sort_array(F.transform(F.slice("_h", 1, F.greatest(n - 2, F.lit(1))), lambda h, i: F.struct(F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)).alias("k"), i.alias("i"))))),
    )
    near = lambda x, i: (F.get("_win", i - 1)["k"] == x["k"]) | (F.get("_win", i + 1)["k"] == x["k"])
    d = d.withColumn("_rep", F.sort_array(F.transform(F.filter("_win", lambda x, i: F.coalesce(near(x, i), F.lit(False))), lambda x: x["i"])))
    # a repeated window covers three words, fewer where the next repeated window starts inside it
    d = d.withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform("_rep", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("_rep", i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACES, gone)) > 0)
    d = d.withColumn("_l", lines)
    low = F.aggregate("_w", F.lit(0), lambda a, w: a + F.when(w.isin(STOP_WORDS), 1).otherwise(0))
    length = lambda c: F.length(c).cast("long")
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": length(F.translate(t, SPACES, gone)),
        "n_symbols": length(t) - length(F.translate(t, SYMBOLS, gone)),
        "_lines": F.size("_l").cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        "stop_words": low,
        "_marks": length(F.translate(t, SPACES, gone)) - length(F.translate(t, SPACES + "0123456789.,;:!?'\"()[]{}-_/\\+=~`@^" + SYMBOLS, gone)),
    })
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return d.withColumns({
        "mean_word_chars": share("word_chars", "n_words"),
        "symbol_ratio": share("n_symbols", "n_words"),
        "dup_line_ratio": share("n_dup_lines", "_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "letter_ratio": 1 - share("_marks", "word_chars"),
    }).drop("_t", "_w", "_h", "_win", "_rep", "_l", "_lines", "_marks")


def fails(rule: Rule) -> Column:
    c = F.col(rule.measure)
    tests = [c < rule.least] * (rule.least is not None) + [c > rule.most] * (rule.most is not None)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The key with its measures, base_failed, failed_rules (names) and kept."""
    d = measures(df, key, text).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    names = [F.when(fails(r), F.lit(r.measure)) for r in (*BASE_RULES, *rules)]
    return d.withColumn("failed_rules", F.array_compact(F.array(*names))).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
