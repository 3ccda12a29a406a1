r"""Quality rules: a threshold table compiled into one projection.

Measures are expressions over the text; rules are rows of a table (measure, comparison, limit,
scope). Both compile to columns of one projection, so a text is read once, nothing is shuffled, and no user
function runs. Repeated three-word windows are found by sorting hashes of a text's windows with
their places, which costs n log n for a text of n words.

Edge cases: a null text has no words and fails; so does an empty one. Lines without a word are no
duplicates. Repeated rows are judged each by itself. An empty table gives none. A very long text
is judged whole, in one task. Other columns of the input are ignored, or, by ``keep_good``, given
back whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, field, restored


@dataclass(frozen=True)
class Threshold:
    """A text fails if ``measure`` is ``fails`` (below or above) ``limit``."""

    name: str
    measure: str
    fails: str
    limit: float


#: The production table. Base rules first.
THRESHOLDS = (
    Threshold("too_short", "n_words", "below", 50),
    Threshold("repeats_windows", "repeat_ratio", "above", 0.5),
    Threshold("symbols", "symbol_ratio", "above", 0.05),
    Threshold("duplicate_lines", "dup_line_ratio", "above", 0.5),
    Threshold("words_too_short", "mean_word", "below", 2.0),
    Threshold("words_too_long", "mean_word", "above", 18.0),
    Threshold("no_stop_words", "n_stop_words", "below", 2),
)

#: Common words of the languages that are kept; fixed values.
STOP_WORDS = tuple(
    "the of and to in is it that for was on are as with be at by this have from or"
    " der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch"
    " de la le et les des en un une du que est pour dans qui par sur au plus pas"
    " el los las y del se por con para una su al lo como más".split()
)


# sorted (hash, place) pairs; a place whose neighbour has its hash repeats; windows of three words
# from sorted places overlap where places are less than three apart
_GRAMS = "transform(sequence(0, size(words) - 3), i -> named_struct('h', xxhash64(words[i], words[i + 1], words[i + 2]), 'p', i))"
_PLACES = """sort_array(filter(transform(__sorted, (s, i) -> if(
    (i > 0 and get(__sorted, i - 1).h = s.h) or (i + 1 < size(__sorted) and get(__sorted, i + 1).h = s.h), s.p, null)), p -> p is not null))"""


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Base counts of each row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and n_lines, n_stop_words.

    With ``carry`` the columns of the input come along as the struct ``row``, as ``carried`` makes it.
    """
    keep = ["row"] if carry else []
    df = carried(docs).select(*keep, field(docs, id_col).alias("doc_id"), F.coalesce(field(docs, text_col).cast("string"), F.lit("")).alias("text"))
    blank = r"\x20\x09-\x0D"
    words = F.split(F.regexp_replace("text", rf"^[{blank}]+|[{blank}]+$", ""), rf"[{blank}]+")
    df = df.withColumn("words", F.filter(words, lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_like(x, F.lit(rf"[^{blank}]")))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    df = df.select(
        *keep,
        "doc_id",
        "words",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    df = df.select(
        "*",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_intersect("words", stop)).cast("long").alias("n_stop_words"),
        F.when(F.size("words") >= 4, F.sort_array(F.expr(_GRAMS))).alias("__sorted"),
    ).drop("words", "lines")
    df = df.withColumn("__p", F.expr(_PLACES)).drop("__sorted")
    overlap = F.zip_with(F.slice("__p", 2, F.greatest(F.size("__p") - 1, F.lit(0))), F.slice("__p", 1, F.greatest(F.size("__p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("__p") > 0, 3 + F.aggregate(overlap, F.lit(0), lambda n, x: n + x)).otherwise(0)
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__p")
    # a later filter on a measure must not be pushed into the expressions above: it would put whole
    # arrays into lambdas and compute them once for each element; nothing is pushed below a generator
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


#: Expressions that thresholds may name.
RATIOS = {
    "n_words": lambda: F.col("n_words"),
    "n_stop_words": lambda: F.col("n_stop_words"),
    "repeat_ratio": lambda: _ratio(F.col("n_repeat_words"), F.col("n_words")),
    "symbol_ratio": lambda: _ratio(F.col("n_symbols"), F.col("word_chars")),
    "dup_line_ratio": lambda: _ratio(F.col("n_dup_lines"), F.col("n_lines")),
    "mean_word": lambda: _ratio(F.col("word_chars"), F.col("n_words")),
}


def fails(rule: Threshold) -> Column:
    """Whether a row with the measures fails the rule."""
    value = RATIOS[rule.measure]()
    return value < rule.limit if rule.fails == "below" else value > rule.limit


def judge(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measures, ``failed`` (names of the rules that the row fails), base_failed and kept."""
    df = measures(docs, id_col, text_col, carry)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    names = F.array_compact(F.array(*[F.when(fails(t), F.lit(t.name)) for t in thresholds]))
    df = df.withColumns({"base_failed": base, "failed": names})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def keep_good(docs: DataFrame, thresholds: tuple[Threshold, ...] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, columns as before."""
    return restored(judge(docs, thresholds, id_col, text_col, carry=True).where("kept"), docs)
