"""Quality rules with adaptive thresholds (operator 7), in DataFrame operations only.

Method: every text is measured in its own row (no exploded words, no shuffle of
texts).  Quantile sketches of the measures are built for each language and source
(Spark's mergeable quantile summaries, so a hot source is summed up where its rows
are) and turned into thresholds; the measured rows meet the thresholds of their
group in a join.  The table of thresholds is broadcast if its size allows it, so that no
text is shuffled; a longer one is joined by group and salt, with the same result.

A text fails the base rules if it has too few words or repeats itself too much.
Of the others, the sketches give the 10th, 50th and 90th percentile of symbols per
word, repeated lines per line, and characters per word.  A text is kept if none of
these lies further above its group's median than ``FENCE`` times the distance from the
10th percentile to the median (nor, for characters per word, further below than
``FENCE`` times the distance up to the 90th), distances counting as ``SPREADS`` at least.
The spread is taken on the far side of the median, so that up to half of a group
may be junk without moving its own threshold.  A group of under ``LEAST`` rows uses the
thresholds of its language, a language of under ``LEAST`` rows those of all.

Words are runs of characters other than white space; windows of ``WINDOW`` words are
compared by a 64-bit hash of their words.

Defined results: null and empty texts have no words and fail the base rules; a
null language or source is a group of its own; repeated rows are judged alike; an
empty table gives no rows; other columns are carried along by ``kept_documents``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits_broadcast, keep

WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
FENCE, LEAST, SALTS = 3.0, 30, 16
#: The least spread of symbols per word, repeated lines per line and characters per word.
SPREADS = {"symbol_share": 0.05, "line_share": 0.15, "word_length": 0.5}
FENCES = ("symbol_most", "line_most", "length_least", "length_most")
ACCURACY = 10_000
WHITE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def measured(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to the rows.

    Intermediate columns stand in selects of their own, each used more than once, so that they are computed once.
    """
    names = docs.columns
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in names]
    rows = docs.select(F.struct(*kept).alias("row"), F.filter(F.split(text, WHITE), lambda w: w != "").alias("words"),
                       F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "").alias("lines"), text.alias("whole"))
    rows = rows.select("row", F.size("words").alias("n"), _without(F.col("whole"), " \t\n\x0b\x0c\r").alias("word_chars"),
                       (F.char_length("whole") - _without(F.col("whole"), SYMBOLS)).alias("n_symbols"),
                       (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.size("lines").alias("n_lines"),
                       F.when(F.size("words") > WINDOW, F.expr(
                           f"transform(sequence(1, size(words) - {WINDOW - 1}), i -> xxhash64(slice(words, i, {WINDOW})))")).alias("windows"))
    # Most texts repeat no window; only the others are sorted.
    rows = rows.withColumn("ordered", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.expr("filter(transform(sequence(0, size(ordered) - 1), k -> "
                   "if(get(ordered, k - 1).h = get(ordered, k).h or get(ordered, k + 1).h = get(ordered, k).h, get(ordered, k).i, null)), i -> i is not null)")
    rows = rows.withColumn("starts", F.when(F.col("ordered").isNotNull(), F.array_sort(twice)))
    covered = F.expr(f"aggregate(sequence(0, size(starts) - 1), 0L, (sum, k) -> sum + least({WINDOW}, coalesce(get(starts, k + 1) - get(starts, k), {WINDOW})))")
    rows = rows.withColumn("n_repeat_words", F.when(F.col("starts").isNotNull(), covered).otherwise(0))
    n = F.col("n").cast("bigint")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    return rows.select("row.*", n.alias("n_words"), *[F.col(c).cast("bigint").alias(c) for c in BASE[1:]],
                       failed.alias("base_failed"), F.col("n_lines").cast("bigint").alias("n_lines"))


def _key(value: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{value}`").cast("string")), F.lit(""))


def _keyed(rows: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (rows.withColumn("group_lang", _key(lang_col)).withColumn("group_source", _key(source_col))
            .withColumn("symbol_share", F.col("n_symbols") / n).withColumn("line_share", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
            .withColumn("word_length", F.col("word_chars") / n))


def thresholds(rows: DataFrame) -> DataFrame:
    """From measured, keyed rows: symbol_most, line_most, length_least and length_most for each group_lang and group_source."""
    sketches = [F.percentile_approx(c, [0.1, 0.5, 0.9], ACCURACY).alias(c) for c in SPREADS]
    lang, source = F.col("group_lang"), F.col("group_source")
    levels = (rows.where(~F.col("base_failed")).groupingSets([[lang, source], [lang], []], lang, source)
              .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("rows"), *sketches))

    def spread(c: str, upper: bool) -> Column:
        low, mid, high = (F.get(c, F.lit(k)) for k in range(3))
        return F.greatest((mid - low) if upper else (high - mid), F.lit(SPREADS[c])) * FENCE

    def fence(c: str, upper: bool) -> Column:
        return F.get(c, F.lit(1)) + (spread(c, True) if upper else -spread(c, False))

    sides = [("symbol_share", True), ("line_share", True), ("word_length", False), ("word_length", True)]
    fences = F.struct(*[fence(c, upper).alias(name) for name, (c, upper) in zip(FENCES, sides)])
    levels = keep(levels.select("group_lang", "group_source", "level", "rows", fences.alias("fences")))
    own, langs = (levels.where(F.col("level") == k) for k in (0, 1))
    langs = langs.select("group_lang", F.col("rows").alias("lang_rows"), F.col("fences").alias("lang_fences"))
    # The fences of all rows are one row of four numbers.
    whole = levels.where(F.col("level") == 3).select("fences.*").first()
    of_all = F.struct(*[F.lit(v).cast("double").alias(c) for c, v in zip(FENCES, whole or [None] * len(FENCES))])
    chosen = F.when(F.col("rows") >= LEAST, F.col("fences")).when(F.col("lang_rows") >= LEAST, F.col("lang_fences")).otherwise(of_all)
    return own.join(langs, "group_lang").select("group_lang", "group_source", chosen.alias("f")).select("group_lang", "group_source", "f.*")


def judged(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Add kept to measured, keyed rows."""
    keys = ["group_lang", "group_source"]
    if not fits_broadcast(limits, *keys):
        rows = rows.withColumn("salt", F.pmod(F.hash("word_chars", "n_words", "n_symbols"), F.lit(SALTS)))
        limits = limits.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
        keys.append("salt")
    else:
        limits = F.broadcast(limits)
    inside = ((F.col("symbol_share") <= F.col("symbol_most")) & (F.col("line_share") <= F.col("line_most"))
              & F.col("word_length").between(F.col("length_least"), F.col("length_most")))
    # A group all of whose rows failed the base rules has no thresholds, and needs none.
    return (rows.join(limits, keys, "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))))


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """For each document: its id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    rows = keep(_keyed(measured(slim).drop("text"), "lang", "source"))
    return judged(rows, thresholds(rows)).select("doc_id", *BASE, "base_failed", "kept")


def kept_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns.

    Texts are measured once: the rows with their measures stay on disk (Spark's cache, recomputed where an executor is lost)
    between the sketches and the join.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col(f"`{text_col}`").alias("text"),
                      F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"))
    rows = _keyed(measured(row).drop("text"), "lang", "source").persist(StorageLevel.DISK_ONLY)
    return judged(rows, thresholds(rows)).where("kept").select("document.*")
