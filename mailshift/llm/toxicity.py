"""Toxicity scores from class-conditional language models (operator 2).

Method: Kneser-Ney models of toxic and of ordinary texts; a text's log-likelihoods
under both are compared, normalised by its length.  Expressions are pairs of
adjacent words, given the first, and words, each counted once for each text that
holds it.  A pair backs off to its second word, a word to its first 6 and its first 4
bytes, and these are weighed, as Kneser-Ney does, by how many different words
continue them and not by how often.  At every level each
class has a model of its own, and the counts of both classes together are the shared
backoff.  The absolute discount of a class is the Kneser-Ney estimate n1 / (n1 + 2 n2), by
the numbers of its words found in one text and in two; it holds on all levels.  What is in few toxic
texts (``FEW`` at most), or is not at least exp(``TELLING``) times likelier by the discounted toxic count
than by the ordinary one (half a text where that has none; first bytes: ``FEW_FORMS``
words, ``TELLING_FORMS``), gives its whole count to the
backoff in both models, as a count cut-off does: it would add noise for each rare word of a text,
and the list would grow with the vocabulary.  What a model does not keep of its mass it hands to
the backoff, so both remain distributions; of a word that no labelled text has, all of it.

The counts are Spark tables by the expression itself, over every labelled row of the
folds in ``LEARN`` and, in the same pass, of those and ``TUNE``.  Pairs are counted in toxic
texts first; only those in more than ``FEW`` of them (told by a bitmap of
fixed size, then by their exact counts) are counted in all.  To the driver and the executors goes
what tells the classes apart, a short list.  A logistic curve over two length-normalised differences (by the number of words, and
by its square root; of a text's summed difference what as many words of which nothing is told would sum to is taken off) turns them into a score; it is fitted on at most ``CURVE_ROWS``
labelled rows of the fold ``TUNE``, by the counts that have not seen them, and then used
with the counts of all four folds.  Rows of fold 0 are held out.

Defined results: null and empty texts have no words and get the score of a
difference of zero; repeated rows get equal scores; labels that are null are left
out; with no labelled rows of one of the classes every score is 0; an empty table
gives no rows; other columns of the documents are carried along, but for ones named
``score`` and ``predicted``, which the results of ``with_scores`` replace.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from operator import itemgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep

STEM_BYTES = (4, 6)
FEW, TELLING = 4, 2.0
FEW_FORMS, TELLING_FORMS = 2, 1.2
FOLDS, LEARN, TUNE = 5, (1, 2, 3), 4
CURVE_ROWS = 20_000
IN_TASK, CACHED, BITS = 60_000, 100_000, 1 << 25

#: ASCII characters other than letters and digits become blanks.
_BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_BLANKS).split()


def fold(key: Column) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(FOLDS))


class _Logs(dict):
    """The log of the likelihood ratio of each word, without the one before it; kept for as many words as fit."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def __missing__(self, word: bytes) -> float:
        if len(self) >= CACHED:
            self.clear()
        self[word] = value = math.log(self.model.ratio(word))
        return value

    def __reduce__(self) -> tuple:
        return _Logs, (self.model,)


#: Of the toxic and of the ordinary model.
Both = tuple[float, float]


@dataclass
class Level:
    """Of one length of expressions, those that tell the classes apart: what each model keeps, over the shared share; and the mass that each hands on."""

    ratios: dict[bytes, Both]
    handed: Both

    def over(self, expression: bytes, below: Both) -> Both:
        """The likelihoods under both models, over the shared one, given those of the backoff."""
        own = self.ratios.get(expression, (0.0, 0.0))
        return own[0] + self.handed[0] * below[0], own[1] + self.handed[1] * below[1]

    @cached_property
    def log_handed(self) -> float:
        return math.log(self.handed[0] / self.handed[1])


@dataclass
class Model:
    """Likelihood ratios of toxic to ordinary: of stems and words, and of pairs by the first word."""

    stems: list[Level]
    words: Level
    pairs: dict[bytes, Level]
    curve: np.ndarray

    def __post_init__(self) -> None:
        self.logs = _Logs(self)
        # Of a word of which nothing is told: both models hand it on.
        self.common = math.fsum(level.log_handed for level in (*self.stems, self.words))

    def likelihoods(self, word: bytes) -> Both:
        """Of a word by itself, under both models, over the shared likelihood."""
        value = (1.0, 1.0)
        for size, level in zip(STEM_BYTES, self.stems):
            value = level.over(word[:size], value)
        return self.words.over(word, value)

    def ratio(self, word: bytes) -> float:
        toxic, ordinary = self.likelihoods(word)
        return toxic / ordinary

    def difference(self, text: str | None) -> tuple[float, int]:
        """Summed difference of a whole text, beyond that of as many words of which nothing is told, and its number of words."""
        words, logs, firsts = words_of(text), self.logs, self.pairs
        total = math.fsum(map(logs.__getitem__, words)) - len(words) * self.common
        if not firsts.keys().isdisjoint(words):
            for first, word in zip(words, words[1:]):
                if first in firsts:
                    level = firsts[first]
                    if word in level.ratios:
                        toxic, ordinary = level.over(word, self.likelihoods(word))
                        total += math.log(toxic / ordinary) - logs[word]
                    else:
                        # A pair that tells nothing backs off to its word, of which a share is handed on.
                        total += level.log_handed
        return total, len(words)

    def score(self, text: str | None) -> float:
        total, n = self.difference(text)
        if not self.curve.any():
            return 0.0
        z = float(self.curve @ normalised(total, n))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def normalised(total: float, n: int) -> np.ndarray:
    return np.array([1.0, total / (n + 1), total / math.sqrt(n + 1)])


#: Texts of each class that hold an expression: in all folds that may be learned from, and in LEARN alone.
COUNTS = ("toxic", "ordinary", "toxic_learn", "ordinary_learn")
WORD, PAIR, FIRST = 1, 2, 3


def marked(values: DataFrame) -> DataFrame:
    """From a column bit (0 to BITS - 1): bucket and bitmap, a set of a fixed size in which every value is found."""
    bit = F.col("bit") + 1
    return values.select(F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))


def bitmap(rows: DataFrame, value: Column) -> bytes:
    """A set of ``BITS`` bits in which the crc32 of every value is found: 4 MB, however many."""
    bits = np.zeros(BITS >> 3, dtype="uint8")
    for r in marked(rows.select(F.pmod(F.crc32(value), F.lit(BITS)).alias("bit"))).toLocalIterator():
        bits[(r.bucket - 1) * 4096:r.bucket * 4096] = np.frombuffer(r.bitmap, dtype="uint8")
    return bits.tobytes()


def class_counts(labelled: DataFrame, wanted: Broadcast | None = None) -> DataFrame:
    """From rows of text, toxic and tune (booleans): COUNTS of each word, of all pairs by their first word, and of each pair in toxic texts alone.

    The row without an expression has the sum of the words.  Given a bitmap of pairs, the counts of these pairs in the texts of both classes.
    Pairs in FEW toxic texts are not returned.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each class and fold: words, first words and pairs, in how many texts.
        seen = {(toxic, tune): (Counter(), Counter(), Counter()) for toxic in (True, False) for tune in (True, False)}

        def rows() -> Iterator[pa.RecordBatch]:
            """One batch for each counter, emptied as it goes; the aggregate adds up an expression's rows."""
            for (toxic, tune), counted in seen.items():
                for kind, counter in zip((WORD, FIRST, PAIR), counted):
                    if not counter:
                        continue
                    size, n = len(counter), pa.array(list(counter.values()), pa.int64())
                    firsts = pa.array([x for x, _ in counter], pa.binary()) if kind == PAIR else pa.nulls(size, pa.binary())
                    found = pa.array([x for _, x in counter] if kind == PAIR else list(counter), pa.binary())
                    counter.clear()
                    zero = pa.repeat(pa.scalar(0, pa.int64()), size)
                    own = (toxic, not toxic, toxic and not tune, not toxic and not tune)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(kind, pa.int32()), size), firsts, found, *[n if x else zero for x in own]],
                                                     names=["kind", "first", "expression", *COUNTS])

        for batch in batches:
            for text, toxic, tune in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = words_of(text.as_py())
                by_word, by_first, by_pair = seen[toxic, tune]
                pairs = set(zip(words, words[1:]))
                if wanted is None:
                    single = set(words)
                    by_word.update(single)
                    by_word[None] += len(single)
                    by_first.update(map(itemgetter(0), pairs))
                    if toxic:
                        by_pair.update(pairs)
                else:
                    bits = wanted.value
                    for pair in pairs:
                        bit = crc32(b" ".join(pair)) % BITS
                        if bits[bit >> 3] >> (bit & 7) & 1:
                            by_pair[pair] += 1
                if sum(len(c) for counted in seen.values() for c in counted) >= IN_TASK:
                    yield from rows()
        yield from rows()
        pa.default_memory_pool().release_unused()

    rows = labelled.select("text", "toxic", "tune").mapInArrow(count, "kind int, first binary, expression binary, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return rows.groupBy("kind", "first", "expression").agg(*[F.sum(c).alias(c) for c in COUNTS]).where((F.col("kind") != PAIR) | (F.col("toxic") > FEW))


def all_counts(labelled: DataFrame) -> DataFrame:
    """COUNTS of words, of first words, and of the pairs that are in more than FEW toxic texts; no others can tell the classes apart."""
    found = keep(class_counts(labelled))
    pair = F.col("kind") == PAIR
    shared = labelled.sparkSession.sparkContext.broadcast(bitmap(found.where(pair), F.concat("first", F.lit(b" "), "expression")))
    pairs = keep(class_counts(labelled, shared))
    shared.unpersist()
    return found.where(~pair).union(pairs)


def _kept(count: Column, of_all: Column, discount: float) -> Column:
    """What a model keeps of a count after the absolute discount, as a share of its class."""
    return F.greatest(count - F.lit(discount), F.lit(0.0)) / F.greatest(of_all, F.lit(0.5))


def _discount(once: int, twice: int) -> float:
    """The Kneser-Ney estimate by the numbers of expressions found once and twice; a half where there are none."""
    return once / (once + 2 * twice) if once + twice else 0.5


def _level(rows: list) -> Level:
    return Level({bytes(r.expression): (r.toxic_kept / r.shared, r.ordinary_kept / r.shared) for r in rows},
                 (1 - math.fsum(r.toxic_kept for r in rows), 1 - math.fsum(r.ordinary_kept for r in rows)))


def models(counts: DataFrame) -> tuple[Model, Model] | None:
    """Of the counts, kept: the model of LEARN and that of all folds but the one held out; none if a class has no words in LEARN."""
    words = counts.where((F.col("kind") == WORD) & F.col("expression").isNotNull())
    totals = counts.where((F.col("kind") == WORD) & F.col("expression").isNull()).first()
    if totals is None or not totals["toxic_learn"] or not totals["ordinary_learn"]:
        return None

    def model(toxic: str, ordinary: str) -> Model:
        t, o = F.col(toxic), F.col(ordinary)

        def telling(rows: DataFrame, all_toxic: Column, all_ordinary: Column, few: int = FEW, least: float = TELLING) -> DataFrame:
            told = rows.withColumns({"toxic_kept": _kept(F.col("t"), all_toxic, discounts[0]), "ordinary_kept": _kept(F.col("o"), all_ordinary, discounts[1])})
            likely = F.lit(math.exp(least)) * (F.col("o") + 0.5) / F.greatest(all_ordinary, F.lit(0.5))
            return told.where((F.col("t") > few) & (F.col("toxic_kept") > likely))

        def plain(rows: DataFrame, all_t: int, all_o: int, n: int, *least: float) -> Level:
            return _level(telling(rows, F.lit(all_t), F.lit(all_o), *least).withColumn("shared", F.col("n") / F.lit(n)).collect())

        seen = words.where(t + o > 0)
        sizes = seen.agg(F.count_if(t > 0).alias("t"), F.count_if(o > 0).alias("o"), F.count(F.lit(1)).alias("n"),
                         *[F.count_if(c == k).alias(f"{name}{k}") for name, c in (("t", t), ("o", o)) for k in (1, 2)]).first()
        discounts = _discount(sizes.t1, sizes.t2), _discount(sizes.o1, sizes.o2)
        stems = [plain(seen.groupBy(F.substring("expression", 1, size).alias("expression"))
                       .agg(F.count_if(t > 0).alias("t"), F.count_if(o > 0).alias("o"), F.count(F.lit(1)).alias("n")), sizes.t, sizes.o, sizes.n, FEW_FORMS, TELLING_FORMS) for size in STEM_BYTES]
        own = plain(seen.select("expression", t.alias("t"), o.alias("o"), (t + o).alias("n")), totals[toxic], totals[ordinary], totals[toxic] + totals[ordinary])
        firsts = counts.where(F.col("kind") == FIRST).select(F.col("expression").alias("first"), t.alias("all_t"), o.alias("all_o"))
        pairs = counts.where((F.col("kind") == PAIR) & (t > 0)).select("first", "expression", t.alias("t"), o.alias("o"))
        told = telling(pairs.join(firsts.hint("merge"), "first"), F.col("all_t"), F.col("all_o"))
        # A pair backs off to its second word, so what is kept of it is set against that word's shared share.
        rows = told.join(seen.select("expression", ((t + o) / F.lit(totals[toxic] + totals[ordinary])).alias("shared")).hint("merge"), "expression").collect()
        by_first: dict[bytes, list] = {}
        for r in rows:
            by_first.setdefault(bytes(r["first"]), []).append(r)
        return Model(stems, own, {x: _level(found) for x, found in by_first.items()}, np.zeros(3))

    return model("toxic_learn", "ordinary_learn"), model("toxic", "ordinary")


def fit_curve(features: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression by Newton steps, with a small ridge."""
    scale = np.maximum(np.abs(features).max(axis=0), 1e-9)
    x, w = features / scale, np.zeros(features.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (toxic - p) - 1e-2 * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _labelled(docs: DataFrame, labels: DataFrame, folds: tuple[int, ...], id_col: str, text_col: str) -> DataFrame:
    """text, toxic and tune of the labelled rows of some folds; both sides are filtered before the join.

    Labels grow with the corpus, so they are never broadcast: the plan is the same at every size.  A bitmap of their
    keys, of a fixed size, spares most other texts the way to the join.
    """
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where(fold(F.col("key")).isin(*folds))
    marks = (labels.select(F.col(id_col).alias("key"), (F.col("toxic") == 1).alias("toxic"))
             .where(F.col("toxic").isNotNull() & fold(F.col("key")).isin(*folds)))
    # A bit is the hash's place in its bucket of 32768 bits.
    hashed = F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(BITS))
    bits = keep(marked(marks.select(hashed.alias("bit"))))
    octet = F.conv(F.hex(F.substring(F.col("bitmap"), (F.pmod(hashed, F.lit(32768)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = (rows.withColumn("bucket", F.bitmap_bucket_number(hashed + 1)).join(F.broadcast(bits), "bucket")
            .where(F.getbit(octet, F.pmod(hashed, F.lit(8)).cast("int")) == 1).select("key", "text"))
    return rows.join(marks.hint("merge"), "key").select("text", "toxic", (fold(F.col("key")) == TUNE).alias("tune"))


def _differences(model: Broadcast) -> Callable[[Column], Column]:
    @F.arrow_udf("total double, n bigint")
    def difference(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            # Text by text, so that no batch stands in memory a second time as Python strings.
            found = [model.value.difference(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([d for d, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], names=["total", "n"])
        pa.default_memory_pool().release_unused()

    return difference


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", curve_rows: int = CURVE_ROWS) -> Model:
    """Learn from the labelled rows (labels: id and toxic, 1 or 0) that are not held out."""
    found = models(all_counts(_labelled(docs, labels, (*LEARN, TUNE), id_col, text_col)))
    if found is None:
        return Model([], Level({}, (1.0, 1.0)), {}, np.zeros(3))
    model, whole = found
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The scores are taken where the texts are; only they meet the labels.
    rows = (docs.where(fold(F.col(id_col)) == TUNE)
            .select(F.col(id_col).alias("key"), _differences(shared)(F.col(text_col)).alias("d")).select("key", "d.*"))
    marks = labels.select(F.col(id_col).alias("key"), "toxic").where(F.col("toxic").isNotNull() & (fold(F.col("key")) == TUNE))
    tuned = rows.join(marks.hint("merge"), "key").orderBy(F.xxhash64("key"), "total").limit(curve_rows).select("total", "n", "toxic").toArrow()
    shared.unpersist()
    features = np.array([normalised(a, b) for a, b in zip(tuned["total"].to_pylist(), tuned["n"].to_pylist())])
    toxic = tuned["toxic"].to_numpy() == 1
    if len(features) == 0 or toxic.all() or not toxic.any():
        # Nothing to tune on: a text that says as much for both classes is not toxic.
        whole.curve = np.array([-2.0, 10.0, 5.0])
    else:
        whole.curve = fit_curve(features, toxic.astype("float64"))
    return whole


def score_of(text: Column, model: Model, spark: SparkSession) -> Column:
    """The score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())
        pa.default_memory_pool().release_unused()

    return score(text)


def with_scores(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on)."""
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    rows = docs.select(*others, score_of(F.col(f"`{text_col}`"), model, docs.sparkSession).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def clean_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that score under one half, with their own columns only."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return docs.where(score_of(F.col(f"`{text_col}`"), model, docs.sparkSession) < 0.5)


def held_out(key: Column) -> Column:
    return F.coalesce(fold(key) == 0, F.lit(False))
