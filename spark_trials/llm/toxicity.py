"""Toxicity: boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learned first: words, and beginnings of words, whose document share among toxic rows stands out from that
among the others. Each text is then a short vector: densities of lexicon words, plain and weighted, their closeness to a second person, capitals,
punctuation, and words that hide letters behind digits or symbols. Spark ML fits the trees on one part of the labelled
rows and an isotonic curve on the other, which turns their margins into probabilities.

Only the fit is bounded: ``fit_rows`` labelled rows at most, drawn by a hash. Scoring reads every whole text, once, and
what is sent to the tasks is the lexicon of at most ``lexicon_words`` words.

Defined results: a null text is an empty one; its features are zero and it gets the score they give. Labels that are null
or conflict for one id count as the larger, missing ones as none. Without rows of both labels every score is the share of
toxic rows (0 without any). Repeated rows get equal scores; an empty table gives an empty result. Texts of any length are read
whole, ids are whole numbers or cast to them (a string that is none fails), and other columns are not read. ``you_a_word`` is 0
in a text without words of the lexicon, and ``capital_words`` in one with fewer than three of A-Z.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_trials.llm.common import checkpoint, ship

FIT_ROWS, LEXICON_WORDS, CUT = 40_000, 2_000, 0.7
KEPT_WORDS, KEPT_LETTERS, FIT_TASKS = 300_000, 64, 6
WORD = re.compile(r"[^\W_]+")
#: Letters parted by digits or signs. Possessive, and tried only where a run of letters starts: linear in any text.
HIDDEN = re.compile(r"(?<![^\W\d_])[^\W\d_]++(?:[0-9@$*#!|+]++[^\W\d_]++)++")
CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}+\b")
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus".split())
NEAR = 5
#: A word needs this likelihood ratio to count as telling; by chance one in 50,000 words gets there.
SURPRISE = 18.0
#: Lengths of the beginnings of words that the lexicon may hold.
STEMS = (5, 4)
NAMES = ("hits_a_word", "log_hits", "weight_a_word", "strongest", "near_you", "you_a_word", "capitals", "capital_words", "bangs", "punctuation", "hidden", "log_words")


class Weights(dict):
    """The weight of a word: its own, or that of its beginning, or 0. Short words are kept as they come, up to ``KEPT_WORDS``."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        of, (long, short) = self.lexicon.get, STEMS
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = of(word) or of(word[:long] + "*") or of(word[:short] + "*") or 0.0
        if len(word) <= KEPT_LETTERS:
            self[word] = found
        return found


def features(text: str | None, weights: Weights) -> list[float]:
    """The numbers ``NAMES`` of a text, in time that grows with its length alone."""
    text = text or ""
    if not text:
        return [0.0] * len(NAMES)
    found = WORD.findall(text.lower())
    n = max(1, len(found))
    told = list(map(weights.__getitem__, found))
    hits = [i for i, x in enumerate(told) if x] if any(told) else []
    values = [told[i] for i in hits]
    you = [i for i, w in enumerate(found) if w in SECOND_PERSON] if hits else []
    near = 0
    if you and hits:
        places = np.searchsorted(you_ := np.array(you), np.array(hits))
        after = np.abs(you_[np.minimum(places, len(you) - 1)] - hits)
        before = np.abs(you_[np.maximum(places - 1, 0)] - hits)
        near = int((np.minimum(after, before) <= NEAR).sum())
    size = len(text)
    hidden = 0
    if any(c in text for c in "0123456789@$*#!|+"):
        hidden = sum(1 for _ in HIDDEN.finditer(text))
    capitals = len(text) - len(text.translate(_NO_CAPITALS))
    return [
        len(hits) / n, math.log1p(len(hits)), sum(values) / n, max(values, default=0.0), near / n, len(you) / n, capitals / size,
        sum(1 for _ in CAPITAL.finditer(text)) / n if capitals > 2 else 0.0, text.count("!") / size, sum(map(text.count, ".,;:?\"'()-")) / size, hidden / n, math.log1p(len(found)),
    ]


_NO_CAPITALS = {c: None for c in range(65, 91)}


def with_features(docs: DataFrame, text: str, lexicon: dict[str, float]) -> DataFrame:
    """``docs`` and one more column, ``features``, a vector. Only texts go to Python; the other columns wait beside it."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights = Weights(sent.value)
        for texts in batches:
            flat = [x for i in range(len(texts)) for x in features(texts[i].as_py(), weights)]
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)), pa.array(flat, pa.float64()))

    measure = F.arrow_udf(run, T.ArrayType(T.DoubleType())).asNondeterministic()  # so that no plan measures twice
    return docs.withColumn("features", array_to_vector(measure(F.col(text).cast("string"))))


def learn_lexicon(rows: DataFrame, *, size: int = LEXICON_WORDS) -> dict[str, float]:
    """Words with log odds, from rows (text, toxic): the ``size`` most telling ones."""
    toxic, plain = (int(x or 0) for x in rows.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    least = max(3, math.ceil(0.003 * toxic))
    found = F.regexp_extract_all(F.lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    starts = [F.transform(found, lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    word = F.explode(F.array_distinct(F.concat(found, *starts)))
    counts = rows.select("toxic", word.alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).where(F.col("t") >= least)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / (plain + 1.0))
    base, t, n = toxic / (toxic + plain), F.col("t"), F.col("n")
    rest = F.when(n > t, (n - t) * F.log((n - t) / (n * (1 - base)))).otherwise(F.lit(0.0))
    surprise = 2 * (t * F.log(t / (n * base)) + rest)  # likelihood ratio against a word that tells nothing
    told = counts.withColumn("odds", odds).where((F.col("odds") > 2) & (surprise > SURPRISE)).orderBy(F.desc(F.col("odds") * F.sqrt("t")), "w").limit(size)
    return {r["w"]: float(r["odds"]) for r in told.select("w", "odds").collect()}


def fold(id_) -> F.Column:
    return F.crc32(id_.cast("string")) % 3


class Model:
    """``lexicon``, the trees and the curve; or a constant."""

    def __init__(self, lexicon, trees, curve, constant):
        self.lexicon, self.trees, self.curve, self.constant = lexicon, trees, curve, constant

    def score(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) for every row."""
        at = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        if self.trees is None:
            return at.select("doc_id", F.lit(float(self.constant)).alias("score"))
        return self.scored(with_features(at, "text", self.lexicon).drop("text")).select("doc_id", "score")

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows with ``features`` get ``score``."""
        made = self.curve.transform(_margin(self.trees.transform(rows)))
        return made.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))))


def _margin(frame: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return frame.withColumn("margin", vector_to_array("rawPrediction")[1])


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS,
    lexicon_words: int = LEXICON_WORDS, rounds: int = 12, depth: int = 3, seed: int = 42,
) -> Model:
    """Fit on labelled rows whose fold is not 1: three quarters for the lexicon and the trees, the rest for the curve."""
    marks = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("i")).agg(F.max(label_col).cast("double").alias("toxic"))
    marks = marks.where(F.col("i").isNotNull() & (fold(F.col("i")) != 1))
    there = marks.count()
    if there > fit_rows:
        bar = int(fit_rows / there * (1 << 31))
        marks = marks.where(F.pmod(F.xxhash64("i", F.lit(seed)), F.lit(1 << 31)) < bar)
    texts = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text"))
    # about fit_rows rows of two numbers at most, so they go to the texts and the texts stay where they are
    rows = checkpoint(texts.join(F.broadcast(marks), "i").select("text", "toxic", (F.pmod(F.xxhash64("i", F.lit("part")), F.lit(4)) > 0).alias("grows")))
    counts = {(g, t): n for g, t, n in rows.groupBy("grows", "toxic").count().collect()}
    toxic, total = sum(n for (_, t), n in counts.items() if t), sum(counts.values())
    if any(counts.get((g, t), 0) < 2 for g in (True, False) for t in (0.0, 1.0)):
        return Model({}, None, None, toxic / total if total else 0.0)
    lexicon = learn_lexicon(rows.where("grows").select("text", "toxic"), size=lexicon_words)
    # at most fit_rows short vectors, a few MB: dealt evenly to few tasks, which the many small passes of the fit then read
    ready = checkpoint(with_features(rows, "text", lexicon).select("toxic", "grows", "features").repartition(FIT_TASKS))
    trees = GBTClassifier(labelCol="toxic", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(ready.where("grows"))
    margins = _margin(trees.transform(ready.where("not grows")))
    curve = IsotonicRegression(labelCol="toxic", featuresCol="margin", predictionCol="score").fit(margins.select("toxic", "margin"))
    return Model(lexicon, trees, curve, None)


def judge(docs: DataFrame, labels: DataFrame, *, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels, id_col=id_col, text_col=text_col, **options).score(docs, id_col=id_col, text_col=text_col)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, learn_from: DataFrame | None = None, cut: float = CUT, **options) -> DataFrame:
    """The rows of ``docs`` whose score is under ``cut``, all columns as they are.

    A filter: rows are scored where they are read, and nothing is joined or shuffled but the rows of the fit.
    """
    text_col = options.get("text_col", "text")
    model = fit(learn_from if learn_from is not None else docs, labels, **options)
    columns = docs.columns
    if model.trees is None:
        return docs if model.constant < cut else docs.limit(0)
    # One struct holds the row, so that no column of it meets a name of the model.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kept = model.scored(with_features(rows, "text", model.lexicon)).where(F.col("score") < cut)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])
