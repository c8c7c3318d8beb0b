"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text (each as itself and as its
first six letters).  Training pairs every labelled text that names a group
with the same text after swapping the term for another of its family (gender,
origin, faith, ...), and the loss adds ``PENALTY`` times the squared change
of the score, so that neutral mentions of a group do not raise it.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the
least hash of doc_id; ids, languages and sources are no features.  Its words
are those of at least ``LEAST_ROWS`` training rows, the ``MAX_FEATURES`` with
the largest chi-square.  Everything that is broadcast is bounded by these
parameters.  All rows are scored over their whole texts.

Defined results: null and empty texts get the score of no words; with no
labelled row the score of every text is just below 0.5, and with labels of one
class only it is a constant on that class's side; of
several labels for a doc_id the largest counts; rows without doc_id are
scored and are not held out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, resting

TRAIN_ROWS = 12_000
LEAST_ROWS = 3
MAX_FEATURES = 4096
HASH_BITS = 22
PREFIX = 6
L2 = 0.02
PENALTY = 1.0
STEPS = 150
CALIBRATE = 5
#: Megabytes of weights by word that a worker remembers (twice this at most).
REMEMBERED = 12
#: Families of identity terms; each is swapped within its family.
IDENTITY_FAMILIES = tuple(
    tuple(x.split())
    for x in (
        "man woman boy girl male female men women boys girls transgender nonbinary",
        "mann frau männer frauen junge mädchen",
        "homme femme hommes femmes garçon fille",
        "hombre mujer hombres mujeres niño niña",
        "black white asian african european american arab latino hispanic indian chinese mexican immigrant refugee",
        "schwarze weiße asiaten afrikaner europäer araber türken ausländer flüchtlinge",
        "noirs blancs asiatiques africains européens arabes immigrés réfugiés",
        "negros blancos asiáticos africanos europeos árabes inmigrantes refugiados",
        "muslim christian jewish hindu buddhist atheist catholic muslims christians jews hindus buddhists atheists catholics",
        "muslime christen juden hindus buddhisten atheisten katholiken",
        "musulmans chrétiens juifs hindous bouddhistes athées catholiques",
        "musulmanes cristianos judíos hindúes budistas ateos católicos",
        "gay straight lesbian bisexual heterosexual homosexual queer",
        "deaf blind disabled autistic paralyzed",
        "old young elderly teenage",
    )
)
WORD_CHARACTER = re.compile(r"\w")


def without_edges(raw: str) -> str:
    """The word from its first letter, digit or underscore to its last one."""
    first = WORD_CHARACTER.search(raw)
    if not first:
        return ""
    end = len(raw)
    while not (raw[end - 1].isalnum() or raw[end - 1] == "_"):
        end -= 1
    return raw[first.start() : end]


def features_of(raw: str) -> tuple[str, ...]:
    word = without_edges(raw.lower())
    if not word:
        return ()
    return (word, f"{word[:PREFIX]}*") if len(word) >= PREFIX else (word,)


def words(text: str | None) -> set[str]:
    return set((text or "").split())


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, toxic of the labelled rows to fit on (the others of 5 folds are held out)."""
    known = labels.filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    chosen = known.filter(~is_held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def cut_off(scores: np.ndarray, toxic: np.ndarray) -> float:
    """The place between two scores at which the F1 measure is best."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(s) + 1) + toxic.sum())
    f1[:-1][s[:-1] == s[1:]] = -1.0  # equal scores stay together
    k = int(np.argmax(f1))
    below = s[k + 1] if k + 1 < len(s) else s[k] - 1.0
    return float((s[k] + below) / 2)


class Model:
    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights

    def scorer(self) -> Remembered:
        get = self.weights.get
        return Remembered(lambda raw: sum(get(f, 0.0) for f in features_of(raw)), REMEMBERED)


def _swapped(rows: Iterable[set[str]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, feature, change) of the feature counts between a text and its
    counterfactual; one pair for each text and identity term in it."""
    other = {t: family[(i + 1) % len(family)] for family in IDENTITY_FAMILIES for i, t in enumerate(family)}
    pair, feature, change, count = [], [], [], 0
    for row in rows:
        for raw in sorted(row):
            word = without_edges(raw.lower())
            if word in other:
                for fs, sign in ((features_of(word), -1.0), (features_of(other[word]), 1.0)):
                    for f in fs:
                        if f in index:
                            pair.append(count)
                            feature.append(index[f])
                            change.append(sign)
                count += 1
    return np.array(pair, np.int64), np.array(feature, np.int64), np.array(change)


def fit(texts: list[str | None], toxic: list[int]) -> Model:
    """Fits on four fifths of the rows and sets the cut-off on the others."""
    apart = [i for i in range(len(texts)) if i % CALIBRATE == 0]
    rest = [i for i in range(len(texts)) if i % CALIBRATE]
    if len({toxic[i] for i in apart}) < 2 or len({toxic[i] for i in rest}) < 2:
        return _fit(texts, toxic)
    model = _fit([texts[i] for i in rest], [toxic[i] for i in rest])
    weight_of = model.scorer().__getitem__
    scores = np.array([model.bias + sum(map(weight_of, words(texts[i]))) for i in apart])
    model.bias -= cut_off(scores, np.array([toxic[i] for i in apart], float))
    return model


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (1 << HASH_BITS) - 1


class _Words:
    """The distinct words of each text, made when asked for."""

    def __init__(self, texts: list[str | None]):
        self.texts = texts

    def __iter__(self) -> Iterator[set[str]]:
        return map(words, self.texts)


def _fit(texts: list[str | None], toxic: list[int]) -> Model:
    y = np.array(toxic, float)
    positive = float(y.sum())
    if not 0 < positive < len(y):
        return Model(-1e-9 if not len(y) else (2.0 if positive else -2.0), {})
    rows = _Words(texts)
    # Words of few rows are most of all; a table of counts by hash sets them aside first.
    seen = np.zeros(1 << HASH_BITS, np.uint16)
    for row in rows:
        own = {f for raw in row for f in features_of(raw)}
        at = np.unique(np.fromiter((_slot(f) for f in own), np.int64, len(own)))
        seen[at] += seen[at] < LEAST_ROWS
    kept = seen >= LEAST_ROWS
    in_rows, in_toxic = Counter(), Counter()
    for row, label in zip(rows, toxic):
        own = {f for raw in row for f in features_of(raw) if kept[_slot(f)]}
        in_rows.update(own)
        if label:
            in_toxic.update(own)
    share = positive / len(y)
    terms = {t for family in IDENTITY_FAMILIES for t in family}

    def chi(f: str) -> float:
        n, k = in_rows[f], in_toxic[f]
        return (k - n * share) ** 2 / (n * share * (1 - share))

    frequent = [f for f, n in in_rows.items() if n >= LEAST_ROWS]
    chosen = sorted(frequent, key=lambda f: (f not in terms, -chi(f), f))[:MAX_FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    # Counted anew for the chosen features: counts of all would not fit a worker's share of memory.
    at, which, value = array("q"), array("q"), array("d")
    for i, row in enumerate(rows):
        for f, n in Counter(f for raw in row for f in features_of(raw) if f in index).items():
            at.append(i)
            which.append(index[f])
            value.append(n)
    at, which, value = np.array(at), np.array(which), np.array(value)
    pair, swapped, change = _swapped(rows, index)
    pairs = int(pair.max()) + 1 if len(pair) else 0

    # Full-batch Adam on: mean log loss + L2 + PENALTY * mean squared change.
    w, b = np.zeros(len(index)), float(np.log(share / (1 - share)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    for step in range(1, STEPS + 1):
        z = b + np.bincount(at, value * w[which], len(y))
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(which, value * slope[at], len(w)) / positive + L2 * w
        if pairs:
            moved = np.bincount(pair, change * w[swapped], pairs)
            g += 2 * PENALTY * np.bincount(swapped, change * moved[pair], len(w)) / pairs
        gb = slope.sum() / positive
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= 0.1 * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return Model(b, {f: float(w[i]) for f, i in index.items()})


def trained(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fits in one task, over the bounded sample; weights come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            toxic += batch.column("toxic").to_pylist()
        # The same order in each run, and one unrelated to how texts begin.
        order = sorted(range(len(texts)), key=lambda i: (hashlib.sha256((texts[i] or "").encode()).digest(), toxic[i]))
        model = fit([texts[i] for i in order], [toxic[i] for i in order])
        yield pa.RecordBatch.from_pydict({"feature": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    sample = training_rows(docs, labels, rows).repartition(1)
    got = {r.feature: r.weight for r in sample.mapInArrow(resting(run), "feature string, weight double").collect()}
    return Model(got.pop("", -1e-9), got)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """score and predicted beside the columns of docs (which may not have them)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.bias, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, weights = shared.value
        scorer = Model(bias, weights).scorer()
        weight_of = scorer.__getitem__
        try:
            for batch in batches:
                z = np.array([bias + sum(map(weight_of, words(t.as_py()))) for t in batch.column("text")])
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                yield batch.append_column("score", pa.array(score)).append_column("predicted", pa.array((score >= 0.5).astype(np.int32)))
        finally:
            scorer.forget()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(resting(run), f"{schema}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(rows, trained(docs, labels)).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows predicted to be toxic."""
    columns = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*columns).withColumn("text", F.col(columns[docs.columns.index("text")]).cast("string"))
    kept = scored(plain, trained(docs, labels)).filter("predicted = 0")
    return kept.select(*columns).toDF(*docs.columns)
