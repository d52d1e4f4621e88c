"""Severity grades of toxic text by cumulative-link ordinal regression.

For grades 0 to K-1 the model has one weight vector w and K-1 ascending
thresholds: P(grade > k) = 1 / (1 + exp(theta_k - w.x)). All thresholds share
the weights. Outputs are the expected severity, sum over k of P(grade > k), the
median grade (the highest that is reached with a probability of one half), and
whether that is above the lowest.

Features are sparse and binary: the words of the whole text (letters and digits,
lower-cased) and the first 4, 5, 6 and 7 characters of each, which meet words
that take endings, hashed to DIMENSIONS places; and, for each of these, that it
stands there at least so many times as one of LEVELS.

Learning is bounded: about SAMPLE_ROWS labelled ids (chosen by a hash of the id;
a parameter), about TEXTS_EACH texts of an id that is repeated, and features that
enough of these rows have. Grades above
the lowest make up to half of the sample, and the thresholds are moved back by
the logarithm of the two sampling shares. The features of those rows that enough
of them have go to the driver, where the likelihood with an L1 penalty is maximised; most weights end
at zero. Scoring covers every row and whole texts.

Defined cases: a null or empty text has no features and gets the grade of the
thresholds alone; labels that are null, and labelled rows without a text, are
not learned from; a repeated label, and a repeated text of one id, count once;
columns of the documents that bear a name of an added column are replaced;
grades that no row has take no part; with fewer than two
grades in the sample every text gets the only grade (0 if there is none).
"""

from __future__ import annotations

import math
import re
import uuid
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field, replace
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Recent, appended, durable, table, tables_of

SAMPLE_ROWS = 4_000
TEXTS_EACH = 8
#: A feature counts if at least MIN_ROWS rows of the sample have it, and one of ROWS_EACH.
MIN_ROWS, ROWS_EACH = 4, 1_000
PREFIXES = (4, 5, 6, 7)
LEVELS = (1, 2, 4)
#: Places of words and prefixes; level k of a place is that place plus k times so many.
DIMENSIONS = 1 << 22
PENALTY, ROUNDS = 5e-4, 100
_WORD = re.compile(r"[^\W_]+")


def features_of(word: str) -> list[int]:
    """Places of the word and of its prefixes (marked, so that they are no words)."""
    from xxhash import xxh32_intdigest

    named = [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]
    return [xxh32_intdigest(f.encode("utf-8", "surrogatepass")) % DIMENSIONS for f in named]


def features(text: str) -> np.ndarray:
    """The distinct features of a whole text, ascending."""
    often: Counter = Counter()
    for w, n in Counter(_WORD.findall(text.lower())).items():
        for f in features_of(w):
            often[f] += n
    return np.unique(np.array([f + k * DIMENSIONS for f, n in often.items() for k, least in enumerate(LEVELS) if n >= least], np.int32))


@dataclass
class Severity:
    """grades: the labels seen, ascending; thresholds: one fewer; weights: those that are not negligible."""

    grades: list[int]
    thresholds: np.ndarray
    weights: dict[int, float]
    words: Recent | None = field(default=None, repr=False)
    sums: dict[int, list[float]] = field(default_factory=dict, repr=False)  # of a place: the sum of its weights up to each level

    def __getstate__(self):
        return self.__dict__ | {"words": None, "sums": {}}

    def _of(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        known = self.sums
        return {w: tuple(f for f in features_of(w) if f in known) for w in words}

    def links(self, texts: list[str | None]) -> list[float]:
        """w.x of each text."""
        if self.words is None:
            self.sums = {f: list(accumulate(self.weights.get(f + k * DIMENSIONS, 0.0) for k in range(len(LEVELS)))) for f in {f % DIMENSIONS for f in self.weights}}
            self.words = Recent(self._of, 100_000, 60)
        counted = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in texts]
        out = []
        for words, named in zip(counted, self.words.of(counted), strict=True):
            often: dict[int, int] = {}
            for n, fs in zip(words.values(), named, strict=True):
                for f in fs:
                    often[f] = often.get(f, 0) + n
            out.append(math.fsum(self.sums[f][bisect_right(LEVELS, n) - 1] for f, n in often.items()))
        return out

    def predict_all(self, texts: list[str | None]) -> list[list]:
        """For each text expected severity, median grade, and whether a grade above the lowest is at least as likely as not."""
        if len(self.grades) < 2:
            only = self.grades[0] if self.grades else 0
            return [[float(only)] * len(texts), [only] * len(texts), [only > 0] * len(texts)]
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.array(self.links(texts)).reshape(-1, 1), -500, 500)))
        ends = np.ones((len(texts), 1))
        each = np.hstack([ends, above]) - np.hstack([above, 0 * ends])
        grades = np.array(self.grades)
        return [(each @ grades).tolist(), grades[(above >= 0.5).sum(axis=1)].tolist(), (above[:, 0] >= 0.5).tolist()]


def fit(grade_of: np.ndarray, sizes: np.ndarray, column: np.ndarray, min_rows: int = MIN_ROWS, penalty: float = PENALTY, rounds: int = ROUNDS) -> Severity:
    """The model of rows with these grades and numbers of features, the features one row after the other: Adam with soft thresholds."""
    grades = sorted(set(grade_of.tolist()))
    if len(grades) < 2:
        return Severity(grades, np.zeros(0), {})
    row = np.repeat(np.arange(len(sizes)), sizes)
    names, column, often = np.unique(column, return_inverse=True, return_counts=True)
    kept = often >= min_rows
    row, column = row[kept[column]], (np.cumsum(kept) - 1)[column[kept[column]]]
    names = names[kept]
    level = np.searchsorted(grades, grade_of)
    n, m, k = len(sizes), len(names), len(grades)
    share = np.array([(level > j).mean() for j in range(k - 1)])
    theta = -np.log(share / (1 - share))
    # gaps between thresholds are held by their logarithms, which keeps the thresholds ascending
    x = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3)), np.zeros(m)])
    mean, square, rate = np.zeros_like(x), np.zeros_like(x), 0.1
    cuts_of = lambda x: np.cumsum(np.r_[x[0], np.exp(x[1 : k - 1])])
    for t in range(1, rounds + 1):
        cuts = np.r_[-np.inf, cuts_of(x), np.inf]
        eta = np.bincount(row, x[k - 1 :][column], n)
        below = lambda c: 1 / (1 + np.exp(-np.clip(c - eta, -500, 500)))  # noqa: E731, B023
        hi, lo = below(cuts[level + 1]), below(cuts[level])
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        by_cut = np.array([d_lo[level == j + 1].sum() - d_hi[level == j].sum() for j in range(k - 1)])
        by_gap = [by_cut[j + 1 :].sum() * np.exp(x[1 + j]) for j in range(k - 2)]
        g = np.concatenate([[by_cut.sum()], by_gap, np.bincount(column, (d_hi - d_lo)[row], m)]) / n
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        step = rate / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)
        x -= step * mean / (1 - 0.9**t)
        w = x[k - 1 :]
        w[:] = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step[k - 1 :] * penalty, rate), 0)
    return Severity(grades, cuts_of(x), {int(f): float(v) for f, v in zip(names, x[k - 1 :], strict=True) if v})


def learn(docs: DataFrame, labels: DataFrame, grade: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, **how) -> Severity:
    """The model of a bounded sample of the labelled rows; grade is a SQL expression over labels."""
    named = labels.select(F.col(id_col).alias("__i"), F.expr(grade).cast("int").alias("__g")).where("__i is not null and __g is not null").distinct()
    sizes = {r[0]: r[1] for r in named.groupBy("__g").count().collect()}
    if not sizes:
        return Severity([], np.zeros(0), {})
    lowest = min(sizes)
    above = sum(n for g, n in sizes.items() if g > lowest)
    share = {g: min(1.0, sample_rows / 2 / (n if g == lowest else above)) for g, n in sizes.items()}
    draw = F.create_map(*[F.lit(v) for g in sorted(share) for v in (g, share[g])])
    drawn = durable(named.where(F.pmod(F.xxhash64(F.lit("severity sample"), F.col("__i").cast("string")), F.lit(1_000_000)) < F.element_at(draw, F.col("__g")) * 1_000_000))
    # distinct pairs of id and grade, so about sample_rows; that is checked before they are sent to all tasks
    few = drawn.count() <= 4 * sample_rows + 1_000
    sent = F.broadcast if few else lambda df: df
    texts = docs.select(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).where("__t is not null")
    often = texts.select("__i").join(sent(drawn.select("__i").distinct()), "__i").groupBy("__i").agg(F.count("*").alias("n"))
    drawn = durable(drawn.join(often, "__i"))
    chosen = texts.join(sent(drawn.where("n = 1")), "__i").select("__i", "__g", "__t")
    again = durable(drawn.where("n > 1"))
    if not again.isEmpty():
        # of an id with several texts about TEXTS_EACH different ones, chosen by their hashes
        hashed = texts.withColumn("h", F.xxhash64(F.lit("text"), F.col("__t")))
        different = durable(hashed.join(sent(again.select("__i").distinct()), "__i").select("__i", "h").distinct())
        number = different.groupBy("__i").agg(F.count("*").alias("m"))
        taken = durable(different.join(number, "__i").where(F.pmod("h", F.lit(1_000_000)) * F.col("m") < TEXTS_EACH * 1_000_000).select("__i", "h"))
        some = hashed.join(sent(taken) if taken.count() <= 4 * TEXTS_EACH * sample_rows else taken, ["__i", "h"]).select("__i", "__t").distinct()
        chosen = chosen.unionByName(some.join(sent(again.select("__i", "__g")), "__i").select("__i", "__g", "__t"))

    def make():
        return lambda ts: [[features(t) for t in ts]]

    found = durable(appended(chosen, "__t", T.StructType([T.StructField("fs", T.ArrayType(T.IntegerType()))]), make).select("__i", "__g", "fs").withColumn("k", F.monotonically_increasing_id()))
    # only features that enough rows have reach the driver
    each = found.select("k", F.explode("fs").alias("f"))
    least = max(how.get("min_rows", MIN_ROWS), found.count() // ROWS_EACH)
    common = each.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("f")
    kept = each.join(common, "f").groupBy("k").agg(F.array_sort(F.collect_list("f")).alias("fs"))
    rows = found.drop("fs").join(kept, "k", "left").select("__i", "k", "__g", F.coalesce("fs", F.array().cast("array<int>")).alias("fs")).toArrow().sort_by([("__i", "ascending"), ("k", "ascending")])
    if not rows.num_rows:
        return Severity([], np.zeros(0), {})
    listed = rows.column("fs").combine_chunks()
    model = fit(rows.column("__g").to_numpy(), np.diff(listed.offsets.to_numpy()), listed.flatten().to_numpy(), **how)
    model.thresholds = model.thresholds + np.log(max(share[g] for g in share if g > lowest) / share[lowest]) if len(model.grades) > 1 else model.thresholds
    return model


ADDED = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])


def grade(docs: DataFrame, model: Severity, text_col: str = "text") -> DataFrame:
    """docs with severity, grade and toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    name = uuid.uuid4().hex

    def make():
        # recent words are kept with a copy, so they go when another operator comes
        return tables_of("toxicity", name, lambda: replace(sent.value, words=None, sums={})).predict_all

    return appended(docs, text_col, ADDED, make)


#: Severity from the labels: not toxic; toxic in a poor text, which other filters drop as well; toxic in a good one.
GRADE = "case when toxic is null then null when toxic = 0 then 0 when quality = 0 then 1 else 2 end"


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return grade(docs, learn(docs, table(spark, sf_dir, "labels"), GRADE)).select("doc_id", *ADDED.names)
