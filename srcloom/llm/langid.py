"""Language identification with bit-sliced Bloom filters of character n-grams.

Learning: for each language the n-grams that are frequent in it are put in its
Bloom filter. The filters of all languages have the same size and hash functions
and are stored bit-sliced: one machine word for each position, with one bit for
each language. Reading the few positions of an n-gram and and-ing the words
gives, at once, the bitmask of all languages that may contain it.

Predicting: the n-grams of a text are looked up and the bits counted for each
language. A count of h hits among n look-ups contains false positives, which the
filter's fill tells: with a false-positive rate f the corrected count is
(h - f n) / (1 - f). The language with the largest corrected count wins; the
score is that count's share of all n-grams of the text.

n-grams are taken inside words (runs of letters, lower-cased, with a blank on
each side), so the counts of a word are found once and kept in a table of
bounded size; every word of the whole text counts as often as it occurs.

Learning is bounded: at most about SAMPLE_ROWS rows of each language (chosen by
a hash of the id, so that the choice does not depend on the order of rows), and
GRAMS n-grams for each language (the most frequent, cut at a quantile of their counts); both are parameters. Prediction covers every
row and whole texts.

Defined cases: a null text and a text without a letter are `und` with score 0; a
text with letters but without a known n-gram gets the language most frequent in
the sample, with score 0; ties go to the first language in alphabetical order;
rows with null text, language or id are not learned from; with no rows to learn
from everything is `und`; words of any length are learned from and looked up;
columns of the documents that bear a name of an added column are replaced.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, in_test_fold, table, tables_of

#: Expected rows to learn from, for each language.
SAMPLE_ROWS = 4000
#: n-grams kept for each language.
GRAMS = 8000
SIZES = (2, 3, 4, 5)
#: Letters of a part of a word.
PART = 32
#: Positions of the filter, and positions read for each n-gram.
SLOTS, HASHES = 1 << 18, 3
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")


#: Words kept by a task, and code points worked on at one time.
KEPT, BLOCK_CODES = 150_000, 500_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)


def gram_hashes(points: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each n up to longest the hash of the n code points from each place."""
    out, h = [], np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        h = h[: len(points) - n + 1] * _FACTOR + points[n - 1 :] + np.uint64(1)
        x = h ^ (h >> np.uint64(31))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        out.append(x ^ (x >> np.uint64(29)))
    return out


def positions(h: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """Positions of each n-gram in the filter, by double hashing of its 64-bit hash."""
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(slots)).astype(np.int64)


@dataclass
class Filters:
    """The bit-sliced filters: slices[p, w] holds the bits of languages 64 w to 64 w + 63 at position p."""

    langs: list[str]
    slices: np.ndarray
    false_positive: np.ndarray
    common: str = UNKNOWN
    hashes: int = HASHES
    place: dict[str, int] = field(default_factory=dict, repr=False)  # row of each word in counted
    counted: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"place": {}, "counted": None}

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram hash the words of the bitmask of languages that may contain it."""
        return np.bitwise_and.reduce(self.slices[positions(h, len(self.slices), self.hashes)], axis=1)

    def counts(self, words: list[str]) -> np.ndarray:
        """For each word: its n-grams, and how many of them each language may contain. Words without a letter have none."""
        out = np.zeros((len(words), len(self.langs) + 1), np.int64)
        real = [k for k, w in enumerate(words) if any(map(str.isalpha, w))]  # others are such as superscript figures
        at = 0
        while at < len(real):
            upto, size = at, 0
            while upto < len(real) and (upto == at or size + len(words[real[upto]]) + 2 <= BLOCK_CODES):
                size += len(words[real[upto]]) + 2
                upto += 1
            some = real[at:upto]
            lengths = np.array([len(words[k]) + 2 for k in some])
            owner = np.repeat(np.arange(len(some)), lengths)
            left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(owner))  # code points from each place to the end of its word
            for n, h in enumerate(gram_hashes(codes("".join(f" {words[k]} " for k in some)), max(SIZES)), 1):
                if n not in SIZES:
                    continue
                inside = np.flatnonzero(left[: len(h)] >= n)
                masks, who = self.masks(h[inside]), owner[inside]
                out[some, 0] += np.bincount(who, minlength=len(some))
                for k in range(len(self.langs)):
                    bit = (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                    out[some, k + 1] += np.bincount(who, bit, len(some)).astype(np.int64)
            at = upto
        return out

    def _learned(self, needed: list[str]) -> None:
        found = self.counts(needed)
        self.counted[len(self.place) : len(self.place) + len(needed)] = found
        self.place.update(zip(needed, range(len(self.place), len(self.place) + len(needed)), strict=True))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        listed = [_WORD.findall(t.lower()) if t else [] for t in texts]
        needed = set().union(*listed) - self.place.keys()
        if self.counted is None or len(self.place) + len(needed) > len(self.counted):
            needed = set().union(*listed)
            self.place.clear()
            self.counted = np.zeros((max(KEPT, len(needed)), len(self.langs) + 1), np.int64)
        self._learned(sorted(needed))
        return [self._decide(self.counted[np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))].sum(axis=0)) for ws in listed]

    def _decide(self, total: np.ndarray) -> tuple[str, float]:
        """total: the n-grams of a text, and how many of them each language may contain."""
        if not total[0]:
            return UNKNOWN, 0.0
        corrected = np.maximum(0.0, (total[1:] - self.false_positive * total[0]) / (1 - self.false_positive))
        if not corrected.sum() > 0:
            return self.common, 0.0
        best = int(corrected.argmax())
        return self.langs[best], float(corrected[best] / total[0])


def build(rows: list[tuple[str, str]], common: str = UNKNOWN, slots: int = SLOTS, hashes: int = HASHES) -> Filters:
    """Filters from (language, n-gram) rows."""
    langs = sorted({lang for lang, _ in rows})
    slices = np.zeros((slots, max(1, -(-len(langs) // 64))), np.uint64)
    for k, lang in enumerate(langs):
        for n in SIZES:
            grams = [g for x, g in rows if x == lang and len(g) == n]
            h = gram_hashes(codes("".join(grams)), n)[-1][::n] if grams else np.zeros(0, np.uint64)
            slices[positions(h, slots, hashes).ravel(), k // 64] |= np.uint64(1 << (k % 64))
    fill = np.array([np.count_nonzero(slices[:, k // 64] & np.uint64(1 << (k % 64))) / slots for k in range(len(langs))])
    return Filters(langs, slices, np.minimum(fill**hashes, 0.99), common, hashes)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, n_grams: int = GRAMS) -> Filters:
    """Filters from the rows of docs outside the test fold; only the chosen n-grams, a bounded number, reach the driver."""
    known = docs.where(~in_test_fold(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(F.col(lang_col)).count().collect()}
    if not sizes:
        return build([])
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample_rows / n))])
    drawn = F.pmod(F.xxhash64(F.lit("lang sample"), F.col(id_col).cast("string")), F.lit(1_000_000)) < F.element_at(share, F.col(lang_col)) * 1_000_000
    words = known.where(drawn).select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    # words are cut into parts that overlap by the longest n-gram less one, so that long ones take no longer for each letter
    parts = F.regexp_extract_all(F.concat(F.lit(" "), "word", F.lit(" ")), F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))
    begun = lambda ps: F.transform(ps, lambda p, k: F.struct(F.concat(p, F.coalesce(F.substring(F.get(ps, k + 1), F.lit(1), F.lit(max(SIZES) - 1)), F.lit(""))).alias("text"), F.length(p).alias("starts")))
    each = words.select("lang", "count", parts.alias("ps")).select("lang", "count", F.explode(begun(F.col("ps"))).alias("p"))
    here, starts = F.col("p.text"), F.col("p.starts")
    cut = lambda n: F.filter(F.transform(F.sequence(F.lit(1), starts), lambda i: F.substring(here, i, F.lit(n))), lambda g: F.length(g) == n)
    grams = each.select("lang", "count", F.explode(F.concat(*[cut(n) for n in SIZES])).alias("gram")).groupBy("lang", "gram").agg(F.sum("count").alias("n"))
    # the frequent n-grams of each language: one threshold for each, so no language's n-grams meet in one task
    ranked = grams.groupBy("lang").agg(F.count("*").alias("have"), F.percentile_approx("n", [1 - k / 512 for k in range(512)], 2000).alias("cuts"))
    least = {r["lang"]: r["cuts"][min(511, n_grams * 512 // max(r["have"], 1))] if r["have"] > n_grams else 0 for r in ranked.collect()}
    bar = F.create_map(*[F.lit(x) for k, n in sorted(least.items()) for x in (k, int(n))]) if least else None
    chosen = grams.where(F.col("n") > F.element_at(bar, F.col("lang"))).select("lang", "gram").collect() if least else []
    return build(sorted((r["lang"], r["gram"]) for r in chosen), max(sorted(sizes), key=sizes.get))


ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. The filters have a fixed size, whatever they were learned from."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    name = uuid.uuid4().hex

    def make():
        # the words counted by this worker process are kept with a copy, so they go when another operator comes
        f = tables_of("langid", name, lambda: replace(sent.value, place={}, counted=None))
        return lambda texts: [list(c) for c in zip(*f.predict_all(texts), strict=True)] if texts else [[], []]

    return appended(docs, text_col, ADDED, make)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", in_test_fold("doc_id").alias("held_out"), *ADDED.names)
