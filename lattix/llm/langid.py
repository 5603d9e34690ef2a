"""Language identification by error-correcting output codes over character n-grams.

Every language gets a codeword; one linear n-gram classifier per bit tells the languages with a 1 there from those
with a 0.  A text's bit margins are decoded to the codeword with the least weighted loss, where a bit weighs as much
as it separated the training rows.  The score is what lies between the shares of the two nearest codewords, and a text
whose score is below ``AMBIGUOUS`` is flagged: its language is as good as tied with another.

Counts of n-grams come from a sample of about ``max_docs_per_language`` texts of each language, drawn by a hash of the id
(a documented bound); predictions cover every whole text.  There is no bound on the number of languages: counts by
language stay distributed, and the driver gets one row per language (its name and its codeword's margins) and one per
bucket of n-grams.  N-grams are taken inside words, with marks at both ends, so a word's contribution is computed once
per batch of texts.

Defined results: a null text or one without letters is ``und`` with score 0 and not ambiguous; so is every text where
no language was learned; texts of one single learned language are all given that language.  Ties go to the first
language by code point.  Rows with a null id are never learned from.  Rows repeat as they come, further columns are
ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattix.llm.common import local_table, release_memory, remove, stored

BUCKETS = 1 << 16
#: Words whose n-grams are in memory at once.
LOT_WORDS = 4_000
UNKNOWN = "und"
#: Below this score two codewords are as good as equally near.
AMBIGUOUS = 0.01
_LETTERS = re.compile(r"[^\W\d_]+")
_SIZES = (1, 2, 3, 4)


def words_of(text: str | None) -> list[str]:
    """Runs of letters; none in a text without a letter, though some numerals would count as parts of words."""
    return _LETTERS.findall(text.lower()) if text and any(map(str.isalpha, text)) else []


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, one after the other, and the place where each word's begin."""
    lens = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lens)
    left = np.repeat(ends, lens) - np.arange(len(codes))  # characters from here to the word's end
    hashes, owner = [], []
    of = np.repeat(np.arange(len(words)), lens)
    for n in _SIZES:
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        inside = left[: len(h)] >= n
        hashes.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(of[: len(h)][inside])
    owner, hashes = np.concatenate(owner), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return hashes[order], np.searchsorted(owner[order], np.arange(len(words)))


def codewords(n: int, *, max_bits: int = 31) -> np.ndarray:
    """n rows of +1 and -1, all different and no bit the same in all of them: all splits where they are few, else the best
    of some random codes, else (for thousands) random bits after the bits of the row's number."""
    if n <= 1:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        rows = [np.array(c) for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.stack(rows, 1).astype(np.float32)
    rng, best, far = np.random.default_rng(n), None, -1
    digits = int(np.ceil(np.log2(n)))
    bits = max(max_bits, 3 * digits)
    if n > 1_000:
        number = np.float32(1) - 2 * ((np.arange(n)[:, None] >> np.arange(digits)) & 1).astype(np.float32)
        return np.hstack([number, rng.choice(np.float32([1, -1]), (n, bits - digits))])
    for _ in range(200 if n <= 64 else 20):
        code = rng.choice(np.float32([1, -1]), (n, bits))
        if (np.abs(code.sum(0)) == n).any():
            continue
        between = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if between.min() > far:
            best, far = code, between.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, plus a column of ones that counts n-grams
    centre: np.ndarray  # of each bit's margins in training
    scale: np.ndarray
    bit_weight: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each language for rows of bit margins: weighted logistic loss against its codeword."""
        z = np.clip(2 * (margins - self.centre) / self.scale, -50, 50)
        up = self.code > 0
        return (np.log1p(np.exp(-z)) * self.bit_weight) @ up.T + (np.log1p(np.exp(z)) * self.bit_weight) @ ~up.T

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        margins, counts = self.margins(texts)
        some = np.flatnonzero(counts)
        if len(some) and self.languages:
            loss = self.losses(margins[some])
            first = loss.argmin(1)
            p = np.exp(-(loss - loss.min(1, keepdims=True)))
            p = np.sort(p / p.sum(1, keepdims=True), 1)
            for i, k in zip(some, first, strict=True):
                names[i] = self.languages[k]
            scores[some] = p[:, -1] - (p[:, -2] if p.shape[1] > 1 else 0)
        return names, scores

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of each bit over a text's n-grams, and how many there are."""
        ids: dict[str, int] = {}
        flat: list[int] = []
        lens = []
        for t in texts:
            w = words_of(t)
            flat.extend(ids.setdefault(x, len(ids)) for x in w)
            lens.append(len(w))
        bits = self.weights.shape[1] - 1
        out, counts = np.zeros((len(texts), bits)), np.zeros(len(texts))
        if not flat:
            return out, counts
        words = list(ids)
        per_word = np.empty((len(words), bits + 1))
        for a in range(0, len(words), LOT_WORDS):
            h, starts = word_grams(words[a : a + LOT_WORDS])
            per_word[a : a + len(starts)] = np.add.reduceat(self.weights[h], starts, axis=0)
        lens = np.array(lens)
        full = np.flatnonzero(lens)
        starts = (np.cumsum(lens) - lens)[full]
        index = np.array(flat)
        stops = np.append(starts[1:], len(index))
        for i, a, b in zip(full, starts, stops, strict=True):
            s = per_word[index[a:b]].sum(0)
            counts[i] = s[-1]
            out[i] = s[:-1] / s[-1]
        return out, counts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, part in pdf.groupby("lang"):
            total = np.zeros(BUCKETS, np.int64)
            for t in part["text"]:
                if w := words_of(t):
                    for a in range(0, len(w), LOT_WORDS):
                        total += np.bincount(word_grams(w[a : a + LOT_WORDS])[0], minlength=BUCKETS)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": total[at]})
    release_memory()


def training_sample(docs: DataFrame, max_docs_per_language: int) -> DataFrame:
    """(lang, text) of the documents whose hash is below their language's share, which leaves about
    ``max_docs_per_language`` of each language.  Nothing is shuffled but counts, one row per language."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    shares = {"lang": [r["lang"] for r in counts], "share": [min(1.0, max_docs_per_language / r["n"]) for r in counts]}
    shares = local_table(docs.sparkSession, shares, "lang string, share double")
    at = (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    return usable.join(F.broadcast(shares), "lang").where(at < F.col("share")).select("lang", "text")


def learn(docs: DataFrame, *, max_docs_per_language: int = 1_000, smoothing: float = 0.5) -> Model:
    """A model from (doc_id, text, lang) rows; the caller leaves out what must not be learned from."""
    sample = training_sample(docs.select("doc_id", "text", "lang"), max_docs_per_language)
    counts = stored(sample.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    model = fit(counts, totals, smoothing)
    remove(counts)
    return model


def fit(counts: DataFrame, totals: dict[str, int], smoothing: float) -> Model:
    """A model from counts (lang, bucket, n) and their sums by language."""
    spark = counts.sparkSession
    languages = sorted(totals)
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = np.ones((BUCKETS, bits + 1), np.float32)
    if len(languages) < 2:
        one = np.ones(bits)
        return Model(languages, code, weights, one * 0, one, one)
    part = np.array([1 / (totals[x] + smoothing * BUCKETS) for x in languages])  # every language weighs the same
    about = {"lang": languages, "part": part.tolist(), "up": (code > 0).tolist()}
    about = F.broadcast(local_table(spark, about, "lang string, part double, up array<boolean>"))
    share = F.col("n") * F.col("part")
    on = [F.sum(F.when(F.col("up")[b], share).otherwise(0.0)).cast("float").alias(f"b{b}") for b in range(bits)]
    got = counts.join(about, "lang").groupBy("bucket").agg(*on, F.sum(share).cast("float").alias("all")).toPandas()
    up, every = np.zeros((BUCKETS, bits)), np.zeros(BUCKETS)
    up[got["bucket"].to_numpy(int)] = got[[f"b{b}" for b in range(bits)]].to_numpy(float)
    every[got["bucket"].to_numpy(int)] = got["all"].to_numpy(float)
    is_up = code > 0
    least = smoothing * part
    ups, downs = up + least @ is_up, np.maximum(every[:, None] - up, 0) + least @ ~is_up
    weights[:, :-1] = np.log(ups / is_up.sum(0)) - np.log(downs / (~is_up).sum(0))
    shared, rest = spark.sparkContext.broadcast(weights), smoothing * weights[:, :-1].sum(0)

    def margin(pdf: pd.DataFrame) -> pd.DataFrame:
        w = shared.value[pdf["bucket"].to_numpy(int), :-1]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "m": [pdf["n"].to_numpy(float) @ w]})

    sums = dict(counts.groupBy("lang").applyInPandas(margin, "lang string, m array<double>").toPandas().itertuples(index=False, name=None))
    mean = (np.stack([sums[x] for x in languages]) + rest) * part[:, None]  # expected margins of each language
    low, high = np.nanmin(np.where(is_up, mean, np.nan), 0), np.nanmax(np.where(is_up, np.nan, mean), 0)
    gap = np.maximum(low - high, 1e-3)
    return Model(languages, code, weights, (low + high) / 2, np.maximum(np.abs(low - high) / 4, 1e-3), gap / gap.sum() * bits)


def predict_column(spark, model: Model):
    """A vectorised function of a text column: struct<lang_pred, score, ambiguous>.  The broadcast model holds one row per
    bucket and one per language."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        names, scores, values = [], [np.zeros(0)], text.to_numpy()
        for a in range(0, len(values), 512):
            n, s = shared.value.predict([t if isinstance(t, str) else None for t in values[a : a + 512]])
            names += n
            scores.append(s)
        release_memory()
        score = np.concatenate(scores)
        return pd.DataFrame({"lang_pred": names, "score": score, "ambiguous": (score < AMBIGUOUS) & (np.array(names, object) != UNKNOWN)})

    return predict
