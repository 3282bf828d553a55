"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all training rows; the classifier is fitted on at most `sample_docs` of them (an equal share
for each language, chosen by hash), by follow-the-regularised-leader with elastic-net penalties. A fifth of the sample is
kept from training and sets the temperature by which the scores are calibrated.

A text's familiarity tells whether it is in the predicted language at all, which the classifier, bound to choose one,
can't: the mean, over the text's n-grams, of log(1 + df) / log(1 + texts) among all training texts of that language. It
is near 1 for n-grams that most of them have and 0 for those that none has, whatever the language's share of the rows.

Texts are lower-cased, runs of non-letters become one space, and n-grams are hashed into `buckets`. A text that is null
or has no letter is `und` with score 0, as is every text if no row is labelled. Null languages are never learned.
Repeated rows are separate observations; equal texts get equal predictions. Of languages with equal scores the first in
order of name is predicted. Long texts are read whole, a piece at a time. An empty table gives an empty result. With more
than `sample_docs` languages, the classifier learns those that the sample holds; the others' texts may be unfamiliar.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import _chars as C
from vectorloom.llm._spark import arrow_batches, held_out, trim

CHUNK = 200_000  # characters handled at once


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = 1 << 15
    sample_docs: int = 4000
    sample_numbers: int = 20_000_000  # bound of the sample's bucket counts, 8 bytes each
    epochs: int = 3
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.001


def _chunks(texts: list) -> list[tuple[int, int]]:
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return [*out, (start, len(texts))] if start < len(texts) else out


def features(texts: list[str | None], s: Settings):
    """Per text: bucket numbers and counts of its character n-grams; (None, None) without letters."""
    shift = np.uint32(32 - (s.buckets.bit_length() - 1))
    for lo, hi in _chunks(texts):
        codes = C.spaced_letters(C.joined_codes(texts[lo:hi]))
        grams = []
        for n in s.orders:
            h = np.full(max(0, len(codes) - n + 1), n, np.uint32)
            for i in range(n):
                h = (h ^ codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            grams.append((h * np.uint32(0x85EBCA6B)) >> shift)
        start = 0
        for end in np.flatnonzero(codes == C.BREAK).tolist():
            if (codes[start:end] != C.SPACE).any():
                count = np.bincount(np.concatenate([g[start : max(start, end - n + 1)] for n, g in zip(s.orders, grams)]), minlength=s.buckets)
                where = np.flatnonzero(count)
                yield where, count[where]
            else:
                yield None, None
            start = end + 1


def tfidf(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count) * idf
    return x / max(1e-12, np.sqrt((x * x).sum()))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, buckets: int, s: Settings) -> np.ndarray:
    """Weights (buckets + 1, classes); the last row is the bias. FTRL-proximal, a step per row."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at):
        return np.where(np.abs(z[at]) <= s.l1, 0.0, -(z[at] - np.sign(z[at]) * s.l1) / ((s.beta + np.sqrt(n[at])) / s.alpha + s.l2))

    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, buckets), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha * w
            n[at] += g * g
    return weights(slice(None))


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t):
        return -np.log(softmax(logits / np.exp(log_t))[np.arange(len(y)), y] + 1e-12).mean() + 1e-4 * log_t * log_t

    lo, hi, ratio = -3.0, 3.0, (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class LanguageModel:
    settings: Settings
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray | None = None
    weights: np.ndarray | None = None
    common: np.ndarray | None = None  # languages x buckets
    temperature: float = 1.0

    @classmethod
    def fit(cls, rows: DataFrame, settings: Settings = Settings()) -> LanguageModel:
        """rows: (key, text, lang) of the training rows."""
        s, spark = settings, rows.sparkSession
        arrow_batches(spark)
        rows = rows.toDF("key", "text", "lang").where("text is not null and lang is not null")
        counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        model = cls(s, sorted(counts))
        if not counts:
            return model

        def frequencies(batches):
            df: dict[str, np.ndarray] = {}  # a language's texts, then its buckets' document frequencies
            for batch in batches:
                for (at, _), lang in zip(features(batch.column(0).to_pylist(), s), batch.column(1).to_pylist()):
                    if at is not None:
                        own = df.setdefault(lang, np.zeros(s.buckets + 1, np.int64))
                        own[at + 1] += 1
                        own[0] += 1
            for lang, own in df.items():
                where = np.flatnonzero(own)
                columns = [pa.array([lang] * len(where)), pa.array(where - 1, pa.int32()), pa.array(own[where], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

        counted = rows.select("text", "lang").mapInArrow(frequencies, "lang string, bucket int, n long")
        df = np.zeros((len(counts), s.buckets + 1), np.int64)
        number = {lang: i for i, lang in enumerate(model.languages)}
        for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            df[number[r.lang], r.bucket + 1] = r.n  # languages x buckets numbers at most
        every = df.sum(0)
        model.idf = np.log((every[0] + 1) / np.maximum(every[1:], 1))
        model.common = (np.log1p(df[:, 1:]) / np.log1p(np.maximum(df[:, :1], 1))).astype(np.float32)

        share = max(1, s.sample_docs // len(counts))
        rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * share / n))])
        picked = rows.withColumn("h", F.xxhash64("key", "text")).where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

        def sample(batches):
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.binary())
            for batch in batches:
                texts, langs, hashes = (batch.column(c).to_pylist() for c in range(3))
                out = [
                    (h, lang, at.astype(np.int32).tobytes(), n.astype(np.int32).tobytes())
                    for (at, n), lang, h in zip(features(texts, s), langs, hashes)
                    if at is not None
                ]
                columns = list(zip(*out)) or [[]] * 4
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["h", "lang", "buckets", "counts"])

        taken = picked.select("text", "lang", "h").mapInArrow(sample, "h long, lang string, buckets binary, counts binary")
        data, held = [], 0
        for r in taken.orderBy("h", "lang", "buckets").limit(s.sample_docs).toLocalIterator():
            at = np.frombuffer(r.buckets, np.int32)
            held += len(at)
            if held > s.sample_numbers:
                break
            data.append((at, tfidf(np.frombuffer(r.counts, np.int32), model.idf[at]), number[r.lang]))
        train, rest = [x for i, x in enumerate(data) if i % 5], data[::5]
        model.weights = train_ftrl(train, len(counts), s.buckets, s)
        logits = np.array([x @ model.weights[at] + model.weights[-1] for at, x, _ in rest]).reshape(-1, len(counts))
        model.temperature = temperature(logits, np.array([y for _, _, y in rest], int))
        return model

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, float]]:
        """Of each text: the language, its probability, the next one's, and the familiarity."""
        out = []
        for at, count in features(texts, self.settings):
            if at is None or self.weights is None:
                out.append(("und", 0.0, 0.0, 0.0))
                continue
            p = softmax((tfidf(count, self.idf[at]) @ self.weights[at] + self.weights[-1]) / self.temperature)
            best = int(p.argmax())
            known = float((count * self.common[best, at]).sum() / count.sum())
            out.append((self.languages[best], float(p[best]), float(np.delete(p, best).max(initial=0.0)), known))
        return out

    def transform(self, df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
        """df with lang_pred, score (its calibrated probability), next_score and familiarity; prefix goes before these."""
        arrow_batches(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)  # buckets x languages numbers at most

        def run(batches):
            for batch in batches:
                found = shared.value.predict(batch.column(batch.schema.get_field_index(text)).to_pylist())
                columns = list(zip(*found)) or [[]] * 4
                added = [pa.array(c, pa.float64() if i else pa.string()) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *names])

        names = [prefix + n for n in ("lang_pred", "score", "next_score", "familiarity")]
        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        return df.mapInArrow(run, f"{kept}, " + ", ".join(f"`{n}` {'double' if i else 'string'}" for i, n in enumerate(names)))


def identify(docs: DataFrame, settings: Settings = Settings(), modulus: int = 3, rest: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows whose remainder is not `rest`."""
    learned = docs.where(~held_out("doc_id", modulus, rest))
    model = LanguageModel.fit(learned.select("doc_id", F.col("text").cast("string"), "lang"), settings)
    out = model.transform(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return out.select("doc_id", held_out("doc_id", modulus, rest).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, margin: float = 1.25, known: float = 0.7, settings: Settings = Settings()) -> DataFrame:
    """The rows whose language is identified; columns as before.

    Rejected are texts without a letter, those whose language is less than `margin` times as probable as the next one,
    and those less familiar than `known`: other languages and scripts, random letters. Both measures mean the same for
    any number of languages. Rows with null lang or doc_id are judged as any other; if no row has a lang, none is
    identified."""
    model = LanguageModel.fit(docs.select("doc_id", "text", "lang"), settings)
    trim()  # the driver goes on with other work
    out = model.transform(docs, prefix="__vl_")
    sure = (F.col("__vl_score") >= margin * F.col("__vl_next_score")) & (F.col("__vl_familiarity") >= known)
    return out.where((F.col("__vl_lang_pred") != "und") & sure).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
