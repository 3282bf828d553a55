"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton over folded text.

Texts are folded first: case, accents, look-alike letters of other scripts, digit substitutions and invisible marks
(see `_chars.fold`). Lexicon entries are whole words, of any length up to `longest` letters, and word beginnings of
`shortest` to `longest` letters; an entry's weight is its log-odds between toxic and clean documents. Entries and weights
are learned from at most `sample_docs` labelled rows of each class, chosen by hash, of which one of each group of near
copies of one label is used, the first by hash: copies would make their rare words look typical. An
exception is a phrase of two words around a hit that clean documents use and toxic ones do not; given exception phrases
are added to the learned ones. Hits inside an exception don't count. The summed weight and the weight per word (the
length-normalised measure) enter a logistic score that is fitted on the same sample.

Null and empty texts have no hits and get the score of any text without hits. Repeated label rows of one document count
once, toxic if any is; labels without a document, and null labels, are ignored. Without labels of both classes there is
no lexicon and every score is the share of toxic labels (0 without labels). Without an entry that tells the classes
apart, scores come from the shares alone. Of entries that begin at one place the heaviest counts; which entries are
learned doesn't depend on the order or partitions of the rows. Long texts are matched whole. An empty table of documents
gives no rows.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import _chars as C
from vectorloom.llm import _text as X
from vectorloom.llm._spark import arrow_batches, held_out, stage

CHUNK = 200_000


@dataclass(frozen=True)
class Settings:
    sample_docs: int = 3000
    shortest: int = 3
    longest: int = 12
    least_docs: int = 4
    least_weight: float = 2.0
    least_g: float = 20.0
    lexicon_size: int = 5000
    exceptions: tuple[str, ...] = ()


def folded_texts(texts: list[str | None]):
    """(folded text with BREAKs, start of each row in it) for chunks of rows."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= CHUNK or i == len(texts) - 1:
            codes = C.fold(texts[start : i + 1])
            ends = np.flatnonzero(codes == C.BREAK)
            yield codes.tobytes().decode("utf-32-le"), np.concatenate([[0], ends + 1]), codes
            start, size = i + 1, 0


def fold_phrase(text: str) -> str:
    return C.fold([text]).tobytes().decode("utf-32-le").strip(" \0")


def automaton(patterns):
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(patterns):
        a.add_word(p, (i, len(p)))
    if len(a):
        a.make_automaton()
    return a


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge-penalised logistic regression (the last is the bias), by damped Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 4 / (1e-9 + np.abs(step).max()))
    return w


def one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample, (row, toxic, text), with one text of each group of near copies of one label, that of smallest row.

    Texts are copies if they share half of their eight smallest hashes of three-word shingles with the first text that
    holds them; texts without words are copies of each other. Sketches of the bounded sample alone come to the driver."""

    def run(batches):
        for batch in batches:
            data, offsets = X.byte_column(batch.column(2))
            small = []
            for i, j in X.row_groups(offsets):
                sets = X.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], 3)
                small += [x[:8].view(np.int64).tolist() for x in sets]
            columns = [batch.column(0), batch.column(1), pa.array(small, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "toxic", "small"])

    first: dict[tuple, int] = {}
    keep = []
    for r in sorted(sample.mapInArrow(run, "row long, toxic int, small array<long>").collect()):
        small = r.small or [0]
        held = Counter(first[(r.toxic, v)] for v in small if (r.toxic, v) in first)
        if not held or held.most_common(1)[0][1] * 2 < len(small):
            keep.append(r.row)
        for v in small:
            first.setdefault((r.toxic, v), r.row)
    kept = sample.sparkSession.createDataFrame([(row,) for row in keep], "row long")
    return sample.join(F.broadcast(kept), "row")  # rows of the sample at most


@dataclass
class ToxicityModel:
    settings: Settings = Settings()
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    prior: float = 0.0
    _built: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_built": None}  # the automata are built where they are used

    def hits(self, texts: list[str | None], phrases: bool = False) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """Per text: summed weight of its hits, number of words, and (if asked for) the two-word phrases around hits."""
        if self._built is None:
            words = list(self.lexicon)
            weights = np.array([self.lexicon[w] for w in words])
            self._built = (automaton([f" {w}" for w in words]), weights, automaton([f" {p} " for p in self.exceptions]))
        find, weight, excepted = self._built
        totals, lengths, around = [], [], []
        for text, starts, codes in folded_texts(texts):
            n = len(starts) - 1
            total = np.zeros(n)
            spaces = np.searchsorted(np.flatnonzero(codes == C.SPACE), starts)
            lengths.append(np.maximum(0, np.diff(spaces) - 1))
            found: list[set] = [set() for _ in range(n)]
            if len(find):
                at = [(end - size + 1, i) for end, (i, size) in find.iter(text)]
                if at:
                    pos, which = np.array([x[0] for x in at]), np.array([x[1] for x in at])
                    good = np.ones(len(pos), bool)
                    if len(excepted):
                        for end, (_, size) in excepted.iter(text):
                            good &= ~((pos >= end - size + 1) & (pos < end))
                    # nested entries: the heaviest at a place counts
                    order = np.lexsort((-weight[which], pos))
                    pos, which, good = pos[order], which[order], good[order]
                    good[1:] &= pos[1:] != pos[:-1]
                    row = np.searchsorted(starts, pos, "right") - 1
                    np.add.at(total, row[good], weight[which[good]])
                    if phrases:
                        for p, r in zip(pos.tolist(), row.tolist()):
                            end = text.find(" ", p + 1)
                            before = text.rfind(" ", int(starts[r]), p)
                            if before >= 0:
                                found[r].add(text[before + 1 : end])
                            after = text.find(" ", end + 1)
                            if after >= 0 and text[end + 1 : after] and "\0" not in text[end:after]:
                                found[r].add(text[p + 1 : after])
            totals.append(total)
            around += found
        return np.concatenate(totals or [np.zeros(0)]), np.concatenate(lengths or [np.zeros(0)]), around

    @staticmethod
    def measures(total: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.stack([np.log1p(total), np.log1p(100 * total / np.maximum(words, 1)), (total > 0).astype(float)], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, words, _ = self.hits(texts)
        if self.weights is None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.measures(total, words) @ self.weights[:-1] + self.weights[-1], -30, 30)))

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> ToxicityModel:
        """docs: (key, text); labels: (key, toxic), of the rows to learn from."""
        s = settings
        arrow_batches(docs.sparkSession)
        labels = labels.toDF("key", "toxic").where("key is not null and toxic is not null").groupBy("key").agg(F.max("toxic").alias("toxic"))
        model = cls(s, exceptions=[fold_phrase(e) for e in s.exceptions])
        n = {bool(r[0]): r[1] for r in labels.groupBy(F.col("toxic") > 0).count().collect()}
        model.prior = n.get(True, 0) / max(1, sum(n.values()))
        if not n.get(True) or not n.get(False):
            return model
        picked = [labels.where((F.col("toxic") > 0) == kind).orderBy(F.xxhash64("key"), "key").limit(s.sample_docs) for kind in (True, False)]
        texts = docs.toDF("key", "text").join(F.broadcast(picked[0].union(picked[1])), "key")  # 2 x sample_docs ids at most
        # rows that tie in key and text are one
        texts = texts.select(F.xxhash64("key", "text").alias("row"), (F.col("toxic") > 0).cast("int").alias("toxic"), "text")
        sample = stage(texts.dropDuplicates(["row"]), "toxicity-sample")
        sample = one_of_copies(sample).select("toxic", "text")

        def beginnings(batches):
            count: list[Counter] = [Counter(), Counter()]
            for batch in batches:
                toxic, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                row = 0
                for text, _, _ in folded_texts(texts):
                    for one in text.split("\0")[:-1]:
                        words = set(one.split())
                        begun = {w[:k] for w in words for k in range(s.shortest, min(s.longest, len(w)) + 1)}
                        count[toxic[row]].update(begun | {f"{w} " for w in words if len(w) <= s.longest})
                        count[toxic[row]][""] += 1
                        row += 1
            keys = list(count[0].keys() | count[1].keys())
            toxic, clean = (pa.array([count[i][k] for k in keys], pa.int64()) for i in (1, 0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), toxic, clean], ["entry", "toxic", "clean"])

        counted = sample.mapInArrow(beginnings, "entry string, toxic long, clean long")
        counted = counted.groupBy("entry").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
        whole = counted.where("entry = ''").collect()
        if not whole or not whole[0].t or not whole[0].c:
            return model
        n_toxic, n_clean = whole[0].t, whole[0].c
        weight = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
        # the likelihood-ratio statistic against one rate for both classes
        both = (F.col("t") + F.col("c")) / (n_toxic + n_clean)
        part = lambda k, n: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (n * both))).otherwise(0.0)
        g = 2 * (part("t", n_toxic) + part("c", n_clean))
        tells = (F.col("t") >= s.least_docs) & (F.col("w") >= s.least_weight) & (F.col("g") >= s.least_g)
        ranked = counted.where("entry <> ''").withColumns({"w": weight, "g": g}).where(tells).orderBy(F.desc("g"), "entry")
        rows = ranked.limit(20 * s.lexicon_size).collect()
        model.lexicon = chosen({r.entry: (r.t, r.w) for r in rows}, s)

        shared = model

        def around(batches):
            for batch in batches:
                total, words, phrases = shared.hits(batch.column(1).to_pylist(), phrases=True)
                listed = pa.array([sorted(p) for p in phrases], pa.list_(pa.string()))
                columns = [batch.column(0), pa.array(total), pa.array(words.astype(np.int64)), listed]
                yield pa.RecordBatch.from_arrays(columns, ["toxic", "total", "words", "phrases"])

        seen = "toxic int, total double, words long, phrases array<string>"
        phrases = sample.mapInArrow(around, seen).select("toxic", F.explode("phrases").alias("phrase")).groupBy("phrase")
        phrases = phrases.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).where("t = 0 and c >= 2")
        learned = (r.phrase for r in phrases.orderBy(F.desc("c"), "phrase").limit(s.lexicon_size).collect())
        model.exceptions = sorted({*model.exceptions, *learned})
        model._built = None
        rows = sample.mapInArrow(around, seen).select("toxic", "total", "words").collect()  # 2 x sample_docs at most
        x = cls.measures(np.array([r.total for r in rows]), np.array([r.words for r in rows], float))
        model.weights = logistic(x, np.array([r.toxic for r in rows], float))
        model._built = None
        return model


def chosen(entries: dict[str, tuple[int, float]], s: Settings) -> dict[str, float]:
    """Of entries that begin one another, the longest that still covers nearly all toxic documents of the shorter.

    A whole word ends in a blank, and so is longer than the beginning with the same letters."""
    longer: dict[str, int] = {}
    for e, (t, _) in entries.items():
        for k in range(1, len(e)):
            longer[e[:k]] = max(longer.get(e[:k], 0), t)
    out: dict[str, float] = {}
    for e in sorted(entries, key=lambda e: (len(e), e)):
        t, w = entries[e]
        if longer.get(e, 0) >= 0.9 * t or any(e[:k] in out and out[e[:k]] >= w - 1 for k in range(1, len(e))):
            continue
        out[e] = w
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[: s.lexicon_size])


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    settings: Settings = Settings(),
    threshold: float = 0.7,
    modulus: int = 3,
    rest: int = 1,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; labels of rows whose remainder is `rest` are not used."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = labels.select("doc_id", "toxic").where(~held_out("doc_id", modulus, rest))
    model = ToxicityModel.fit(docs, known, settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # lexicon_size entries at most

    def run(batches):
        for batch in batches:
            scores = pa.array(shared.value.scores(batch.column(1).to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], [batch.schema.names[0], "score"])

    kind = docs.schema[0].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, score double")
    held, predicted = held_out("doc_id", modulus, rest), (F.col("score") >= threshold).cast("int")
    return out.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return score_toxicity(docs, labels)
