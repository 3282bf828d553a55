"""Language-model scoring with a log-frequency Bloom filter.

Counting, filter building and scoring are three distributed passes:

1. Every task hashes its words and n-grams, sums equal ones and ships them as packed arrays, one row per hash block.
   Blocks are ranges of the hash, so no word, however common, makes a block larger than another.
2. Each block's counts are summed and quantised to 2^e (1 + m/32), exact below 64. The block's own bit array gets the
   entries (n-gram, 0..e), the logarithm in unary, and one entry for each bit of m that is set. A probe is a word of 64
   bits, of which four must be set. Exact word counts, for the add-one base score, are kept as sorted arrays.
3. A filter of `pass_mb` or less is broadcast, in slices of at most `slice_mb`, of which a task holds one at a time. Of a
   larger one no task ever sees more than a slice either, but the n-grams come to the slices: documents are bundled in
   groups of some megabytes of text, each group's distinct keys are dealt to the slices by their hash, looked up there,
   and the counts go back to the group. A key is moved once whatever the filter's size, so the work grows with the text.

All counts are read from the filter by repeated membership probes: entries 0, 1, ... until one is missing, then the bits
of m. A word's probability interpolates the orders: p(w|h) = l c(hw)/c(h) + (1 - l) p(w|h'), with l = c / (c + a c^b) for
c = c(h). The words' own probabilities are (c(w) + 1) / (Q + V + 1), Q being the sum of the V words' counts as the filter
gives them, so those of all words and of one unknown word sum to 1, and those after a context to 1 but for quantisation
(below 1 % a count) and false hits. An n-gram's first entry has as many bits as the number of words has binary digits,
and `spare` more: a whole vocabulary has about one false hit in 2^spare contexts, at every corpus size. (A block knows
the number of words from its own, as its n-grams are an even share of all.) An n-gram counts no more often than its
context and its shorter form do.

Null and empty texts count as a text with no words: one end token. An empty training set gives every token the base
probability 1 and the score 0. Repeated rows count as often as they occur. Rows with a null key are training rows. Texts
of any length are read whole, in segments; texts that tie in score are simply equal. `a` and `b` are fixed settings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import _text as X
from vectorloom.llm._spark import arrow_batches, grouped, held_out, per_group, release, shuffle_partitions, stage, trim

U64 = np.uint64
END = int(X.mix(np.array([0xE0D], U64))[0])
FLUSH = 800_000
LOOKED_UP = 400_000  # keys that are looked up at once
BUNDLES = 16  # groups of documents in a task
PIECE = 1 << 13  # bytes of a slice pickled at once
BITS = 4  # bits of a word that a probe looks at
FINE = 5  # bits of m
FIRST_FINE = 64  # number of the entry for the highest bit of m


@dataclass(frozen=True)
class Settings:
    order: int = 2
    a: float = 4.0
    b: float = 0.75
    spare: int = 6
    probes: int = 3
    slice_mb: int = 8
    pass_mb: int = 8
    group_bytes: int = 2 << 20
    bundle_bytes: int = 4 << 20
    block_bytes: int = 4 << 20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of each row followed by its end token, and the row offsets."""
    h, rows = X.word_hashes(data, offsets)
    n = np.diff(rows)
    at = np.concatenate([[0], np.cumsum(n + 1)]).astype(np.int64)
    out = np.full(at[-1], END, U64)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, at


def ngram_keys(tok: np.ndarray, at: np.ndarray, order: int) -> list[np.ndarray]:
    """For each order, a key per token of the n-gram that ends there; 0 where the text has not begun early enough.

    The key's lowest two bits hold its order less 1."""
    begun = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
    keys = []
    for n in range(1, order + 1):
        k = np.zeros(len(tok), U64)
        if len(tok) >= n:
            k[n - 1 :] = (tok[n - 1 :] if n == 1 else X.chain(tok, n)) & U64(0xFFFFFFFFFFFFFFFC) | U64(n - 1)
        k[begun < n - 1] = 0
        keys.append(k)
    return keys


def summed(keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and their counts."""
    if n is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(n[order], heads) if len(heads) else n[:0]


def block_rows(keys: np.ndarray, n: np.ndarray, shift: int) -> pa.RecordBatch:
    block = (keys >> U64(shift)).astype(np.int64)
    at = np.concatenate([np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), [len(keys)]])
    ids = block[at[:-1]]
    put = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
    columns = [pa.array(ids.astype(np.int32)), put(keys), put(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["block", "keys", "n"])


def ngram_counts(texts: DataFrame, order: int, shift: int) -> DataFrame:
    """(block, keys, n): packed n-gram counts of every task; a row per block and flush."""

    def run(batches):
        kept: list[np.ndarray] = []
        for batch in batches:
            data, offsets = X.byte_column(batch.column(0))
            for i, j in X.row_groups(offsets):
                part = data[offsets[i] : offsets[j]]
                tok, at = tokens(part, offsets[i : j + 1] - offsets[i])
                kept += [k[k != 0] for k in ngram_keys(tok, at, order)]
                if sum(map(len, kept)) >= FLUSH:
                    yield block_rows(*summed(np.concatenate(kept)), shift)
                    kept = []
        if kept and sum(map(len, kept)):
            yield block_rows(*summed(np.concatenate(kept)), shift)
        kept = []
        trim()

    return texts.mapInArrow(run, "block int, keys binary, n binary")


def quantised(n: np.ndarray) -> np.ndarray:
    """Codes of counts above 0: (e + 1) << 5 | m, with 2^e (1 + m/32) the count to six binary digits."""
    e = np.frexp(n.astype(float))[1] - 1
    m = np.rint((n / np.exp2(e) - 1) * (1 << FINE)).astype(np.int64)
    return ((e + 1 << FINE) + m).astype(np.uint16)  # m = 32 carries into e


def values() -> np.ndarray:
    """The count that each code stands for; 0 for code 0."""
    code = np.arange(64 << FINE)
    e, m = (code >> FINE) - 1, code & (1 << FINE) - 1
    return np.where(e < 0, 0.0, np.exp2(np.maximum(e, 0)) * (1 + m / (1 << FINE)))


def probe_seeds(keys: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and stride of an entry's probes."""
    x = X.mix(keys ^ U64((entry + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return x, x * U64(0xFF51AFD7ED558CCD) | U64(1)


def probed(start: np.ndarray, stride: np.ndarray, probe: int) -> np.ndarray:
    """The hash of a probe: its upper half tells the word, its lowest digits the bits.

    The sum of start and strides is mixed again: strides near a fraction of 2^64 would come back to few places."""
    x = start + U64(probe) * stride
    x ^= x >> U64(29)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(32)
    return x


def word_of(x: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    return ((x >> U64(32)) * size >> U64(32)).astype(np.int64)


def put_entries(keys: np.ndarray, n: np.ndarray, first: int, s: Settings) -> np.ndarray:
    """The bit array of a block's n-grams with counts, as words; half of the bits are set."""
    code = quantised(n)
    e, m = (code >> FINE).astype(np.int64) - 1, code.astype(np.int64) & (1 << FINE) - 1
    probes = first * len(keys) + s.probes * int(e.sum() + np.bitwise_count(m.astype(np.uint8)).sum())
    size = max(1, int(BITS * probes / np.log(2)) // 64 + 1)
    bits = np.zeros(64 * size, bool)

    def put(own, entry):
        start, stride = probe_seeds(own, entry)
        for probe in range(s.probes if entry else first):
            x = probed(start, stride, probe)
            at = word_of(x, U64(size)) * 64
            for i in range(BITS):
                bits[at + (x >> U64(6 * i) & U64(63)).astype(np.int64)] = True

    for entry in range(int(e.max()) + 1 if len(e) else 0):
        put(keys[e >= entry], entry)
    for i in range(FINE):
        put(keys[m >> (FINE - 1 - i) & 1 == 1], FIRST_FINE + i)
    return np.packbits(bits, bitorder="little").view("<u8")


def read_codes(
    keys: np.ndarray, size: np.ndarray, base: np.ndarray, first: np.ndarray, bits: np.ndarray, s: Settings
) -> np.ndarray:
    """Codes of keys by membership probes.

    size, base, first: the words and place of the bit array of each key's block, and the probes of its first entries."""
    out = np.zeros(len(keys), np.uint16)

    def members(own, entry):
        n, at, left = size[own], base[own], first[own] if entry == 0 else np.full(len(own), s.probes)
        start, stride = probe_seeds(keys[own], entry)
        most, least = (int(left.max()), int(left.min())) if len(own) else (0, 0)
        for probe in range(most):
            x = probed(start, stride, probe)
            mask = U64(1) << (x & U64(63))
            for i in range(1, BITS):
                mask |= U64(1) << (x >> U64(6 * i) & U64(63))
            hit = bits[word_of(x, n) + at] & mask == mask
            if probe >= least:
                hit |= left <= probe
            if not hit.all():
                own, start, stride, n, at, left = (x[hit] for x in (own, start, stride, n, at, left))
        return own

    own, entry = np.flatnonzero(size > 0), 0
    while len(own) and entry < FIRST_FINE - 1:
        own = members(own, entry)
        entry += 1
        out[own] = entry << FINE
    for i in range(FINE):  # a count of e + 1 binary digits has e of m's bits at most
        own = members(np.flatnonzero(out >> FINE > i + 1), FIRST_FINE + i)
        out[own] |= 1 << (FINE - 1 - i)
    return out


def short_counts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as a byte each; places and counts of those that don't fit, whose byte is 0."""
    large = np.flatnonzero(n > 255)
    return np.where(n > 255, 0, n).astype(np.uint8), large, n[large]


def build_filter(counts: DataFrame, blocks: int, s: Settings) -> DataFrame:
    """One row per block: exact word counts, the bit array, the probes of first entries, and the words' number,
    occurrences and sum as read back."""

    def block(table):
        joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        keys, n = summed(joined("keys", U64), joined("n", np.int64))
        own = keys & U64(3) == 0
        words, word_n = keys[own], n[own]
        first = -(-((blocks * max(1, len(words))).bit_length() + s.spare) // BITS)
        bits, same = put_entries(keys, n, first, s), np.ones(len(words), np.int64)
        read = read_codes(words, same.astype(U64) * U64(len(bits)), same * 0, same * first, bits, s)
        row = {
            "block": table.column("block")[0].as_py(),
            "words": words.tobytes(),
            "word_n": word_n.tobytes(),
            "bits": bits.tobytes(),
            "first": first,
            "tokens": int(word_n.sum()),
            "types": len(words),
            "mass": float(values()[read].sum()),
        }
        return pa.RecordBatch.from_pylist([row], schema=FILTER)

    spark_schema = "block int, words binary, word_n binary, bits binary, first int, tokens long, types long, mass double"
    return per_group(counts, ["block"], block, spark_schema)


FILTER = pa.schema(
    [
        ("block", pa.int32()),
        ("words", pa.binary()),
        ("word_n", pa.binary()),
        ("bits", pa.binary()),
        ("first", pa.int32()),
        ("tokens", pa.int64()),
        ("types", pa.int64()),
        ("mass", pa.float64()),
    ]
)


class Slice:
    """Some consecutive blocks of the filter, as broadcast: filled piece by piece, on the driver and where it is read,
    so that no process ever holds a second copy."""

    def __init__(self, sizes: list, shift: int, s: Settings):
        """sizes: (block, bytes of words, bytes of bits, probes of first entries) of each block."""
        self.sizes, self.shift, self.settings = sorted(tuple(x) for x in sizes), shift, s
        self.first = self.sizes[0][0] if self.sizes else 0
        span = self.sizes[-1][0] - self.first + 1 if self.sizes else 1
        self.size, self.base = np.zeros(span, U64), np.zeros(span, np.int64)
        self.probes, self.word_at = np.zeros(span, np.int64), np.zeros(span, np.int64)
        place, total = 0, 0
        for block, n_words, n_bits, first in self.sizes:
            i = block - self.first
            self.size[i], self.base[i], self.probes[i], self.word_at[i] = n_bits // 8, place, first, total
            place, total = place + n_bits // 8, total + n_words // 8
        self.bits, self.words, self.word_n = np.zeros(place, U64), np.zeros(total, U64), np.zeros(total, np.uint8)
        self.large: dict[int, int] = {}  # counts over 255 by place
        self.filled = 0

    def put(self, block: int, words: bytes, word_n: bytes, bits: bytes) -> None:
        i = block - self.first
        at, word_at, n = int(self.base[i]), int(self.word_at[i]), len(words) // 8
        self.bits[at : at + len(bits) // 8] = np.frombuffer(bits, U64)
        self.words[word_at : word_at + n] = np.frombuffer(words, U64)
        self.word_n[word_at : word_at + n], large, count = short_counts(np.frombuffer(word_n, np.int64))
        self.large |= dict(zip((large + word_at).tolist(), count.tolist()))

    def flat(self) -> list[np.ndarray]:
        return [x.view(np.uint8) for x in (self.bits, self.words, self.word_n)]

    def __reduce__(self):
        pieces = (x[i : i + PIECE].tobytes() for x in self.flat() for i in range(0, len(x), PIECE))
        return Slice, (self.sizes, self.shift, self.settings), {"large": self.large}, pieces

    def append(self, piece: bytes) -> None:
        """The next piece, as the pickle gives them."""
        at = self.filled
        for x in self.flat():
            if at < len(x):
                x[at : at + len(piece)] = np.frombuffer(piece, np.uint8)
                break
            at -= len(x)
        self.filled += len(piece)

    def extend(self, pieces) -> None:
        for piece in pieces:
            self.append(piece)

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """Each key's code; 0 for the key 0, for keys of other slices and for those that are not in the filter."""
        out = np.zeros(len(keys), np.uint16)
        block = (keys >> U64(self.shift)).astype(np.int64) - self.first
        own = np.flatnonzero((keys != 0) & (block >= 0) & (block < len(self.size)))
        b = block[own]
        out[own] = read_codes(keys[own], self.size[b], self.base[b], self.probes[b], self.bits, self.settings)
        return out

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        i = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        found = self.words[i] == keys
        out = np.where(found, self.word_n[i], 0).astype(np.int64)
        for j in np.flatnonzero(found & (out == 0)).tolist():  # keys are distinct, so these are few
            out[j] = self.large[int(i[j])]
        return out


def probability(codes: np.ndarray, begun: np.ndarray, total: float, a: float, b: float) -> np.ndarray:
    """Interpolated probabilities of tokens, from codes (order x tokens); total: Q + V + 1."""
    c = values()[codes]
    p = (c[0] + 1) / total
    for n in range(1, len(c)):
        before = np.concatenate([[0.0], c[n - 1][:-1]]) if c.shape[1] else c[0]
        before = np.where(begun >= n, before, 0.0)
        some = np.maximum(before, 1e-9)
        weight = before / (before + a * some**b)
        p = np.where(before > 0, weight * np.minimum(np.minimum(c[n], c[n - 1]), before) / some + (1 - weight) * p, p)
    return p


@dataclass
class NgramModel:
    """A fitted model; `blocks` is the filter's table in the shared folder."""

    settings: Settings
    shift: int
    blocks: DataFrame
    slices: list[tuple[int, int]]
    tokens: int
    types: int
    mass: float
    size: int = 0  # bytes of all blocks
    shared: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: DataFrame, settings: Settings = Settings()) -> NgramModel:
        """texts: a DataFrame whose first column is the text."""
        spark, s = texts.sparkSession, settings
        arrow_batches(spark)
        release(spark)
        texts = texts.select(F.col(f"`{texts.columns[0]}`").cast("string").alias("text"))
        size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shift = 64 - max(1, (int(size) // s.block_bytes).bit_length())
        blocks = stage(build_filter(ngram_counts(texts, s.order, shift), 1 << 64 - shift, s), "lm-filter")
        release(spark)  # the counts' shuffle files go before slices are sent out
        slices, held, n, v, mass, total = [], 0, 0, 0, 0.0, 0
        bytes_of = F.octet_length("words") + F.octet_length("word_n") + F.octet_length("bits")
        for r in blocks.select("block", bytes_of.alias("size"), "tokens", "types", "mass").orderBy("block").toLocalIterator():
            n, v, mass, total = n + r.tokens, v + r.types, mass + r.mass, total + r.size
            if not slices or held + r.size > s.slice_mb << 20:
                slices.append((r.block, r.block))
                held = 0
            slices[-1], held = (slices[-1][0], r.block), held + r.size
        return cls(s, shift, blocks, slices or [(0, 0)], n, v, mass, total)

    def _slice(self, i: int):
        if i not in self.shared:
            own = self.blocks.where(F.col("block").between(*self.slices[i]))
            sizes = own.select("block", F.octet_length("words"), F.octet_length("bits"), "first").collect()
            one = Slice(sizes, self.shift, self.settings)
            for r in own.select("block", "words", "word_n", "bits").toLocalIterator():
                one.put(*r)
            self.shared[i] = self.blocks.sparkSession.sparkContext.broadcast(one)
            del one
        return self.shared[i]

    def score(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(key, n_tokens, n_known, base_score, score) of each row of docs."""
        arrow_batches(docs.sparkSession)
        df = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
        out = f"`{key}` {df.schema[0].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double"
        if self.size > self.settings.pass_mb << 20:
            return self._exchanged(df, out)
        shared = [self._slice(k) for k in range(len(self.slices))]
        s, scored = self.settings, self._scorer()

        def looked_up(tok, at):
            """Codes (order x tokens) and exact word counts."""
            keys = [np.unique(k, return_inverse=True) for k in ngram_keys(tok, at, s.order)]
            found = [np.zeros(len(k), np.uint16) for k, _ in keys]
            count = np.zeros(len(keys[0][0]), np.int64)
            for one in shared:
                part = one.value
                for codes, (k, _) in zip(found, keys):
                    codes |= part.codes(k)  # a key has a code in one slice only
                count += part.exact(keys[0][0])
                if len(shared) > 1:
                    del part
                    one.__dict__.pop("_value", None)  # the next slice takes its place
            return np.stack([codes[back] for codes, (_, back) in zip(found, keys)]), count[keys[0][1]]

        def run(batches):
            for piece in pieces(batches, s.group_bytes):
                tok, at = piece_tokens(piece)
                yield scored(piece, tok, at, *looked_up(tok, at))
            trim()

        return df.mapInArrow(run, out)

    def _scorer(self):
        s, total, mass = self.settings, float(self.tokens + self.types + 1), self.mass + self.types + 1

        def scored(piece: pa.Table, tok: np.ndarray, at: np.ndarray, codes: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
            """The result's rows of (key, text), from the codes (order x tokens) and exact counts of its tokens."""
            begun = np.arange(len(tok)) - np.repeat(at[:-1], np.diff(at))
            n = np.diff(at)
            known = np.add.reduceat((count > 0).astype(np.int64), at[:-1])
            base = np.add.reduceat(np.log10(count + 1.0), at[:-1]) - n * np.log10(total)
            score = np.add.reduceat(np.log10(probability(codes, begun, mass, s.a, s.b)), at[:-1])
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)]
            names = [piece.schema.names[0], "n_tokens", "n_known", "base_score", "score"]
            return pa.RecordBatch.from_arrays([piece.column(0).combine_chunks(), *columns], names)

        return scored

    def _exchanged(self, df: DataFrame, out: str) -> DataFrame:
        """As `score`, with the n-grams dealt to the slices."""
        s, shift, slices, scored, spark = self.settings, self.shift, self.slices, self._scorer(), df.sparkSession
        starts = np.array([a << shift for a, _ in slices[1:]], U64)

        def bundle(batches):
            from pyspark import TaskContext

            for i, piece in enumerate(pieces(batches, s.bundle_bytes), TaskContext.get().partitionId() << 32):
                yield pa.RecordBatch.from_pydict({"bundle": pa.array([i], pa.int64()), "docs": pa.array([to_bytes(piece)], pa.binary())})

        def distinct(tok, at):
            """The keys of all orders, one after the other, the places that sort them, and where a new one starts."""
            keys = np.concatenate(ngram_keys(tok, at, s.order))
            order = np.argsort(keys)
            ranked = keys[order]
            return order, ranked, np.concatenate([[True], ranked[1:] != ranked[:-1]]) & (ranked != 0)

        def deal(batches):
            for batch in batches:
                for number, docs in zip(batch.column(0).to_pylist(), batch.column(1)):
                    keys = np.sort(np.concatenate([k[k != 0] for k in ngram_keys(*piece_tokens(from_bytes(docs)), s.order)]))
                    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
                    cuts = [0, *np.searchsorted(keys, starts).tolist(), len(keys)]
                    own = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                    columns = [pa.array([i for i, _, _ in own], pa.int32()), pa.array([number] * len(own), pa.int64())]
                    columns.append(pa.array([packed(keys[a:b]) for _, a, b in own], pa.binary()))
                    yield pa.RecordBatch.from_arrays(columns, ["slice", "bundle", "keys"])
            trim()

        def look_up(batches):
            now, held, part = None, [], None
            for batch in batches:
                at, blocks = batch.column("slice").to_pylist(), batch.column("block").to_pylist()
                asked, had = [], 0
                for i in range(batch.num_rows):
                    if at[i] != now:
                        if asked:
                            yield answered(part, now, asked)
                        now, held, part, asked, had = at[i], [], None, [], 0
                    if blocks[i] is not None:
                        held.append([batch.column(c)[i].as_py() for c in ("block", "words", "word_n", "bits", "first")])
                        continue
                    if part is None:
                        part = Slice([(b, len(w), len(bits), first) for b, w, _, bits, first in held], shift, s)
                        for row in held:
                            part.put(*row[:4])
                        held = []
                    asked.append((batch.column("bundle")[i].as_py(), unpacked(batch.column("keys")[i].as_py())))
                    had += len(asked[-1][1])
                    if had >= LOOKED_UP:
                        yield answered(part, now, asked)
                        asked, had = [], 0
                if asked:
                    yield answered(part, now, asked)
            trim()

        def finish(batches):
            for table in grouped(batches, "bundle"):
                docs = from_bytes(table.column("docs")[0])  # its slice is -1, so it comes first
                tok, at = piece_tokens(docs)
                order, ranked, heads = distinct(tok, at)
                back = np.cumsum(heads)  # 0: no n-gram
                join = lambda name, kind: np.concatenate([spread(x, kind) for x in table.column(name)[1:].to_pylist()])
                codes, count = join("codes", np.uint16), join("counts", np.int64)
                if len(codes) != heads.sum():
                    raise ValueError("a bundle's n-grams have not all been looked up")
                flat = np.empty(len(order), np.uint16)
                flat[order] = np.concatenate([[0], codes]).astype(np.uint16)[back]
                whole = np.zeros(len(codes) + 1, np.int64)
                whole[1:][(ranked[heads] & U64(3)) == 0] = count
                words = order < len(tok)
                exact = np.empty(len(tok), np.int64)
                exact[order[words]] = whole[back[words]]
                yield scored(docs, tok, at, flat.reshape(s.order, -1), exact)
            trim()

        bundles = stage(df.mapInArrow(bundle, "bundle long, docs binary"), "lm-bundles")
        release(spark)  # shuffle files of the counts that were still referred to when the filter was built
        own = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(slices)], "slice int, a int, b int")
        own = own.select("slice", F.explode(F.sequence("a", "b")).alias("block"))  # a row per block
        filled = self.blocks.join(F.broadcast(own), "block").select("slice", "block", "words", "word_n", "bits", "first")
        keys = bundles.mapInArrow(deal, "slice int, bundle long, keys binary")
        both = filled.unionByName(keys, allowMissingColumns=True)
        both = both.repartition(max(shuffle_partitions(spark), 2 * len(slices)), "slice")
        both = both.sortWithinPartitions("slice", F.col("block").asc_nulls_last())  # a slice's blocks, then its keys
        answers = both.mapInArrow(look_up, "bundle long, slice int, codes binary, counts binary")
        answers = stage(answers, "lm-codes")
        del both, keys, filled
        release(spark)  # the keys' shuffle files go
        parts = max(shuffle_partitions(spark), bundles.count() // BUNDLES)
        release(spark)  # and those that the job before still held
        rows = bundles.withColumn("slice", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
        return rows.repartition(parts, "bundle").sortWithinPartitions("bundle", "slice").mapInArrow(finish, out)


def packed(keys: np.ndarray) -> bytes:
    """Rising keys as differences, a plane for each byte, of which the highest compress to nothing."""
    return squeezed(np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T)


def unpacked(planes: bytes) -> np.ndarray:
    rows = np.ascontiguousarray(spread(planes, np.uint8).reshape(8, -1).T)
    return np.cumsum(rows.view(U64).ravel(), dtype=U64)


def answered(part: Slice, number: int, asked: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    """The codes of each bundle's keys in a slice, and the exact counts of those that are words."""
    keys = np.concatenate([k for _, k in asked])
    codes, at = part.codes(keys), np.cumsum([0, *(len(k) for _, k in asked)])
    word = keys & U64(3) == 0
    count, word_at = part.exact(keys[word]), np.concatenate([[0], np.cumsum(word)])[at]
    put = lambda x, cuts: pa.array([squeezed(x[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())
    columns = [pa.array([b for b, _ in asked], pa.int64()), pa.array([number] * len(asked), pa.int32())]
    columns += [put(codes, at), put(count, word_at)]
    return pa.RecordBatch.from_arrays(columns, ["bundle", "slice", "codes", "counts"])


def squeezed(x: np.ndarray) -> bytes:
    """Its length and compressed bytes."""
    data = x.tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def spread(value: bytes, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(value[8:], int.from_bytes(value[:8], "little"), codec="zstd", asbytes=True), kind)


def to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(value: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(value.as_buffer()).read_all()


def piece_tokens(piece: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tokens(*X.byte_column(piece.column(1)))


def pieces(batches, size: int):
    """Tables of some consecutive rows of (key, text), about `size` bytes of text each."""
    for table in joined(batches, size):
        _, offsets = X.byte_column(table.column(1))
        for i, j in X.row_groups(offsets, size):
            yield table.slice(i, j - i)


def joined(batches, size: int):
    """Tables of some consecutive batches, `size` bytes or a little more each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def score_documents(docs: DataFrame, settings: Settings = Settings(), modulus: int = 7, rest: int = 2) -> DataFrame:
    """Score every row, learning from the rows whose crc32(doc_id) modulo `modulus` is not `rest`."""
    model = NgramModel.fit(docs.where(~held_out("doc_id", modulus, rest)).select("text"), settings)
    out = model.score(docs.select("doc_id", "text"))
    learned = F.lit(model.tokens).cast("long").alias("train_tokens")
    held = held_out("doc_id", modulus, rest).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", learned, "base_score", "score")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
