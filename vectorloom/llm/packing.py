"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised where they lie; only piece lengths travel. A document is followed by the end id and cut only if
it is longer than a sequence: its remainder comes first, then full pieces, which fill sequences of their own. The other
pieces are counted and dealt by hash to shards of about `shard_items`. Every shard is evolved by `islands` tasks for `epochs` rounds;
between rounds each island's elite migrates to the next island through a join. An individual is a list of bins.
Crossover injects whole well-filled bins of one parent into the other, drops the bins that hold injected pieces, and
puts the displaced pieces back by best fit decreasing; mutation empties some badly filled bins in the same way. The
first individuals are best-fit-decreasing packings of perturbed orders, so no result is worse than best fit.

Null and empty texts are the end id alone. Repeated rows are packed as often as they occur, rows without doc_id too.
Pieces of equal length are told apart by their place in the input. Very long texts are tokenised whole, and so are runs
of blanks or letters of any length, by the tokenizer itself where the faster encoder gives up. An empty table gives no
rows.
"""

from __future__ import annotations

import base64
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm._spark import arrow_batches, per_group, stage


#: A run without a break that the ranks' encoder would match or merge in more than linear time.
LONG_RUN = re.compile(r"\s{50000}|\S{50000}")


@dataclass(frozen=True)
class Settings:
    length: int = 1024
    end_id: int = 2
    tokenizer: str = ""  # the tokenizer's JSON file; empty: byte_bpe_50k.json of public_tokenizers
    ranks: str = ""  # the same vocabulary as ranks, which encode faster; empty: byte_bpe_50k.tiktoken
    shard_items: int = 8192
    islands: int = 2
    epochs: int = 2
    population: int = 4
    crossovers: int = 12
    elite: int = 2
    seed: int = 7


class Encoder:
    """Token ids as the tokenizer's JSON file gives them. Plain texts go through the same vocabulary's ranks.

    The ranks' pattern matcher gives up on runs of about a million blanks, and merges very long words slowly; such texts
    go through the tokenizer itself, which gives the same ids."""

    def __init__(self, s: Settings):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(s.tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(s.ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if not any(x in text for x in self.special) and not LONG_RUN.search(text):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
            except ValueError:  # the matcher's stack is full
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, slot) of (doc_id, text); slot tells the pieces apart."""

    def run(batches):
        encode, made = Encoder(s), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode(text) if text else np.zeros(0, np.uint32), np.uint32(s.end_id)).astype("<u4")
                start, cut = 0, len(ids) % s.length or min(len(ids), s.length)
                number = 0
                while start < len(ids):
                    n = cut if not number else s.length
                    rows.append((doc, number, start, n, zlib.crc32(ids[start : start + n].tobytes()), part << 32 | made))
                    start, number, made = start + n, number + 1, made + 1
            if rows:
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "slot"])

    kind = docs.schema[0].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, slot long")


class Bins:
    """An individual: bins of items, with the free space of each. Best fit looks levels of free space up in a bit mask."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] | None = None):
        self.sizes, self.capacity = sizes, capacity
        self.bins = bins or []
        self.free = [capacity - sum(map(sizes.__getitem__, b)) for b in self.bins]

    def insert(self, items: list[int]) -> None:
        """Best fit decreasing of items into the bins and, where none has room, into new ones."""
        levels: dict[int, list[int]] = {}
        mask = 0
        for i, f in enumerate(self.free):
            levels.setdefault(f, []).append(i)
            mask |= 1 << f
        sizes, bins, free = self.sizes, self.bins, self.free
        for item in sorted(items, key=sizes.__getitem__, reverse=True):
            size = sizes[item]
            room = mask >> size
            if room:
                level = size + (room & -room).bit_length() - 1
                at = levels[level].pop()
                if not levels[level]:
                    mask ^= 1 << level
                bins[at].append(item)
            else:
                level, at = self.capacity, len(bins)
                bins.append([item])
                free.append(level)
            left = level - size
            free[at] = left
            levels.setdefault(left, []).append(at)
            mask |= 1 << left

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        full = sum((self.capacity - f) ** 2 for f in self.free)
        return -len(self.bins), full / max(1, len(self.bins)) / self.capacity**2

    def without(self, gone: set[int]) -> tuple[Bins, list[int]]:
        """The bins but for those numbered in gone, and the items of these."""
        kept = Bins.__new__(Bins)
        kept.sizes, kept.capacity = self.sizes, self.capacity
        kept.bins = [list(b) for i, b in enumerate(self.bins) if i not in gone]
        kept.free = [f for i, f in enumerate(self.free) if i not in gone]
        return kept, [x for i in gone for x in self.bins[i]]

    def packed(self) -> bytes:
        at = np.zeros(len(self.sizes), np.int32)
        for i, b in enumerate(self.bins):
            at[b] = i
        return at.tobytes()

    @classmethod
    def unpacked(cls, data: bytes, sizes: list[int], capacity: int) -> Bins:
        bins: dict[int, list[int]] = {}
        for item, at in enumerate(np.frombuffer(data, np.int32).tolist()):
            bins.setdefault(at, []).append(item)
        return cls(sizes, capacity, list(bins.values()))


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Well-filled bins of b injected whole into a; displaced items go back by best fit."""
    ranked = sorted(range(len(b.bins)), key=lambda i: (b.free[i], i))
    well = [i for i in ranked[: max(1, len(ranked) * 3 // 4)] if rng.random() < 0.6]
    injected = {x for i in well for x in b.bins[i]}
    clash = {i for i, one in enumerate(a.bins) if not injected.isdisjoint(one)}
    child, displaced = a.without(clash)
    child.bins += [list(b.bins[i]) for i in well]
    child.free += [b.free[i] for i in well]
    child.insert([x for x in displaced if x not in injected])
    return child


def mutate(a: Bins, rng: random.Random) -> Bins:
    """The least filled bins, and some others, emptied and their items put back by best fit."""
    worst = sorted(range(len(a.bins)), key=lambda i: (-a.free[i], i))[: max(2, len(a.bins) // 50)]
    child, displaced = a.without({*worst, *(rng.randrange(len(a.bins)) for _ in range(len(worst)))})
    child.insert(displaced)
    return child


def evolve(sizes: np.ndarray, elites: list[bytes], rng: random.Random, s: Settings) -> list[tuple[tuple, bytes]]:
    """One epoch of one island: its best `elite` individuals, fittest first."""
    size = sizes.tolist()
    people = [Bins.unpacked(e, size, s.length) for e in elites]
    while len(people) < s.population:
        start = Bins(size, s.length)
        if people:  # the first is best fit decreasing; others begin from a part that is packed in random order
            some = rng.sample(range(len(size)), len(size) // 4)
            for x in range(0, len(some), 64):
                start.insert(some[x : x + 64])
            rest = set(range(len(size))).difference(some)
            start.insert(list(rest))
        else:
            start.insert(list(range(len(size))))
        people.append(start)
    bound = -(-int(sizes.sum()) // s.length)
    for _ in range(s.crossovers):
        people.sort(key=Bins.fitness, reverse=True)
        if len(people[0].bins) == bound:
            break  # no packing has fewer bins
        del people[s.population :]
        a, b = rng.sample(people, 2)
        child = crossover(a, b, rng) if rng.random() < 0.7 else mutate(a, rng)
        people.append(child)
    people.sort(key=Bins.fitness, reverse=True)
    return [(p.fitness(), p.packed()) for p in people[: s.elite]]


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of (doc_id, text) goes."""
    s = settings
    arrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    items = stage(pieces(docs, s), "packing-pieces")
    shards = max(1, -(-items.where(F.col("length") < s.length).count() // s.shard_items))
    items = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(s.seed), "slot"), F.lit(shards)).cast("int"))
    short = items.where(F.col("length") < s.length).select("shard", "slot", "length")

    def gathered(table):
        order = np.argsort(table.column("slot").to_numpy(), kind="stable")
        size = table.column("length").to_numpy()[order].astype(np.int32)
        return pa.RecordBatch.from_pylist([{"shard": table.column("shard")[0].as_py(), "sizes": size.tobytes()}], pa.schema([("shard", pa.int32()), ("sizes", pa.binary())]))

    sizes = stage(per_group(short, ["shard"], gathered, "shard int, sizes binary"), "packing-sizes")
    state = sizes.withColumns({"island": F.explode(F.sequence(F.lit(0), F.lit(s.islands - 1))), "elites": F.array().cast("array<binary>")})
    schema = "shard int, island int, fitness struct<bins:int,fill:double>, packing binary"
    fields = pa.schema([("shard", pa.int32()), ("island", pa.int32()), ("fitness", pa.struct([("bins", pa.int32()), ("fill", pa.float64())])), ("packing", pa.binary())])

    for epoch in range(s.epochs):

        def run(batches, epoch=epoch):
            for batch in batches:
                for r in batch.to_pylist():
                    rng = random.Random(f"{s.seed} {r['shard']} {r['island']} {epoch}")
                    best = evolve(np.frombuffer(r["sizes"], np.int32), r["elites"], rng, s)
                    yield pa.RecordBatch.from_pylist([{"shard": r["shard"], "island": r["island"], "fitness": {"bins": f[0], "fill": f[1]}, "packing": p} for f, p in best], fields)

        dealt = state.repartition(max(1, min(shards * s.islands, 100_000)), "shard", "island")
        best = stage(dealt.select("shard", "island", "sizes", "elites").mapInArrow(run, schema), f"packing-epoch{epoch}")
        if epoch + 1 < s.epochs:
            stay = best.groupBy("shard", "island").agg(F.collect_list("packing").alias("own"))  # `elite` packings of one shard
            guests = best.groupBy("shard", "island").agg(F.max_by("packing", "fitness").alias("guest")).withColumn("island", (F.col("island") + 1) % s.islands)
            state = sizes.join(stay, "shard").join(guests, ["shard", "island"]).select("shard", "island", "sizes", F.array_distinct(F.array_append("own", F.col("guest"))).alias("elites"))

    chosen = best.groupBy("shard").agg(F.max_by("packing", F.struct("fitness", "packing")).alias("packing"))
    kind = docs.schema[0].dataType.simpleString()
    both = items.withColumn("packing", F.lit(None).cast("binary")).unionByName(chosen.withColumn("slot", F.lit(-1).cast("long")), allowMissingColumns=True)

    def placed(table):
        table = table.sort_by("slot")
        first = table.column("packing")[0].as_py() if table.column("slot")[0].as_py() == -1 else None
        table = table.slice(1) if first is not None else table
        if not table.num_rows:
            return None
        length = table.column("length").to_numpy()
        bins, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        small = length < s.length
        count = 0
        if first is not None:
            own = np.frombuffer(first, np.int32).astype(np.int64)
            bins[small] = own
            count = int(own.max()) + 1 if len(own) else 0
            order = np.argsort(own, kind="stable")
            run, group = np.cumsum(length[small][order]) - length[small][order], own[order]
            heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            run -= np.repeat(run[heads], np.diff(np.concatenate([heads, [len(group)]])))
            within = np.empty(len(own), np.int64)
            within[order] = run
            offset[small] = within
        bins[~small] = count + np.arange(int((~small).sum()))
        sequence = (table.column("shard").to_numpy().astype(np.int64) << 32) + bins
        columns = [table.column(c).combine_chunks() for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return per_group(both, ["shard"], placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
