"""MinHash near-duplicate detection with bottom-k sketches from one hash function.

1. Every document's set of word shingles is hashed once; its `k` smallest values are its sketch. Rows with equal sets
   form a class, whose number is a hash of the set.
2. Sketch values held by two classes or more form inverted lists. Two sets of Jaccard similarity t share at least m
   retained values (m: `overlap` for full sketches, exact for sets below k), so each class needs only be listed under
   its rarest values: with s values it may leave out m - 1, and it leaves out the most frequent ones. Values that
   everybody holds thus have short lists.
3. Every member of a list meets the list's smallest member; the pair's similarity is estimated from the union sketch
   (the k smallest values of both) and pairs that may reach t are kept. In lists whose members don't come together in
   one component, those outside its largest component meet all others, in blocks, and give the edges that join components.
4. The full sets of a loose component are compared exactly. Its members are dealt to blocks, all pairs of a block are
   compared, and `leaders` members that go to every block tie the blocks together: a group of n copies costs n rows and
   a few for each block, not pairs of blocks. Where a component of several blocks has not become one, the members outside
   its largest true component meet all others. Only the edges of a spanning forest of the true links are returned, so a
   group of n copies yields n - 1 edges. Their components are the result.

Set hashes have 64 bits. With t = 0.8, k = 32 and an overlap of 12 a pair at exactly t is missed by the sketches with a
probability below 3e-8, and even then its documents are compared if both are in one loose component.

Null, empty and blank texts have no shingles and are linked with nothing. A row without doc_id has no component. Rows
that repeat a doc_id are one node for each different set of shingles: their component is that of their own text. Ties
don't arise: the smallest doc_id leads. Very long texts are hashed whole. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectorloom.llm import _text as X
from vectorloom.llm._spark import arrow_batches, components, per_group, salted_join, stage

U64 = np.uint64


@dataclass(frozen=True)
class Settings:
    words: int = 4
    percent: int = 80
    k: int = 32
    overlap: int = 12
    least_estimate: float = 0.375
    block: int = 512
    leaders: int = 8
    columns: int = 4096


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketches(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, n, d1, d2, sketch) of (doc_id, text): the set's size, a 128-bit digest of it, its k smallest values."""

    def run(batches):
        for batch in batches:
            data, offsets = X.byte_column(batch.column(1))
            n, digests, sketch, ends = [], [], [], [0]
            for i, j in X.row_groups(offsets):
                for values in X.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.words):
                    n.append(len(values))
                    digests.append(digest_of(values))
                    sketch.append(values[: s.k])
                    ends.append(ends[-1] + min(s.k, len(values)))
            flat = signed(np.concatenate(sketch)) if sketch else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            d1, d2 = (pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1))
            columns = [batch.column(0), pa.array(n, pa.int64()), d1, d2, lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "d1", "d2", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, sketch array<long>")


def union_estimate(k: int):
    """Estimated Jaccard similarity of the columns a and b, sorted sketches, from the k smallest values of both."""
    union = F.slice(F.array_sort(F.array_union("a", "b")), 1, k)
    return F.size(F.array_intersect(F.array_intersect("a", "b"), union)) / F.size(union)


class Forest:
    """Union-find over positions; the smaller one leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def overlaps(sets: list[np.ndarray], columns: int) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 blocks of at most `columns` values."""
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    values, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = count >= 2
    number = np.cumsum(shared) - 1
    keep = shared[back]
    row, col = row[keep], number[back][keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(col, [lo, lo + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[a:b], col[a:b] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def within_blocks(members: DataFrame, group: str, member: str, size: int, leaders: int) -> DataFrame:
    """members with a block number bi: blocks of about `size` members of a group, and `leaders` of the group in each."""
    count = members.groupBy(group).agg(F.ceil(F.count("*") / size).cast("int").alias("__n"))
    dealt = salted_join(members, count, group, member).withColumn("bi", F.pmod(F.xxhash64(member), F.col("__n")).cast("int"))
    # the leaders are found by a limited window, on the numbers of members of large groups alone
    large = dealt.where("__n > 1")
    first = Window.partitionBy(group).orderBy(F.xxhash64(member, F.lit(1)), member)
    lead = large.select(group, member, "__n").withColumn("__r", F.row_number().over(first)).where(F.col("__r") <= leaders)
    lead = lead.select(group, member, F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("bi"))
    again = large.drop("bi", "__n").join(lead, [group, member])
    return dealt.drop("__n").unionByName(again)


def against_others(members: DataFrame, group: str, member: str, label: str, size: int) -> DataFrame:
    """members with block numbers (bi, bj): the members of a group outside its most frequent label meet all of it.

    Groups of one label are left out. A member is copied once for every block of those others, and one of these once for
    every block of the group."""
    per = members.groupBy(group, label).agg(F.count("*").alias("n"))
    parts = per.groupBy(group).agg(F.max(F.struct("n", label)).alias("m"), F.sum("n").alias("all"))
    others = F.col("all") - F.col("m.n")
    blocks = lambda n: F.ceil(n / size).cast("int")
    parts = parts.where(others > 0).select(group, F.col(f"m.{label}").alias("__main"), blocks(F.col("all")).alias("__a"), blocks(others).alias("__o"))
    dealt = salted_join(members, parts, group, member)
    one_of = lambda n: F.pmod(F.xxhash64(member), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = dealt.withColumn("bj", one_of("__a")).withColumn("bi", all_of("__o"))
    few = dealt.where((F.col("__a") > 1) & (F.col(label) != F.col("__main")))  # a single block has them already
    few = few.withColumn("bi", one_of("__o")).withColumn("bj", all_of("__a"))
    return every.unionByName(few).drop("__main", "__a", "__o")


def linked(table: pa.Table, value: str, member: str, test, known: str | None = None) -> pa.RecordBatch | None:
    """Spanning-forest edges (a, b) of the pairs of a block that pass `test(sets)`, a matrix of booleans."""
    ids = np.array(table.column(member).to_pylist())
    first = np.unique(ids, return_index=True)[1]
    if len(first) < 2:
        return None
    table, ids = table.take(pa.array(first)), ids[first]
    good = np.triu(test([np.frombuffer(x, U64) for x in table.column(value).to_pylist()]), 1)
    forest, edges = Forest(len(ids)), []
    if known:  # members of one component needn't be joined again
        lead: dict = {}
        for i, c in enumerate(table.column(known).to_pylist()):
            forest.join(lead.setdefault(c, i), i)
    for i, j in zip(*np.nonzero(good)):
        if forest.join(int(i), int(j)):
            edges.append((int(ids[i]), int(ids[j])))
    if not edges:
        return None
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])


def digest_of(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set of hashes, as signed numbers."""
    if not len(values):
        return 0, 0
    two = np.array([values.sum(dtype=U64), np.bitwise_xor.reduce(values * U64(0x9FB21C651E98DF25) ^ values >> U64(32))])
    return tuple(signed(two).tolist())


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of (doc_id, text)."""
    s = settings
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = stage(sketches(docs, s), "minhash-rows")
    classes = rows.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2")
    classes = classes.agg(F.min("doc_id").alias("first_doc"), F.first("sketch").alias("sketch"))
    reps = stage(classes.withColumn("rep", F.xxhash64("n", "d1", "d2")), "minhash-classes")

    # the rarest values of each class
    values = reps.select("rep", "n", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    smallest, largest = F.ceil(F.col("n") * s.percent / 100 - 1e-9), F.floor(F.col("n") * 100 / s.percent + 1e-9)
    exact = F.greatest(F.lit(1), smallest - F.greatest(F.lit(0), largest - s.k))
    least = F.when(F.col("n") >= s.k, F.lit(s.overlap)).otherwise(exact)
    listed = values.join(common.hint("merge"), "v").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("held"))
    listed = listed.withColumn("take", (F.size("held") - least + 1).cast("int")).where("take > 0")
    lists = listed.select("rep", F.explode(F.slice("held", 1, F.col("take"))).alias("x"))
    lists = stage(lists.select("rep", F.col("x.v").alias("v")), "minhash-lists")

    # members against the first of each list
    first = lists.groupBy("v").agg(F.min("rep").alias("first"))
    pairs = salted_join(lists, first, "v", "rep").where("rep <> first").select("rep", "first").distinct()
    sketch = reps.select("rep", "sketch")
    tried = pairs.join(sketch.withColumnRenamed("sketch", "a"), "rep").join(sketch.toDF("first", "b"), "first")
    tried = tried.where(union_estimate(s.k) >= s.least_estimate)
    near = stage(tried.select(F.col("rep").alias("a"), F.col("first").alias("b")), "minhash-near")
    loose = components(near, "a", "b", "minhash-loose")

    # lists that more than one component shares
    placed = lists.join(loose.toDF("rep", "c"), "rep", "left").select("v", "rep", F.coalesce("c", "rep").alias("c"))
    open_lists = placed.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("v")
    members = salted_join(placed, open_lists, "v", "rep").join(sketch, "rep").select("v", "rep", "c", "sketch")

    def may_reach(sets):
        size = np.array([len(x) for x in sets])
        same = overlaps(sets, s.columns)
        # the union sketch has k values, or all of both
        union = np.minimum(s.k, size[:, None] + size[None, :] - same)
        return same >= s.least_estimate * union

    def compare_sketches(table):
        packed = pa.array([np.array(x, np.int64).tobytes() for x in table.column("sketch").to_pylist()], pa.binary())
        table = table.set_column(table.schema.get_field_index("sketch"), "sketch", packed)
        return linked(table, "sketch", "rep", may_reach, known="c")

    met = against_others(members, "v", "rep", "c", s.block)
    more = per_group(met, ["v", "bi", "bj"], compare_sketches, "a long, b long")
    loose = stage(components(near.union(more), "a", "b", "minhash-groups"), "minhash-members")

    # exact comparison of full sets
    wanted = loose.toDF("rep", "c").join(reps.select("rep", "first_doc", "d1", "d2"), "rep").withColumnRenamed("first_doc", "doc_id")
    texts = docs.join(wanted.hint("merge"), "doc_id").select("doc_id", "rep", "c", "d1", "d2", "text")

    def full_sets(batches):
        doc, had = None, set()  # rows of one doc_id follow each other; equal texts are read once
        for batch in batches:
            data, offsets = X.byte_column(batch.column(5))
            keep, sets = [], []
            names = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)))
            found = (
                x
                for i, j in X.row_groups(offsets)
                for x in X.shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], s.words)
            )
            for i, (values, (own, rep, *digest)) in enumerate(zip(found, names)):
                if own != doc:
                    doc, had = own, set()
                # a repeated doc_id may have other texts too
                if rep not in had and digest_of(values) == tuple(digest):
                    had.add(rep)
                    keep.append(i)
                    sets.append(values.tobytes())
            at = pa.array(keep, pa.int64())
            columns = [batch.column(1).take(at), batch.column(2).take(at), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "c", "values"])

    sets = stage(texts.mapInArrow(full_sets, "rep long, c long, values binary"), "minhash-sets")

    def same(sets):
        size = np.array([len(x) for x in sets])
        if len(sets) > 4:
            inter = overlaps(sets, s.columns)
        else:
            inter = np.array([[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets])
        return (100 * inter >= s.percent * (size[:, None] + size[None, :] - inter)) & (inter > 0)

    blocks = within_blocks(sets, "c", "rep", s.block, s.leaders)
    links = per_group(blocks, ["c", "bi"], lambda t: linked(t, "values", "rep", same), "a long, b long")
    links = stage(links, "minhash-links")
    found = components(links, "a", "b", "minhash-found").toDF("rep", "root")
    # components of several blocks that have not become one
    large = sets.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > s.block).drop("n")
    if large.limit(1).count():
        own = salted_join(sets, large, "c", "rep").join(found.toDF("rep", "g"), "rep", "left")
        met = against_others(own.withColumn("g", F.coalesce("g", "rep")), "c", "rep", "g", s.block)
        rest = per_group(met, ["c", "bi", "bj"], lambda t: linked(t, "values", "rep", same, known="g"), "a long, b long")
        rest = stage(rest, "minhash-rest")
        if rest.limit(1).count():
            found = components(links.union(rest), "a", "b", "minhash-joined").toDF("rep", "root")

    # a component is named by its smallest doc_id
    placed = reps.select("rep", "first_doc").join(found, "rep")
    named = placed.groupBy("root").agg(F.min("first_doc").alias("least"))
    placed = salted_join(placed, named, "root", "rep").select("rep", "least")
    classes = reps.select("n", "d1", "d2", "rep", "first_doc").join(placed, "rep", "left")
    classes = classes.select("n", "d1", "d2", F.coalesce("least", "first_doc").alias("root"))
    out = rows.select("doc_id", "n", "d1", "d2").join(classes.hint("merge"), ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, settings: Settings = Settings(words=5)) -> DataFrame:
    """docs without the documents that are near-duplicates of one with a smaller doc_id; columns as before.

    A doc_id that several rows repeat goes if none of its texts is kept."""
    found = near_duplicates(docs.select("doc_id", "text"), settings).where("doc_id is not null")
    gone = found.groupBy(F.col("doc_id").alias("__vl_gone")).agg(F.max("kept").alias("kept")).where(~F.col("kept")).drop("kept")
    return docs.join(gone, F.col("doc_id") == F.col("__vl_gone"), "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
