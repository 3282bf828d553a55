"""Substring dedup by content-defined chunking.

A gear hash rolls over each text's UTF-8 bytes; a chunk ends where its top bits are zero, subject to a least and a
largest size. The hash at a byte depends on the `WINDOW` bytes before it only, so insertions shift no later boundary and
equal passages fall into equal chunks. What is compared is windows: the shortest sequences of neighbouring chunks with at
least `least_words` words, one from each chunk on and one up to each chunk, by 96-bit digests of their chunks' digests. A
window is a repeat if a document with a smaller doc_id holds the whole of it; all repeats are removed. So what is cut
stands, `least_words` words at a time, in one earlier document, which may have lost it to a still earlier one; the first
holder of a window keeps what no earlier window covers. Repeats within one document stay.

Boundaries fall into step only after some bytes of a passage, so a repeated passage of 50 words and more shows as a run
that is shorter by a few chunks; the default threshold allows for that.

Null texts stay null, empty ones empty. Rows without doc_id are left alone and make no other row a repeat. Rows that
repeat a doc_id count as one document; nothing is removed from them on each other's account. Long texts are chunked
whole, in segments. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.llm import _text as X
from vectorloom.llm._spark import arrow_batches, shuffle_partitions, stage

WINDOW = 8
SEGMENT = 1 << 20  # bits of a filter's segment
GEAR = (X.mix(np.arange(1001, 1257, dtype=np.uint64)) >> np.uint64(56)).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    mask_bits: int = 4
    least_bytes: int = 8
    most_bytes: int = 128
    least_words: int = 22
    filter_bits: int = 1 << 28


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The 8-bit gear hash after each byte: the sum of the last 8 bytes' values, each shifted by its distance."""
    h = GEAR[data]
    for step in (1, 2, 4):
        h[step:] = h[step:] + (h[:-step] << np.uint8(step))
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Ends of each row's chunks, as places in data.

    Where no boundary comes before `most_bytes`, as in periodic text, the first place of the largest hash is one."""
    hashes = gear_hashes(data)
    hit = np.flatnonzero(hashes >> np.uint8(8 - s.mask_bits) == 0) + 1 if len(data) else np.zeros(0, np.int64)
    at = np.searchsorted(hit, offsets + 1)
    hits, out = hit.tolist(), []
    least, most = max(s.least_bytes, WINDOW), s.most_bytes
    for i in range(len(offsets) - 1):
        end = int(offsets[i + 1])
        ends, last = [], int(offsets[i])
        for c in [*hits[at[i] : at[i + 1]], end]:
            while c - last > most:
                last += least + int(hashes[last + least - 1 : last + most].argmax())
                ends.append(last)
            if c - last >= least or c == end > last:
                ends.append(c)
                last = c
        out.append(np.array(ends, np.int64))
    return out


def digests(data: np.ndarray, start: int, ends: np.ndarray) -> np.ndarray:
    import xxhash

    view, digest, last, out = memoryview(data), xxhash.xxh3_64_intdigest, start, []
    for end in ends.tolist():
        out.append(digest(view[last:end]))
        last = end
    return np.array(out, np.uint64).view(np.int64)


def windows(data: np.ndarray, offsets: np.ndarray, s: Settings):
    """(starts, ends, a, b, digest, check): the rows' chunks, and the first and last chunk and the digests of each window.

    A window never leaves its row. Prefix sums give a window's digests, so long windows cost no more than short ones."""
    of_row = chunk_ends(data, offsets, s)
    rows = np.repeat(np.arange(len(of_row)), [len(e) for e in of_row])
    ends = np.concatenate([*of_row, np.zeros(0, np.int64)])
    starts = np.concatenate([np.zeros(min(1, len(ends)), np.int64), ends[:-1]])  # rows are neighbours
    begins, least = X.words(data, offsets)[0], max(1, s.least_words)
    n = np.arange(len(ends))
    # from each chunk on: the chunk that holds the beginning of the last word needed
    last = np.searchsorted(begins, starts) + least - 1
    a = n[last < len(begins)]
    b = np.searchsorted(ends, begins[last[a]], "right")
    # up to each chunk: the chunk that holds the beginning of the first word needed
    first = np.searchsorted(begins, ends) - least
    d = n[first >= 0]
    c = np.searchsorted(ends, begins[first[d]], "right")
    new = ~np.isin(d, b)  # elsewhere the last window from a chunk on is the one up to d
    a, b = np.concatenate([a, c[new]]), np.concatenate([b, d[new]])
    own = rows[a] == rows[b]
    a, b = a[own], b[own]
    one = np.concatenate([digests(data, int(o), e) for o, e in zip(offsets, of_row)] + [np.zeros(0, np.int64)]).view(np.uint64)
    up, down = X._power_tables(len(one) + 1)
    out = []
    for x in (one, X.mix(one ^ np.uint64(0xD6E8FEB86659FD93))):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        out.append(X.mix((sums[b + 1] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
    return starts, ends, a, b, out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bit_filter(found: DataFrame, s: Settings):
    """A broadcast bitmap with the bit of every digest in `found` set; a digest's bit is the number of its top bits.

    It has about sixteen bits a digest up to filter_bits, which bounds the broadcast; beyond that more digests pass for
    nothing, and are dropped by the join that follows. Segments are built where their digests meet."""
    size = max(SEGMENT, min(s.filter_bits, 16 * found.count()))
    bits = (size - 1).bit_length()

    def segments(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            for block in np.unique(at // np.uint64(SEGMENT)):
                held.setdefault(int(block), np.zeros(SEGMENT, bool))[(at[at // np.uint64(SEGMENT) == block] % np.uint64(SEGMENT)).astype(np.int64)] = True
        for block, on in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    spark = found.sparkSession
    shift = 64 - bits + (SEGMENT - 1).bit_length()
    block = F.shiftrightunsigned("digest", shift) if shift < 64 else F.lit(0)
    dealt = found.select("digest").repartition(shuffle_partitions(spark), block)
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for r in dealt.mapInArrow(segments, "block long, bits binary").toLocalIterator():
        whole[r.block * SEGMENT // 8 : (r.block + 1) * SEGMENT // 8] |= np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast((bits, whole))


def window_rows(docs: DataFrame, s: Settings, wanted=None) -> DataFrame:
    """(digest, check, doc_id): the distinct windows of each row of (doc_id, text), or those that pass the filter."""

    def run(batches):
        for batch in batches:
            data, offsets = X.byte_column(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in X.row_groups(offsets):
                part, at = np.ascontiguousarray(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
                starts, _, a, _, digest, check = windows(part, at, s)
                if wanted is not None:
                    bits, on = wanted.value
                    place = (digest.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
                    some = on[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
                    a, digest, check = a[some], digest[some], check[some]
                row = np.searchsorted(at, starts[a], "right") - 1
                order = np.lexsort((check, digest, row))
                row, digest, check = row[order], digest[order], check[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])
                digest, check, who = digest[once], check[once], ids[i:j][row[once]]
                for lo in range(0, len(digest), 200_000):
                    yield pa.RecordBatch.from_arrays([pa.array(digest[lo : lo + 200_000]), pa.array(check[lo : lo + 200_000]), pa.array(who[lo : lo + 200_000], pa.int64())], ["digest", "check", "doc_id"])

    return docs.mapInArrow(run, "digest long, check int, doc_id long")


def remove_repeats(docs: DataFrame, settings: Settings = Settings(), details: bool = True) -> DataFrame:
    """docs with the repeated runs cut from text; with details also n_chunks, removed_words, removed_spans, first_doc_ids.

    removed_spans are [start, end) byte ranges of the text as it was; first_doc_ids the documents that keep the chunks."""
    s = settings
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''")
    firsts = window_rows(plain, s).groupBy("digest", "check").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    firsts = stage(firsts, "substring-firsts")
    repeats = window_rows(plain, s, bit_filter(firsts, s)).join(firsts.hint("merge"), ["digest", "check"]).where("first < doc_id")
    marks = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "check", "first")).alias("__vl_repeats")).withColumnRenamed("doc_id", "__vl_doc")
    joined = docs.withColumn("__vl_text", F.col("text").cast("string")).join(marks, F.col("doc_id").cast("long") == F.col("__vl_doc"), "left").drop("__vl_doc")
    names = docs.columns
    extra = [("n_chunks", "int"), ("removed_words", "int"), ("removed_spans", "array<struct<start:bigint,end:bigint>>"), ("first_doc_ids", "array<bigint>")] if details else []
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = X.byte_column(batch.column("__vl_text"))
            texts = batch.column("__vl_text").to_pylist()
            n_chunks, words, spans, origins = [], [], [], []
            lists = batch.column("__vl_repeats")
            place = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
            flat = lists.flatten()
            digest, check, holder = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("digest", "check", "first"))
            for i in range(batch.num_rows):
                part = np.ascontiguousarray(data[offsets[i] : offsets[i + 1]])
                gone, first, lost, count = [], set(), 0, 0
                own = slice(int(place[i]), int(place[i + 1]))
                if own.start < own.stop:
                    at = np.array([0, len(part)])
                    starts, ends, a, b, have, also = windows(part, at, s)
                    count = len(ends)
                    order = np.argsort(digest[own], kind="stable")
                    near = order[np.minimum(np.searchsorted(digest[own], have, sorter=order), len(order) - 1)]
                    hit = (digest[own][near] == have) & (check[own][near] == also)
                    a, b, source = a[hit], b[hit], holder[own][near[hit]]
                    step = np.zeros(count + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, b + 1, -1)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(step) > 0]).astype(np.int8)))
                    begins = X.words(part, at)[0]
                    for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                        lo, hi = int(starts[x]), int(ends[y - 1])
                        # whole characters only
                        while lo < hi and part[lo] & 0xC0 == 0x80:
                            lo += 1
                        while hi < len(part) and hi > lo and part[hi] & 0xC0 == 0x80:
                            hi -= 1
                        n = int(np.searchsorted(begins, hi) - np.searchsorted(begins, lo))
                        if n >= s.least_words:
                            gone.append({"start": lo, "end": hi})
                            first |= set(source[(a >= x) & (b < y)].tolist())
                            lost += n
                elif details:
                    count = len(chunk_ends(part, np.array([0, len(part)]), s)[0])
                if gone:
                    keep = np.ones(len(part), bool)
                    for g in gone:
                        keep[g["start"] : g["end"]] = False
                    texts[i] = part[keep].tobytes().decode("utf-8", "replace")
                n_chunks.append(count)
                words.append(lost)
                spans.append(gone)
                origins.append(sorted(first))
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            if details:
                columns += [pa.array(n_chunks, pa.int32()), pa.array(words, pa.int32()), pa.array(spans, span), pa.array(origins, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(e for e, _ in extra)])

    types = {f.name: "string" if f.name == "text" else f.dataType.simpleString() for f in docs.schema}
    return joined.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*types.items(), *extra]))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, its text without the repeated passages, what was removed, and which documents keep it."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def clean_documents(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """docs with the repeated passages cut; columns as before, n_chars (where there is one) as of the new text.

    A document of which nothing but separators is left is a repeat as a whole and goes."""
    out = remove_repeats(docs.withColumn("__vl_before", F.col("text")), settings, details=False)
    changed = F.col("text") != F.col("__vl_before")
    out = out.where(~F.coalesce(changed & (F.regexp_replace("text", r"[\x20\x09-\x0D]", "") == ""), F.lit(False)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
