"""Every operator and stage on odd rows, on no rows, and on the table that pipelines hand on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectorloom.llm import ann, avi, language_id, lm_scoring, minhash, mixing, packing, substring_dedup, toxicity, warc

N = 16


def labels(spark, odd):
    return odd.select("doc_id", F.lit(1).alias("quality"), F.when(F.col("doc_id") != 5, F.col("doc_id") % 2).cast("int").alias("toxic"))


PER_DOC = {
    "op1": lambda s, d: lm_scoring.score_documents(d),
    "op2": lambda s, d: avi.media_digest(d),
    "op3": lambda s, d: toxicity.score_toxicity(d, labels(s, d)),
    "op4": lambda s, d: language_id.identify(d),
    "op6": lambda s, d: substring_dedup.remove_repeats(d),
    "op8": lambda s, d: mixing.mix_report(d),
    "op10": lambda s, d: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", PER_DOC)
def test_a_row_for_each_row(spark, odd, none, name):
    assert PER_DOC[name](spark, odd).count() == N
    assert PER_DOC[name](spark, none).count() == 0


def test_lm(spark, odd):
    rows = {(r.doc_id, r.n_tokens): r for r in lm_scoring.score_documents(odd).collect()}
    assert rows[(1, 1)].n_known == 1 and rows[(2, 1)].base_score == rows[(1, 1)].base_score
    assert (3, 1) in rows and (4, 2) in rows and (8, 60_001) in rows and (9, 2) in rows
    assert all(r.score <= 0 and r.train_tokens == rows[(1, 1)].train_tokens for r in rows.values())
    one = odd.where("doc_id = 4")  # nothing to learn from but itself
    assert lm_scoring.score_documents(one).first().n_tokens == 2
    nothing = odd.where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")  # no row to learn from
    assert all((r.base_score, r.score, r.train_tokens) == (0, 0, 0) for r in lm_scoring.score_documents(nothing).collect())


def test_lm_slices_agree(spark, odd):
    """Several slices of the filter, and several passes, give the scores of one."""
    whole = {(r.doc_id, r.n_tokens): (r.n_known, r.base_score, r.score) for r in lm_scoring.score_documents(odd).collect()}
    tiny = lm_scoring.NgramModel.fit(odd.where("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2").select("text"), lm_scoring.Settings(block_bytes=50_000))
    assert len(tiny.slices) == 1
    first = tiny.blocks.agg(F.min("block"), F.max("block")).first()
    tiny.slices = [(b, b) for b in range(first[0], first[1] + 1)]
    tiny.shared.clear()
    both = tiny.score(odd).collect()  # one pass that takes slice after slice
    tiny.settings = lm_scoring.Settings(block_bytes=50_000, pass_mb=64)  # a pass for each slice
    for r in [*both, *tiny.score(odd).collect()]:
        n_known, base, score = whole[(r.doc_id, r.n_tokens)]
        assert r.n_known == n_known and abs(r.base_score - base) < 1e-6 * abs(base)
        assert abs(r.score - score) <= 0.6 + 0.014 * r.n_tokens


def test_lm_exchange_agrees(spark, odd):
    """N-grams dealt to the slices of a large filter give the scores of a broadcast one, bit for bit."""
    lm = lm_scoring.NgramModel.fit(odd.where("doc_id is null or doc_id <> 8").select("text"), lm_scoring.Settings(block_bytes=50_000))
    row = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score)
    broadcast = sorted(map(row, lm.score(odd).collect()))
    first = lm.blocks.agg(F.min("block"), F.max("block")).first()
    assert first[1] - first[0] >= 3
    lm.slices, lm.settings = [(b, b) for b in range(first[0], first[1] + 1)], lm_scoring.Settings(block_bytes=50_000, pass_mb=0, bundle_bytes=100_000)
    lm.shared.clear()
    assert sorted(map(row, lm.score(odd).collect())) == broadcast and len(broadcast) == N
    assert not lm.shared  # nothing was broadcast, so no task loads a whole filter for some megabytes of text
    assert lm.score(odd.limit(0)).count() == 0


def test_media(spark, odd):
    rows = {(r.doc_id, r.n_bytes): r for r in avi.media_digest(odd).collect()}
    assert rows[(1, 0)].payload_bytes == rows[(2, 0)].payload_bytes == 64 and rows[(9, 300_000)].payload_bytes == 300_032
    a, b = [r for r in rows.values() if r.doc_id in (6, 7)]
    assert a.media_sha256 == b.media_sha256 and a.feature == b.feature
    clips = avi.media_clips(avi.encode_media(odd.select("doc_id", "text")), "doc_id")
    assert clips.where("doc_id = 9").count() >= 1 and clips.where("end_ms <= start_ms").count() == 0
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id long, media binary")
    assert avi.media_clips(bad, "doc_id").count() == 0


def test_language(spark, odd):
    rows = {r.doc_id: r for r in language_id.identify(odd).collect() if r.doc_id is not None}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 11)) and rows[6].lang_pred in ("en", "fr")
    kept = language_id.keep_identified(odd, margin=1.0, known=0.0)
    assert kept.columns == odd.columns and kept.where("doc_id in (1, 2, 3, 11)").count() == 0
    assert language_id.keep_identified(odd.limit(0)).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_toxicity_without_labels(spark, odd):
    none = labels(spark, odd).limit(0)
    assert {(r.score, r.predicted) for r in toxicity.score_toxicity(odd, none).collect()} == {(0.0, 0)}


def test_substring(spark, odd):
    rows = substring_dedup.remove_repeats(odd).where("doc_id is not null").collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[7].removed_words > 40 and by[7].first_doc_ids == [6]
    assert all(r.removed_words == 0 for r in rows if r.doc_id != 7)
    assert substring_dedup.clean_documents(odd).columns == odd.columns


def test_packing(spark, odd, none):
    assert packing.pack(none).count() == 0
    rows = packing.pack(odd).collect()
    assert len({(r.doc_id, r.start) for r in rows if r.doc_id == 8}) > 100
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for a, n in sorted(spans):
            assert a == end
            end += n
        assert end <= 1024


def test_mixing(spark, odd):
    assert mixing.mix_documents(odd).columns == odd.columns
    empty = odd.withColumn("text", F.lit(None).cast("string"))
    assert mixing.mix_report(empty).agg(F.sum("taken"), F.sum("target")).first() == (0, 0.0)


def test_minhash(spark, odd):
    rows = {r.doc_id: r for r in minhash.near_duplicates(odd).collect() if r.doc_id is not None}
    assert rows[1].n_shingles == rows[2].n_shingles == rows[3].n_shingles == 0 and rows[4].n_shingles == 1
    assert rows[7].component_id == 6 and not rows[7].kept and rows[6].kept and rows[2].component_id == 2
    assert minhash.drop_near_duplicates(odd).columns == odd.columns


def test_warc(spark):
    big = "<p>" + "x" * 40_000 + "</p>"
    rows = [(1, "u", big), (2, None, big), (2, "v", big), (None, "w", big), (3, "x y\r\nz", None), (4, "", ""), (5, "", "é" * 600), (6, "", "é" * 600), (7, "", "short"), (8, "", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.page_report(pages).collect()), key=repr)
    want = [(1, 40007, "revisit", 2), (2, 40007, "response", None), (2, 40007, "response", None), (None, 40007, "response", None), (3, 0, "response", None), (4, 0, "response", None), (5, 1200, "revisit", 6), (6, 1200, "response", None), (7, 5, "response", None), (8, 5, "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.page_report(pages.limit(0)).count() == 0
    body = warc.read_archives(warc.write_archives(pages, warc.Settings(compress=True)), payload=True)
    assert {bytes(r.payload).decode() for r in body.collect() if r.payload is not None} == {big, "", "é" * 600, "short"}


def test_warc_files(spark, tmp_path):
    """Archives that lie about as files."""
    pages = spark.createDataFrame([(i, "u", "x" * (i * 9000)) for i in range(5)], "page_id long, url string, html string")
    for r in warc.write_archives(pages, warc.Settings(compress=True)).collect():
        (tmp_path / f"{r.archive}.gz").write_bytes(r.content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert sorted(r.payload_bytes for r in warc.read_archives(files).collect()) == [i * 9000 for i in range(5)]


def test_warc_damage(spark):
    """Damage gives a row with an error, and hurts no other record."""
    rows = [(1, "u", "x" * 40_000), (2, "u", "short"), (3, "u", "y" * 2000), (4, "u", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    names = [(r.archive, bytes(r.content)) for r in warc.write_archives(pages).orderBy("archive").collect()]

    def read(*contents):
        table = spark.createDataFrame([(c,) for c in contents], "content binary")
        return sorted((r.record_type or "", r.payload_bytes or -1, r.error or "") for r in warc.read_archives(table).collect())

    whole = dict(names)
    first, rest, again = (whole[n] for n in sorted(whole))
    small = [("response", 5, ""), ("response", 2000, "")]
    good = sorted([*small, ("response", 40_000, ""), ("revisit", 2000, "")])
    assert read(first, rest, again) == good
    assert read(first, again) == sorted([*small, ("response", -1, "missing or damaged segments"), ("revisit", 2000, "")])
    assert ("revisit", -1, "the response is missing") in read(again)
    at = first.index(b"y" * 2000) - 5
    assert ("response", -1, "damaged chunk") in read(first[:at] + b"7d1" + first[at + 3 :], rest, again)
    cut = first.index(b"short")
    broken = read(first[:cut] + first[cut + 3 :], rest, again)
    assert ("", -1, "record of a wrong length") in broken and ("response", 2000, "") in broken
    import gzip

    zipped = gzip.compress(b"WARC/1.1\r\nContent-Length: 0\r\nWARC-Type: response\r\n\r\n\r\n\r\n")
    assert read(zipped, None, b"", b"junk") == [("", -1, "not a WARC record"), ("response", -1, "")]
    assert read(zipped + zipped[:-4]) == [("", -1, "damaged gzip member"), ("response", -1, "")]
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")
    assert warc.hex_digest("sha1:" + "A" * 32) == "0" * 40 and warc.hex_digest("md5:00") == ""


def test_ann_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (200, [-0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(v, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100), (0, 2, 6), (0, 3, 200), (100, 1, 0), (100, 2, 6), (100, 3, 200), (200, 1, 6), (200, 2, 0), (200, 3, 100)]
    assert ann.search(v.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, none, tmp_path):
    import corpus_pipeline

    for docs in (odd, none):
        for k, (_, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, docs, "")
            if k + 1 < len(corpus_pipeline.STAGES):
                assert out.columns == docs.columns
            out.collect()


def test_ann_fit_memory():
    """The quantiser's fit holds no table of sample x lists distances, and finds what whole tables give."""
    import tracemalloc

    x = np.random.default_rng(1).standard_normal((12_000, 16))
    b = x[:300].copy()
    assert (ann.nearest(x, b) == ann.squared(x, b).argmin(1)).all()
    tracemalloc.start()
    model = ann.Quantiser.fit(x, 600_000, ann.Settings(rounds=1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.centres) == 774 and peak < 60e6  # 12,000 x 774 doubles are 74 MB, and three such tables were held
