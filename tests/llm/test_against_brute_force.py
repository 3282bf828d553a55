"""Results on the small tables against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from helpers import agree, rows_of
from pyspark.sql import functions as F

from vectorloom.llm import ann, avi, language_id, lm_scoring, minhash, mixing, packing, registry, substring_dedup, toxicity

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SF = "/root/testdata/sf0.01"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, small, name):
    df = registry.QUERIES[name](spark, small)
    names = sorted(df.columns)
    assert agree([tuple(r) for r in df.select(*names).collect()], rows_of(duck.execute(registry.oracle_sql()[name]), names))


def test_lm(docs, texts):
    tokens = {k: [*words(t), None] for k, t in texts.items()}
    count = collections.Counter(x for k, w in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for x in w)
    total, kinds = sum(count.values()), len(count)
    rows = lm_scoring.score_documents(docs).collect()
    for r in rows:
        w = tokens[r.doc_id]
        base = sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(count[x] > 0 for x in w), total, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the same model from exact counts
    pairs = collections.Counter(x for k, w in tokens.items() if zlib.crc32(str(k).encode()) % 7 != 2 for x in zip(w, w[1:]))
    s, off = lm_scoring.Settings(), []
    for r in rows:
        want, last = 0.0, None
        for x in tokens[r.doc_id]:
            p = (count[x] + 1) / (total + kinds + 1)
            if last is not None and count[last]:
                weight = count[last] / (count[last] + s.a * count[last] ** s.b)
                p = weight * pairs[(last, x)] / count[last] + (1 - weight) * p
            want, last = want + math.log10(p), x
        off.append(abs(r.score - want))
        assert off[-1] <= 0.6 + 0.014 * len(tokens[r.doc_id])  # log10(65 / 64) for each of two counts; a false hit doubles one
    assert sum(off) <= 0.003 * sum(map(len, tokens.values())), (max(off), sum(off), sum(map(len, tokens.values())))


@pytest.fixture(scope="module")
def lm(docs):
    return lm_scoring.NgramModel.fit(docs.select("text"), lm_scoring.Settings())


def test_lm_probabilities_sum_to_one(lm, docs):
    """Over all words and an unknown one, without a context and after rare and frequent words."""
    import pyarrow as pa

    part, value = lm._slice(0).value, lm_scoring.values()
    data, offsets = lm_scoring.X.byte_column(pa.array([r.text for r in docs.collect()]))
    token = np.unique(lm_scoring.tokens(data, offsets)[0])
    key = token & np.uint64(0xFFFFFFFFFFFFFFFC)
    exact, read, total = part.exact(key), value[part.codes(key)], lm.mass + lm.types + 1
    assert len(token) == lm.types and math.isclose((read + 1).sum() + 1, total)
    rng = np.random.default_rng(0)
    for lo, hi in ((1, 2), (2, 5), (5, 20), (20, 100), (100, 1000), (1000, 10**9)):
        some = np.flatnonzero((exact >= lo) & (exact < hi) & (token != np.uint64(lm_scoring.END)))
        for i in rng.choice(some, min(8, len(some)), replace=False):
            both = np.empty(2 * len(token), np.uint64)
            both[::2], both[1::2] = token[i], token
            pair = lm_scoring.X.chain(both, 2)[::2] & np.uint64(0xFFFFFFFFFFFFFFFC) | np.uint64(1)
            mass = 0.0
            for lot in range(0, len(token), 5000):  # a column: the context, then one word
                codes = np.zeros((2, 2, len(token[lot : lot + 5000])), np.uint16)
                codes[0, 0], codes[0, 1] = part.codes(key[i : i + 1])[0], part.codes(key[lot : lot + 5000])
                codes[1, 1] = part.codes(pair[lot : lot + 5000])
                flat = codes.transpose(0, 2, 1).reshape(2, -1)
                begun = np.tile([0, 1], flat.shape[1] // 2)
                mass += lm_scoring.probability(flat, begun, total, lm.settings.a, lm.settings.b)[1::2].sum()
            unknown = np.array([[part.codes(key[i : i + 1])[0], 0], [0, 0]], np.uint16)
            mass += lm_scoring.probability(unknown, np.arange(2), total, lm.settings.a, lm.settings.b)[1]
            assert 0.98 <= mass <= 1.02, (exact[i], mass)


def test_filter_counts(lm):
    """Counts are read to six binary digits, with hardly any false hits; words that were not seen are not found."""
    part, value = lm._slice(0).value, lm_scoring.values()
    n = part.exact(part.words)
    want, got = value[lm_scoring.quantised(n)], value[part.codes(part.words)]
    assert (np.abs(want / n - 1) <= 1 / 64).all() and (want[n < 64] == n[n < 64]).all() and n.sum() == lm.tokens
    assert (got >= want).all() and (got > want).mean() < 0.02
    import pickle

    again = pickle.loads(pickle.dumps(part))
    assert (again.codes(part.words) == part.codes(part.words)).all() and (again.exact(part.words) == n).all()
    unseen = np.arange(1, 200_001, dtype=np.uint64) << np.uint64(2)
    assert (part.codes(unseen) > 0).sum() <= 1


def test_lm_order_three(docs):
    few = docs.limit(200)
    score = {n: sum(r.score for r in lm_scoring.score_documents(few, lm_scoring.Settings(order=n)).collect()) for n in (2, 3)}
    assert score[3] > score[2]  # mostly training texts


def test_media_round_trip(docs, texts):
    import hashlib

    for r in avi.media_digest(docs).collect():
        p = avi.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_shots_and_decoding():
    """Two scenes of flat frames are two shots, and their samples are read back as they were stored."""
    frames = avi.write_avi([bytes([200]) * 64 * 16 * 12 + bytes(range(256)) * 4 * 12])[0]
    opened, ms = avi.read_avi(frames)
    histograms, stored = avi.decode(opened)
    assert len(opened) == 24 and ms == 40 and b"".join(stored) == bytes([200]) * 64 * 16 * 12 + bytes(range(256)) * 4 * 12
    assert [(a, b) for a, b, _ in avi.shots(histograms)] == [(0, 12), (12, 24)]
    basis = avi.inverse_dct() / (1 << 14)
    assert np.allclose(basis @ basis.T, np.eye(64), atol=1e-3)


def test_shots_by_hand():
    """Cuts where the difference of neighbouring histograms stands out from those around it."""
    import random

    rng = random.Random(2)
    for n in (1, 2, 3, 4, 9, 40):
        rows, level = [], 0
        for _ in range(n):
            level = rng.choice([0, 2, 5]) if rng.random() < 0.2 else level
            rows.append([10 * (i == level) + rng.randrange(3) for i in range(6)])
        share = [[x / max(1, sum(r)) for x in r] for r in rows]
        d = [sum(abs(x - y) for x, y in zip(a, b)) / 2 for a, b in zip(share, share[1:])]
        cuts = [0]
        for i, x in enumerate(d):
            near = [d[j] for j in range(max(0, i - avi.WINDOW), min(len(d), i + avi.WINDOW + 1)) if j != i]
            if len(near) >= 2:
                mean = sum(near) / len(near)
                spread = math.sqrt(sum((y - mean) ** 2 for y in near) / len(near))
                if x > max(avi.LEAST, mean + avi.DEVIATIONS * spread):
                    cuts.append(i + 1)
        assert [(a, b) for a, b, _ in avi.shots(np.array(rows, float))] == list(zip(cuts, [*cuts[1:], n]))


def test_default_tables():
    """A frame without tables: three components, four luma blocks a unit, no restarts, coded by the standard's tables."""
    codes = {}
    for number in avi.DEFAULT_TABLES:
        lengths, symbols = avi.default_table(number)
        assert sum(lengths) == len(symbols) == len(set(symbols)) == (162 if number & 0x10 else 12)
        code, k = 0, 0
        for bits in range(1, 17):
            for _ in range(lengths[bits - 1]):
                codes[(number, symbols[k])] = f"{code:0{bits}b}"
                code, k = code + 1, k + 1
            code <<= 1

    def put(number, run, value):
        size = abs(value).bit_length()
        extra = value if value > 0 else value + (1 << size) - 1
        return codes[(number, run << 4 | size)] + (f"{extra:0{size}b}" if size else "")

    rng = np.random.default_rng(3)
    blocks = np.zeros((2, 6, 64), int)  # units, blocks of a unit
    blocks[:, :, 0] = rng.integers(-900, 900, (2, 6))
    for b in blocks.reshape(-1, 64):
        b[rng.integers(1, 64, 9)] = rng.integers(-300, 300, 9)
    bits, last = "", [0, 0, 0]
    for unit in blocks:
        for i, b in enumerate(unit):
            part = max(0, i - 3)
            table = int(part > 0)
            bits += put(table, 0, int(b[0]) - last[part])
            last[part] = int(b[0])
            run = 0
            for x in b[1 : np.flatnonzero(b)[-1] + 1 if b[1:].any() else 1].tolist():
                if not x:
                    run += 1
                    continue
                while run > 15:
                    bits, run = bits + codes[(0x10 | table, 0xF0)], run - 16
                bits, run = bits + put(0x10 | table, run, x), 0
            if not b[63]:
                bits += codes[(0x10 | table, 0)]
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + avi._segment(0xDB, bytes([0] + [1] * 64)) + avi._segment(0xC0, bytes([8, 0, 16, 0, 32, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])) + avi._segment(0xDA, bytes([3, 1, 0, 2, 0x11, 3, 0x11, 0, 63, 0]))
    out, component, _ = avi.coefficients([head + data + b"\xff\xd9"], head)
    assert (out[0].reshape(2, 6, 64) == blocks).all() and component.tolist() == [0, 0, 0, 0, 1, 2] * 2


def test_missing_index():
    data = avi.write_avi([b"a" * 64 * 40])[0]
    at = data.index(b"idx1")
    assert avi.read_avi(data[:at])[0] == avi.read_avi(data)[0]


def test_language_held_out(docs):
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in language_id.identify(docs).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.98


JUNK = [
    "Съешь же ещё этих мягких французских булок да выпей чаю " * 3,
    "人人生而自由在尊严和权利上一律平等他们赋有理性和良心",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια",
    "qzx vkj wqq zzx jjq " * 10,
    "x" * 300,
    "12 34 !!",
    None,
]


def test_language_stage(spark, docs):
    """Texts in no learned language go, those in a learned one stay, be they short; every rule against plain NumPy."""
    rows = [(1_000_000 + i, t, "en") for i, t in enumerate(JUNK)]
    mixed = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.keep_identified(mixed).collect()}
    assert not kept & {k for k, _, _ in rows}
    gone = {r.doc_id: r.text for r in docs.collect() if r.doc_id not in kept}
    assert len(gone) <= 0.002 * docs.count(), gone
    model = language_id.LanguageModel.fit(docs.select("doc_id", "text", "lang"))
    s, some = model.settings, [r for r in docs.collect() if r.lang == "fr"]
    df = np.zeros(s.buckets)
    for at, _ in language_id.features([r.text for r in some], s):
        df[at] += 1
    for r, got in zip(some[:40], model.predict([r.text for r in some[:40]])):
        at, n = next(language_id.features([r.text], s))
        if got[0] == "fr":
            want = sum(c * math.log1p(df[b]) / math.log1p(len(some)) for b, c in zip(at, n)) / n.sum()
            assert math.isclose(got[3], want, rel_tol=1e-5) and got[1] >= got[2]


def test_ftrl_steps():
    """The vectorised learner against FTRL-proximal written out, a weight at a time."""
    rng = np.random.default_rng(4)
    s = language_id.Settings(epochs=2, l1=0.05, l2=0.01)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3), int(rng.integers(3))) for _ in range(30)]
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(b, c):
        if abs(z[b][c]) <= s.l1:
            return 0.0
        return -(z[b][c] - math.copysign(s.l1, z[b][c])) / ((s.beta + math.sqrt(n[b][c])) / s.alpha + s.l2)

    for epoch in range(s.epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            at, x, y = rows[i]
            terms = [*zip(at.tolist(), x.tolist()), (6, 1.0)]
            w = {(b, c): weight(b, c) for b, _ in terms for c in range(3)}
            logit = [sum(v * w[(b, c)] for b, v in terms) for c in range(3)]
            whole = sum(math.exp(v) for v in logit)
            for b, v in terms:
                for c in range(3):
                    g = v * (math.exp(logit[c]) / whole - (c == y))
                    z[b][c] += g - (math.sqrt(n[b][c] + g * g) - math.sqrt(n[b][c])) / s.alpha * w[(b, c)]
                    n[b][c] += g * g
    assert np.allclose(language_id.train_ftrl(rows, 3, 6, s), [[weight(b, c) for c in range(3)] for b in range(7)])


def test_toxicity_held_out(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p and not t for p, t in held) <= 1 and sum(p and t for p, t in held) >= 0.7 * sum(t for _, t in held)


def test_toxicity_scores(spark, docs, texts):
    """Scores from lexicon, exceptions and weights by splitting the folded texts into words."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.ToxicityModel.fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    assert model.lexicon and model.weights is not None
    some = [t for k, t in sorted(texts.items()) if t][:400] + ["", None]
    for t, score in zip(some, model.scores(some)):
        word = toxicity.fold_phrase(t or "").split()
        excepted = set()
        for p in model.exceptions:
            own = p.split()
            excepted |= {j for i in range(len(word)) if word[i : i + len(own)] == own for j in range(i, i + len(own))}
        total = 0.0
        for i, w in enumerate(word):
            hits = [model.lexicon[x] for x in [*(w[:k] for k in range(1, len(w) + 1)), w + " "] if x in model.lexicon]
            total += max(hits) if hits and i not in excepted else 0
        x = [math.log1p(total), math.log1p(100 * total / max(1, len(word))), float(total > 0), 1.0]
        assert math.isclose(score, 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)))), rel_tol=1e-9)


def test_toxicity_of_any_layout(spark, docs):
    """The model doesn't depend on the rows' order and partitions, and counts a group of copies once."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    own = docs.select("doc_id", "text")
    a, b = (toxicity.ToxicityModel.fit(d, labels) for d in (own, own.repartition(7, "text").sortWithinPartitions("text")))
    assert a.lexicon == b.lexicon and a.exceptions == b.exceptions and np.allclose(a.weights, b.weights)
    rows = [(i, 1, "one toxic line that came in many copies") for i in range(50)] + [(99, 1, ""), (98, 1, None), (97, 0, "a clean one")]
    left = toxicity.one_of_copies(spark.createDataFrame(rows, "row long, toxic int, text string"))
    assert sorted(r.row for r in left.collect()) == [0, 97, 98]


def distinct_lines(spark, toxic, clean, n=240):
    """(doc_id, text): random prose, odd rows with one of the toxic phrases, even ones with one of the clean ones."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprtv") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        line = [word() for _ in range(30)]
        line.insert(rng.randrange(30), rng.choice(toxic if i % 2 else clean))
        rows.append((i, " ".join(line)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_toxicity_folding_and_exceptions(spark):
    docs = distinct_lines(spark, ["idiot", "idiot scum", "zax"], ["friend", "algae scum layer", "zaxon"])
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = toxicity.ToxicityModel.fit(docs, labels)
    assert any((toxicity.fold_phrase("idiot") + " ").startswith(e) for e in model.lexicon)
    plain, folded, clean = model.scores(["such an idiot", "such an 1DіО​T", "such an apple"])
    assert plain > 0.7 and math.isclose(plain, folded) and clean < 0.3
    short, longer = model.scores(["you zax you", "you zaxon you"])  # a word of three letters, not the beginning of others
    assert short > 0.7 and longer < 0.3
    excepted = toxicity.ToxicityModel(exceptions=[toxicity.fold_phrase("village idiot")], lexicon={toxicity.fold_phrase("idiot"): 5.0})
    total, length, _ = excepted.hits(["the village idiot play", "an idiot play", None, ""])
    assert total.tolist() == [0, 5, 0, 0] and length.tolist() == [4, 3, 0, 0]


def test_minhash_components(docs, texts):
    sets = {}
    for k, t in texts.items():
        w = words(t)
        sets[k] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    first = plain_components(sets)
    for r in minhash.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), first[r.doc_id], first[r.doc_id] == r.doc_id)


def test_minhash_small_blocks(docs):
    """Blocks that cut every list and component give the same components."""
    a, b = (sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, minhash.Settings(block=n)).collect()) for n in (512, 3))
    assert a == b


def test_minhash_repeated_ids(spark):
    """Rows of one doc_id with different texts are nodes of their own; equal rows are one."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (5, b), (6, a + " more"), (7, b + " more"), (3, b + " else"), (8, "c d e f g h")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = [(5, 5), (5, 3), (5, 3), (6, 5), (7, 3), (3, 3), (8, 8)]
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(want)


def test_minhash_large_group(spark):
    """A chain of texts, each close to its neighbours alone, over many blocks: one component, its rows copied few times."""
    words_of = [f"w{i}" for i in range(1400)]
    rows = [(i, " ".join(words_of[i * 3 : i * 3 + 60])) for i in range(300)]
    rows += [(1000 + i, " ".join(f"x{j}" if j != i else "y" for j in range(80))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, minhash.Settings(block=16, leaders=2)).collect()}
    assert all(got[i] == 0 for i in range(300)) and all(got[1000 + i] == 1000 for i in range(80))
    sets = spark.range(50_000).select(F.col("id").alias("rep"), F.lit(1).alias("c"))
    dealt = minhash.within_blocks(sets, "c", "rep", 512, 8)
    assert dealt.count() <= 50_000 * 1.02 and dealt.groupBy("bi").count().agg(F.max("count")).first()[0] < 700
    true = sets.withColumn("g", F.when(F.col("rep") < 49_900, 0).otherwise(F.col("rep")))
    assert minhash.against_others(true, "c", "rep", "g", 512).count() <= 50_000 * 1.25


def test_components(spark):
    """Long chains, a star and random edges, of which some repeat: both ways find the same, and few edges need few jobs."""
    rng = np.random.default_rng(5)
    names = [int(x) for x in rng.choice(1 << 62, 900, replace=False) - (1 << 61)]
    pairs = [(i, i + 1) for i in range(299)] + [(300, i) for i in range(301, 500)] + [(int(a), int(b)) for a, b in rng.integers(500, 900, (300, 2))]
    pairs += [(b, a) for a, b in pairs[::3]]
    rng.shuffle(pairs)
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a long, b long").repartition(5)
    first = {x: x for x in names}
    for _ in names:
        for a, b in pairs:
            first[names[a]] = first[names[b]] = min(first[names[a]], first[names[b]])
    held = {names[x] for a, b in pairs if a != b for x in (a, b)}
    spark.sparkContext.setJobGroup("components", "")
    few = minhash.components(edges, "a", "b", "test-few")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("components"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for found in (few, minhash.components(edges, "a", "b", "test-many", at_once=0)):
        assert sorted((r.node, r.root) for r in found.collect()) == sorted((x, first[x]) for x in held)
    assert jobs <= 6
    assert not minhash.components(edges.where("a = b"), "a", "b", "test-none").count()


def test_pipeline_near_dedup_jobs(spark):
    """The driver keeps something of every job: a long chain of near copies needs no more of them than a short one."""
    import corpus_pipeline

    def jobs(n):
        rows = [(i, " ".join(f"w{j}" for j in range(i * 3, i * 3 + 60))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        spark.sparkContext.setJobGroup(f"chain {n}", "")
        kept = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {n}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert kept == [0]
        return found

    assert jobs(120) <= jobs(3) + 8


def test_substring_repeats(docs, texts):
    seen: dict = {}
    for k in sorted(texts):
        w = texts[k].split()
        for g in {hash(tuple(w[i : i + 50])) for i in range(len(w) - 49)} if len(set(w)) > 0.3 * len(w) else ():
            seen.setdefault(g, []).append(k)
    later = {k for own in seen.values() for k in own[1:]}
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs.select("doc_id", "text")).collect()}
    caught = {k for k, r in rows.items() if r.removed_words}
    assert len(later - caught) <= 0.01 * len(later)
    short: dict = {}
    for k in sorted(texts):
        w = texts[k].split()
        for g in {hash(tuple(w[i : i + 20])) for i in range(len(w) - 19)}:
            short.setdefault(g, set()).add(k)
    repeats = {k for own in short.values() if len(own) > 1 for k in own}
    assert len(caught - repeats) <= 0.01 * len(caught) and all(rows[k].text == texts[k] for k in set(texts) - caught)


def test_substring_one_holder(spark, docs, texts):
    """What is cut stands in one earlier document, 20 whole words at a time; chunks that several of them hold do not do."""
    line = "the quick brown theatre bleu "
    rows = [(1, f"one {line * 3}end"), (2, f"two {line * 40}end"), (3, f"three {line * 40}end")]
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].removed_words == 0 and got[2].text == rows[1][1] and got[3].removed_words > 150 and got[3].first_doc_ids == [2]
    rows = {r.doc_id: r for r in substring_dedup.remove_repeats(docs.select("doc_id", "text")).collect()}
    seen: dict = {}
    for k in sorted(texts):
        w = (texts[k] or "").encode().split()
        for g in {tuple(w[i : i + 20]) for i in range(len(w) - 19)}:
            seen.setdefault(g, k)
    for k, r in rows.items():
        for span in r.removed_spans:
            w = texts[k].encode()[span.start : span.end].split()[1:-1]
            held = {j for i in range(len(w) - 19) if seen[tuple(w[i : i + 20])] < k for j in range(i, i + 20)}
            assert len(held) == len(w)


def test_substring_copies_go_whole(spark):
    """A copy of 22 words and more is cut to its last word, whatever its length."""
    import random

    rng = random.Random(5)
    long = [" ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n)) for n in range(22, 90)]
    rows = [(2 * i + j, t) for i, t in enumerate(long) for j in (0, 1)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.text == ("" if r.doc_id % 2 else long[r.doc_id // 2]) for r in got)


def test_insertion_resists_shift():
    s = substring_dedup.Settings()
    base = " ".join(f"word{i * 7919 % 1000}" for i in range(400)).encode()
    moved = b"a few new words in front " + base
    cut = lambda b: set(substring_dedup.digests(np.frombuffer(b, np.uint8), 0, substring_dedup.chunk_ends(np.frombuffer(b, np.uint8), np.array([0, len(b)]), s)[0]).tolist())
    assert len(cut(base) & cut(moved)) >= 0.95 * len(cut(base))


def test_packing_ids(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(packing.Settings())
    odd = ["a  b\n\n c \t\n d", "<|endoftext|> x", "It's 12345 naïve — 東京 🙂　\xa0 y"]
    odd += [" " * 1_500_000, "\n" * 1_500_000 + "x", "y" * 200_000, "z" * 49_999 + " " * 49_999]
    for t in [*list(texts.values())[:150], *odd]:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids
    rows = packing.pack(docs).collect()
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.01 * math.ceil(total / 1024) + 1
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for k, t in texts.items():
        ids = np.append(encode(t), 2).astype("<u4")
        own = sorted(by[k], key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:]) and all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_grouping_genetics():
    import random

    rng = random.Random(1)
    sizes = np.array([rng.randrange(1, 1024) for _ in range(600)], np.int32)
    plain = packing.Bins(sizes.tolist(), 1024)
    plain.insert(list(range(600)))
    best = packing.evolve(sizes, [], random.Random(2), packing.Settings())
    again = packing.Bins.unpacked(best[0][1], sizes.tolist(), 1024)
    assert best[0][0] >= plain.fitness() and min(again.free) >= 0 and sorted(x for b in again.bins for x in b) == list(range(600))


def test_mixing_shares(docs):
    out = mixing.mix_report(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(r.target <= 3 * r.source_size + 1e-6 for r in out)
    table = mixing.source_targets(docs.select("source", mixing.word_count("text").alias("size"))).collect()
    assert math.isclose(sum(r.target for r in table), sum(r.source_size for r in table))
    taken, target = sum(r.taken for r in out), sum(r.target for r in table)
    assert abs(taken - target) < 0.1 * target


def test_ann_recall(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = collections.defaultdict(list)
    for r in ann.search(v, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in ids[ids % 20 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        true = [i for i in ids[np.lexsort((ids, d))] if i != q][:10]
        hit += len({i for i, _ in got[q]} & set(true))
        assert all(s == d[ids == i][0] for i, s in got[q]) and len(got[q]) == 10
    assert hit / (10 * len(got)) >= 0.9


def plain_components(sets):
    """Smallest id reachable over links of 80 % and more, from all pairs that share a shingle."""
    holders = collections.defaultdict(list)
    for k, own in sets.items():
        for x in own:
            holders[x].append(k)
    shared = collections.Counter((a, b) for own in holders.values() if len(own) > 1 for i, a in enumerate(own) for b in own[i + 1 :])
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, b), n in shared.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def test_pipeline(spark, docs):
    """Every stage's rows against plain Python on what the stage before it kept, and run() against the last."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    rows_of_stage = [sorted(docs.collect(), key=lambda r: r.doc_id)]
    df = docs
    for name, function in corpus_pipeline.STAGES:
        df = corpus_pipeline.stage(function(spark, df, SF), f"test-{name}")
        rows_of_stage.append(df.collect())
    start, language, unique, cut, mix, packed = rows_of_stage

    # language: the same decisions from the model's numbers, a text at a time
    model = language_id.LanguageModel.fit(docs.select("doc_id", "text", "lang"))
    sure = lambda t: (p := model.predict([t])[0])[0] != "und" and p[1] >= 1.25 * p[2] and p[3] >= 0.7
    assert sorted(r.doc_id for r in language) == [r.doc_id for r in start if sure(r.text)] and len(language) > 0.99 * len(start)

    # near-duplicates: the smallest id of each component of five-word shingles
    sets = {}
    for r in language:
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    first = plain_components(sets)
    assert sorted(r.doc_id for r in unique) == sorted(k for k in first if first[k] == k)

    # repeated passages: what is gone stood in an earlier document of the stage's input; what is left is in its order
    seen: dict = {}
    for r in sorted(unique, key=lambda r: r.doc_id):
        w = r.text.split()
        for g in {tuple(w[i : i + 20]) for i in range(len(w) - 19)}:
            seen.setdefault(g, r.doc_id)
    after = {r.doc_id: r for r in cut}
    for r in unique:
        w, left = r.text.split(), after[r.doc_id].text.split() if r.doc_id in after else []
        earlier = [False] * len(w)
        for i in range(len(w) - 19):
            if seen[tuple(w[i : i + 20])] < r.doc_id:
                earlier[i : i + 20] = [True] * 20
        fresh = [x for x, e in zip(w, earlier) if not e]
        rest = iter(left)
        # words at the edges of a cut may be cut in two, so each cut may spoil a word on either side
        missing = sum(all(x != y for y in rest) for x in fresh[:1])
        assert len(left) <= len(w) and len(left) >= len(fresh) - 2 * (1 + sum(earlier) // 20) and missing <= 1
        if not any(earlier):
            assert after[r.doc_id].text == r.text
        if r.doc_id in after and after[r.doc_id].text != r.text:
            assert after[r.doc_id].n_chars == len(after[r.doc_id].text)

    # mixing: floor(rate) copies and the hashed draw
    import hashlib

    size = collections.Counter()
    for r in cut:
        size[r.source] += len(words(r.text))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size))}
    target, open_ones, rest = {}, set(size), sum(size.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        full = {s for s in open_ones if share[s] > 3 * size[s]}
        if not full:
            target |= share
            break
        target |= {s: 3 * size[s] for s in full}
        rest, open_ones = rest - sum(3 * size[s] for s in full), open_ones - full
    want = collections.Counter()
    for r in cut:
        rate = target[r.source] / size[r.source]
        drawn = int(hashlib.md5(f"mix-1/{r.doc_id}".encode()).hexdigest()[:8], 16) / (1 << 32)
        want[r.doc_id] = math.floor(rate) + (drawn < rate - math.floor(rate))
    assert collections.Counter(r.doc_id for r in mix) == +want

    # packing: the tokens of the mix, each once, in sequences without gaps
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    length = {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in mix}
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in packed:
        total[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert total == collections.Counter({k: length[k] * want[k] for k in length})
    for own in bins.values():
        end = 0
        for at, n in sorted(own):
            assert at == end
            end += n
        assert end <= 1024
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda rows: collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert key(again) == key(packed)


def test_op6_leaves_unrepeated_text(spark):
    """Texts over few words, in which no window of eleven words occurs twice, lose nothing."""
    import random

    rng, vocabulary = random.Random(8), ["".join(random.Random(i).choice("abcdefghijkl") for _ in range(3 + i % 6)) for i in range(20)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(200))) for i in range(1500)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("removed_words")).first()[0]
    assert got == 0
