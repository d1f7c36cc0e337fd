"""Quality rules, BPE, toxicity, class bigrams: against plain brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leakatlas.llm import bpe, brown_lm, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines))


def test_counts(docs, plain):
    got = quality.with_counts(docs, keep_text=False).collect()
    assert "text" not in got[0].asDict()
    assert sorted(((r.doc_id, *(r[c] for c in quality.COUNTS)) for r in got), key=str) == sorted(((i, *plain_counts(t)) for i, t in plain), key=str)


def test_counts_keep_columns(docs):
    assert quality.with_counts(docs).columns == [*docs.columns, *quality.COUNTS]


def test_binomial_tail():
    for n, k, p in ((20, 3, 0.2), (50, 0, 0.1), (10, 10, 0.3)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))


def test_cutoffs_keep_the_risk(spark):
    rng = random.Random(2)
    rows = []
    for i in range(4000):
        good = rng.random() < 0.8
        rows.append((i, "en" if i % 2 else "de", 100, 500, 0 if good else 90, 0, 0, 5, int(good)))
    counts = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, quality int")
    cut = quality.risk_cutoffs(counts.drop("quality"), counts.select("doc_id", "quality"))
    judged = quality.judge(counts, cut).groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    assert all(r.kept == r.quality for r in judged)
    tests = 2 * sum(map(len, quality.GRID.values()))
    for r in cut.collect():
        assert quality.binomial_tail(r.n_rejected, r.n_good, quality.RISK / 3) <= quality.ERROR / tests


def test_quality_without_labels(docs, no_docs, labels):
    counts = quality.with_counts(docs, keep_text=False)
    judged = quality.judge(counts, quality.risk_cutoffs(counts, labels.limit(0))).collect()
    assert len(judged) == docs.count() and all(r.kept != r.base_failed for r in judged)
    empty = quality.with_counts(no_docs)
    assert quality.judge(empty, quality.risk_cutoffs(empty, labels)).count() == 0


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(docs, plain, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = library()
    want = []
    for i, text in plain:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    got = bpe.encode_texts(docs, path, with_ids=True)
    assert got.columns == [c for c in docs.columns if c != "text"] + ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, r.decoded) for r in got.collect()), key=str) == sorted(want, key=str)
    assert bpe.encode_texts(no_docs, path).count() == 0


def test_bpe_random_strings():
    codec, t, rng = bpe.Codec(bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))), library(), random.Random(3)
    texts = ["<|startoftext|>Hi<|endoftext|> x <|endof", "don't I'LL we'VE", "ΑΣ ΣΑΣ İstanbul ǅ ﬁ", "²³½ ⅷ 12", "</w> x</w>", "🎉🎉 👍🏽", "thth" * 400]
    texts += ["".join(rng.choice("abcdething '!?ééÉ1²<|>/w\n") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        ids = t.encode(text, add_special_tokens=False).ids
        assert codec.encode(text) == ids
        assert codec.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_caches_may_turn_over(monkeypatch):
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    large, small = bpe.Codec(vocabulary), bpe.Codec(vocabulary)
    small.words, small.parts = bpe.Cache(3), bpe.Cache(2)
    for text in ("the then there the, then. these", "a b c d e f g", "the a then b"):
        assert small.encode_decode(text) == large.encode_decode(text)


def test_bpe_words_and_pieces_share_a_cache():
    """A piece that is also a word of its own is encoded and kept once."""
    codec, encoded = bpe.Codec(bpe.load_vocabulary(public_tokenizers.path("word_bpe_49k.json"))), []
    encode = codec.encode_word
    codec.encode_word = lambda w: encoded.append(w) or encode(w)
    codec.encode_decode("qzvx qzvx, éqz")
    codec.encode_decode("qzvx; , ;")
    assert set(codec.words.ids) == {"qzvx", "qzvx,", "éqz", "qzvx;", ",", ";"}
    assert sorted(encoded) == [",", ";", "qzvx", "éqz"]


def test_bpe_gives_caches_back(docs):
    """A worker that has encoded goes on to other stages without the words and pairs that it found."""
    bpe.encode_texts(docs, public_tokenizers.path("word_bpe_49k.json")).collect()

    def held(batches):
        import sys

        import pyarrow as pa

        for _ in batches:
            pass
        codecs = [c for k, c in vars(sys.modules.get("_leakatlas_worker_cache", object)).items() if k.startswith("bpe_")]
        kept = sum(len(c.words.ids) + len(c.words.old[0]) + len(c.table) for c in codecs)
        yield pa.RecordBatch.from_arrays([pa.array([len(codecs)]), pa.array([kept])], names=["codecs", "kept"])

    rows = docs.select("doc_id").mapInArrow(held, "codecs long, kept long").collect()
    assert sum(r.codecs for r in rows) and not sum(r.kept for r in rows)


def test_toxicity_learns_and_orders(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        grade = rng.choice((0, 0, 0, 1, 2))
        words = [rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(60)]
        for _ in range((0, 1, 4)[grade]):
            words[rng.randrange(60)] = rng.choice(("idiot,", "Clown", "awful."))
        rows.append((i, " ".join(words), int(grade > 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.filter("doc_id < 1000"), frame.select("doc_id", "toxic"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    held = toxicity.score(frame.filter("doc_id >= 1000"), model).join(frame.select("doc_id", F.col("toxic").alias("truth")), "doc_id").collect()
    assert sum(r.toxic == bool(r.truth) for r in held) / len(held) > 0.97
    assert all(abs(sum(r.grade_probabilities) - 1) < 1e-9 and 0 <= r.severity <= 2 for r in held)


def test_toxicity_edge_cases(docs, no_docs, labels):
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model).collect()
    assert len(scored) == docs.count()
    assert len({r.severity for r in scored if r.doc_id in (600, 601, 602)}) == 1
    assert toxicity.train(docs, labels.filter("toxic = 0")) is None
    assert toxicity.score(no_docs, None).count() == 0
    assert {r.severity for r in toxicity.score(docs, None).collect()} == {0.0}


def test_class_bigrams(docs, plain, no_docs):
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = brown_lm.score_documents(docs, held).collect()
    tokens = [(i, WORD.findall((t or "").translate(FOLD)) + [None]) for i, t in plain]
    counts = collections.Counter(w for i, ws in tokens if i is None or zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5)) for i, ws in tokens]
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == sorted(want, key=str)
    assert all(r.score < 0 and r.perplexity > 1 for r in got)
    assert brown_lm.score_documents(no_docs, held).count() == 0


def test_rare_words_by_join(docs):
    """Words beyond the tasks' own counts give the same scores."""
    train = docs.select("text")
    held = docs.withColumn("held_out", F.lit(False))
    scores = []
    for lookup in (1 << 19, 300):
        model, counts = brown_lm.train(train, classed=50, n_classes=8, lookup_words=lookup, rounds=2)
        scores.append({(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in brown_lm.score(held, model, counts, train.count()).collect()})
    assert scores[0] == scores[1]


def test_probabilities_sum_to_one(docs):
    model, counts = brown_lm.train(docs.select("text"), classed=40, n_classes=6, rounds=2)
    assert (10**model.transition).sum(1) == pytest.approx(1)
    own, lookup = model.classes[model.lookup.symbols], model.lookup
    for c in range(2, 6):
        assert (lookup.counts[own == c] / model.class_totals[c]).sum() in (0, pytest.approx(1))
    rest = lookup.counts[own == brown_lm.REST]
    assert len(rest) == model.rest_types
    assert ((rest + 1).sum() + 1) / (model.class_totals[brown_lm.REST] + model.rest_types + 1) == pytest.approx(1)


def test_exchange_raises_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(1)
    size, n_classes = 42, 5
    hidden = np.concatenate([[0, 1], 2 + np.arange(40) % 3])
    bigrams = rng.integers(0, 3, (size, size)) + 30 * ((hidden[:, None] + 1) % 3 == hidden[None, :] % 3)
    bigrams = bigrams.astype(float)
    classes = np.concatenate([[0, 1], 2 + rng.integers(0, 3, 40)])

    def sums(classes):
        one = np.eye(n_classes)[classes]
        return bigrams.T @ one, bigrams @ one

    values = []
    for turn in range(12):
        before, after = sums(classes)
        values.append(brown_lm.likelihood(np.eye(n_classes)[classes].T @ after))
        classes = brown_lm.exchange(classes, before, after, np.diag(bigrams), np.arange(2 + turn % 2, size, 2), n_classes)
    assert values[-1] > values[0]


def test_gains_are_differences_of_the_likelihood():
    import numpy as np

    rng = np.random.default_rng(2)
    size, n_classes = 30, 6
    bigrams = rng.integers(0, 5, (size, size)) * (rng.random((size, size)) < 0.3)
    classes = np.concatenate([[0, 1], rng.integers(1, n_classes, size - 2)])
    one = np.eye(n_classes)[classes]
    gains = brown_lm.move_gains(classes, bigrams.T @ one, bigrams @ one, np.diag(bigrams), one.T @ bigrams @ one)
    for w in range(2, size):
        values = []
        for c in range(n_classes):
            moved = np.eye(n_classes)[np.where(np.arange(size) == w, c, classes)]
            values.append(brown_lm.likelihood(moved.T @ bigrams @ moved))
        assert gains[w] - gains[w, classes[w]] == pytest.approx(np.array(values) - values[classes[w]])


def test_every_word_above_the_least_count_is_clustered(spark, monkeypatch):
    """Also those beyond the seeded ones and the tasks' own counts; words of two kinds follow each other in turn."""
    monkeypatch.setattr(brown_lm, "SEEDED", 20)
    rng = random.Random(9)
    kinds = [[f"{k}{i}" for i in range(150)] for k in "ab"]
    texts = [" ".join(rng.choice(kinds[i % 2]) for i in range(40)) for _ in range(250)] + ["rare words here"]
    model, counts = brown_lm.train(spark.createDataFrame([(t,) for t in texts], "text string").repartition(4), n_classes=4, lookup_words=50)
    often = {r.key for r in counts.filter(f"n >= {brown_lm.LEAST}").collect()}
    own = model.classes[model.lookup.symbols]
    assert len(often) > 290 and set(model.lookup.words[own > brown_lm.REST].tolist()) == often
    # Words of a kind end up in one class.
    data = np.frombuffer(" ".join(w for k in kinds for w in k).encode(), np.uint8)
    keys, _ = brown_lm.word_keys(data, np.array([0, len(data)]))
    at, found = model.lookup.find(keys)
    of_kind = [collections.Counter(own[at[part]][found[part]].tolist()).most_common(1)[0] for part in (slice(0, 150), slice(150, 300))]
    assert of_kind[0][0] != of_kind[1][0] and min(n for _, n in of_kind) > 140


def test_neighbours_are_counted_in_flat_rows(spark, docs, monkeypatch):
    """Pairs of neighbours cross one shuffle, as arrays and not as a row each; the counts are those of brute force."""
    monkeypatch.setattr(brown_lm, "BUCKET_ROWS", 500)
    texts = docs.select("text")
    keys = np.unique(np.concatenate([brown_lm.word_keys(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())]))[0] for r in texts.collect()]))
    symbols = np.where(np.arange(len(keys)) % 3 == 0, brown_lm.REST, np.arange(len(keys)) + 2)
    lookup = brown_lm.Lookup(keys, np.ones(len(keys), np.int64), symbols, len(keys) + 2)
    asked = np.concatenate([keys, keys + 1, keys - 1, [np.iinfo(np.int64).min, np.iinfo(np.int64).max]])
    assert [list(x) for x in lookup.find(asked)] == [list(np.minimum(np.searchsorted(keys, asked), len(keys) - 1)), list(np.isin(asked, keys))]
    want = collections.Counter()
    for r in texts.collect():
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        row = [brown_lm.END, *brown_lm.symbol_rows(*brown_lm.word_keys(data, np.array([0, len(data)])), 1, lookup)[0]]
        want.update(zip(row, row[1:], strict=False))
    rows = brown_lm.neighbour_rows(texts, lookup, 20, sum(want.values()))
    batches = rows.toArrow().to_batches()
    got = collections.Counter()
    for w, side, other, n in brown_lm.unpacked(batches):
        for a, s, b, c in zip(w.tolist(), side.tolist(), other.tolist(), n.tolist(), strict=True):
            got[(a, b, s)] += c
    assert got == collections.Counter({**{(a, b, 1): c for (a, b), c in want.items()}, **{(b, a, 0): c for (a, b), c in want.items()}})
    assert sum(b.num_rows for b in batches) < 1 + 2 * sum(want.values()) // 500 + 1


def test_pipeline_bounds_the_bytes_of_batches(spark):
    """10,000 texts of 2 KB were one batch of 20 MB in the JVM and the worker; the kept text went there twice."""
    import corpus_pipeline
    from leakatlas.llm.shared import BATCH_BYTES

    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(bound, None)
    docs = spark.range(0, 10_000, 1, 1).selectExpr("id AS doc_id", "repeat('abcd', 500) AS text")
    try:
        spark.conf.unset(bound)
        corpus_pipeline.bpe_encoding(spark, docs, "")

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

        most = docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
        assert most < 1.5 * BATCH_BYTES
    finally:
        spark.conf.unset(bound) if before is None else spark.conf.set(bound, before)
    assert "__text" not in quality.with_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
