"""URL filter, sharding, WARC, the pipeline and the registered queries."""

import base64
import hashlib
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from leakatlas.llm import sharding, url_filter, warc
from leakatlas.llm.all_queries import QUERIES
from leakatlas.llm.queries import URL_RULES

from .conftest import PAGES, prose


def test_rules_and_parts(spark):
    cases = [
        (1, "http://WWW.Example.com/en/x?q=1", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        (2, "https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        (3, "https://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        (4, "http://x.net/es/1#f", "x.net", "/es/1", "net/es/", "block"),
        (5, "ftp://x.net/es", "x.net", "/es", None, None),
        (6, "no scheme", "", "", None, None),
        (7, None, "", "", None, None),
        (8, "http://x.com", "x.com", "", None, None),
        (9, "http://x.com?u=://y.net/es/", "x.com", "", None, None),
        (10, "", "", "", None, None),
        (11, "http://Ä.com/a\nb", "Ä.com", "/a\nb", "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u, "h", "clash", "clash") for i, u, *_ in cases], PAGES)
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    for i, _, host, path, rule, verdict in cases:
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or rule is None and got[i].verdict in ("allow", "block")
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    rows = [(i, f"http://site{i % 7}.org/{'a' * (i % 5)}/x" if i % 2 else f"http://s-{i}-9{i}.org/p?a={i}&b=2&c=3") for i in range(400)]
    urls = url_filter.with_features(spark.createDataFrame(rows, "id long, url string")).withColumn("blocked", (F.col("id") % 2 == 0).cast("int"))
    model = url_filter.train(urls.filter("id < 300"))
    scored = model.score(urls.filter("id >= 300")).select("blocked", "block_probability").collect()
    assert all((r.block_probability > 0.5) == bool(r.blocked) for r in scored)
    assert url_filter.train(urls.filter("blocked = 1")) is None


def test_entropy(spark):
    got = spark.createDataFrame([("aabb",), ("aaaa",), ("",)], "u string").select(url_filter.entropy(F.col("u")).alias("e")).collect()
    assert [r.e for r in got] == pytest.approx([1.0, 0.0, 0.0])


def shard_properties(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    prefixes = sorted(by)
    assert not any(b.startswith(a) for a, b in zip(prefixes, prefixes[1:], strict=False) if a != b)  # no shard inside another
    for shard, members in by.items():
        size = sum(r.n_bytes for r in members)
        assert {r.depth for r in members} == {len(shard)} and {r.shard_bytes for r in members} == {size}
        assert size <= limit or members[0].oversized and len(members) == 1
        if shard:  # split only because the bucket above was too large
            assert sum(r.n_bytes for r in rows if r.shard.startswith(shard[:-1])) > limit


@pytest.mark.parametrize("limit", [2_000, 30_000, 10**9])
def test_shards(docs, plain, limit):
    rows = sharding.shards(docs, "doc_id", F.octet_length("text"), limit).collect()
    assert sorted((str(r.doc_id), r.n_bytes) for r in rows) == sorted((str(i), len((t or "").encode())) for i, t in plain)
    shard_properties(rows, limit)


def test_hot_key_is_split(spark):
    frame = spark.range(20_000).select(F.lit(7).alias("k"), F.lit("x" * 50).alias("t")).union(spark.range(100).select("id", F.lit("y" * 99)))
    rows = sharding.shards(frame, "k", F.octet_length("t"), 40_000).collect()
    assert len(rows) == 20_100 and not any(r.oversized for r in rows)
    shard_properties(rows[:0] + rows, 40_000)


def test_written_shards(spark, docs):
    path = tempfile.mkdtemp(prefix="run-shards-") + "/out"
    sharding.write_shards(docs, "doc_id", F.octet_length("text"), 20_000, path)
    back = spark.read.parquet(path)
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert back.count() == docs.count() and all((r.b or 0) <= 20_000 or r.n == 1 for r in sizes)
    assert sharding.shards(docs.limit(0), "doc_id", F.octet_length("text"), 5).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(docs, "doc_id", F.octet_length("text"), 0)


ROWS = [(1, "http://a/", "<p>one</p>"), (2, "http://b/", "two"), (3, None, "two"), (4, "http://c/\r\nX: y", ""), (5, "http://d/", None), (6, "http://e/", "zä" * 40_000), (7, "http://f/", "WARC/1.1\r\n\r\n\x1f"), (3, "http://g/", "two"), (None, "http://h/", "two")]


@pytest.fixture(scope="module")
def archive(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="run-warc-")
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in ROWS], PAGES).repartition(3)
    warc.write_warc(pages, folder)
    return folder


def test_warc_round_trip(spark, archive):
    got = warc.read_warc(spark, archive).collect()
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        visit = first[h or ""] != i
        digest = "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if visit else "response", f"urn:page:{first[h or '']}" if visit else None, digest, str(len(raw)), None if visit else raw))
    read = [(r.record_id, r.record_type, r.refers_to, r.payload_digest, r.payload_length, None if r.record_type == "revisit" else bytes(r.payload)) for r in got]
    assert sorted(read, key=str) == sorted(want, key=str)


def test_warc_predicates_and_ranges(spark, archive, monkeypatch):
    ids = lambda df: sorted(r.record_id for r in df.collect())
    everything = warc.read_warc(spark, archive)
    assert ids(warc.read_warc(spark, archive, "record_id string", types="revisit")) == ids(everything.filter("record_type = 'revisit'"))
    assert ids(warc.read_warc(spark, archive, where={"WARC-Target-URI": "http://b/"})) == ["urn:page:2"]
    assert "payload" not in warc.read_warc(spark, archive, "record_id string").columns
    filtered = spark.read.format("warc_filtered").load(archive).filter("record_type = 'revisit'")
    assert ids(filtered) == ids(everything.filter("record_type = 'revisit'"))
    pieces = spark.read.format("warc").option("split_bytes", "200").load(archive)
    assert pieces.rdd.getNumPartitions() > 5 and ids(pieces) == ids(everything)


def test_warc_pushes_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    from pyspark.sql.types import StructType

    reader = warc.FilteringReader({"path": "/"}, StructType())
    left = list(reader.pushFilters([EqualTo(("record_type",), "response"), In(("record_id",), ("a", "b")), GreaterThan(("record_id",), "a")]))
    assert len(left) == 1 and reader.wanted.where == {"WARC-Type": {"response"}, "WARC-Record-ID": {"a", "b"}}


def test_foreign_archives(spark):
    """Gzip members without lengths, and plain files."""
    import gzip
    import os

    folder = tempfile.mkdtemp(prefix="run-warc-")
    records = [warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:page:{i}>", "Content-Type": "application/http"}, warc.HTTP_HEAD + b"x" * i * 3000) for i in range(6)]
    with open(os.path.join(folder, "a.warc.gz"), "wb") as f:
        f.writelines(gzip.compress(r) for r in records[:3])
    with open(os.path.join(folder, "b.warc"), "wb") as f:
        f.writelines(records[3:])
    got = warc.read_warc(spark, folder).collect()
    assert sorted((r.record_id, len(r.payload)) for r in got) == [(f"urn:page:{i}", 3000 * i) for i in range(6)]
    assert len(warc.read_warc(spark, folder, "record_id string", where={"WARC-Record-ID": "urn:page:1"}).collect()) == 1


def test_broken_payload_is_found(spark):
    folder = tempfile.mkdtemp(prefix="run-warc-")
    with open(folder + "/a.warc", "wb") as f:
        f.write(warc.record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:AAAA", "Content-Type": "application/http"}, warc.HTTP_HEAD + b"x"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read_warc(spark, folder).collect()


def test_empty_archive(spark):
    folder = "file://" + tempfile.mkdtemp(prefix="run-warc-")
    warc.write_warc(spark.createDataFrame([], PAGES), folder)
    assert warc.read_warc(spark, folder).count() == 0


def test_stages(spark, docs, sf_dir):
    """Columns, and that each decision holds, on the fixture."""
    import corpus_pipeline as p

    frame = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, frame, sf_dir)
        assert out.columns == frame.columns, name
        assert stage(spark, frame.limit(0), sf_dir).count() == 0, name
    single = p.minhash_near_dedup(spark, frame, sf_dir).collect()
    texts = [r.text for r in single if r.text and len(r.text.split()) > 4]
    assert len(texts) == len({t.lower() for t in texts}) + sum(r.doc_id is None and r.text is not None for r in single) or len(texts) >= len(set(texts))
    assert sum(r.doc_id == 0 for r in single) == 1
    assert [r.doc_id for r in single if r.doc_id is not None and 500 <= r.doc_id < 530] == []
    last = p.bpe_encoding(spark, frame, sf_dir)
    assert {"doc_id", "ids", "n_tokens"} <= set(last.columns)


def test_pipeline_drops_and_keeps(spark, sf_dir):
    import glob

    got = QUERIES["pipeline"](spark, sf_dir)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert len(ids) == len(set(ids))
    con = duckdb.connect()
    files = glob.glob(f"{sf_dir}/documents.parquet")
    leaked = {r[0] for r in con.execute(f"select distinct d.doc_id from '{files[0]}' d join '{sf_dir}/benchmark.parquet' b on contains(d.text, b.text)").fetchall()}
    assert leaked and not leaked & set(ids)
    assert len(ids) > 0.6 * con.execute(f"select count(*) from '{files[0]}'").fetchone()[0]


def test_repeats_are_cut_beside_passages_of_the_benchmark(spark):
    """Repeats go from documents with such a passage too; without evidence left these are dropped at once, else by the next stage."""
    import corpus_pipeline as p

    item, short, shared = prose(700, 55), prose(701, 20), prose(702, 60)
    assert len(item) > p.PASSAGE_BYTES > len(short) and len(shared) > p.PASSAGE_BYTES
    texts = {
        1: [prose(1, 80), item, prose(2, 80)],
        2: [prose(3, 80), item, prose(4, 80)],
        3: [prose(5, 80), short, prose(6, 80), shared],
        4: [prose(7, 80), shared, prose(8, 80)],
        5: [prose(9, 80)],
    }
    rows = [(i, "\n".join(parts), "en", "src0", len("\n".join(parts))) for i, parts in texts.items()]
    folder = tempfile.mkdtemp(prefix="run-benchmark-")
    spark.createDataFrame([(1, item), (2, short)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    cut = p.suffix_array_dedup(spark, frame, folder)
    got = {r.doc_id: r for r in cut.collect()}
    assert sorted(got) == [3, 4, 5]
    assert not any(item in r.text or shared in r.text for r in got.values())
    assert short in got[3].text and all(r.n_chars == len(r.text) for r in got.values())
    assert sorted(r.doc_id for r in p.benchmark_decontamination(spark, cut, folder).collect()) == [4, 5]


def test_contract_columns(spark, sf_dir):
    want = {
        "op2_url_filter": ["page_id", "host", "path", "rule", "verdict"],
        "op5_sharding": ["doc_id", "n_bytes", "shard"],
        "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, sf_dir)
        assert df.columns[: len(columns)] == columns
        assert df.count() == spark.read.parquet(f"{sf_dir}/{'documents' if name == 'op5_sharding' else 'pages'}.parquet").count()
