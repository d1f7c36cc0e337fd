"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from leakatlas.llm import bpe, brown_lm, centroids, decontaminate, merkle, minmax_dedup, pii, quality, sharding, suffix_dedup, toxicity, url_filter, warc
from leakatlas.llm.registry import query, table
from leakatlas.llm.shared import shared_folder, stored

SHARD_BYTES = 4 << 20
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    documents = table(spark, sf_dir, "documents")
    model = toxicity.train(documents, table(spark, sf_dir, "labels"))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", "severity", "toxic", (~F.col("toxic")).alias("kept"))


@query("op2_url_filter")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, none over SHARD_BYTES of text."""
    return sharding.shards(table(spark, sf_dir, "documents"), "doc_id", F.octet_length("text"), SHARD_BYTES)


SQL_WORD = r"[^\x20\x09-\x0D]"
SQL_GRID = ", ".join(f"('{s}', {c})" for s, cutoffs in quality.GRID.items() for c in cutoffs)
SQL_SHARE = quality.RISK / len(quality.GRID)
QUALITY_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SQL_WORD}+') AS ws FROM documents),
words AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM words WHERE c IS NOT NULL),
repeats AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM windows, (VALUES (0), (1), (2)) v(d) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM
  (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{SQL_WORD}') GROUP BY doc_id),
counts AS (SELECT w.doc_id, stratum, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN lines USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts),
signals AS (SELECT doc_id, stratum, base_failed, unnest([{{'s': 'symbols_per_word', 'v': n_symbols / greatest(n_words, 1)}}, {{'s': 'dup_line_share', 'v': n_dup_lines / greatest(n_lines, 1)}},
  {{'s': 'repeat_word_share', 'v': n_repeat_words / greatest(n_words, 1)}}], recursive := true) FROM judged),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING max(quality) = 1),
tallies AS (SELECT stratum, g.s, g.c, count(*) AS n, count(*) FILTER (v > c) AS k FROM signals JOIN good USING (doc_id) JOIN (VALUES {SQL_GRID}) g(s, c) ON g.s = signals.s WHERE NOT base_failed GROUP BY ALL),
tests AS (SELECT *, CASE WHEN k < {SQL_SHARE} * n THEN list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({SQL_SHARE}) + (n - i) * ln(1 - {SQL_SHARE})))) ELSE 1 END AS p FROM tallies),
cutoffs AS (SELECT stratum, s, min(c) AS cutoff FROM tests WHERE p <= {quality.ERROR} / (SELECT count(*) FROM tests) GROUP BY ALL),
beyond AS (SELECT doc_id, string_agg(s, ',' ORDER BY CASE s WHEN 'symbols_per_word' THEN 1 WHEN 'dup_line_share' THEN 2 ELSE 3 END) AS rejected_by FROM signals JOIN cutoffs USING (stratum, s) WHERE v > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM judged LEFT JOIN beyond USING (doc_id)
"""


@query("op6_quality_rules", QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    counts = stored(quality.with_counts(documents, keep_text=False), "quality-counts")
    cutoffs = quality.risk_cutoffs(counts, table(spark, sf_dir, "labels"))
    judged = quality.judge(counts, cutoffs)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    import public_tokenizers

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_texts(documents, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


# Five hexadecimal digits are four of base32.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - i % 4 * 5 AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""


@query("op10_warc", WARC_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back."""
    folder = shared_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder)
    records = warc.read_warc(spark, folder)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("bigint")
    return records.select(
        page("record_id").alias("page_id"),
        F.when(F.col("record_type") == "revisit", F.col("payload_length").cast("long")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


@query("op7_minmax_dedup")
def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return minmax_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 85)


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once repeated 400-byte strings are cut."""
    cut = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("text").alias("kept_text"))


@query("op8_brown_lm")
def op8_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class model scores of every document; every seventh by hash is held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = brown_lm.score_documents(documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


@query("op3_decontaminate")
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of documents that match a benchmark item."""
    return decontaminate.matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


CLUSTERS, ROUNDS, DIMS = 40, 5, 64


def _cluster_sql() -> str:
    """The rounds one after another, each by comparing every vector with every centroid."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cluster, v AS c FROM kept
  WHERE vec_id IS NOT NULL ORDER BY 1 LIMIT {CLUSTERS})""",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"""far{i} AS (SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM kept, c{i})""")
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v, cluster, distance FROM far{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)""")
        if i < ROUNDS:
            parts.append(f"""sums{i} AS (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range({DIMS})) AS dim FROM a{i}) GROUP BY ALL)""")
            parts.append(f"""m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c FROM sums{i} GROUP BY cluster)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (cluster)"""


@query("op12_centroid_clustering", _cluster_sql())
def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The centroid of every vector after five rounds."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"), k=CLUSTERS, rounds=ROUNDS, dims=DIMS)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def _manifest_sql(levels: int = 6) -> str:
    """The manifest by numbering and sorting; ``levels`` of runs are more than the test tables need."""
    crc = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))))"
    written = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(written(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    folded = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""d AS MATERIALIZED (SELECT doc_id, coalesce('+' || source, '') AS tree, {leaf('text')} AS node, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(folded)} ELSE {leaf('text')} END AS f0 FROM documents)""",
        "n0 AS MATERIALIZED (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS pos, node FROM d)",
        "w0 AS MATERIALIZED (SELECT doc_id, tree, node AS leaf, f0 AS fold, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST) - 1 AS pos, '' AS proof FROM d)",
    ]

    def climb(p: str) -> None:
        for i in range(levels):
            parts.append(f"{p}c{i} AS (SELECT tree, count(*) AS n FROM {p}n{i} GROUP BY tree)")
            parts.append(f"{p}r{i} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, list(node ORDER BY pos) AS s, any_value(n) AS n FROM {p}n{i} JOIN {p}c{i} USING (tree) GROUP BY tree, pos // 16)")
            parts.append(f"{p}n{i + 1} AS MATERIALIZED (SELECT tree, pos, CASE WHEN n = 1 THEN s[1] ELSE sha256(array_to_string(s, '')) END AS node FROM {p}r{i})")
            left, right = "array_to_string(s[1:w.pos % 16], '')", "array_to_string(s[w.pos % 16 + 2:], '')"
            parts.append(
                f"""{p}w{i + 1} AS MATERIALIZED (SELECT doc_id, w.tree, leaf, w.pos // 16 AS pos, CASE WHEN n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold,
  CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof{', sub' if p else ''} FROM {p}w{i} w JOIN {p}r{i} r ON r.tree = w.tree AND r.pos = w.pos // 16)"""
            )

    climb("")
    parts.append(f"un0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, node, tree AS src FROM n{levels})")
    parts.append(f"uw0 AS MATERIALIZED (SELECT doc_id, '' AS tree, leaf, u.pos AS pos, fold, proof, u.node AS sub FROM w{levels} w JOIN un0 u ON u.src = w.tree)")
    climb("u")
    return f"""WITH {", ".join(parts)}
SELECT doc_id, leaf, sub AS subroot, node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = node AS verified FROM uw{levels} CROSS JOIN un{levels}"""


@query("op13_merkle_manifest", _manifest_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, and what a reader finds where A-Z of every fifth text by hash became a-z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    columns = ["doc_id", "source", "lang", "n_chars"]
    found = [*[F.col(c) for c in columns], F.translate("text", upper, upper.lower())]
    made = merkle.manifest(table(spark, sf_dir, "documents"), "doc_id", "source", [*columns, "text"], found, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


@query("op11_pii")
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and a digest of the base matches of every document, and all spans."""
    found = pii.find_identifiers(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))
