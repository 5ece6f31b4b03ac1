"""The queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op2_warc_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages -> ARC files -> WARC files -> what the files say."""
    from . import archives as A

    legacy, path = A.new_archive(spark), A.new_archive(spark)
    A.write_arc(A.to_arc(table(spark, sf_dir, "pages")), legacy)
    A.write_warc(A.to_warc(A.read_arc(spark, legacy)), path)
    drop_path(spark, legacy)
    return A.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages by visible text, declared language, suffix and host; trigrams are fitted on labelled documents."""
    from . import language_id as L

    model = L.fit(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", L.visible_text(F.col("html")).alias("text"), L.declared_language(F.col("html")).alias("declared"))
    parts = L.host_parts(F.col("url"))
    return L.identify(pages, model, declared=F.col("declared"), **parts).select("page_id", "declared", "text_lang", "lang", "confidence", "accepted")


def op4_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, words_in

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_in(F.col("text")).alias("size"))
    return mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, each a file of its source's directory or of one up to two levels below, as its doc_id says."""
    from .licenses import scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    n = F.col("doc_id")
    path = F.concat_ws("/", "source", F.when(n % 7 > 0, F.concat(F.lit("part"), n % 10)), F.when(n % 7 > 2, F.concat(F.lit("sub"), n % 3)), n.cast("string"))
    return scan(docs, path).select("doc_id", "license", "cosine", "license_share", "inherited_license", "inherited_from", "effective_license")


def op6_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm_scoring as L

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), L.held_out(F.col("doc_id")).alias("held_out"))
    return L.score(docs, L.train(docs, ~F.col("held_out")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, tokenizer_path()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import content_store as S

    path = S.new_store(spark)
    S.write_store(table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return S.read_index(spark, path)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_with_next

    return compare_with_next(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_warc_convert, op3_language_id, op4_weighted_mix, op5_license_scan, op6_ctw_scoring, op7_token_counts, op8_token_store, op9_fingerprints, op10_decontaminate)}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A label passes one link a round; no component of the test tables is so many links wide.
_ROUNDS = 16
_PASS = "".join(f",\nc{i} AS MATERIALIZED (SELECT doc_id, min(label) AS label FROM (SELECT * FROM c{i - 1} UNION ALL SELECT b, label FROM c{i - 1} JOIN links ON a = doc_id) GROUP BY doc_id)" for i in range(1, _ROUNDS + 1))
ORACLES = {
    "op1_ngram_join": rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
c0 AS MATERIALIZED (SELECT doc_id, doc_id AS label FROM n){_PASS}
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.label, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c{_ROUNDS} c ON c.doc_id = w.doc_id""",
    "op2_warc_convert": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM p LEFT JOIN m ON m.d = p.d""",
    "op4_weighted_mix": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ':' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS w, ss * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS full_at FROM r),
t AS (SELECT *, (least(sum(ss) OVER () * 1.5::DOUBLE, sum(cap) OVER ()) - coalesce(sum(cap) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
g AS (SELECT source, ss, least(cap, w * (SELECT arg_min(level, full_at) FROM t WHERE level <= full_at)) AS target FROM t),
q AS (SELECT d.*, g.ss, g.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source),
sent AS (SELECT *, (b + ss * turn + size) / nullif(target, 0) AS fin FROM q, (VALUES (0), (1)) v(turn)),
late AS (SELECT *, coalesce(sum(size) OVER (ORDER BY fin, source, h, doc_id, turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size AS ahead FROM sent WHERE fin > 1),
won AS (SELECT doc_id, source, b, size, fin, turn FROM sent WHERE fin <= 1 UNION ALL SELECT doc_id, source, b, size, fin, turn FROM late WHERE ahead <= (SELECT sum(target) FROM g) - (SELECT coalesce(sum(size), 0) FROM sent WHERE fin <= 1))
SELECT q.doc_id, q.size, q.ss AS source_size, q.target, CAST(coalesce(x.taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN (SELECT doc_id, source, b, size, sum(size) AS taken FROM won GROUP BY ALL) x
  ON x.doc_id IS NOT DISTINCT FROM q.doc_id AND x.source IS NOT DISTINCT FROM q.source AND x.b = q.b AND x.size = q.size""",
    "op10_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item, p, dw.n AS n FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query's result; the others are held against brute force by the tests."""
    return dict(ORACLES)
