"""The operators' queries over the test tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, html_extract, line_dedup, quality, quality_gam, simhash, suffix_dedup, token_planes, url_filter, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Sentences of fewer words don't count, and runs of repeated sentences of fewer words stay.
SENTENCE_WORDS, RUN_WORDS = 3, 20


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_removed, n_units, removed): characters and sentences that went, and where they stood."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = line_dedup.remove_repeated_lines(docs, min_words=SENTENCE_WORDS, sentences=True, run_words=RUN_WORDS)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select("doc_id", "text", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_units"), "removed")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.measure(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.measure(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.measure(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_line_dedup, op2_simhash, op3_html_extract, op4_decontaminate, op5_quality, op6_suffix_dedup, op7_url_filter, op8_warc, op9_bpe, op10_token_planes, op11_collocations, op12_quality_gam, op13_whitening)
    return {f.__name__: f for f in own}


#: Revisits of equal payloads: SQL hashes the whole payloads as the archive does.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM q
"""


#: Words are cut and counted phrase by phrase; a phrase of two words can only lie in one of three.
COLLOCATIONS_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS words FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: array_to_string(words[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(words) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS parts FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT c.lang, c.k, c.phrase, c.a, j, l.a AS l, r.a AS r, CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.parts[1:c.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.parts[c.j + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, short, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(parts[1:2], ' '), array_to_string(parts[2:3], ' ')]) AS short FROM c WHERE k = 3) GROUP BY ALL),
o AS (SELECT m.* FROM m LEFT JOIN h ON h.lang = m.lang AND h.short = m.phrase WHERE m.k = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * m.a),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT b.lang, b.rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b JOIN n ON n.lang = b.lang WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_warc": WARC_SQL, "op11_collocations": COLLOCATIONS_SQL}
