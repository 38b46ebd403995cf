"""Registered queries of the subpackage: name -> (Spark query, DuckDB statement or None)."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, hard_negatives, html_text, language_id, minhash_dedup, mixing_lm, pairwise_quality, quality_rules, sharding, substring_dedup, token_alignment, warc
from .common import stash, table

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, tuple[Query, str | None]] = {}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        CATALOG[name] = (fn, sql)
        return fn
    return add


@register("op1_substring_dedup", f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
  win AS (SELECT doc_id, p, array_to_string(ws[p:p + 34], ' ') AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w)),
  again AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS q FROM win JOIN again USING (g)),
  word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w),
  kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS text
           FROM word ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
  SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
  FROM w LEFT JOIN kept USING (doc_id)""")
def op1(spark, sf):
    done = substring_dedup.dedup(table(spark, sf, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@register("op10_quality_rules")
def op10(spark, sf):
    s = F.col("signals")
    return quality_rules.judge(table(spark, sf, "documents")).select(
        "doc_id", *[s[n].alias(n) for n in quality_rules.SIGNALS[:5]], "base_failed", "kept",
        *[s[n].alias(n) for n in quality_rules.SIGNALS[5:]], "posterior")


SHINGLES = f"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  sh AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
         FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS p FROM w)),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id)"""


@register("op4_minhash_dedup", f"""WITH RECURSIVE {SHINGLES},
  both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
  reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION
    SELECT r.a, CASE WHEN l.a = r.b THEN l.b ELSE l.a END FROM reach r JOIN link l ON l.a = r.b OR l.b = r.b)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(b) AS component_id, d.doc_id = min(b) AS kept
  FROM documents d JOIN reach ON a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""")
def op4(spark, sf):
    return minhash_dedup.near_duplicates(table(spark, sf, "documents")).drop("k2")


@register("op8_warc", """WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
  f AS (SELECT page_id, n, sha256(h) AS digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
  SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM f""")
def op8(spark, sf):
    archives = stash(warc.write(table(spark, sf, "pages")), "archives")
    return warc.read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op3_html_text")
def op3(spark, sf):
    return html_text.main_text(table(spark, sf, "pages"))


@register("op2_bpe")
def op2(spark, sf):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.decoded_digests(bpe.encode(table(spark, sf, "documents"), ranks), ranks)


@register("op6_decontamination", f"""WITH {SHINGLES},
  iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark),
  ish AS (SELECT DISTINCT item_id, array_to_string(ws[p:p + 4], ' ') AS g
          FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 3, least(len(ws), 1) + 1))) AS p FROM iw)),
  i AS (SELECT item_id, count(*) AS n_item FROM ish GROUP BY item_id)
  SELECT doc_id, item_id, n_item, count(*) AS shared FROM ish JOIN sh USING (g) JOIN i USING (item_id)
  GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item""")
def op6(spark, sf):
    found = decontaminate.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("k1").alias("doc_id"), F.col("i1").alias("item_id"), "n_item", "shared")


@register("op9_pairwise_quality")
def op9(spark, sf):
    return pairwise_quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@register("op5_mixing_lm")
def op5(spark, sf):
    return mixing_lm.score_documents(table(spark, sf, "documents"))


@register("op7_language_id")
def op7(spark, sf):
    return language_id.identify(table(spark, sf, "pages"), table(spark, sf, "documents"))


def _sharding_sql(rounds: int, seed: int) -> str:
    """The permutation with a and b from the number of rows; rows whose number is n or more walk on."""
    left, right = "(x // b)", "(x % b)"
    for turn in range(rounds):
        half, side = (left, "b") if turn % 2 else (right, "a")
        digest = f"('0x' || substr(md5({half} || ':{turn}:{seed}'), 1, 15))::BIGINT % {side}"
        left, right = (left, f"(({right} + {digest}) % b)") if turn % 2 else (f"(({left} + {digest}) % a)", right)
    once = f"{left} * b + {right}"
    return f"""WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
  rows AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
  crc AS (SELECT doc_id, size, xor(4294967295, list_reduce(range(1, size), lambda c, k: xor(c >> 8,
        t[1 + (xor(c, ('0x' || substr(h, 2 * k - 1, 2))::BIGINT) & 255)]), 4294967295)) AS text_crc32 FROM rows, bits),
  num AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x0 FROM crc),
  size_b AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS b FROM num),
  k AS (SELECT n, b, (n + b - 1) // b AS a FROM size_b),
  walk(x0, x, n, a, b) AS (SELECT x0, {once}, n, a, b FROM (SELECT x0, x0 AS x, n, a, b FROM num, k)
    UNION ALL SELECT x0, {once}, n, a, b FROM walk WHERE x >= n)
  SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 8)::INTEGER AS shard, x // 8 AS slot, NULL::INTEGER AS grown_shard
  FROM num JOIN walk USING (x0) WHERE x < n"""


@register("op13_sharding", _sharding_sql(sharding.ROUNDS, sharding.SEED))
def op13(spark, sf):
    placed = sharding.shard_documents(table(spark, sf, "documents"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


@register("op11_hard_negatives", """WITH v AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id),
  p AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS positive_rank FROM s WHERE same),
  n AS (SELECT p.a, p.b AS positive_id, positive_rank, p.score AS positive_score, s.b AS negative_id, s.score AS negative_score,
          row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
        FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
        WHERE positive_rank <= 5)
  SELECT a AS anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score,
    positive_rank::INTEGER AS positive_rank FROM n WHERE rank <= 5""")
def op11(spark, sf):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    rows = hard_negatives.quantized(vectors)
    return hard_negatives.mine(rows, rows.where("id % 100 = 0"))


@register("op12_token_alignment")
def op12(spark, sf):
    path = public_tokenizers.path
    return token_alignment.align(table(spark, sf, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))
