"""Registered queries of the operators, with the SQL of those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentlens.llm import (
    chat, decontaminate, exact_dedup, fill_middle, forest, page_diff, pieces, quality, segment_search, surrogates, toxicity, url_filter,
    vector_codes,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

RULES = [
    url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"), url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"), url_filter.Rule("net", "/fr/", "block"),
]


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return quality.score(documents, quality.train(documents, table(spark, folder, "labels")))


@query()
def op2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


@query()
def op3_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return forest.join(table(spark, folder, "documents"))


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = toxicity.train(documents, table(spark, folder, "labels"))
    scored = toxicity.score(documents.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


@query("""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST) AS keep_id FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.copies(table(spark, folder, "documents"))


@query("""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages
), split AS (
  SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest
), known AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(/|\\.html?)$', '') END AS address FROM split
), listed AS (
  SELECT address FROM known WHERE address IS NOT NULL GROUP BY address HAVING count(*) >= 2
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT host, path FROM split) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT k.page_id, k.host, k.path, b.rule,
  CASE WHEN b.rule IS NOT NULL THEN b.rule_verdict WHEN l.address IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM known k LEFT JOIN best b ON k.host = b.host AND k.path = b.path LEFT JOIN listed l ON k.address = l.address
""")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judge(pages, RULES, url_filter.repeated_addresses(pages))


@query()
def op7_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_diff.main_text(table(spark, folder, "pages"))


@query()
def op8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.replace_entities(documents, "2026-training-data")


@query()
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("""
WITH said AS (
  SELECT conv_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), shown AS (
  SELECT *, '<|' || replace(role, '<|', '< |') || '|>\n' || replace(text, '<|', '< |') || '\n<|end|>\n' AS line FROM said
), turns AS (
  SELECT conv_id, turn, string_agg(turn || chr(31) || role || chr(31) || text || chr(30), '' ORDER BY role, text) AS raw,
    string_agg(line, '' ORDER BY role, text) AS lines, count(*) AS n FROM shown GROUP BY conv_id, turn
), prefixes AS (
  SELECT conv_id, turn, string_agg(raw, '') OVER w AS p, string_agg(lines, '') OVER w AS chat, CAST(sum(n) OVER w AS BIGINT) AS n,
    max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), whole AS (
  SELECT p, chat, n, min(conv_id) AS conv_id FROM prefixes WHERE turn = last_turn GROUP BY p, chat, n
)
SELECT conv_id, n AS n_turns, chat FROM whole WHERE p NOT IN (SELECT p FROM prefixes WHERE turn < last_turn)
""")
def op10_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(table(spark, folder, "conversations"))


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_SQUARES = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _round(n: int) -> str:
    """Assignment of every part to the entries ``e{n}``."""
    return f"""a{n} AS (
  SELECT r, p, arg_min(struct_pack(e := e, d := d), d * 64 + e) AS best
  FROM (SELECT r, x.p, e, CAST({_SQUARES.format(a="x.part", b="y.entry")} AS BIGINT) AS d FROM parts x JOIN e{n} y ON x.p = y.p) GROUP BY r, p
)"""


def _entries(n: int) -> str:
    """Entries ``e{n + 1}``: floored means of the assigned parts, or as before."""
    return f"""m{n} AS (
  SELECT p, e, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS entry FROM (
    SELECT p, e, i, sum(part[i]) AS total, count(*) AS n
    FROM (SELECT x.p, best.e AS e, part, unnest(range(1, len(part) + 1)) AS i FROM a{n} a JOIN parts x ON a.r = x.r AND a.p = x.p) GROUP BY p, e, i
  ) GROUP BY p, e
), e{n + 1} AS (SELECT b.p, b.e, coalesce(m.entry, b.entry) AS entry FROM e{n} b LEFT JOIN m{n} m ON b.p = m.p AND b.e = m.e)"""


@query(f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_FINITE}
), parts AS (
  SELECT r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS part FROM (SELECT r, v, unnest(range(0, 16)) AS p FROM kept)
), e0 AS (SELECT p, r - 1 AS e, part AS entry FROM parts WHERE r <= 64), {_round(0)}, {_entries(0)}, {_round(1)}, {_entries(1)}, {_round(2)},
coded AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM e2) AS codebooks_sha256
FROM kept JOIN coded USING (r)
""")
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compressed(table(spark, folder, "embeddings"))


@query(r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM units
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), pieces AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM pieces
""")
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digests(table(spark, folder, "documents"))


@query(f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {_FINITE}
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) QUALIFY row_number() OVER w <= 5
""")
def op13_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return segment_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
