"""The operators as queries over whole tables, with production parameters."""

import json
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latentspark.llm import chat_format, decontaminate, fill_middle, jaccard_join, langid, lm_score, packing, secret_ledger, sharding, token_counts, topk_search, url_filter, whitening
from latentspark.llm.common import shared_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def pack_whole(docs: DataFrame) -> DataFrame:
    """Documents packed with the byte-level tokenizer. Its two files hold one vocabulary; the special strings are those of the .json."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_whole(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, F.col("vec_id") % 100 == 0)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    text = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that begins empty: every distinct text is scanned once by every rule."""
    ledger = f"{shared_dir(spark)}/ledger/{uuid.uuid4().hex}"
    rows = secret_ledger.scan_versions(table(spark, sf_dir, "documents").select("doc_id", "text"), ledger)
    spans = F.col("spans")
    counts = [secret_ledger.counted(spans, r.kind).alias(f"n_{r.kind}") for r in secret_ledger.BASE]
    return rows.select("doc_id", *counts, F.sha2(secret_ledger.listed(secret_ledger.base(spans)), 256).alias("base_sha256"), secret_ledger.listed(spans).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_token_counts, op3_url_filters, op4_best_fit_packing, op5_chat_formatting, op6_topk_search, op7_sharding, op8_ngram_jaccard_join, op9_decontamination, op10_lm_scoring, op11_embedding_whitening, op12_fill_in_middle, op13_secret_scans)}

_WORDS = r"list_filter(list_transform(regexp_split_to_array(lower(text), '\s+'), lambda t: regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')), lambda t: t <> '')"
_RUNS = "unnest(list_distinct(list_transform(range(1, greatest(2, len(ws) - 3)), lambda i: array_to_string(ws[i:i + 4], ' '))))"

_ESCAPED = r"regexp_replace(text, '(\\|### |</turn>|<\|)', '\\\1', 'g')"

_UNITS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]')"


def _spans(kind: str, place: int, pattern: str, value: int = 0, least: int = 0) -> str:
    """Spans of one rule in SQL: lengths of gaps and matches, added up."""
    p = pattern.replace("'", "''")
    found = f"regexp_extract_all(text, '{p}', 0) AS m, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}', {value}) AS v"
    piece = "unnest(list_transform(range(1, len(m) + 1), lambda i: {'at': i, 'gap': length(g[i]), 'all': length(m[i]), 'value': length(v[i])})) AS p"
    end = "sum(p.gap + p.all) OVER (PARTITION BY uid ORDER BY p.at)"
    return f"SELECT uid, '{kind}' AS kind, {place} AS place, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM (SELECT uid, p.all AS size, p.value AS value, {end} AS stop FROM (SELECT uid, {piece} FROM (SELECT uid, {found} FROM d) WHERE len(m) > 0)) WHERE value >= {least}"


#: RE2 folds letters beyond ASCII; classes do not.
_ASSIGN = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_EVERY = " UNION ALL ".join([_spans("assign", 0, _ASSIGN, 2, 6), _spans("access", 1, "AKIA[A-Z0-9]+", 0, 20), _spans("hex", 2, "[0-9a-f]+", 0, 24), *[_spans(r.kind, 3 + i, r.pattern) for i, r in enumerate(secret_ledger.MORE)]])
_LIST = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place){0}, '')"

#: The rows of these need no method to be defined: digests of what was put in, exact similarity, the exact best, exact containment.
ORACLES = {
    "op5_chat_formatting": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ' || role || ': ' || {_ESCAPED} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op8_ngram_jaccard_join": f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
     s AS (SELECT doc_id, {_RUNS} AS s FROM d WHERE len(ws) > 0),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
     near AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
     link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
     reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
     class AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM reach GROUP BY a),
     degree AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, md5(text) AS text_key, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN degree USING (doc_id)
""",
    "op9_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE text IS NOT NULL),
     b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE text IS NOT NULL),
     ds AS (SELECT doc_id, {_RUNS} AS s FROM d WHERE len(ws) > 0),
     bs AS (SELECT item_id, {_RUNS} AS s FROM b WHERE len(ws) > 0),
     n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM bs JOIN ds USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
""",
    "op12_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_UNITS} AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
     r AS (SELECT *, len(u) AS n, [CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT) for i in range(4)] AS k FROM d),
     c AS (SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS a, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR k[3] % 100 >= 90 THEN 'plain'
                       WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
     p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""",
    "op13_secret_scans": f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text FROM documents),
     s AS ({_EVERY})
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256({_LIST.format(" FILTER (place < 3)")}) AS base_sha256, {_LIST.format(" FILTER (kind IS NOT NULL)")} AS spans
FROM d LEFT JOIN s USING (uid) GROUP BY uid, doc_id
""",
    "op6_topk_search": """
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS uid, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.uid AS query_uid, q.vec_id AS query_id, c.uid AS uid, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.uid <> q.uid
), ordered AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, vec_id, uid) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ordered WHERE rank <= 10
""",
}
