"""Registered queries of the text operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillframe.llm import mixing
from rillframe.llm.ann import nearest
from rillframe.llm.bpe import bpe_encode
from rillframe.llm.chat import conversation_digests, format_conversations
from rillframe.llm.common import read_table
from rillframe.llm.exact_dedup import exact_dedup
from rillframe.llm.hpylm import language_scores
from rillframe.llm.line_dedup import line_dedup
from rillframe.llm.pii import pseudonymise
from rillframe.llm.simhash import simhash_components
from rillframe.llm.toxicity import classify

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The default vocabulary; it lies at one path on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read_table(spark, sf_dir, "documents"), tokenizer_path(), digests=True)


#: The key of the registered query; a production run passes its own secret.
PII_KEY = "rillframe example key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read_table(spark, sf_dir, "documents"), PII_KEY)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"), keep="high")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(turns.unionByName(extra), typed=False))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as typed parts: its text, an image, and for some sound, a document and a kind that isn't known."""
    turns = read_table(spark, sf_dir, "conversations")
    text = lambda c: F.col(c).cast("string")
    part = lambda kind, **fields: F.to_json(F.struct(F.lit(kind).alias("type"), *[c.alias(n) for n, c in fields.items()]))
    parts = F.array_compact(F.array(
        part("text", text=F.col("text")),
        part("image", url=F.concat_ws("/", F.lit("img"), text("conv_id"), text("turn")), width=300 + 200 * F.col("turn"), height=100 * (F.col("conv_id") % 20)),
        F.when(F.col("turn") % 2 == 1, part("audio", id=F.concat(F.lit("a"), text("turn")), seconds=F.col("turn") + 0.5)),
        F.when(F.col("conv_id") % 3 == 0, part("document", name=F.concat(F.lit("d"), text("conv_id")), pages=F.coalesce(F.length("text"), F.lit(0)) % 7)),
        F.when(F.col("conv_id") % 5 == 0, part("video", id=F.lit("v")))))
    typed = turns.select("conv_id", "turn", "role", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("text"))
    return conversation_digests(format_conversations(typed)).select("conv_id", "n_turns", "attached_tokens", "n_attachments", "attachments_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), radius=2, width=3)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op10_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(read_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_ann": op4_ann,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_chat": op7_chat,
    "chat_typed_parts": chat_typed_parts,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_hpylm": op10_hpylm,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op3_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM (SELECT doc_id, {_LOWER} AS body FROM documents) WINDOW w AS (PARTITION BY body)""",
    "op4_ann": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (c.e[i] - q.e[i]) * (c.e[i] - q.e[i])), lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INTEGER AS rank FROM p) WHERE rank <= 10""",
    "op7_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, length(regexp_replace(text, '(\\*)(###|</turn>|<\|)', '\1\1_\2', 'g')) AS escaped_chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + escaped_chars + 9)::BIGINT AS formatted_chars, 0::BIGINT AS attached_tokens,
       0::BIGINT AS n_attachments, sha256('') AS attachments_sha256
FROM e GROUP BY conv_id""",
    # the parts as their columns say, without any JSON: label, kind, reference and tokens in order
    "chat_typed_parts": """
WITH t AS (SELECT conv_id, turn, (turn // 64) || '.' || (row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn, role, text) - 1) || '.' AS lead_,
                  turn % 2 = 1 AS sound, conv_id % 3 = 0 AS paper, conv_id % 5 = 0 AS film, coalesce(length(text), 0) % 7 AS pages FROM conversations),
p AS (SELECT conv_id, turn, lead_ || '1' AS label, 1 AS k, 'image' AS kind, 'img/' || conv_id || '/' || turn AS ref,
             ceil((300 + 200 * turn) / 512)::BIGINT * greatest(1, ceil(100 * (conv_id % 20) / 512))::BIGINT + 1 AS tokens FROM t
      UNION ALL SELECT conv_id, turn, lead_ || '2', 2, 'audio', 'a' || turn, (turn + 1) * 25 FROM t WHERE sound
      UNION ALL SELECT conv_id, turn, lead_ || (2 + sound::INT), 3, 'document', 'd' || conv_id, greatest(1, pages) * 800 FROM t WHERE paper
      UNION ALL SELECT conv_id, turn, lead_ || (2 + sound::INT + paper::INT), 4, 'other', 'v', 0 FROM t WHERE film)
SELECT conv_id, (SELECT count(*) FROM t u WHERE u.conv_id = p.conv_id) AS n_turns, sum(tokens)::BIGINT AS attached_tokens, count(*) AS n_attachments,
       sha256(string_agg(label || ' ' || kind || ' ' || ref || ' ' || tokens || chr(10), '' ORDER BY turn, k)) AS attachments_sha256
FROM p GROUP BY conv_id""",
    # the schedule is simulated slot by slot: the earliest deadline among the released blocks takes the slot
    "op5_mixing": """
WITH RECURSIVE c AS (SELECT source, count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS w FROM documents GROUP BY 1),
g AS (SELECT list_reduce(list(w), lambda a, b: gcd(a, b)) AS g FROM c),
src AS (SELECT source, w // g.g AS w, sum(w // g.g) OVER ()::BIGINT AS all_w, row_number() OVER (ORDER BY source NULLS FIRST) AS i FROM c, g),
ws AS (SELECT list(w ORDER BY i) AS ws, any_value(all_w) AS n FROM src),
sim AS (
  SELECT -1::BIGINT AS t, list_transform(ws, lambda x: 0::BIGINT) AS k, 0::BIGINT AS pick, ws, n FROM ws
  UNION ALL
  SELECT t + 1, list_transform(k, lambda v, j: CASE WHEN j = p THEN v + 1 ELSE v END), p, ws, n
  FROM (SELECT t, k, ws, n, list_min(list_transform(list_filter(range(1, len(ws) + 1), lambda j: k[j] * n // ws[j] <= t + 1),
                                lambda j: ((k[j] + 1) * n + ws[j] - 1) // ws[j] * 100000 + j)) % 100000 AS p
        FROM sim WHERE t < n - 1)),
slots AS (SELECT pick AS i, list(t ORDER BY t) AS slots FROM sim WHERE t >= 0 GROUP BY 1),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0-' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT doc_id, d.source, k // 16 AS block, (k % 16)::INTEGER AS place, k // 16 // w * all_w + slots[k // 16 % w + 1] AS slot,
       k // 16 * all_w // w AS release, ((k // 16 + 1) * all_w + w - 1) // w AS deadline
FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source JOIN slots USING (i)""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
