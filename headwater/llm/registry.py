"""Registered queries of this folder: operator N as opN_<name> over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import alignment, bpe, chat, decontaminate, fingerprint, language, licences, near, pii, polytope, spans, spelling, toxicity
from headwater.session import table

#: Key of the registered query; a deployment passes its own secret.
PII_KEY = "headwater-demonstration-key"
RANKS = "byte_bpe_multi_50k.tiktoken"
ALIGNED = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer() -> tuple[str, str]:
    """(rank file, pattern) of the public tokenizer that is installed."""
    import public_tokenizers as P

    return P.path(RANKS), P.PATTERN


def op1_pii_surrogates(spark: SparkSession, d: str) -> DataFrame:
    """Surrogates in every document; see ``pii.pseudonymise`` for nulls, ids, ties, repeats and empty tables."""
    return pii.pseudonymise(table(spark, d, "documents"), PII_KEY)


def op2_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every document; see ``near.ngram_jaccard_join``."""
    return near.ngram_jaccard_join(table(spark, d, "documents"))


def op3_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items found in any document; see ``decontaminate.find_benchmark``."""
    return decontaminate.find_benchmark(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document; see ``toxicity.score_toxicity``."""
    return toxicity.score_toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_licences(spark: SparkSession, d: str) -> DataFrame:
    """Licence phrases and templates of every document; see ``licences.scan_licences``."""
    return licences.scan_licences(table(spark, d, "documents")).drop("spans")


def op6_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every conversation, and of one more, read back from the formatted text; see ``chat.format_chat``."""
    same = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", same), (-7, 1, "assistant", same)], "conv_id long, turn long, role string, text string")
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digest(chat.format_chat(rows))


def op7_order_minhash(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document, its edited text and its next document; see ``fingerprint.compare_edits``."""
    return fingerprint.compare_edits(table(spark, d, "documents"))


def op8_span_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every document without repeated sentences; see ``spans.dedup_spans``."""
    return spans.dedup_spans(table(spark, d, "documents"))


def op9_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document; see ``bpe.bpe``."""
    return bpe.bpe(table(spark, d, "documents"), *tokenizer())


def op10_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document; see ``language.identify``."""
    return language.identify(table(spark, d, "documents"))


def op11_cross_polytope(spark: SparkSession, d: str) -> DataFrame:
    """Links and components of all vectors; see ``polytope.near_vectors``."""
    return polytope.near_vectors(table(spark, d, "embeddings"))


def op12_spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots; see ``spelling.spelling_variants``."""
    return spelling.spelling_variants(table(spark, d, "documents"))


def aligned_tokenizers() -> tuple[str, str, str]:
    """(byte-level vocabulary, piece model, pattern) of the two public tokenizers that are aligned."""
    import public_tokenizers as P

    return *map(P.path, ALIGNED), P.PATTERN


def op13_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Groups and links of two tokenizers over every document; see ``alignment.align_tokenizers``."""
    return alignment.align_tokenizers(table(spark, d, "documents"), *aligned_tokenizers())


#: The same in DuckDB where SQL can express it.
SQL: dict[str, str] = {
    "op6_chat_format": """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS joined,
    regexp_replace(replace(role, '\\', '\\\\'), '(<|\\[)(\\||/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2', 'g') AS role_out,
    regexp_replace(replace(text, '\\', '\\\\'), '(<|\\[)(\\||/?s>|/?INST\\]|</?SYS>>)', '\\1\\\\\\2', 'g') AS text_out
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(text_out) + CASE WHEN joined THEN 8 ELSE length(role_out) + 23 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
}

QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op") and name[2].isdigit()}
