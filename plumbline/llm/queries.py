"""The registered queries of this subpackage, with the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.token_counts import sentencepiece_vocabulary, token_counts

    pieces = sentencepiece_vocabulary(tokenizer_path("piece_bpe_32k.model"))
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces).select("doc_id", "n_words", "n_tokens")


def encoded_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of the ids and of the bytes that they decode to."""
    import public_tokenizers

    from plumbline.llm.bpe import bpe_encode, read_ranks

    ranks = read_ranks(docs.sparkSession, tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe_encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False, decoded_col="decoded")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digest(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.line_dedup import line_dedup

    docs = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
hot AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id <> h.top, false) AS lost FROM keyed k LEFT JOIN hot h USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.secret_scan import secret_spans

    found = secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda s: s.kind.isin("assign", "access", "hex"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secret_spans")).alias("spans"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.ngram_join import similar_components

    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.toxicity import learn_lexicon, toxicity

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))  # a null id is never learned from
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out))
    return toxicity(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality_rules import learn_quality_rules, quality_verdicts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_quality_rules(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality_verdicts(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) form pair k."""
    from plumbline.llm.chat_format import preference_pairs

    turns = table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(F.pmod("conv_id", F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text"
    )
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start.cast("string"), s.end.cast("string"))), ",").alias(c)
    return preference_pairs(turns).select("pair_id", F.col("n_common").cast("long").alias("n_common"), "prompt", "chosen_text", "rejected_text", listed("chosen_spans"), listed("rejected_spans"))


OP2_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations),
c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
differs AS (
  SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, min(coalesce(c.i, r.i)) FILTER (NOT coalesce(c.role = r.role AND c.text = r.text, false)) - 1 AS n,
    max(coalesce(c.i, r.i)) AS most, count(c.i) AS n_c, count(r.i) AS n_r
  FROM c FULL JOIN r ON c.pair_id = r.pair_id AND c.i = r.i GROUP BY 1),
k AS (SELECT pair_id, coalesce(n, most) AS n_common, n_c, n_r FROM differs),
s AS (
  SELECT t.*, k.n_common, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS out FROM t JOIN k USING (pair_id)),
p AS (
  SELECT *, coalesce(sum(length(out)) FILTER (i > n_common) OVER (PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM s),
g AS (
  SELECT pair_id, string_agg(out, '' ORDER BY i) FILTER (side = 0 AND i <= n_common) AS prompt,
    string_agg(out, '' ORDER BY i) FILTER (side = 0 AND i > n_common) AS chosen, string_agg(out, '' ORDER BY i) FILTER (side = 1 AND i > n_common) AS rejected,
    string_agg(CAST(pos0 + 13 + length(role) AS BIGINT) || ':' || CAST(pos0 + length(out) - 1 AS BIGINT), ',' ORDER BY i) FILTER (side = 0 AND i > n_common AND role = 'assistant') AS cs,
    string_agg(CAST(pos0 + 13 + length(role) AS BIGINT) || ':' || CAST(pos0 + length(out) - 1 AS BIGINT), ',' ORDER BY i) FILTER (side = 1 AND i > n_common AND role = 'assistant') AS rs
  FROM p GROUP BY pair_id)
SELECT pair_id, n_common, coalesce(prompt, '') AS prompt, CASE WHEN n_c > 0 THEN coalesce(chosen, '') END AS chosen_text, CASE WHEN n_r > 0 THEN coalesce(rejected, '') END AS rejected_text,
  CASE WHEN n_c > 0 THEN coalesce(cs, '') END AS chosen_spans, CASE WHEN n_r > 0 THEN coalesce(rs, '') END AS rejected_spans
FROM g JOIN k USING (pair_id)"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.decontamination import contaminated

    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"), keep_html=False).select("page_id", "url", "text", "n_chars")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_chat_format": op2_chat_format,
    "op3_bpe": op3_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_html_extraction": op6_html_extraction,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_secret_scan": op9_secret_scan,
    "op10_ngram_join": op10_ngram_join,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op7_line_dedup": OP7_SQL,
}
