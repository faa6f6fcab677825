"""The operators of this folder on the tables they are meant for.

Each query reads its whole table with production parameters.  ``ORACLES``
holds SQL where SQL can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.llm import bitslice, chat, licenses, minhash, mixing, oracles, packing, quality, substring, tokenfile, topk, toxicity, vectors, whiten
from minutebook.llm.common import load
from minutebook.session import scratch_dir

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op10_dart_minhash(spark: SparkSession, sf: str) -> DataFrame:
    classes = minhash.near_duplicates(load(spark, sf, "documents"))
    return classes.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


@query
def op1_pfair_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf, "documents"))
    return mixed.select("doc_id", "source", "mix.block", "mix.release", "mix.deadline", "mix.slot", "mix.start", "mix.share")


@query
def op2_sentence_rules(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(load(spark, sf, "documents"))


@query
def op3_factorization_machine(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score_quality(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op4_concatenate_cut(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(load(spark, sf, "documents"), tokenizer_path())


@query
def op5_sorted_projections(spark: SparkSession, sf: str) -> DataFrame:
    return vectors.near_duplicate_vectors(load(spark, sf, "embeddings"))


@query
def op6_voronoi_join(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_products(load(spark, sf, "embeddings"))


@query
def op7_ngram_nb_linear(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(load(spark, sf, "documents"), load(spark, sf, "labels"))


@query
def op8_preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations")
    pairs = chat.preference_pairs(turns, chat.with_other_answer(turns))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")

    return pairs.select("conv_id", "prefix_turns", "prompt", "chosen", listed("chosen_spans").alias("chosen_spans"),
                        "rejected", listed("rejected_spans").alias("rejected_spans"))


ORACLES["op8_preference_pairs"] = """
WITH t AS (
  SELECT conv_id AS pair, turn, coalesce(role, 'user') AS role, replace(coalesce(text, ''), '<|', '< |') AS text, 'a' AS side
  FROM conversations WHERE conv_id IS NOT NULL
), last AS (
  SELECT conv_id AS pair, max(turn) AS stop, max({'turn': turn, 'text': coalesce(text, '')}).text AS answer
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL GROUP BY conv_id
), both_sides AS (
  SELECT * FROM t
  UNION ALL SELECT t.pair, turn, role, text, 'b' FROM t LEFT JOIN last USING (pair) WHERE stop IS NULL OR turn < stop
  UNION ALL SELECT l.pair, l.stop, 'assistant', replace(o.answer, '<|', '< |'), 'b' FROM last l JOIN last o ON o.pair = xor(l.pair, 1)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY pair, side ORDER BY turn, role, text) AS k FROM both_sides
), prefix AS (
  SELECT pair, coalesce(min(CASE WHEN same THEN NULL ELSE k END) - 1, max(k)) AS n FROM (
    SELECT pair, k, count(*) = 2 AND count(DISTINCT role || chr(0) || text) = 1 AS same FROM numbered GROUP BY pair, k) GROUP BY pair
), rendered AS (
  SELECT pair, side, k, n, role, '<|im_start|>' || role || chr(10) AS head, text FROM numbered JOIN prefix USING (pair)
), placed AS (
  SELECT *, head || text || '<|im_end|>' || chr(10) AS body,
    coalesce(sum(length(head) + length(text) + 11) OVER (PARTITION BY pair, side, k > n ORDER BY k
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS first
  FROM rendered
)
SELECT pair AS conv_id, any_value(n)::INT AS prefix_turns,
  coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE side = 'a' AND k <= n), '') AS prompt,
  coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE side = 'a' AND k > n), '') AS chosen,
  coalesce(string_agg(first || '-' || (first + length(text) + 10), ',' ORDER BY k)
    FILTER (WHERE side = 'a' AND k > n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg(body, '' ORDER BY k) FILTER (WHERE side = 'b' AND k > n), '') AS rejected,
  coalesce(string_agg(first || '-' || (first + length(text) + 10), ',' ORDER BY k)
    FILTER (WHERE side = 'b' AND k > n AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY pair"""


@query
def op9_relative_lz(spark: SparkSession, sf: str) -> DataFrame:
    found = substring.remove_repeats(load(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op11_incremental_eigen(spark: SparkSession, sf: str) -> DataFrame:
    return whiten.whiten(load(spark, sf, "embeddings"))


@query
def op12_bit_sliced_bloom(spark: SparkSession, sf: str) -> DataFrame:
    return bitslice.search(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@query
def op13_zstd_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch_dir(spark, "tokens")
    tokenfile.write_tokens(load(spark, sf, "documents"), folder, tokenizer_path())
    return tokenfile.read_tokens(spark, folder, columns={"ids_crc32": F.crc32("ids")})


ORACLES["op1_pfair_mix"] = oracles.MIXTURE
ORACLES["op5_sorted_projections"] = oracles.VECTOR_LINKS
ORACLES["op6_voronoi_join"] = oracles.TOP_PRODUCTS
ORACLES["op9_relative_lz"] = oracles.REPEATS
ORACLES["op10_dart_minhash"] = oracles.NEAR_DUPLICATES
ORACLES["op12_bit_sliced_bloom"] = oracles.SEARCH
