"""The queries of the training-data operators: thin views that apply each operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, jaccard, langid, packing, pieces, pitmanyor, quality, suffixes, toxicity, webarchive
from .common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and packed into sequences; see packing.pack_documents. Null texts are one end id."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


#: Limits for instruction data: tokens, segments and loss-bearing tokens of a sequence.
INSTRUCTION_LIMITS = (2048, 16, 1024)


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as whole instruction examples under three limits that bind apart; see packing.pack_examples."""
    examples = packing.conversation_examples(table(spark, sf_dir, "conversations"), tokenizer_path())
    return packing.pack_examples(examples, limits=INSTRUCTION_LIMITS)


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op2_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents: their number, the CRC-32 of the ids and whether they decode; see pieces.encode."""
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learns from four remainders in five. Null texts and texts without a letter are und."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, _remainder(5) != 0)
    found = langid.identify(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "n_words")


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; learns from six remainders in seven. Null texts are one end token."""
    found = pitmanyor.score_texts(table(spark, sf_dir, "documents"), _remainder(7) != 2)
    return found.select("doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "train_types")


def op5_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates; see jaccard.jaccard_components. Documents without words are their own."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in ZIP packages and read back; see webarchive.archive_and_read."""
    found = webarchive.archive_and_read(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op7_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts; see fingerprints.compare_with_next."""
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op8_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learns from four remainders in five. Null and empty texts match nothing."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted", "n_clauses")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; see quality.quality_rules. Null texts fail the base rule."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated passages; see suffixes.removal_digests."""
    return suffixes.removal_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five stages over documents; see corpus_pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_packing": op1_packing,
    "packing_conversations": packing_conversations,
    "op2_piece_lattice": op2_piece_lattice,
    "op3_language_crf": op3_language_crf,
    "op4_pitman_yor": op4_pitman_yor,
    "op5_partenum_join": op5_partenum_join,
    "op6_zip_warc": op6_zip_warc,
    "op7_quartile_digest": op7_quartile_digest,
    "op8_toxicity_grammar": op8_toxicity_grammar,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
}
