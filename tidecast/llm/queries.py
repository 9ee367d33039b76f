"""The registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import decontaminate, licenses, merkle, mixing, packing, prefixes, quality, sharding, simhash, toxicity, urls, variants, wrappers
from tidecast.llm.common import table, unsigned_hex

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents: 4-word shingles, at most 4 differing bits."""
    found = simhash.classes(table(spark, folder, "documents"))
    return found.select("doc_id", unsigned_hex("fp").alias("fingerprint"), "component_id")


def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint against those of an edited text and of the next document."""
    return prefixes.with_edited(table(spark, folder, "documents"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold copies of benchmark items, with score and place."""
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_toxicity_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Chain probabilities of every document and whether it is rejected as toxic."""
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op5_shard_placement(spark: SparkSession, folder: str) -> DataFrame:
    """The slot and shard of every document."""
    return sharding.place(table(spark, folder, "documents")).select("doc_id", "slot", "shard")


def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page by its host's wrapper."""
    return wrappers.extract(table(spark, folder, "pages"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every page by the rules or its host's trust and distrust."""
    found = urls.judge(table(spark, folder, "pages"))
    return found.withColumns({c: F.round(c, 4) for c in ("trust", "distrust")})


def op8_hierarchical_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into windows of 1024 tokens and shorter tiers, with their step groups."""
    return packing.step_groups(packing.pack(table(spark, folder, "documents"), tokenizer_path()))


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """License labels of every document."""
    return licenses.summary(licenses.scan(table(spark, folder, "documents")))


def op10_quality_perplexity(spark: SparkSession, folder: str) -> DataFrame:
    """Perplexity of every document under the model of trusted text, the limit of its language and the verdict."""
    scores, limits, _ = quality.judged(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return quality.decide(scores, limits)


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's leaf, roots and proof, and the root that folding finds after a third of the texts lost their capitals."""
    return merkle.with_tampered(table(spark, folder, "documents"))


def op12_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document a mixture of 150 % of all words takes, the sources weighing 5, 2, 1 in turn."""
    return mixing.taken(table(spark, folder, "documents")).drop("source")


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word of all documents, some spelled wrong, with its more frequent form and the root of its group."""
    return variants.groups(variants.word_counts(table(spark, folder, "documents"), variants.with_slips))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_decontamination": op3_decontamination,
    "op4_toxicity_chain": op4_toxicity_chain,
    "op5_shard_placement": op5_shard_placement,
    "op6_html_extraction": op6_html_extraction,
    "op7_url_filter": op7_url_filter,
    "op8_hierarchical_packing": op8_hierarchical_packing,
    "op9_license_scan": op9_license_scan,
    "op10_quality_perplexity": op10_quality_perplexity,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_mixing": op12_source_mixing,
    "op13_spelling_variants": op13_spelling_variants,
}
ORACLE = {
    "op5_shard_placement": sharding.ORACLE_PLACE,
    "op7_url_filter": urls.ORACLE_JUDGE,
    "op11_merkle_manifest": merkle.ORACLE_TAMPERED,
    "op13_spelling_variants": variants.ORACLE_SLIPS,
}
