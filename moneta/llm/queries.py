"""The registered queries of this subpackage: thin digests of the operators' results."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moneta.llm.common import read


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: keys of 40 code points in 5 documents."""
    from moneta.llm.line_dedup import dedup_lines
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of all documents; a value with three sources is an example."""
    from moneta.llm.secret_scan import KINDS, joined, scan_secrets
    out = scan_secrets(read(spark, sf_dir, "documents"), min_owners=3)

    def of(kind: int):
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("live"))
    return out.select(
        "doc_id", *[F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["example"])).cast("long").alias("n_example"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents covered by windows of 10 words of the benchmark."""
    from moneta.llm.decontam import decontaminate
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), length=10, k=5)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents: Jaccard 0.75 on 5-word shingles."""
    from moneta.llm.minhash import near_duplicates
    return near_duplicates(read(spark, sf_dir, "documents"), percent=75)


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words in all documents that a smaller doc_id has too."""
    from moneta.llm.substring import dedup_substrings
    return dedup_substrings(read(spark, sf_dir, "documents"), length=50).drop("kept")


def op7_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95; codebooks are fitted on 4096 vectors."""
    from moneta.llm.embed import near_embeddings
    return near_embeddings(read(spark, sf_dir, "embeddings"), cosine=0.95)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages; weights are learned from 1000 labelled pages."""
    from moneta.llm.html_extract import extract_pages
    return extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    import public_tokenizers
    from moneta.llm.packing import pack_documents
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents; learned from at most 8000 labelled rows outside the held-out fold."""
    from moneta.llm.toxicity import score_toxicity
    out = score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"), fold=5, held=0)
    return out.select("doc_id", "held_out", "score", "predicted")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from at most 2000 labelled rows outside the held-out fold."""
    from moneta.llm.langid import identify
    out = identify(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold=4, held=2)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings: 8 parts, 16 entries each, 6 rounds."""
    from moneta.llm.vector_codes import compress_vectors
    out, _ = compress_vectors(read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five text filters in every order, over all documents by source."""
    from moneta.llm.filter_audit import audit_filters
    return audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), part="source")


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes in all documents that start anywhere else too."""
    from moneta.llm.suffix_dedup import dedup_repeats
    out = dedup_repeats(read(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_suffix_dedup": op13_suffix_dedup,
    "op2_langid": op2_langid,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op8_html": op8_html,
    "op7_embedding": op7_embedding,
    "op1_line_dedup": op1_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_decontam": op4_decontam,
    "op9_minhash": op9_minhash,
    "op10_substring": op10_substring,
}
