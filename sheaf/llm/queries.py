"""Registered queries of the training-data operators, one ``opN_<name>`` each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import arc, collinear_chains, column_bwt, cross_parsing, host_quality, maxent_lm, packing, piece_encoding, prefix_trie, ranked_search, simhash_vptree, template_decontamination, url_templates
from sheaf.llm.shared import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


URL_RULES = [url_templates.Rule("block", "net", "/"), url_templates.Rule("allow", "example.net", "/en/"),
             url_templates.Rule("block", "example.com", "/de/"), url_templates.Rule("allow", "org", "/fr/")]


@query("op1_url_templates")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page url by the rules, else by its host's template tree."""
    return url_templates.judge(read(spark, sf_dir, "pages"), URL_RULES)


SQL["op1_url_templates"] = url_templates.sql(URL_RULES)


@query("op2_cross_parsing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled ones that are not held out."""
    return cross_parsing.predict(read(spark, sf_dir, "documents"))


@query("op3_bounded_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    pieces = packing.pack(read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset", "sequence_tokens")


@query("op4_host_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document by its own rules and its host's."""
    return host_quality.judge(read(spark, sf_dir, "documents"))


SQL["op4_host_quality"] = host_quality.SQL


@query("op5_arc_to_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as ARC files, converted to WARC files and read back; one row for each page's record."""
    legacy, archives = new_path(spark, "arc"), new_path(spark, "warc")
    arc.write_arc(read(spark, sf_dir, "pages"), legacy)
    arc.convert(spark, legacy, archives)
    records = arc.read_warc(spark, archives).filter(F.col("record_type").isin("response", "revisit"))
    return records.select(F.col("source_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op5_arc_to_warc"] = arc.SQL


@query("op6_simhash_vptree")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over fingerprints of 4-word shingles at 4 or fewer differing bits."""
    return simhash_vptree.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@query("op7_template_decontamination")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a re-parameterised one, with the item."""
    found = template_decontamination.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("__key")


SQL["op7_template_decontamination"] = template_decontamination.SQL


@query("op8_collinear_chains")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, at a similarity of 0.8 or more, that an earlier document holds too."""
    return collinear_chains.passages(read(spark, sf_dir, "documents")).drop("__ref")


@query("op9_maxent_lm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every document by a unigram base and the maximum-entropy model."""
    return maxent_lm.score(read(spark, sf_dir, "documents"))


@query("op10_column_bwt")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 400-byte strings that start elsewhere too."""
    left = column_bwt.remove(read(spark, sf_dir, "documents"), length=400)
    return left.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_ranked_search")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for each benchmark item."""
    return ranked_search.search(read(spark, sf_dir, "benchmark"), ranked_search.index(read(spark, sf_dir, "documents")))


SQL["op11_ranked_search"] = ranked_search.SQL


@query("op12_piece_encoding")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the ids of a merge-type model, and decoded again."""
    return piece_encoding.digests(read(spark, sf_dir, "documents"))


@query("op13_prefix_trie")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie.branched_trie(read(spark, sf_dir, "conversations"))


SQL["op13_prefix_trie"] = prefix_trie.SQL
