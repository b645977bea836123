"""Documents to a tokenised training mix, stage by stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from planisphere.llm.bpe import bpe_encode
from planisphere.llm.mixing import take
from planisphere.llm.quality import fit, keep_good
from planisphere.llm.queries import tokenizer
from planisphere.llm.simhash import keep_one
from planisphere.llm.suffix import keep_new
from planisphere.session import cut


def quality(spark, docs, sf_dir):
    """Documents that the hierarchical Bayes classifier finds good; host: the source, path: the language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, fit(docs, labels), F.col("source"), F.col("lang"))


def near_copies(spark, docs, sf_dir):
    """One document of each group of SimHash near-duplicates: three-word shingles, up to three bits."""
    return keep_one(docs, width=3, radius=3)


def repeats(spark, docs, sf_dir):
    """Strings of 50 bytes and more that documents before have go."""
    return keep_new(docs, span=50)


def mixing(spark, docs, sf_dir):
    """Each document as often as the mix of 1.5 times all words takes it, no source above two epochs."""
    return take(docs, weights=(5.0, 2.0, 1.0), budget=1.5, max_epochs=2.0, seed=42)


def tokens(spark, docs, sf_dir):
    """Ids of each text taken, and a digest of what they decode to."""
    coded = bpe_encode(docs, tokenizer("word_bpe_49k.json"), decode=True)
    return coded.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_copies", near_copies), ("repeats", repeats), ("mixing", mixing), ("tokens", tokens)]
#: The classifier, the fingerprints and the suffix arrays are not expressible in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
