"""From raw documents to packed sequences: each stage reads what the one before it wrote.

Quality classifier (documents that it rejects go), MinHash near duplicates (one document of each group stays), personal
data (values are replaced in the texts), best-fit packing (the texts become pieces in sequences).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pricewright.llm import minhash, packing, pii, quality
from pricewright.llm.common import Scratch, on_executors, read_local


def quality_stage(spark, docs, sf_dir):
    """The rows in the sample; null and empty texts weigh nothing, and without good labels all rows stay."""
    on_executors(spark)
    return quality.keep_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark, docs, sf_dir):
    """One row of each class, that of the least id; null and empty texts are copies of each other, of equal rows one stays."""
    on_executors(spark)
    return minhash.keep_one(docs)


def pii_stage(spark, docs, sf_dir):
    """n_chars follows the text; a null text stays null. The session's ``spark.pricewright.pii.key`` is the key, else the one for demonstrations."""
    changed = pii.pseudonymize(docs, spark.conf.get(pii.KEY_SETTING, pii.DEMO_KEY))
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark, docs, sf_dir):
    """Pieces of all documents and their places in sequences; a null text is empty, so its end id alone is packed."""
    import public_tokenizers

    on_executors(spark)
    return packing.pack_documents(docs, read_local(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: None of the stages can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Pieces of what is kept of documents and their places; a stage's table goes when the next one's is written."""
    docs, scratch, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
