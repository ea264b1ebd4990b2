"""The corpus pipeline: documents through five stages, each written as Parquet
and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from custlens.llm import minhash, mixing, packing, quality, queries, secrets
from custlens.llm.shared import write_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark, docs, sf_dir):
    """Rejected documents go."""
    return quality.judge(docs).where(F.col("rejected_by").isNull()).select(*COLUMNS)


def near_dedup(spark, docs, sf_dir):
    """The smallest document of each near-duplicate group stays, once; documents without words all stay."""
    return minhash.survivors(docs).select(*COLUMNS)


def secret_scan(spark, docs, sf_dir):
    """Every document stays; secrets in its text give way to a mark."""
    clean = secrets.redact(F.col("text"), F.col("spans"))
    return (secrets.scan(docs).withColumn("text", clean)
            .withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
            .select(*COLUMNS))


def source_mix(spark, docs, sf_dir):
    """Each document as often as the mix takes it."""
    _, plan = mixing.solve(docs)
    return (mixing.take(mixing.sizes(docs), plan)
            .withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS))


def best_fit_packing(spark, docs, sf_dir):
    """Token sequences of the mix."""
    return packing.pack(docs, public_tokenizers.path(queries.TOKENIZER))


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("secret_scan", secret_scan),
          ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]

#: The tokenizer, the near-duplicate search and the mix have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
