"""The corpus pipeline: stages that each read what the one before them has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskforge.llm.bpe import stage_bpe
from maskforge.llm.common import table, written
from maskforge.llm.decontaminate import stage_decontaminate
from maskforge.llm.line_dedup import stage_line_dedup
from maskforge.llm.near_dedup import stage_near_dedup
from maskforge.llm.toxicity import stage_toxicity

#: All but the last return the columns of ``documents``; the last adds ids and n_tokens.
STAGES = [
    ("toxicity", stage_toxicity),
    ("line_dedup", stage_line_dedup),
    ("near_dedup", stage_near_dedup),
    ("decontaminate", stage_decontaminate),
    ("bpe", stage_bpe),
]

#: A trained classifier decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
