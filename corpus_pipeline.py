"""The corpus pipeline: documents of a known language, one of each group of near copies, free of
benchmark items, mixed to target weights, as token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written and read again, so
a later stage never recomputes an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolith.llm import storage
from chronolith.llm.decontamination import decontamination_stage
from chronolith.llm.jaccard_join import jaccard_stage
from chronolith.llm.language_id import language_stage
from chronolith.llm.mixing import mix_stage
from chronolith.llm.token_files import token_stage

STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mix_stage),
    ("token_files", token_stage),
]

#: Rank-order profiles, hash permutations and a tokenizer have no SQL form; tests/llm checks the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = storage.stage(docs, f"pipeline-{name}")
    return docs
