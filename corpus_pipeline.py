"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes all rows that its predecessor kept and calls one operator:
quality rules drop rejected documents, near-duplicate groups keep their least
doc_id, contaminated documents go, secrets are replaced in the text, and what is
left is cut into sequences.
"""

from __future__ import annotations

from botlens.llm import decontam, packing, quality, secretscan, simhash
from botlens.llm.common import bounded_batches, table
from botlens.session import apply_conf, stage


def _ready(spark):
    apply_conf(spark)
    bounded_batches(spark)


def quality_rules(spark, docs, sf_dir):
    _ready(spark)
    return quality.kept(docs)


def near_duplicates(spark, docs, sf_dir):
    _ready(spark)
    return simhash.one_of_each(docs, shingle=4, distance=4)


def decontamination(spark, docs, sf_dir):
    _ready(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), size=10)


def secrets(spark, docs, sf_dir):
    _ready(spark)
    return secretscan.redacted(docs)


def pack(spark, docs, sf_dir):
    _ready(spark)
    return packing.pieces(docs, length=2048)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", pack)]

# Ids of a tokenizer and compressed sizes have no SQL; tests/llm/test_pipeline.py compares run() with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
