"""From raw documents to a training mix, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame, which is written and read again as the next one's docs.
All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontam, langid, mixing, neardup, substrings
from millrace.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labels. Null texts, texts without letters and those that the nearest
    language codes no better than single bytes go."""
    return langid.in_known_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity of 0.8 over five-word shingles), that with the smallest id."""
    return neardup.drop_near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that an earlier document has are cut out; n_chars follows."""
    return substrings.drop_repeats(docs, n_chars="n_chars")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, with the number of the copy."""
    return mixing.mix(docs)


STAGES = [
    ("identify_language", identify_language),
    ("drop_near_duplicates", drop_near_duplicates),
    ("drop_repeated_passages", drop_repeated_passages),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: SQL cannot express the trained, hashed and aligned stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of ``documents``. Stages hand over Parquet in the shared folder, removed when the session's program ends."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    atexit.register(_clean, scratch)
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def _clean(scratch: Scratch) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        scratch.__exit__()
