"""A corpus pipeline of five stages; each works on the documents that the stage before it kept.

toxicity: documents scored 0.5 or more go. near_duplicates: of each group linked by five-word shingles of a
similarity of 0.8 or more the document of the least id stays. decontamination: documents that contain a benchmark item go. mixing: documents stay
as often as the mix takes them. shards: token ids are written as sorted string tables and read back.

Rows after mixing may repeat an id; each copy is an entry of its own in the shards. Null texts and empty
tables pass as the operators define. From the second stage on each begins with the
executors' heaps emptied of what the one before it left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flightloom.llm import decontamination, mixing, ngram_join, sstable, toxicity
from flightloom.llm._io import relieve, table, written

#: Words of a shingle and least similarity of near copies here; op10's own query takes 4 words and 85.
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filtered(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return ngram_join.deduplicated(docs, n=SHINGLE, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return mixing.mixed(docs)


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    relieve(spark)
    return sstable.round_trip(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("shards", write_shards),
]

#: Training, SimHash and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
