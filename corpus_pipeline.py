"""A training corpus from raw documents, in five stages; each is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import materialize, read, recording, remove
from spanloom.llm.decontaminate import decontaminate
from spanloom.llm.lines import line_dedup
from spanloom.llm.mixing import mix
from spanloom.llm.quality import quality_filter
from spanloom.llm.simhash import near_dedup

#: For each folder of tables, what the stage before wrote for itself. Its result has been written when the next stage
#: begins, unless that reads these tables still.
_scratch: dict[str, list[str]] = {}


def _stage(work):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        reads = "\n".join(docs.inputFiles())
        remove(spark, [t for t in _scratch.pop(sf_dir, []) if t.rsplit("/", 1)[-1] not in reads])
        with recording() as made:
            out = work(spark, docs, sf_dir)
        _scratch[sf_dir] = made
        return out

    return stage


#: name, function of (spark, docs, sf_dir).
STAGES = [
    ("quality rules", _stage(lambda spark, docs, sf_dir: quality_filter(docs))),
    ("line dedup", _stage(lambda spark, docs, sf_dir: line_dedup(docs))),
    ("SimHash near-dedup", _stage(lambda spark, docs, sf_dir: near_dedup(docs))),
    ("benchmark decontamination", _stage(lambda spark, docs, sf_dir: decontaminate(docs, read(spark, sf_dir, "benchmark")))),
    ("mixing sources to target weights", _stage(lambda spark, docs, sf_dir: mix(docs))),
]
#: Components of near duplicates are not said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        with recording() as made:
            docs = materialize(out, name.replace(" ", "-"))
        remove(spark, [*before, *_scratch.pop(sf_dir, [])])
        before = made
    return docs
