"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

1. toxicity: documents that the classifier rejects go;
2. exact_dedup: of equal texts the row with the smallest doc_id stays;
3. near_dedup: the n-gram Jaccard join (five words, 0.8); of each group one document stays;
4. decontaminate: documents that hold a benchmark passage go;
5. mix: the rest is mixed to target weights; returns the mix's table.

Edge cases: null texts count as empty (kept as one document by stage 2); rows
whose id is null or repeated are decided on one by one, of equal ones any stays;
an empty table stays empty; further columns are carried along, whatever their
names, to the last stage, which returns the mix's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, exact_dedup, jaccard_join, mixing, toxicity
from tilewright.llm.common import cut, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_civil(docs, model)


def unused(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_ids(docs: DataFrame) -> DataFrame | None:
    """The ids, as ``id``, that name no single row: the repeated ones and null; None if there are none."""
    ids = cut(docs.groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or id is null").select("id"))
    return None if ids.isEmpty() else ids


def with_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs`` whose doc_id, null included, is (left_anti: is not) among ``ids``."""
    return docs.alias("docs").join(ids.alias("ids"), F.col("docs.doc_id").eqNullSafe(F.col("ids.id")), how)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = exact_dedup.exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"))
    shared = shared_ids(docs)
    if shared is None:
        return with_ids(docs, kept)
    own = unused(docs, "_sha")
    several = with_ids(docs, shared).withColumn(own, F.sha2(exact_dedup.normalised().cast("binary"), 256)).alias("docs")
    same = F.col("docs.doc_id").eqNullSafe(F.col("ids.id")) & (F.col(f"docs.{own}") == F.col("ids.sha"))
    stay = several.join(kept.distinct().alias("ids"), same, "left_semi")
    return with_ids(with_ids(docs, shared, "left_anti"), kept).unionByName(stay.dropDuplicates(["doc_id", own]).drop(own))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def kept(rows: DataFrame) -> DataFrame:
        joined = jaccard_join.join(rows, words=5, percent=80)
        return joined.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("id"))

    shared = shared_ids(docs)
    if shared is None:
        return with_ids(docs, kept(docs))
    # rows without an id of their own get a number that no row has as its id
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    number = F.monotonically_increasing_id()
    number = number + F.lit((most or 0) + 1) if (most or 0) < 1 << 60 else F.lit(least - 1) - number
    row = unused(docs, "_row")
    several = cut(with_ids(docs, shared).withColumn(row, number))
    rows = with_ids(docs, shared, "left_anti").withColumn(row, F.col("doc_id").cast("long")).unionByName(several)
    stay = kept(rows.select(F.col(row).alias("doc_id"), "text"))
    return rows.alias("docs").join(stay.alias("ids"), F.col(f"docs.{row}") == F.col("ids.id"), "left_semi").drop(row)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
]

#: A trained classifier and an LSH search decide; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
