"""Helpers shared by the corpus operators: splits, bounded samples, shared storage, connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True where crc32 of the id as text is divisible by `folds`; a null id is held out as well."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / float(1 << 30)


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share; a folder of this session where it is unset
    (a single machine, as in tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = context.getCheckpointDir() or tempfile.mkdtemp(prefix="corpus-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, so that later reads neither compute them again nor depend on executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files, broadcasts and checkpoints of tables that are no longer needed. It does so when the
    driver collects its garbage, which a search of many small jobs would leave undone for long."""
    gc.collect()
    spark._jvm.System.gc()


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, label) of about `rows` labelled training rows, chosen by a hash of the id, all of them if there are no more.

    Held-out ids, null ids and null labels are left out; of repeated ids the greatest label counts.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    total = known.count()
    if total <= rows:
        return known
    return known.where(unit_hash(F.col("doc_id"), seed=11) < rows / total)


def components(edges: DataFrame, apart: bool = False) -> DataFrame:
    """(node, root) for the nodes of undirected `edges` (a, b); root is the smallest node that can be reached.

    With `apart`, minima are shuffled once more before they are joined back, so that the join stands alone in its stage
    and Spark can split the edges of a node that has very many.

    Alternating large-star and small-star rounds. Minima are aggregated before they are joined back, so a node with
    many neighbours is no single group, and every round is cut off by a checkpoint.
    """

    def mark(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    def own(least: DataFrame) -> DataFrame:
        # Under an expression's name the rows count as not yet placed by their key.
        return least.select(F.greatest("a", "a").alias("a"), "m") if apart else least

    # Every edge points from its greater to its smaller end.
    edges = settled(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = own(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settled(large.distinct())
        least = own(large.groupBy("a").agg(F.min("b").alias("m")))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).union(
            joined.where(F.col("b") != F.col("m")).select(F.col("b"), F.col("m"))
        )
        edges = settled(small.distinct())
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct()
    )


def with_text_columns(docs: DataFrame, fields: str, make: Callable[[], Callable[[list, dict], list[list]]], also: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with columns computed from the whole `text` (and the columns `also`), one Arrow batch at a time.

    `make` is called once in a task and returns a function from the batch's texts (and the other columns' values by
    name) to a list of values for each field. Columns of `docs` with a new one's name are replaced.
    """
    new = T.StructType.fromDDL(fields)
    docs = docs.drop(*new.names)
    names = docs.columns
    kinds = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            values = compute(batch.column("text").to_pylist(), {c: batch.column(c).to_pylist() for c in also})
            made = [pa.array(v, kinds.field(i).type) for i, v in enumerate(values)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *made], names=[*names, *new.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *new.fields]))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group, without the group's columns, from batches sorted by their first `keys` columns."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if row[:keys] != last:
                if rows:
                    yield rows
                last, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield rows
