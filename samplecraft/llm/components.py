"""Connected components of a link table by label propagation with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .joins import join_counted


#: largest Arrow batch of a stored table's Python stages, unless the session states its own
ARROW_BYTES = 4 << 20
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``ARROW_BYTES`` for the jobs inside; a session that sets a size of its own keeps it."""
    own = _ARROW_CONF in spark.conf.getAll
    if not own:
        spark.conf.set(_ARROW_CONF, str(ARROW_BYTES))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(_ARROW_CONF)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: short lineage, computed once."""
    path = scratch_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once nothing reads them any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); ``comp`` is the smallest node it reaches.

    Each round takes the smallest label among the neighbours and then the
    label's own label, so a path of length n needs about log n rounds.  Rows of a
    node with very many neighbours, and of a label that very many nodes have,
    stay where they are: ``join_counted`` brings them the other side.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "links")
    first = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    labels = stored(first.select(F.col("a").alias("node"), F.least("a", "m").alias("comp"), "degree"), "labels")
    n_links, n_nodes = both.count(), labels.count()
    while True:
        near = (join_counted(both, labels.select(F.col("node").alias("b"), "comp", "degree"), "b", "degree", n_links, "inner")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        low = stored(labels.join(near, "node", "left").select("node", F.col("comp").alias("old"),
                                                              F.least("comp", "m").alias("comp"), "degree"), "labels")
        # the label of a label is a node too: jump to its smallest neighbour's label
        jumps = (low.select(F.col("node").alias("comp"), F.col("comp").alias("next")).filter("comp <> next")
                 .join(low.groupBy("comp").agg(F.count(F.lit(1)).alias("k")), "comp"))
        new = stored(join_counted(low, jumps, "comp", "k", n_nodes).select(
            "node", F.least("comp", F.coalesce("next", "comp")).alias("comp"), "degree", "old"), "labels")
        forget(labels, low)
        labels = new.drop("old")
        if not new.filter("old <> comp").limit(1).count():
            forget(both)
            return labels.drop("degree")
