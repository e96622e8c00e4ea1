"""Helpers shared by the operators: table access, stored stages, connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import stored  # noqa: F401  (the operators import it from here)

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def forget(frame: DataFrame) -> None:
    """Remove the files of a ``stored`` stage whose readers are all stored themselves; nothing may read it afterwards."""
    spark = frame.sparkSession
    folders = {path.rsplit("/", 1)[0] for path in frame.inputFiles()}
    for folder in folders:
        if not folder.rsplit("/", 1)[-1].startswith("stage-"):
            raise ValueError(f"{folder} is not a stored stage.")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Caches of the operators in this Python worker, by owner.
_CACHES: dict[str, list] = {}


def claim(owner: str, *caches) -> None:
    """Called when a task starts: registers the owner's caches and empties those of all others.

    Workers are reused by later stages, and without this every operator that ever ran would keep its words.
    """
    for other, held in _CACHES.items():
        if other != owner:
            for cache in held:
                cache.clear()
    _CACHES[owner] = list(caches)


def connected_components(edges: DataFrame, rounds: int = 60, free: bool = False) -> DataFrame:
    """Smallest reachable node of every node that occurs in ``edges(a, b)``; columns node, root.

    Alternating large-star and small-star steps: each replaces links by links to the smallest neighbour, so a chain
    of n nodes needs O(log^2 n) rounds. Both steps aggregate with ``min`` (combined before the shuffle), never a
    list of neighbours, so a node of any degree is fine. Links of null nodes and self links are ignored.
    """
    pairs = edges.select("a", "b").where("a <> b")
    links = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), free)
    state = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.distinct(), free)
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stored(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), free)
        found = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
