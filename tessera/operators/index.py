"""Building and querying the two-level index: partitioned, sorted Parquet and its catalog."""

from __future__ import annotations

import json
import time
import uuid
import zlib
from copy import copy
from dataclasses import asdict, dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut
from .opclass import IndexParams, OpClass
from .planning import fraction_of, n_partitions, plan_partitions, sample_keys
from .quad import Quad
from .tree import cell_leaves, cells
from .trie import Trie

#: The part of records outside the space, where they are kept.
OVERFLOW = -1
PARTITIONS = T.StructType(
    [
        T.StructField("part_id", T.IntegerType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("prefix", T.StringType()),
        *(T.StructField(c, T.DoubleType()) for c in ("x0", "x1", "y0", "y1")),
    ]
)

INDEXES: dict[str, type[OpClass]] = {}


def register_index(name: str, opclass: type[OpClass]) -> None:
    INDEXES[name] = opclass


register_index("Quad", Quad)
register_index("Trie", Trie)


def make_index(name: str, **params) -> OpClass:
    if name not in INDEXES:
        raise ValueError(f"no index {name}; there are {', '.join(INDEXES)}")
    return INDEXES[name](**params)


@dataclass(frozen=True)
class Names:
    """Where an index of an input lies under a root: inputs of one name in different folders have different places. Every
    build writes folders of its own; a row in `published` says which one counts."""

    root: str
    parser: str
    index: str
    source: str

    def _named(self, kind: str) -> str:
        source = self.source.rstrip("/")
        return f"{self.root.rstrip('/')}/{kind}-{self.parser}-{self.index}-{source.rsplit('/', 1)[-1]}-{zlib.crc32(source.encode()):08x}"

    @property
    def published(self) -> str:
        return f"{self._named('Global')}/published"

    def local(self, version: str) -> str:
        return f"{self._named('Local')}/{version}"

    def catalog(self, version: str) -> str:
        return f"{self._named('Global')}/{version}"


def with_part(records: DataFrame, opclass: OpClass, parts: list[str], outside: str = "raise") -> DataFrame:
    """records with part_id: one generated expression over the key. outside: 'raise' fails the query on a key outside
    the space, 'overflow' keeps such records in part OVERFLOW."""
    if outside == "overflow":
        bad = F.lit(OVERFLOW)
    elif outside == "raise":
        bad = F.raise_error(F.concat_ws(" ", F.lit("key outside the index's space:"), *(F.col(k).cast("string") for k in opclass.keys))).cast("int")
    else:
        raise ValueError(f"outside is raise or overflow, not {outside}")
    chosen = opclass.choose({p: i for i, p in enumerate(parts)}) if parts != [""] else F.lit(0)
    return records.withColumn("part_id", F.when(opclass.valid(), chosen).otherwise(bad).cast("int"))


def build_index(
    records: DataFrame, opclass: OpClass, names: Names, percent: float | None = None, parts: int | None = None, total_bytes: int | None = None, block_bytes: int = 128 << 20, seed: int = 42, outside: str = "raise"
) -> "IndexedTable":
    """Samples keys, plans parts, and writes records (the key's columns, id and path) by part, sorted by path.

    parts, or total_bytes of input, give the number of parts. Rows are dealt to writers by range of (part, path), so a
    heavy part goes to several of them and each writes few files; sorted files let Parquet's statistics skip. The
    catalog has for each part its cell, its records and its least and greatest keys, for each leaf its records and
    bytes, and the index's parameters. All is written to new folders and published last, by one row: until then, and
    if a build fails, readers have the index before."""
    spark, version = records.sparkSession, f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    n = parts or n_partitions(total_bytes or 0, block_bytes, opclass.params.fanout)
    planned = plan_partitions(cut(sample_keys(records, opclass, fraction_of(percent), seed)), opclass, n)
    paths = [p for p, _ in planned]
    depth, local, catalog = opclass.params.resolution, names.local(version), names.catalog(version)
    placed = with_part(records.withColumn("path", F.coalesce(opclass.path(depth), F.lit(""))), opclass, paths, outside)
    writers = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ("part_id", "path", *opclass.keys)
    placed.repartitionByRange(writers, *order).sortWithinPartitions(*order).write.partitionBy("part_id").parquet(local)
    stored = spark.read.schema(placed.schema).parquet(local)
    ends = [f(k).alias(f"{k}_{name}") for k in opclass.keys for name, f in (("least", F.min), ("most", F.max))]
    held = stored.groupBy("part_id").agg(F.count("*").alias("n"), *ends)
    regions = spark.createDataFrame([(i, len(p), *(opclass.region(p)[c] for c in ("prefix", "x0", "x1", "y0", "y1"))) for i, p in enumerate(paths)], PARTITIONS)
    found = regions.join(held, "part_id", "full").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    found.coalesce(1).write.parquet(f"{catalog}/partitions")
    part_leaves(stored, opclass, regions).write.parquet(f"{catalog}/leaves")
    settings = {"index": type(opclass).__name__, "space": json.dumps(opclass.space()), "params": json.dumps(asdict(opclass.params)), "keys": ",".join(opclass.keys), "schema": placed.schema.json(), "source": names.source}
    spark.createDataFrame([(settings,)], "settings map<string,string>").coalesce(1).write.parquet(f"{catalog}/metadata")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(names.published)
    return IndexedTable(spark, names, opclass)


def part_leaves(stored: DataFrame, opclass: OpClass, regions: DataFrame) -> DataFrame:
    """(part_id, leaf, level, n, bytes): within each part, from its own cell on, the shortest prefixes with at most
    blocksize records, or those of the largest depth."""
    size = opclass.key_bytes().cast("long") + 8
    deep = stored.groupBy("part_id", "path").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    # one row a part of the plan, which the driver made
    top = regions.select(F.col("part_id").alias("_part"), F.col("level").alias("_top"))
    deep = cut(deep.join(F.broadcast(top), F.col("part_id") == F.col("_part"), "left").withColumn("_top", F.coalesce("_top", F.lit(0))).drop("_part"))
    if opclass.params.path_shrink == "NEVER":
        each = deep.withColumn("leaf", F.col("path"))
    else:
        inside = deep.where(F.col("part_id") != OVERFLOW)
        each = cell_leaves(inside, opclass, first=F.col("_top")).unionByName(deep.where(F.col("part_id") == OVERFLOW).withColumn("leaf", F.lit("")))
    return each.groupBy("part_id", "leaf").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("part_id", "leaf", F.length("leaf").alias("level"), "n", "bytes")


class IndexedTable:
    """An index on disk, as it was published last when this was made. It's opened with its stored parameters; an index
    family or a space other than those it was built with is refused. Queries prune parts by the keys that they hold,
    then files and row groups by Parquet's statistics on path and key, and always test the key itself, so an answer
    never depends on how the space was divided."""

    def __init__(self, spark: SparkSession, names: Names, opclass: OpClass | None = None):
        self.spark, self.names = spark, names
        self.version = spark.read.schema("version string").parquet(names.published).agg(F.max("version")).first()[0]
        stored = self.settings
        if opclass is None:
            space = json.loads(stored["space"])
            opclass = make_index(names.index)
            if opclass.space() != space:
                raise ValueError(f"give the index family: this index was built over {space}")
        if (type(opclass).__name__, opclass.space()) != (stored["index"], json.loads(stored["space"])):
            raise ValueError(f"built as {stored['index']} over {stored['space']}, opened as {type(opclass).__name__} over {opclass.space()}")
        self.opclass = copy(opclass)
        self.opclass.params = IndexParams(**json.loads(stored["params"]))

    @property
    def catalog(self) -> str:
        return self.names.catalog(self.version)

    @property
    def partitions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.catalog}/partitions")

    @property
    def leaves(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.catalog}/leaves")

    @cached_property
    def settings(self) -> dict[str, str]:
        return self.spark.read.schema("settings map<string,string>").parquet(f"{self.catalog}/metadata").first()["settings"]

    def records(self) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(self.settings["schema"]))
        return self.spark.read.schema(schema).parquet(self.names.local(self.version))

    @cached_property
    def _held(self) -> list:
        """The parts that hold records: a row a part, read once, as a version never changes."""
        return self.partitions.where("n > 0").collect()

    def _parts(self, test) -> list[int]:
        """The parts whose least and greatest keys pass a test; that of records outside the space always does."""
        keys = self.opclass.keys
        ends = lambda r, end: {k: r[f"{k}_{end}"] for k in keys}
        known = lambda r: r["part_id"] != OVERFLOW and all(r[f"{k}_least"] is not None for k in keys)
        return sorted(r["part_id"] for r in self._held if not known(r) or test(ends(r, "least"), ends(r, "most")))

    def qualifying(self, lo, hi) -> list[int]:
        """The parts that can hold a key of the range, by the keys that they do hold."""
        return self._parts(lambda least, most: self.opclass.may_hold(least, most, lo, hi))

    def range(self, lo, hi) -> DataFrame:
        """The records whose keys lie between two corners, or strings, in either order; the ends belong to it."""
        hit = F.col("part_id").isin(self.qualifying(lo, hi)) & self.opclass.in_range(lo, hi)
        if ranges := self.opclass.paths(lo, hi):
            hit = hit & reduce(lambda a, b: a | b, (F.col("path").between(a, b) for a, b in ranges))
        return self.records().where(hit).select("id", *self.opclass.keys)

    def leaf(self, part_id: int, leaf: str) -> DataFrame:
        """The records of one leaf of the catalog."""
        return self.records().where((F.col("part_id") == part_id) & F.col("path").startswith(leaf)).select("id", *self.opclass.keys)

    def point(self, key) -> DataFrame:
        return self.range(key, key)

    def prefix(self, start: str) -> DataFrame:
        """Of a string index, the records that start with a text."""
        from ..functions.strings import interval_may_start

        hit = self._parts(lambda least, most: interval_may_start(least["str"], most["str"], start))
        return self.records().where(F.col("part_id").isin(hit) & F.col("str").startswith(start)).select("id", "str")

    def pruning(self, lo, hi) -> dict[str, int]:
        """How many parts, and records in them, a query has to look at, of how many."""
        hit = set(self.qualifying(lo, hi))
        return {"parts": len(hit), "of_parts": len(self._held), "records": sum(r["n"] for r in self._held if r["part_id"] in hit), "of_records": sum(r["n"] for r in self._held)}


def remove_old(spark: SparkSession, names: Names, keep: int = 1) -> list[str]:
    """Removes all but the last published versions, and what builds that failed left behind; call it when no reader of
    those versions is left."""
    versions = sorted(r["version"] for r in spark.read.schema("version string").parquet(names.published).collect())
    kept, gone = set(versions[-keep:]), []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in (names.local(""), names.catalog("")):
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        for status in fs.listStatus(at) if fs.exists(at) else []:
            name = status.getPath().getName()
            if name.startswith("v") and name not in kept and name <= max(kept):
                fs.delete(status.getPath(), True)
                gone.append(name)
    return sorted(set(gone))
