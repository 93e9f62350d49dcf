"""Tables dealt by key hash (Q24, Q25, L5, J6, I9, I15, I24): lookups, upserts and erasure that
touch only the files they must.

    <path>/part=<hash of the key, modulo PARTS>/part-...

* A lookup joins the asked keys with the table on (part, key).  The keys are the small side, so
  Spark broadcasts them and prunes the folders by their parts (dynamic partition pruning), and
  reads nothing of the others.  Beyond a broadcast's size the same join runs as a shuffle join.
* An upsert reads and rewrites only the folders that the delta's keys lie in.
* An erasure finds the files that hold a row to erase by ``_metadata.file_path`` and rewrites
  those; all others keep their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from botlens.session import drop_path, stage

PARTS = 64


def part_of(keys: list[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def write_keyed(df: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> None:
    """Write a table dealt by its key; each folder is written by the tasks that hold its part."""
    dealt = df.withColumn("part", part_of(keys, parts))
    dealt.hint("rebalance", "part").sortWithinPartitions("part", *keys).write.mode("overwrite").partitionBy("part").parquet(path)


def read_keyed(spark, path: str, schema) -> DataFrame:
    """The whole table, with its ``part``."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(ddl + ", part int").parquet(path)


def lookup(table: DataFrame, asked: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Rows of a keyed table with one of the asked keys (nulls match nothing); repeated keys count once."""
    known = asked.select(*keys).dropna().distinct().withColumn("part", part_of(keys, parts))
    # the comparison makes the keys a selection in the optimizer's eyes, so that it prunes the folders by them
    known = known.filter(F.col("part") >= 0)
    return table.join(known, ["part", *keys], "left_semi").drop("part")


def upsert(spark, path: str, schema, delta: DataFrame, keys: list[str], merge, parts: int = PARTS) -> list[int]:
    """``merge`` the touched folders' rows with ``delta`` and write these folders anew; the parts touched.

    ``merge`` takes the union and returns one row a key; keys of one part never meet those of
    another, so the folders can be merged apart from the rest.  The new rows are staged
    before the old folders go (dynamic partition overwrite): a failed run can be repeated.
    """
    delta = stage(delta.withColumn("part", part_of(keys, parts)), "keyed-delta")
    touched = sorted(r.part for r in delta.select("part").distinct().collect())       # at most ``parts`` numbers
    if not touched:
        return []
    old = read_keyed(spark, path, schema).filter(F.col("part").isin(touched))
    merged = merge(old.drop("part").unionByName(delta.drop("part"))).withColumn("part", part_of(keys, parts))
    ready = stage(merged, "keyed-merged")
    (ready.hint("rebalance", "part").sortWithinPartitions("part", *keys).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path))
    return touched


def erase(table: DataFrame, path: str, gone: DataFrame, on: list[str]) -> dict[str, int]:
    """Erase the rows of the Parquet files under ``path`` whose ``on`` columns are in ``gone``.

    Files without such a row are not opened for writing and keep their names.  The rows that stay
    of the others are written to new files in the same folders first, then the old files go; a
    run that fails in between is repeated after removing the new files, which bear its mark.
    """
    spark = table.sparkSession
    keys = stage(gone.select(*on).distinct(), "erase-keys")
    hit = table.withColumn("_file", F.col("_metadata.file_path")).join(keys, on, "left_semi")
    files = stage(hit.groupBy("_file").agg(F.count(F.lit(1)).alias("n")), "erase-files")
    rows = table.withColumn("_file", F.col("_metadata.file_path"))
    kept = rows.join(files.select("_file"), "_file", "left_semi").join(keys, on, "left_anti")
    parted = [c for c in ("event_date", "part") if c in table.columns]
    done = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if done.files:
        names = files.select("_file")
        ready = stage(kept.drop("_file"), "erase-kept")
        new = f"{path.rstrip('/')}-erase-{uuid.uuid4().hex}"
        writer = ready.hint("rebalance", *parted) if parted else ready
        writer.write.partitionBy(*parted).parquet(new) if parted else writer.write.parquet(new)
        _swap(spark, path, new, names)
    return {"files": done.files, "rows": done.rows}


def _swap(spark, path: str, new: str, names: DataFrame) -> None:
    """Move the new files beside the old ones' neighbours, then remove the old ones (names only; no data)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(new)
    fs = root.getFileSystem(conf)
    found = fs.listFiles(root, True) if fs.exists(root) else None
    base = fs.makeQualified(root).toUri().getPath()
    while found is not None and found.hasNext():
        file = found.next().getPath()
        if file.getName().endswith(".parquet"):
            inside = file.toUri().getPath()[len(base):].lstrip("/")
            target = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{inside}")
            fs.mkdirs(target.getParent())
            fs.rename(file, target)
    for row in names.toLocalIterator():              # one name at a time
        old = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(row._file))
        old.getFileSystem(conf).delete(old, False)
    drop_path(spark, new)
