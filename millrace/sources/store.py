"""Owners' stores: one JSON document each, or tables of an append-only event log.

Documents that can't be read are kept apart, never taken for empty ones. A save is a version folder of
its own that gets its number when it is whole; changed tables are derived from the log anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.shared import file_at, removed

#: Fields of each collection in a document.
COLLECTIONS = {
    "facts": "fact string, category string, added string",
    "priorities": "context string, higher string, lower string, confidence double, evidence int, updated string",
    "goals": "goal string, added string, active boolean",
    "corrections": "context string, suggested string, chosen string, inferred string, added string, ts double",
    "actions": "category string, description string, amount double, outcome string, added string, ts double",
    "observations": "note string, category string, added string, ts double",
    "opportunities": "what string, value_estimate string, aligns_with string, advances_goal string, reduces_risk boolean, urgency double, score double, status string, resolved boolean, outcome string, added string, ts double",
}
PERMISSION = "struct<level:string,cap:double,updated:string>"
DOCUMENT = "owner string, " + ", ".join(f"{n} array<struct<{','.join(':'.join(f.split()) for f in s.split(', '))}>>" for n, s in COLLECTIONS.items()) + f", permissions map<string,{PERMISSION}>, profile map<string,string>"
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ssZ"


def parsed_documents(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of texts (store_path, text) the readable documents (store_path, document fields), and the others as they are."""
    parsed = texts.withColumn("d", F.from_json("text", f"{DOCUMENT}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("d").isNull() | F.col("d._corrupt").isNotNull()
    return parsed.where(~bad).select("store_path", "d.*").drop("_corrupt"), parsed.where(bad).select("store_path", "text")


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The same of files with a JSON document each; a file's path is the document's."""
    return parsed_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("store_path"), F.col("value").alias("text")))


def collection(documents: DataFrame, name: str) -> DataFrame:
    """A collection as rows with owner_id (the document's path) and seq, the position in the document."""
    rows = documents.select(F.col("store_path").alias("owner_id"), F.posexplode(name).alias("seq", "x"))
    return rows.select("owner_id", F.col("seq").cast("long").alias("seq"), "x.*")


def permissions(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("store_path").alias("owner_id"), F.explode("permissions").alias("category", "x")).select("owner_id", "category", "x.level", "x.cap")


def profile_fields(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("store_path").alias("owner_id"), F.explode("profile").alias("field", "value"))


class SaveConflict(RuntimeError):
    """Another save came first."""


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the last version saved at `path`; 0 is none."""
    files, at = file_at(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return max((int(n[2:]) for n in names if n.startswith("v-")), default=0)


def numbered(spark: SparkSession, new: str, path: str, version: int) -> bool:
    """The new folder becomes that version, unless there is one: a rename that never replaces, so one writer alone gets the number."""
    jvm, to = spark.sparkContext._jvm, f"{path}/v-{version:012d}"
    (files, source), (_, target) = file_at(spark, f"{path}/{new}"), file_at(spark, to)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    # Some stores move into a folder that came up in the meantime; its readers don't see names that begin with a line.
    nested = f"{to}/{new}"
    if files.exists(file_at(spark, nested)[1]):
        removed(spark, nested)
        return False
    return True


def write_documents(documents: DataFrame, path: str, made_from: int | None = None) -> int:
    """Documents as JSON lines, one an owner, saved as the version after `made_from`; its number.

    `made_from` is the version that the documents were made from (`current_version`), 0 for none: if another save
    has come since, SaveConflict is raised and nothing changes. Without it this save comes after whatever is there. Readers see the
    former version until the new one is whole. Former versions stay. The store's rename has to be atomic, as HDFS's and POSIX's are.
    """
    spark, new = documents.sparkSession, f"_new-{uuid.uuid4().hex}"
    if made_from is not None and current_version(spark, path) != made_from:
        raise SaveConflict(f"{path} is no longer at version {made_from}")
    documents.write.json(f"{path}/{new}")
    while True:
        version = (current_version(spark, path) if made_from is None else made_from) + 1
        if numbered(spark, new, path, version):
            return version
        if made_from is not None:
            removed(spark, f"{path}/{new}")
            raise SaveConflict(f"{path} is no longer at version {made_from}")


def update_documents(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
    """What `change` makes of the saved documents, saved in turn; made anew from the newer version where another save came first."""
    for left in reversed(range(tries)):
        version = current_version(spark, path)
        try:
            return write_documents(change(read_saved(spark, path, version)).drop("store_path"), path, version)
        except SaveConflict:
            if not left:
                raise
    raise ValueError("tries must be positive")


def read_saved(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The documents of a version, by default the last; `owner` stands for the document's path. Version 0 is empty."""
    version = current_version(spark, path) if version is None else version
    rows = spark.read.schema(DOCUMENT).json(f"{path}/v-{version:012d}") if version else spark.createDataFrame([], DOCUMENT)
    return rows.withColumn("store_path", F.col("owner"))


def append_events(events: DataFrame, path: str, partition: str | None = None) -> None:
    """Events added to the log; the log's files are never rewritten."""
    writer = events.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def read_events(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def stored_times(df: DataFrame, *columns: str) -> DataFrame:
    """ISO times with a numeric offset as timestamps."""
    return reduce(lambda d, c: d.withColumn(c, F.try_to_timestamp(F.col(c), F.lit(TIMESTAMP))), columns, df)


def remember_line(facts: DataFrame, fact: str) -> DataFrame:
    """A plain memory (fact) with one fact more, unless exactly that is there."""
    new = facts.sparkSession.createDataFrame([(fact,)], "fact string")
    return facts.unionByName(new.join(facts, "fact", "left_anti"))
