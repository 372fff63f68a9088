"""A workspace of a `versions.Store` as a folder that can go elsewhere, and back into a store in one commit.

The folder has a table each as gzipped JSON lines, vectors included, and last a manifest: workspace, version, and each table's schema, number of rows and
digest (`governance.bundle_digest`). An import checks the manifest's names and every digest before it writes anything, gives documents and chunks ids of
their own in the target, leaves out documents whose content the target has, and commits the rest with its audit row.

Defined cases: a folder without manifest, with a name that leads out of it, or with rows that don't have their digest raises `TransferRefused`; a second import
of one folder adds nothing; copies of one content within a folder come in once; a workspace without documents can't be exported.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.errors import QuillError
from quillspark.operators.governance import bundle_digest
from quillspark.operators.records import hold_key
from quillspark.operators.versions import CHAINED, Store

FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "compression": "gzip"}
NAME = re.compile(r"[a-z][a-z0-9_]*")


class TransferRefused(QuillError, ValueError):
    """A folder that isn't a whole export."""


def _file(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where  # noqa: SLF001


def export_workspace(store: Store, workspace: str, path: str) -> dict:
    """Writes documents of a workspace and all rows of their keys; returns the manifest."""
    spark, version = store.spark, store.version()
    documents = store.read("documents", version).where(F.col("workspace") == workspace)
    if documents.isEmpty():
        raise QuillError(f"no documents in {workspace}")
    tables = {}
    for name in sorted(set(version.folders) - {CHAINED, "holds"}):
        rows = documents if name == "documents" else store.read(name, version).join(documents.select(store.key).distinct(), store.key, "left_semi")
        rows.write.options(**FORMAT).option("ignoreNullFields", "false").json(f"{path}/{name}")
        written = _read(spark, path, name, rows.schema)
        tables[name] = {"schema": rows.schema.jsonValue(), **bundle_digest(written).first().asDict()}
    manifest = {"schema_version": "1.0", "workspace": workspace, "version": version.number, "key": store.key, "tables": tables}
    fs, where = _file(spark, f"{path}/manifest.json")
    out = fs.create(where, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    return manifest


def _read(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).options(**FORMAT).json(f"{path}/{name}")


def checked(spark: SparkSession, path: str) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest of a folder and its tables, once all names and digests are right."""
    fs, where = _file(spark, f"{path}/manifest.json")
    if not fs.exists(where):
        raise TransferRefused(f"no manifest in {path}")
    stream = fs.open(where)
    try:
        manifest = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))  # noqa: SLF001
    finally:
        stream.close()
    tables = {}
    for name, told in manifest["tables"].items():
        if not NAME.fullmatch(name):
            raise TransferRefused(f"{name!r} is no name of a table")
        if name in (CHAINED, "holds"):
            raise TransferRefused(f"{name} can't be imported")
        fs, where = _file(spark, f"{path}/{name}")
        if not fs.exists(where):
            raise TransferRefused(f"{name} is missing")
        tables[name] = _read(spark, path, name, StructType.fromJson(told["schema"]))
        found = bundle_digest(tables[name]).first().asDict()
        if found != {k: told[k] for k in ("n_rows", "digest")}:
            raise TransferRefused(f"{name} isn't what the manifest says")
    if "documents" not in tables:
        raise TransferRefused("documents are missing")
    return manifest, tables


def import_workspace(store: Store, path: str, actor: str, target: str | None = None) -> dict[str, int]:
    """Adds an exported workspace to a store, as ``target`` or under its own name; returns how many documents came in and how many were left out."""
    spark, version = store.spark, store.version()
    manifest, tables = checked(spark, path)
    target, key = target or manifest["workspace"], manifest["key"]
    documents = tables["documents"].dropDuplicates(["file_hash"])
    known = store.read("documents", version, documents.schema).where(F.col("workspace") == target)
    new = documents.join(known.select("file_hash").distinct(), "file_hash", "left_anti")
    ids = new.select(F.col(key).alias("_old"), F.xxhash64(F.lit(target), F.col(key).cast("string"), "file_hash").alias("_new"))
    out = {}
    for name, rows in tables.items():
        named = rows.join(ids, F.col(key) == F.col("_old")).drop("_old", key).withColumnRenamed("_new", store.key)
        if name == "documents":
            named = named.dropDuplicates([store.key])
        if "workspace" in named.columns:
            named = named.withColumn("workspace", F.lit(target))
        if "chunk_id" in named.columns:
            named = named.withColumn("chunk_id", F.xxhash64(store.key, "chunk_id"))
        out[name] = named
    n = new.count()
    if n:
        told = [F.lit(x).alias(c) for c, x in (("action", "import"), ("workspace", target), ("actor", actor), ("detail", f"{n} documents"))]
        audit = hold_key(store, target).select(F.col(store.key), *told, F.current_timestamp().alias("at"))
        store.add({**out, CHAINED: audit})
    return {"imported": n, "left_out": tables["documents"].count() - n}
