"""Import, dump and restore: CSV, JSON and Parquet folders, or zip files of them, with a manifest."""

from __future__ import annotations

import json
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.sources.catalog import Catalog, Entity

BATCH = 50_000


def read(spark: SparkSession, path: str, form: str, schema: T.StructType) -> DataFrame:
    """A file or folder in the entity's declared schema; CSV holds vectors as JSON text, binary as base64."""
    if form == "parquet":
        return spark.read.schema(schema).parquet(path)
    if form == "json":
        return spark.read.schema(schema).option("allowNonNumericNumbers", "true").json(path)
    if form != "csv":
        raise ValueError(f"no format {form}")
    nested = {f.name for f in schema if isinstance(f.dataType, T.ArrayType | T.StructType)}
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested or isinstance(f.dataType, T.BinaryType) else f.dataType) for f in schema])
    df = spark.read.schema(raw).option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    return df.select(*(F.from_json(f.name, f.dataType.simpleString()).alias(f.name) if f.name in nested else F.unbase64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in schema))


def write(df: DataFrame, path: str, form: str) -> None:
    if form == "csv":
        df = df.select(*(F.to_json(f.name).alias(f.name) if isinstance(f.dataType, T.ArrayType | T.StructType) else F.base64(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name) for f in df.schema))
    writer = df.write.option("maxRecordsPerFile", BATCH)
    {"parquet": writer.parquet, "json": writer.option("ignoreNullFields", "false").json, "csv": writer.option("header", "true").option("escape", '"').csv}[form](path)


def load(entity: Entity, path: str, form: str) -> Entity:
    """Import a file into an entity as one new version."""
    return entity.insert(read(entity.catalog.spark, path, form, T.StructType([T.StructField(f.name, f.dataType) for f in entity.schema])))


def dump(entity: Entity, path: str, form: str = "json") -> None:
    """Write batches and a manifest from which ``restore`` can recreate the entity; a path that ends in .zip becomes one file."""
    if path.endswith(".zip"):
        folder = f"{path}-{uuid.uuid4().hex}"
        try:
            dump(entity, folder, form)
            _zip(entity.catalog, folder, path)
        finally:
            _fs(entity.catalog, folder)[0].delete(_fs(entity.catalog, folder)[1], True)
        return
    write(entity.frame().drop("_tid"), f"{path}/data", form)
    manifest = {"entity": entity.name, "format": form, "schema": entity.meta["schema"], "rows": entity.meta["rows"]}
    entity.catalog.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def _fs(catalog: Catalog, path: str):
    where = catalog.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(catalog.spark.sparkContext._jsc.hadoopConfiguration()), where


def _zip(catalog: Catalog, folder: str, path: str) -> None:
    """Copy a folder into a zip file, one part at a time, by way of a file of the driver."""
    jvm = catalog.spark.sparkContext._jvm
    fs, where = _fs(catalog, folder)
    base = len(fs.getFileStatus(where).getPath().toString()) + 1
    with tempfile.TemporaryDirectory() as own:
        with zipfile.ZipFile(f"{own}/all.zip", "w", zipfile.ZIP_DEFLATED) as out:
            found = fs.listFiles(where, True)
            while found.hasNext():
                part = found.next().getPath()
                fs.copyToLocalFile(False, part, jvm.org.apache.hadoop.fs.Path(f"file://{own}/part"), True)
                out.write(f"{own}/part", part.toString()[base:])
                Path(f"{own}/part").unlink()
        target, place = _fs(catalog, path)
        target.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{own}/all.zip"), place)


def _unzip(catalog: Catalog, path: str, folder: str) -> None:
    jvm = catalog.spark.sparkContext._jvm
    fs, where = _fs(catalog, path)
    target, _ = _fs(catalog, folder)
    with tempfile.TemporaryDirectory() as own:
        fs.copyToLocalFile(False, where, jvm.org.apache.hadoop.fs.Path(f"file://{own}/all.zip"), True)
        with zipfile.ZipFile(f"{own}/all.zip") as found:
            for name in found.namelist():
                if ".." in Path(name).parts or Path(name).is_absolute():
                    raise ValueError("the archive has a path outside itself")
                with found.open(name) as part, open(f"{own}/part", "wb") as out:
                    shutil.copyfileobj(part, out)
                target.copyFromLocalFile(True, True, jvm.org.apache.hadoop.fs.Path(f"file://{own}/part"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))


def restore(catalog: Catalog, path: str, name: str | None = None) -> Entity:
    """Create schema and entity as needed and load the dump; nothing is visible before all rows are."""
    if path.endswith(".zip"):
        folder = f"{path}-{uuid.uuid4().hex}"
        try:
            _unzip(catalog, path, folder)
            return restore(catalog, folder, name)
        finally:
            fs, where = _fs(catalog, folder)
            fs.delete(where, True)
    manifest = json.loads(catalog.spark.read.text(f"{path}/manifest").first()[0])
    name = (name or manifest["entity"]).lower()
    catalog.create_schema(name.split(".")[0], may_exist=True)
    schema, entity = name.split(".")
    catalog._write({"schema": manifest["schema"], "files": [], "sequence": 0, "rows": 0}, schema, entity, "versions", f"{0:012d}.json")
    try:
        return load(catalog.entity(name), f"{path}/data", manifest["format"])
    except Exception:
        catalog.drop_entity(name)
        raise


def dump_schema(catalog: Catalog, schema: str, path: str, form: str = "json") -> None:
    for row in catalog.list_entities(schema).collect():
        dump(catalog.entity(row.dbo), f"{path}/{row.dbo}", form)


def restore_schema(catalog: Catalog, path: str, schema: str | None = None) -> list[Entity]:
    """Restore every entity of a dumped schema, under another schema's name if one is given; all of them or none."""
    fs, where = _fs(catalog, path)
    made = []
    try:
        for name in sorted(x.getPath().getName() for x in fs.listStatus(where)):
            made.append(restore(catalog, f"{path}/{name}", f"{schema or name.split('.')[0]}.{name.split('.')[1]}"))
    except Exception:
        for entity in made:
            catalog.drop_entity(entity.name)
        raise
    return made


def pages(df: DataFrame, rows: int = 1000):
    """The result in pages, one partition at a time."""
    page = []
    for row in df.toLocalIterator():
        page.append(row)
        if len(page) == rows:
            yield page
            page = []
    if page:
        yield page
