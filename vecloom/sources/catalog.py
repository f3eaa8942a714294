"""Schemas, entities, versions, transactions, data manipulation and system views.

An entity is a folder of Parquet files.  ``versions/N.json`` lists the files of version N; a commit writes the next
number's file, which must not exist yet, so one writer wins and readers keep the version they began with.  INSERT adds
files; UPDATE and DELETE rewrite those that hold a row to change.  Everything goes through Hadoop's file system API, so a
catalogue may live in any store that Spark reads.

A transaction keeps its changes to itself: their files are written at once, on top of the versions that it first read.
COMMIT writes the next version of each entity with the transaction's name in it, which locks the entity, and then one
record of the transaction, which makes all of them valid.  A version whose record is missing is not seen by anyone;
if another has taken an entity's next version in the meantime, nothing is committed.  ROLLBACK and KILL remove the locks.
"""

from __future__ import annotations

import copy
import dataclasses
import json
import time
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import vectors
from vecloom.operators import predicates, stats
from vecloom.operators.indexes import kinds
from vecloom.plans.query import Query
from vecloom.types import ColumnDef, schema_of


#: Folder of the records of committed transactions.
LOG = "_transactions"


def loose(kind: T.DataType) -> T.DataType:
    """Files do not promise that arrays are free of nulls."""
    return T.ArrayType(kind.elementType, True) if isinstance(kind, T.ArrayType) else kind


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.transactions: dict[str, Transaction] = {}
        self._loaded: dict[str, kinds.Index] = {}

    # files
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return sorted(x.getPath().getName() for x in self._fs().listStatus(path)) if self._fs().exists(path) else []

    def _read(self, *parts: str) -> dict:
        stream = self._fs().open(self._path(*parts))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _remove(self, *parts: str) -> bool:
        return self._fs().delete(self._path(*parts), True)

    def _write(self, what: dict, *parts: str) -> None:
        """Create a file that must not exist: this is the commit point."""
        stream = self._fs().create(self._path(*parts), False)
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()

    # definition
    def create_schema(self, name: str, may_exist: bool = False) -> DataFrame:
        path = self._path(name.lower())
        if self._fs().exists(path) and not may_exist:
            raise ValueError(f"schema {name} exists")
        self._fs().mkdirs(path)
        return self._status("CREATE SCHEMA", name)

    def drop_schema(self, name: str) -> DataFrame:
        if not self._fs().delete(self._path(name.lower()), True):
            raise ValueError(f"no schema {name}")
        return self._status("DROP SCHEMA", name)

    def list_schemas(self) -> DataFrame:
        return self.spark.createDataFrame([(n, "SCHEMA") for n in self._schemas()], "dbo string, class string")

    def _schemas(self) -> list[str]:
        return [n for n in self._list() if n != LOG]

    def create_entity(self, name: str, columns: list[ColumnDef]) -> DataFrame:
        schema, entity = name.lower().split(".")
        if schema not in self._list():
            raise ValueError(f"no schema {schema}")
        if entity in self._list(schema):
            raise ValueError(f"entity {name} exists")
        made = schema_of(columns)
        self._write({"schema": made.jsonValue(), "files": [], "sequence": 0, "rows": 0}, schema, entity, "versions", f"{0:012d}.json")
        return self._status("CREATE ENTITY", name)

    def drop_entity(self, name: str) -> DataFrame:
        if not self._fs().delete(self._path(*name.lower().split(".")), True):
            raise ValueError(f"no entity {name}")
        return self._status("DROP ENTITY", name)

    def truncate_entity(self, name: str) -> DataFrame:
        self.entity(name)._commit({"files": [], "rows": 0})
        return self._status("TRUNCATE ENTITY", name)

    def list_entities(self, schema: str | None = None) -> DataFrame:
        names = [f"{s}.{e}" for s in ([schema.lower()] if schema else self._schemas()) for e in self._list(s)]
        return self.spark.createDataFrame([(n, "ENTITY") for n in names], "dbo string, class string")

    def entity(self, name: str, version: int | None = None) -> Entity:
        return Entity(self, name.lower(), version)

    # transactions
    def begin(self, read_only: bool = False) -> Transaction:
        t = Transaction(self, read_only)
        self.transactions[t.id] = t
        return t

    def list_transactions(self) -> DataFrame:
        return self.spark.createDataFrame([(t.id, "READONLY" if t.read_only else "EXCLUSIVE", t.state, t.began) for t in self.transactions.values()], "txid string, type string, state string, began double")

    def list_locks(self) -> DataFrame:
        """Entities whose next version a commit in progress has taken, and those that open transactions of this session have changed."""
        held = [(n, "EXCLUSIVE", t.id) for t in self.transactions.values() if t.state == "OPEN" for n in t.changed]
        for row in self.list_entities().collect():
            last = self._list(*row.dbo.split("."), "versions")[-1:]
            owner = self._read(*row.dbo.split("."), "versions", last[0]).get("transaction") if last else None
            if owner and not self.committed(owner):
                held.append((row.dbo, "EXCLUSIVE", owner))
        return self.spark.createDataFrame(sorted(set(held)), "dbo string, mode string, txid string")

    def committed(self, transaction: str) -> bool:
        return self._fs().exists(self._path(LOG, f"{transaction}.json"))

    def release(self, transaction: str) -> None:
        """Remove the locks of a transaction that will not commit, for instance of a session that has died."""
        if self.committed(transaction):
            raise ValueError("the transaction has committed")
        for row in self.list_entities().collect():
            parts = row.dbo.split(".")
            for name in self._list(*parts, "versions")[-1:]:
                if self._read(*parts, "versions", name).get("transaction") == transaction:
                    self._remove(*parts, "versions", name)

    def ping(self) -> bool:
        return True

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over all entities, as views named schema_entity, with the vector functions by name."""
        vectors.register_sql(self.spark)
        for row in self.list_entities().collect():
            self.entity(row.dbo).frame().drop("_tid").createOrReplaceTempView(row.dbo.replace(".", "_"))
        return self.spark.sql(text)

    def _status(self, action: str, name: str) -> DataFrame:
        return self.spark.createDataFrame([(action, name.lower(), 0.0)], "action string, dbo string, duration_ms double")


class Entity:
    """One version of a table; also the source of queries (``frame``, ``indexes``)."""

    def __init__(self, catalog: Catalog, name: str, version: int | None = None, within: Transaction | None = None):
        self.catalog, self.name, self.parts, self.within = catalog, name, name.split("."), within
        found = catalog._list(*self.parts, "versions")
        if not found:
            raise ValueError(f"no entity {name}")
        for last in reversed(found) if version is None else [f"{version:012d}.json"]:
            self.version, self.meta = int(last[:-5]), catalog._read(*self.parts, "versions", last)
            if not self.meta.get("transaction") or catalog.committed(self.meta["transaction"]):
                break
        self.schema = T.StructType.fromJson(self.meta["schema"])

    def _stored(self) -> T.StructType:
        return T.StructType([*(T.StructField(f.name, loose(f.dataType), True, f.metadata) for f in self.schema), T.StructField("_tid", T.LongType())])

    def _folder(self, name: str) -> str:
        return "/".join((self.catalog.root, *self.parts, name))

    def _of(self, files: list[str]) -> DataFrame:
        spark = self.catalog.spark
        return spark.read.schema(self._stored()).parquet(*map(self._folder, files)) if files else spark.createDataFrame([], self._stored())

    def frame(self) -> DataFrame:
        return self._of(self.meta["files"])

    def query(self) -> Query:
        return Query(self)

    def count(self) -> int:
        """From the version's metadata, without a scan."""
        return self.meta["rows"]

    def scan(self, start: int | None = None, end: int | None = None) -> DataFrame:
        df = self.frame()
        return df.where((F.col("_tid") >= (start or 0)) & (F.col("_tid") <= (end if end is not None else (1 << 62))))

    def _commit(self, change: dict) -> Entity:
        """The version with ``change``: visible at once, or in a transaction when that commits."""
        if self.within is not None:
            return self.within._changed(self, change)
        meta = {k: v for k, v in self.meta.items() if k != "transaction"} | change
        self.catalog._write(meta, *self.parts, "versions", f"{self.version + 1:012d}.json")
        return Entity(self.catalog, self.name)

    def _store(self, df: DataFrame, prefix: str = "data") -> str:
        name = f"{prefix}-{uuid.uuid4().hex}"
        df.write.parquet(self._folder(name))
        return name

    def _checked(self, df: DataFrame) -> DataFrame:
        """Cast to the declared types; refuse NULLs and lengths that the declaration excludes."""
        out = []
        for f in self.schema:
            c = F.col(f.name) if f.name in df.columns else F.lit(None)
            kind = loose(f.dataType)
            c = c.cast(kind)
            if f.metadata.get("kind") == "HALF_VECTOR":
                c = F.pandas_udf(lambda v: v.map(lambda x: None if x is None else __import__("numpy").asarray(x, "float16").astype("float32")), "array<float>")(c)
            if f.metadata.get("dim"):
                c = F.when(c.isNull() | (F.size(c) == f.metadata["dim"]), c).otherwise(F.raise_error(F.lit(f"{f.name}: wrong dimension")).cast(kind))
            if not f.nullable and not f.metadata.get("auto_increment"):
                c = F.coalesce(c, F.raise_error(F.lit(f"{f.name} may not be null")).cast(kind))
            out.append(c.alias(f.name))
        return df.select(*out)

    def insert(self, rows: DataFrame | list[dict]) -> Entity:
        """Append rows; returns the new version. Auto-increment values always come from the sequence.

        The rows are written once as they come, so what they are computed from is evaluated once; the second writing gives
        them consecutive ids, from the counts of the first one's partitions.
        """
        if isinstance(rows, list):
            fields = [T.StructField(f.name, f.dataType, True) for f in self.schema]
            rows = self.catalog.spark.createDataFrame([tuple(r.get(f.name) for f in self.schema) for r in rows], T.StructType(fields))
        spark = self.catalog.spark
        raw = self._checked(rows).withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
        draft = self._store(raw, "draft")
        try:
            raw = spark.read.schema(raw.schema).parquet(self._folder(draft))
            at, bases = self.meta["sequence"], []
            for p, n in sorted((r["_p"], r["n"]) for r in raw.groupBy("_p").agg((F.max("_k") + 1).alias("n")).collect()):
                bases.append((p, at))
                at += n
            bases = spark.createDataFrame(bases, "_p int, _base long")  # a row per partition of the input
            numbered = raw.join(F.broadcast(bases), "_p").withColumn("_tid", F.col("_base") + F.col("_k"))
            for f in self.schema:
                if f.metadata.get("auto_increment"):
                    numbered = numbered.withColumn(f.name, F.col("_tid").cast(f.dataType))
            numbered = numbered.select(*self.schema.names, "_tid")
            for index in self.indexes(stale=True):
                if index.kind == "btree_uq" and numbered.select(index.column).unionByName(self.frame().select(index.column)).where(F.col(index.column).isNotNull()).groupBy(index.column).count().where("count > 1").limit(1).count():
                    raise ValueError(f"{index.column} is not unique")
            return self._commit({"files": [*self.meta["files"], self._store(numbered)], "sequence": at, "rows": self.meta["rows"] + at - self.meta["sequence"]})
        finally:
            self.catalog._remove(*self.parts, draft)

    def _touched(self, hit: Column) -> tuple[list[str], list[str], int]:
        """Files with rows to change, the others, and the number of such rows."""
        counts = self.frame().where(hit).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("f")).groupBy("f").count().collect()
        hit_files = {r["f"] for r in counts}
        return [f for f in self.meta["files"] if f in hit_files], [f for f in self.meta["files"] if f not in hit_files], sum(r["count"] for r in counts)

    def update(self, where: Any = None, **values: Any) -> tuple[Entity, int]:
        """Set columns to literals or columns; returns the new version and the number of rows changed."""
        hit = predicates.column(where) if where is not None else F.lit(True)
        old, rest, changed = self._touched(hit)
        if not old:
            return self, 0
        marked = self._of(old).withColumn("_hit", hit)
        for name, value in values.items():
            kind = loose(self.schema[name.lower()].dataType)
            marked = marked.withColumn(name.lower(), F.when(F.col("_hit"), (value if isinstance(value, Column) else F.lit(value)).cast(kind)).otherwise(F.col(name.lower())))
        kept = marked.select(*self.schema.names, "_tid")
        for f in self.schema:
            if not f.nullable:
                kept = kept.withColumn(f.name, F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{f.name} may not be null")).cast(loose(f.dataType))))
        return self._commit({"files": [*rest, self._store(kept)]}), changed

    def delete(self, where: Any = None) -> tuple[Entity, int]:
        hit = predicates.column(where) if where is not None else F.lit(True)
        old, rest, gone = self._touched(hit)
        if not old:
            return self, 0
        return self._commit({"files": [*rest, self._store(self._of(old).where(~hit))], "rows": self.meta["rows"] - gone}), gone

    # indexes and views
    def _index_folders(self) -> dict[str, str]:
        """Folder of the newest whole index of each name."""
        found: dict[str, str] = {}
        for name in self.catalog._list(*self.parts, "indexes"):
            if self.catalog._fs().exists(self.catalog._path(*self.parts, "indexes", name, "info.json")):
                found[name.rsplit("-", 2)[0]] = name
        return found

    def indexes(self, stale: bool = True) -> list[kinds.Index]:
        out = []
        for folder in self._index_folders().values():
            path = self._folder(f"indexes/{folder}")
            if path not in self.catalog._loaded:
                self.catalog._loaded[path] = kinds.load(self.catalog.spark, path)
            index = dataclasses.replace(self.catalog._loaded[path])
            info = self.catalog._read(*self.parts, "indexes", folder, "info.json")
            index.model = index.model | {"params": info["params"]}
            # it covers this version and no other; changes of an open transaction are in none
            index.clean = lambda v=info["version"]: v == self.version and not (self.within and self.name in self.within.changed)
            if stale or index.clean():
                out.append(index)
        return out

    def index(self, name: str) -> kinds.Index:
        found = next((i for i in self.indexes() if i.name == name), None)
        if found is None:
            raise ValueError(f"no index {name}")
        return found

    def create_index(self, kind: str, name: str, column: str, **params: Any) -> kinds.Index:
        if "-" in name:
            raise ValueError("the name of an index has no hyphen")
        folder = f"{name}-{self.version:012d}-{time.time_ns():020d}"
        old = self._index_folders().get(name)
        kinds.build(self.frame(), kind, name, column, path=self._folder(f"indexes/{folder}"), **params)
        self.catalog._write({"version": self.version, "params": {"column": column, **params}}, *self.parts, "indexes", folder, "info.json")
        if old:
            self.catalog._remove(*self.parts, "indexes", old)
        return self.index(name)

    def drop_index(self, name: str) -> None:
        found = self._index_folders().get(name)
        if found is None:
            raise ValueError(f"no index {name}")
        self.catalog._remove(*self.parts, "indexes", found)

    def rebuild_index(self, name: str) -> kinds.Index:
        old = self.index(name)
        params = dict(old.model["params"])
        return Entity(self.catalog, self.name).create_index(old.kind, name, params.pop("column"), **params)

    def rebuild_stale(self, tries: int = 3) -> list[str]:
        """Rebuild the indexes that no longer cover the table; returns their names."""
        done = []
        for index in Entity(self.catalog, self.name).indexes():
            for left in reversed(range(tries)):
                if index.clean():
                    break
                try:
                    self.rebuild_index(index.name)
                    done.append(index.name)
                    break
                except Exception:
                    if not left:
                        raise
        return done

    def about(self) -> DataFrame:
        rows = [(self.name, "ENTITY", None, self.meta["rows"], None, None, None)]
        rows += [(f"{self.name}.{f.name}", "COLUMN", f.metadata.get("kind"), f.metadata.get("dim"), f.nullable, f.metadata.get("primary"), f.metadata.get("auto_increment")) for f in self.schema]
        rows += [(f"{self.name}.{i.name}", "INDEX", i.kind, None, None, None, i.clean()) for i in self.indexes()]
        return self.catalog.spark.createDataFrame(rows, "dbo string, class string, type string, size long, nullable boolean, primary boolean, info boolean")

    def about_index(self, name: str) -> DataFrame:
        index = self.index(name)
        rows = [("kind", index.kind), ("column", index.column), ("state", "CLEAN" if index.clean() else "STALE"), ("reads", str(index.reads)), *((k, str(v)) for k, v in index.model["params"].items())]
        return self.catalog.spark.createDataFrame(rows, "key string, value string")

    # statistics
    def analyze(self, exact_distinct: bool = False, sample: float = 0.1, above: int = 100_000) -> DataFrame:
        """Compute the statistics and keep them with this version. Of a table whose sample has more than ``above`` rows, a sample is read."""
        df = self.frame().drop("_tid")
        if self.meta["rows"] * sample > above:
            df = df.sample(sample, seed=0)
        found = [tuple(r) for r in stats.analyze(df, exact_distinct).collect()]  # a few rows per column
        name = f"{self.version:012d}-{time.time_ns():020d}.json"
        self.catalog._write({"version": self.version, "rows": found}, *self.parts, "statistics", name)
        return self.statistics()

    def _statistics(self) -> list[list]:
        found = self.catalog._list(*self.parts, "statistics")
        return self.catalog._read(*self.parts, "statistics", found[-1])["rows"] if found else []

    def statistics(self) -> DataFrame:
        """What the last ``analyze`` found: dbo, key, value."""
        return self.catalog.spark.createDataFrame([(f"{self.name}.{c}", k, v) for c, k, v in self._statistics()], "dbo string, key string, value string")

    def distinct(self) -> dict[str, float]:
        """Distinct values of each column by the stored statistics."""
        return {c: float(v) for c, k, v in self._statistics() if k == "distinct" and v}


class Transaction:
    """Changes that nobody else sees until they are committed, all together or not at all."""

    def __init__(self, catalog: Catalog, read_only: bool):
        self.catalog, self.read_only, self.id = catalog, read_only, uuid.uuid4().hex[:12]
        self.state, self.began, self.pinned, self.changed = "OPEN", time.time(), {}, {}

    def entity(self, name: str) -> Entity:
        """As it was when the transaction first read it, with the transaction's own changes."""
        name = name.lower()
        if name not in self.pinned:
            self.pinned[name] = Entity(self.catalog, name, within=self)
        return self.pinned[name]

    def _changed(self, entity: Entity, change: dict) -> Entity:
        if self.read_only or self.state != "OPEN":
            raise ValueError("the transaction cannot write")
        new = copy.copy(entity)
        new.meta = {k: v for k, v in entity.meta.items() if k != "transaction"} | change
        self.pinned[entity.name], self.changed[entity.name] = new, True
        return new

    def stage(self, name: str, action: str, *args: Any, **kwargs: Any) -> Any:
        """Do ``insert``, ``update`` or ``delete`` inside the transaction; its Spark jobs are those that ``kill`` ends."""
        if self.read_only or self.state != "OPEN":
            raise ValueError("the transaction cannot write")
        context = self.catalog.spark.sparkContext
        context.setJobGroup(self.id, f"transaction {self.id}", True)
        try:
            return getattr(self.entity(name), action)(*args, **kwargs)
        finally:
            for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(k, None)

    def commit(self) -> None:
        """Fails, with nothing changed, if an entity has a newer version than the one that the changes are based on."""
        if self.state != "OPEN":
            raise ValueError("the transaction is not open")
        taken = []
        try:
            for name in sorted(self.changed):
                entity = self.pinned[name]
                where = (*entity.parts, "versions", f"{entity.version + 1:012d}.json")
                self.catalog._write(entity.meta | {"transaction": self.id}, *where)
                taken.append(where)
            self.catalog._write({"entities": sorted(self.changed)}, LOG, f"{self.id}.json")
        except Exception as e:
            for where in taken:
                self.catalog._remove(*where)
            self.state = "FAILED"
            raise ValueError("another change was committed first") from e
        self.state = "COMMITTED"

    def rollback(self) -> None:
        self.changed, self.state = {}, "ROLLED BACK"

    def kill(self) -> None:
        """End the transaction and its running jobs."""
        self.catalog.spark.sparkContext.cancelJobGroup(self.id)
        self.changed, self.state = {}, "KILLED"
