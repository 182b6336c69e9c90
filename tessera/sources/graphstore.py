"""Versioned graph tables on shared storage.

A store holds, for nodes and edges each, a base of Parquet files laid out by
key and small delta folders of changed rows (whole rows, or their deletion).
A version is a manifest that names them; it is written last, under a name that
must not exist, so a write that fails or loses against another leaves the old
version as it was.  A key's newest delta row counts, so reading a version is
one scan of the base and one of all its deltas, however many writes there were.
Deltas are merged when there are many, and into the base when they are large.
Files know their range of keys (and of values, for indexes), so that point
look-ups open only files that can hold the key.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.graph import PropertyGraph
from tessera.storage import scratch_path

KEYS = {"nodes": "id", "edges": "eid"}
#: Delta folders of a table that are merged into one, share of the base's rows above which they are merged into the base, ids that an index look-up reads by their files.
DELTAS, SHARE, SOUGHT = 8, 0.2, 1000


class Conflict(RuntimeError):
    """Another writer made the version first; read the newest version and try again."""


@dataclass(frozen=True)
class Table:
    """Folders of one table; ``rows`` of the base and of each delta."""

    base: str
    schema: str
    rows: int = 0
    deltas: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Manifest:
    version: int
    nodes: Table
    edges: Table
    indexes: tuple[tuple[str, str, str], ...] = ()  # label, property, folder of (value, id)
    constraints: tuple[tuple[str, str, str], ...] = ()

    def to_json(self) -> str:
        return json.dumps(self, default=vars)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        d = json.loads(text)
        tables = {k: Table(d[k]["base"], d[k]["schema"], d[k]["rows"], tuple((p, n) for p, n in d[k]["deltas"])) for k in KEYS}
        return cls(d["version"], **tables, indexes=tuple(map(tuple, d["indexes"])), constraints=tuple(map(tuple, d["constraints"])))


def newest(base: DataFrame, deltas: DataFrame | None, key: str) -> DataFrame:
    """``base`` with the newest row of ``deltas`` (columns of the base, ``at_``, ``gone_``) for each key that has one."""
    if deltas is None:
        return base
    last = deltas.groupBy(key).agg(F.max_by(F.struct(*[c for c in deltas.columns if c != "at_"]), "at_").alias("r")).select("r.*")
    kept = base.join(last.select(key), key, "left_anti").select(*base.columns)
    return kept.unionByName(last.where("NOT gone_").drop("gone_").select(*base.columns))


def _common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds values of both: of numbers the wider, else text."""
    if isinstance(b, T.NullType):
        return a
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(a, whole) and isinstance(b, whole):
        return T.LongType() if T.LongType() in (a, b) else T.IntegerType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    if isinstance(a, T.AtomicType) and isinstance(b, T.AtomicType):
        return T.StringType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(_common(a.elementType, b.elementType))
    raise TypeError(f"a property of type {a.simpleString()} cannot become {b.simpleString()}")


@dataclass
class Changes:
    """What one version changes: rows to put (by key), keys to drop; kept in order, later ones win."""

    puts: dict[str, list[DataFrame]] = field(default_factory=lambda: {"nodes": [], "edges": []})
    indexes: tuple | None = None
    constraints: tuple | None = None

    def upsert(self, table: str, rows: DataFrame) -> Changes:
        """Each key once in ``rows``."""
        self.puts[table].append(rows.withColumn("gone_", F.lit(False)))
        return self

    def delete(self, table: str, keys: DataFrame) -> Changes:
        self.puts[table].append(keys.select(KEYS[table]).withColumn("gone_", F.lit(True)))
        return self


class GraphStore:
    """A folder of versions.  ``GraphStore.create`` writes the first one from a graph."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm = jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    @classmethod
    def create(cls, graph: PropertyGraph, path: str) -> GraphStore:
        store = cls(graph.spark, path)
        tables = {}
        for name, df in (("nodes", graph.nodes), ("edges", graph.edges)):
            base, rows = store._write_base(df, name)
            tables[name] = Table(base, df.schema.json(), rows)
        store._commit(Manifest(0, **tables, constraints=graph.constraints))
        for label, name in graph.indexes:
            store.create_index(label, name)
        return store

    # files

    def _p(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def _laid(self, rows: DataFrame, key: str, folder: str) -> int:
        """Writes rows by ranges of ``key`` and, beside them, each file's range; returns their number."""
        rows.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.parquet(f"{self.path}/{folder}")
        files = self.spark.read.schema(rows.select(key).schema).parquet(f"{self.path}/{folder}")
        ranges = files.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows"))
        ranges.coalesce(1).write.parquet(f"{self.path}/{folder}.ranges")
        return self.spark.read.parquet(f"{self.path}/{folder}.ranges").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def _write_base(self, rows: DataFrame, table: str) -> tuple[str, int]:
        folder = self._folder(table)
        return folder, self._laid(rows, KEYS[table], folder)

    def _commit(self, manifest: Manifest) -> None:
        """Publishes a manifest: written aside, then renamed to a name that must be free."""
        aside, name = self._p("versions", f".{uuid.uuid4().hex}"), self._p("versions", f"{manifest.version:012d}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(manifest.to_json().encode()))
        out.close()
        none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        flags = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        flags[0] = none
        try:
            self._context.rename(aside, name, flags)
        except Exception as e:
            self._fs.delete(aside, False)
            if self._fs.exists(name):
                raise Conflict(f"version {manifest.version} exists") from e
            raise

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._p("versions"))
        names = [s.getPath().getName() for s in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> Manifest:
        version = self.versions()[-1] if version is None else version
        stream = self._fs.open(self._p("versions", f"{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Manifest.from_json(text)

    # reading

    def _deltas(self, t: Table) -> DataFrame | None:
        if not t.deltas:
            return None
        schema = T.StructType.fromJson(json.loads(t.schema)).add("gone_", T.BooleanType()).add("at_", T.LongType())
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p, _ in t.deltas])

    def _base(self, t: Table, files: list[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(t.schema))
        if files is not None and not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*([f"{self.path}/{t.base}"] if files is None else [f"{self.path}/{t.base}/{f}" for f in files]))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        t = getattr(self.manifest(version), name)
        return newest(self._base(t), self._deltas(t), KEYS[name])

    def graph(self, version: int | None = None) -> PropertyGraph:
        """The graph as of a version, the newest by default."""
        m = self.manifest(version)
        tables = {name: newest(self._base(getattr(m, name)), self._deltas(getattr(m, name)), KEYS[name]) for name in KEYS}
        finder = (lambda label, name, value: self.find(label, name, value, m)) if m.indexes else None
        return PropertyGraph(tables["nodes"], tables["edges"], m.version, tuple((label, name) for label, name, _ in m.indexes), m.constraints, finder)

    # writing

    def commit(self, changes: Changes, on: Manifest | None = None) -> Manifest:
        """Makes the next version; ``on`` is the version that the changes were worked out from."""
        m = on or self.manifest()
        tables = {}
        for name, key in KEYS.items():
            t = getattr(m, name)
            tables[name] = self._with(t, changes.puts[name], key, name, m.version + 1) if changes.puts[name] else t
        made = replace(m, version=m.version + 1, **tables)
        if changes.constraints is not None:
            made = replace(made, constraints=changes.constraints)
        if changes.indexes is not None:
            made = replace(made, indexes=changes.indexes)
        if made.nodes.base != m.nodes.base:
            made = replace(made, indexes=tuple((label, name, self._index(made, label, name)) for label, name, _ in made.indexes))
        self._commit(made)
        return made

    def _with(self, t: Table, puts: list[DataFrame], key: str, name: str, version: int) -> Table:
        own = T.StructType.fromJson(json.loads(t.schema))
        rows = None
        for k, put in enumerate(puts):
            put = put.select(*[c.name for c in put.schema if not isinstance(c.dataType, T.NullType)], F.lit(k).alias("at_"))
            rows = put if rows is None else rows.unionByName(put, allowMissingColumns=True)
        kinds = {f.name: f.dataType for f in own}
        changed = {f.name: _common(kinds[f.name], f.dataType) for f in rows.schema if f.name in kinds and f.dataType != kinds[f.name]}
        changed = {c: kind for c, kind in changed.items() if kind != kinds[c]}
        if changed:
            t = self._retyped(t, changed, key, name)
        own = T.StructType([T.StructField(f.name, changed.get(f.name, f.dataType)) for f in own] + [f for f in rows.schema if f.name not in kinds and f.name not in ("gone_", "at_")])
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in own], "gone_", "at_")
        # one row a key: of several changes in one version the last
        last = rows.groupBy(key).agg(F.max_by(F.struct(*own.names, "gone_"), "at_").alias("r")).select("r.*") if len(puts) > 1 else rows.drop("at_")
        folder = self._folder(f"{name}-delta")
        last.withColumn("at_", F.lit(version).cast("bigint")).write.parquet(f"{self.path}/{folder}")
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        grown = replace(t, schema=own.json(), deltas=(*t.deltas, (folder, n)))
        total = sum(n for _, n in grown.deltas)
        if self._fold(total, t.rows):
            base, kept = self._write_base(newest(self._base(grown), self._deltas(grown), key), name)
            return Table(base, grown.schema, kept)
        if len(grown.deltas) > DELTAS:
            merged = self._deltas(grown).groupBy(key).agg(F.max_by(F.struct(*own.names, "gone_", "at_"), "at_").alias("r")).select("r.*")
            folder = self._folder(f"{name}-delta")
            merged.write.parquet(f"{self.path}/{folder}")
            return replace(grown, deltas=((folder, total),))
        return grown

    def _fold(self, changed: int, rows: int) -> bool:
        """Whether deltas of so many rows go into the base."""
        return changed > max(SHARE * rows, 10_000)

    def _retyped(self, t: Table, kinds: dict[str, T.DataType], key: str, name: str) -> Table:
        """The table with columns of other types: its files hold the old ones, so it is written anew."""
        rows = newest(self._base(t), self._deltas(t), key)
        rows = rows.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})
        base, n = self._write_base(rows, name)
        return Table(base, rows.schema.json(), n)

    def upsert_nodes(self, rows: DataFrame) -> Manifest:
        """Puts whole rows by ``id``: new ids are added, known ones replaced."""
        return self.commit(Changes().upsert("nodes", rows))

    def upsert_edges(self, rows: DataFrame) -> Manifest:
        return self.commit(Changes().upsert("edges", rows))

    def compact(self) -> Manifest:
        """A version whose deltas are in the base; indexes are written anew."""
        m = self.manifest()
        tables = {}
        for name, key in KEYS.items():
            t = getattr(m, name)
            base, rows = self._write_base(newest(self._base(t), self._deltas(t), key), name) if t.deltas else (t.base, t.rows)
            tables[name] = Table(base, t.schema, rows)
        made = replace(m, version=m.version + 1, **tables)
        made = replace(made, indexes=tuple((label, name, self._index(made, label, name)) for label, name, _ in m.indexes))
        self._commit(made)
        return made

    def expire(self, keep: int = 1) -> int:
        """Forgets all but the newest ``keep`` versions and deletes folders that none of them names; returns how many went.

        Only for folders without a writer at work, whose files no version names yet.
        """
        every = self.versions()
        kept = [self.manifest(v) for v in every[-keep:]]
        used = {"versions"}
        for m in kept:
            for t in (m.nodes, m.edges):
                used |= {t.base, f"{t.base}.ranges", *(p for p, _ in t.deltas)}
            used |= {x for _, _, f in m.indexes for x in (f, f"{f}.ranges")}
        for v in every[:-keep]:
            self._fs.delete(self._p("versions", f"{v:012d}.json"), False)
        gone = [s.getPath() for s in self._fs.listStatus(self._root) if s.getPath().getName() not in used]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)

    # indexes and point look-ups

    def _files(self, folder: str, values: list) -> list[str]:
        """Files whose range may hold one of the values."""
        ranges = self.spark.read.parquet(f"{self.path}/{folder}.ranges")
        sought = self.spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField("v", ranges.schema["low"].dataType)]))
        return [r[0] for r in ranges.join(F.broadcast(sought), F.col("v").between(F.col("low"), F.col("high"))).select("file").distinct().collect()]

    def by_id(self, ids: list[int], m: Manifest | None = None) -> DataFrame:
        """Nodes with the given ids, from the files that can hold them."""
        m = m or self.manifest()
        wanted = F.col("id").isin(ids)
        deltas = self._deltas(m.nodes)
        return newest(self._base(m.nodes, self._files(m.nodes.base, ids)).where(wanted), None if deltas is None else deltas.where(wanted), "id")

    def _index(self, m: Manifest, label: str, name: str) -> str:
        rows = self._base(m.nodes).where(F.array_contains("labels", label) & F.col(name).isNotNull()).select(F.col(name).alias("value"), "id")
        folder = self._folder("index")
        self._laid(rows, "value", folder)
        return folder

    def create_index(self, label: str, name: str) -> Manifest:
        """Writes the values of a label's property by range, with the ids that have them (of the base; deltas are always read)."""
        m = self.manifest()
        if any((a, b) == (label, name) for a, b, _ in m.indexes):
            return m
        return self.commit(Changes(indexes=(*m.indexes, (label, name, self._index(m, label, name)))), m)

    def find(self, label: str, name: str, value, m: Manifest | None = None) -> DataFrame | None:
        """Nodes of ``label`` whose property is ``value`` by an index; None where there is no index or it would not help."""
        m = m or self.manifest()
        folder = next((f for a, b, f in m.indexes if (a, b) == (label, name)), None)
        if folder is None or value is None:
            return None
        files = self._files(folder, [value])
        ids: list[int] = []
        if files:
            rows = self.spark.read.parquet(*[f"{self.path}/{folder}/{f}" for f in files])
            ids = [r[0] for r in rows.where(F.col("value") == value).select("id").limit(SOUGHT + 1).collect()]
        if len(ids) > SOUGHT:
            return None
        has = F.array_contains("labels", label) & (F.col(name) == value)
        deltas = self._deltas(m.nodes)
        # the index may be older than the base's successor: ids found are checked again
        if deltas is None:
            return self.by_id(ids, m).where(has) if ids else self._base(m.nodes, []).where(has)
        changed = deltas.select("id").distinct()
        old = self._base(m.nodes, self._files(m.nodes.base, ids) if ids else []).where(F.col("id").isin(ids)).join(changed, "id", "left_anti").select(*self._base(m.nodes).columns)
        return old.unionByName(newest(self._base(m.nodes, []), deltas, "id")).where(has)


class ScratchStore(GraphStore):
    """Versions of a graph that is not stored: its tables stay where they are, changes are deltas in the shared scratch folder."""

    def __init__(self, graph: PropertyGraph):
        super().__init__(graph.spark, scratch_path(graph.spark, "graph"))
        self.given = {"nodes": graph.nodes, "edges": graph.edges}
        self.kept = {0: Manifest(0, *[Table(name, df.schema.json()) for name, df in self.given.items()], constraints=graph.constraints)}
        self.finder, self.indexes = graph.finder, graph.indexes

    def _commit(self, manifest: Manifest) -> None:
        self.kept[manifest.version] = manifest

    def versions(self) -> list[int]:
        return sorted(self.kept)

    def manifest(self, version: int | None = None) -> Manifest:
        return self.kept[max(self.kept) if version is None else version]

    def _base(self, t: Table, files: list[str] | None = None) -> DataFrame:
        df = self.given[t.base]
        return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in T.StructType.fromJson(json.loads(t.schema))])

    def _fold(self, changed: int, rows: int) -> bool:
        return False

    def _retyped(self, t: Table, kinds: dict[str, T.DataType], key: str, name: str) -> Table:
        own = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in T.StructType.fromJson(json.loads(t.schema))])
        deltas = t.deltas
        if deltas:
            folder = self._folder(f"{name}-delta")
            self._deltas(t).withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()}).write.parquet(f"{self.path}/{folder}")
            deltas = ((folder, sum(n for _, n in deltas)),)
        return Table(t.base, own.json(), t.rows, deltas)

    def create_index(self, label: str, name: str) -> Manifest:
        """Only noted: a scratch store does not write its base."""
        if (label, name) not in self.indexes:
            self.indexes = (*self.indexes, (label, name))
        return self.manifest()

    def graph(self, version: int | None = None) -> PropertyGraph:
        m = self.manifest(version)
        own = super().graph(version)
        return replace(own, indexes=self.indexes, finder=self.finder if not m.nodes.deltas else None)
