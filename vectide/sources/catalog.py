"""Databases, tables and their versions.

A managed table is a list of Parquet folders with the columns and ``__pos``; inserts add a folder,
deletes and updates write a new one, and the manifest names the folders of the present version. Readers hold the
version they were bound to, so a vector keeps seeing the rows it was made from. An attached
table is somebody else's DataFrame or Parquet, whose rows get their place in the file as position.

Every change is kept before its statement returns: a manifest is a new numbered file, of which the last counts, and a row
that is inserted stands in the table's log until a folder holds it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectide.errors import ArityError, UnknownObject
from vectide.plans.vectors import POS
from vectide.sources import storage

INDEX_KINDS = ("sorted", "btree")
#: So many folders of fewer rows than SMALL are made one.
MANY, SMALL = 16, 100_000
#: Rows of a stretch in which positions are numbered anew, and the most stretches.
STRETCH, STRETCHES = 1_000_000, 10_000


@dataclass
class Version:
    """What a table holds at one time. folders: path to rows. stats: column to (min, max, sum), where known."""

    folders: dict[str, int] = field(default_factory=dict)
    rows: int = 0
    stats: dict[str, list[int]] = field(default_factory=dict)
    layouts: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True, eq=False)
class Snapshot:
    """A table as it was when a vector was bound to it."""

    table: Table
    version: Version

    def scan(self) -> DataFrame:
        return self.table.scan(self.version)


class Table:
    def __init__(self, catalog: Catalog, db: str, name: str, slots: int):
        self.catalog, self.db, self.name, self.slots = catalog, db, name, slots
        self.columns: list[str] = []
        self.indexes: dict[str, tuple[str, str]] = {}
        self.version = Version()
        self.pending: list[list[int]] = []
        self.attached: DataFrame | None = None

    @property
    def full_name(self) -> str:
        return f"{self.db}.{self.name}"

    @property
    def folder(self) -> str:
        return f"{self.catalog.root}/{self.db}/{self.name}"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(POS, T.LongType()), *(T.StructField(c, T.IntegerType()) for c in self.columns)])

    # Reading

    def snapshot(self) -> Snapshot:
        self.flush()
        return Snapshot(self, self.version)

    def scan(self, version: Version | None = None) -> DataFrame:
        """All columns and positions. The version defaults to the present one, with pending rows in it."""
        spark = self.catalog.spark
        if self.attached is not None:
            return self.attached
        if version is None:
            self.flush()
            version = self.version
        return spark.read.schema(self.schema()).parquet(*version.folders) if version.folders else spark.createDataFrame([], self.schema())

    def layout(self, column: str) -> DataFrame | None:
        """The copy in the order of an index, made when it is first asked for and again when it
        is out of date. A clustered copy holds all columns, an unclustered one the column and positions."""
        if column not in self.indexes:
            return None
        self.flush()
        if column not in self.version.layouts:
            rows = self.scan()
            if self.indexes[column][1] == "unclustered":
                rows = rows.select(POS, column)
            path = f"{self.folder}/index-{column}-{uuid.uuid4().hex}"
            rows.repartitionByRange(column, POS).sortWithinPartitions(column, POS).write.parquet(path)
            self.version.layouts[column] = path
            self._keep()
        return self.catalog.spark.read.parquet(self.version.layouts[column])

    # Writing

    def _keep(self):
        if self.attached is None:
            self.catalog.save(self.db)

    def _written(self, rows: DataFrame) -> tuple[str, dict]:
        """``rows`` (with positions) as a folder, and what it holds."""
        path = f"{self.folder}/part-{uuid.uuid4().hex}"
        rows.select(*self.schema().names).write.parquet(path)
        fresh = self.catalog.spark.read.schema(self.schema()).parquet(path)
        facts = [F.count("*").alias("rows")] + [f(c).alias(f"{f.__name__}_{c}") for c in self.columns for f in (F.min, F.max, F.sum)]
        return path, fresh.agg(*facts).collect()[0].asDict()

    def replace(self, rows: DataFrame, add: bool = False):
        """Writes ``rows`` (with positions) as the new version, or as one more folder of it."""
        path, got = self._written(rows)
        stats = {c: [got[f"{k}_{c}"] for k in ("min", "max", "sum")] for c in self.columns}
        old = self.version
        if add and old.rows:
            merge = lambda a, b: [min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2]] if b[0] is not None else a
            self.version = Version({**old.folders, path: got["rows"]}, old.rows + got["rows"], {c: merge(old.stats[c], stats[c]) for c in self.columns})
        else:
            self.version = Version({path: got["rows"]}, got["rows"], stats)
        self._compact()
        self._keep()

    def _compact(self):
        """Many small folders become one. The old ones stay for the vectors that are bound to them."""
        small = [p for p, n in self.version.folders.items() if n < SMALL]
        if len(small) >= MANY:
            rows = self.catalog.spark.read.schema(self.schema()).parquet(*small)
            path, got = self._written(rows.coalesce(1 + sum(self.version.folders[p] for p in small) // STRETCH))
            self.version.folders = {p: n for p, n in self.version.folders.items() if p not in small} | {path: got["rows"]}

    def flush(self):
        """Rows that stand in the log go to a folder."""
        if self.pending:
            base, rows = self.version.rows, self.pending
            self.pending = []
            placed = [[base + i, *r] for i, r in enumerate(rows)]
            self.replace(self.catalog.spark.createDataFrame(placed, self.schema()), add=True)
            storage.remove(self.catalog.spark, f"{self.folder}/log")

    def insert(self, values: list[int]):
        if len(values) != len(self.columns):
            raise ArityError(f"{self.full_name} has {len(self.columns)} columns, not {len(values)}")
        for v in values:
            if not -(1 << 31) <= v < 1 << 31:
                raise ArityError(f"{v} is not a 32-bit integer")
        place = self.version.rows + len(self.pending)
        storage.write_text(self.catalog.spark, f"{self.folder}/log/{place:020d}", json.dumps(values))
        self.pending.append(list(values))

    def recall(self):
        """Takes in what the log holds beyond the present version."""
        spark, place = self.catalog.spark, f"{self.folder}/log"
        for name in storage.names_in(spark, place):
            if name.isdigit() and int(name) == self.version.rows + len(self.pending):
                self.pending.append(json.loads(storage.read_text(spark, f"{place}/{name}")))

    def load_csv(self, path: str):
        """Appends the rows of a CSV file with one head line, or of a folder of such files in the order of their
        names, in their order; columns go by place. Rows are counted by split and written once."""
        spark = self.catalog.spark
        self.flush()
        own = T.StructType([T.StructField(c, T.IntegerType()) for c in self.columns])
        rows = spark.read.csv(path, schema=own, header=True, enforceSchema=True, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_m"))
        splits = rows.groupBy("_file", "_from").agg(F.count("*").alias("n"), F.min("_m").alias("first")).collect()
        base, starts = self.version.rows, []
        for r in sorted(splits, key=lambda r: (r._file, r._from)):
            starts.append((r._file, r._from, base - r.first))
            base += r.n
        if starts:
            shift = F.broadcast(spark.createDataFrame(starts, "_file string, _from long, _shift long"))
            rows = rows.join(shift, ["_file", "_from"]).withColumn(POS, F.col("_m") + F.col("_shift"))
            self.replace(rows, add=True)


def renumbered(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with positions below n: the gaps among the positions close up. The rows left are counted by
    stretch of positions and numbered within each."""
    stretch = F.floor(F.col(POS) / max(STRETCH, -(-n // STRETCHES)))
    base, starts = 0, []
    for r in sorted(rows.groupBy(stretch.alias("s")).agg(F.count("*").alias("n")).collect()):  # STRETCHES rows at most
        starts.append((r.s, base))
        base += r.n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts or [(0, 0)], "_stretch long, _base long"))
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(POS)) - 1
    own = [c for c in rows.columns if c != POS]
    return rows.withColumn("_stretch", stretch).join(first, "_stretch").select((F.col("_base") + place).alias(POS), *own)


class Database:
    def __init__(self, name: str):
        self.name = name
        self.tables: dict[str, Table] = {}
        self.manifest = 0


class Catalog:
    """All databases below one root folder; managed tables are found again by a later session."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{storage.scratch_root(spark)}/vectide-{spark.sparkContext.applicationId}/db-{uuid.uuid4().hex}").rstrip("/")
        self.databases: dict[str, Database] = {}

    def create_db(self, name: str) -> Database:
        if name not in self.databases:
            found = self._read(name)
            self.databases[name] = found or Database(name)
            if found is None:
                self.save(name)
        return self.databases[name]

    def db(self, name: str) -> Database:
        if name not in self.databases and (found := self._read(name)):
            self.databases[name] = found
        if name not in self.databases:
            raise UnknownObject(f"no database {name}")
        return self.databases[name]

    def create_table(self, name: str, db: str, slots: int) -> Table:
        tables = self.db(db).tables
        if name in tables:
            raise UnknownObject(f"table {db}.{name} exists")
        tables[name] = Table(self, db, name, slots)
        self.save(db)
        return tables[name]

    def create_column(self, name: str, table: str):
        t = self.table(table)
        if name in t.columns or len(t.columns) >= t.slots:
            raise UnknownObject(f"{table} has {'this column' if name in t.columns else 'no free column'}: {name}")
        if t.version.rows or t.pending:
            raise UnknownObject(f"{table} holds rows already")
        t.columns.append(name)
        self.save(t.db)

    def create_index(self, column: str, kind: str, clustering: str):
        t, c = self.column(column)
        t.indexes[c] = (kind, clustering)
        t.version.layouts.pop(c, None)
        t._keep()

    def attach(self, db: str, name: str, df: DataFrame) -> Table:
        """A DataFrame with a ``__pos`` column as a table that is only read; its index copies stand below the root."""
        t = Table(self, db, name, len(df.columns))
        t.columns = [c for c in df.columns if c != POS]
        t.attached = df
        self.databases.setdefault(db, Database(db)).tables[name] = t
        return t

    def table(self, name: str) -> Table:
        if name.count(".") != 1:
            raise UnknownObject(f"{name} is not a table's full name")
        db, t = name.split(".")
        tables = self.db(db).tables
        if t not in tables:
            raise UnknownObject(f"no table {name}")
        return tables[t]

    def column(self, name: str) -> tuple[Table, str]:
        table, _, c = name.rpartition(".")
        t = self.table(table)
        if c not in t.columns:
            raise UnknownObject(f"no column {name}")
        return t, c

    # What outlives the session

    def _manifests(self, db: str) -> list[str]:
        return [n for n in storage.names_in(self.spark, f"{self.root}/{db}") if n.startswith("manifest-") and n.endswith(".json")]

    def save(self, name: str):
        """One more manifest of a database; the ones before it go once it is there."""
        db = self.databases[name]
        held = {t.name: {"slots": t.slots, "columns": t.columns, "indexes": t.indexes, "version": vars(t.version)} for t in db.tables.values() if t.attached is None}
        old = self._manifests(name)
        db.manifest += 1
        storage.write_text(self.spark, f"{self.root}/{name}/manifest-{db.manifest:012d}.json", json.dumps(held, indent=1))
        for n in old:
            storage.remove(self.spark, f"{self.root}/{name}/{n}")

    def flush(self):
        for db in self.databases.values():
            for t in db.tables.values():
                t.flush()

    def _read(self, name: str) -> Database | None:
        found = self._manifests(name)
        if not found:
            return None
        db = Database(name)
        db.manifest = int(found[-1].removeprefix("manifest-").removesuffix(".json"))
        for n, x in json.loads(storage.read_text(self.spark, f"{self.root}/{name}/{found[-1]}")).items():
            t = db.tables[n] = Table(self, name, n, x["slots"])
            t.columns, t.version = x["columns"], Version(**x["version"])
            t.indexes = {c: tuple(v) for c, v in x["indexes"].items()}
            t.recall()
        return db


def positioned(df: DataFrame) -> DataFrame:
    """A Parquet DataFrame with ``__pos``: the place in its file, behind the rows of the files
    before it in order of path. Counts by file come from the footers."""
    files = sorted(df.inputFiles())
    row = F.col("_metadata.row_index")
    if len(files) == 1:
        return df.select(row.alias(POS), "*")
    counts = {r.f: r.n for r in df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()}
    base, starts = 0, []
    for f in sorted(counts):
        starts.append((f, base))
        base += counts[f]
    first = df.sparkSession.createDataFrame(starts, "_file string, _base long")
    return df.select("*", row.alias("_row"), F.col("_metadata.file_path").alias("_file")).join(F.broadcast(first), "_file").withColumn(POS, F.col("_base") + F.col("_row")).drop("_file", "_base", "_row")
