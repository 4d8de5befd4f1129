"""A session runs statements: names to vectors, dispatch, batches, printing."""

from __future__ import annotations

import itertools
import time
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from vectide.errors import ParseError, UnknownVariable
from vectide.operators import aggregates, arithmetic, changes, joins, printing, selection, shared_scan
from vectide.plans.lang import Statement, parse
from vectide.plans.vectors import Scalar, Vector
from vectide.sources.catalog import Catalog


class Session:
    """``execute`` takes a line and returns the text it prints, if any; ``stream`` gives that line by line,
    as the rows come from the executors."""

    def __init__(self, spark: SparkSession, root: str | None = None, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog(spark, root)
        self.pool: dict[str, Vector | Scalar] = {}
        self.queue: list[Statement] | None = None
        self.began: float | None = None
        self.kept: list[DataFrame] = []

    def _told(self, line: str) -> Iterator[str] | None:
        s = parse(line)
        if s is None:
            return None
        if self.queue is not None and s.op != "batch_execute":
            self.queue.append(s)
            return None
        return self.run(s)

    def execute(self, line: str) -> str | None:
        told = self._told(line)
        return None if told is None else "\n".join(told)

    def stream(self, line: str) -> Iterator[str]:
        """The lines that a statement prints; the statement itself has run when this returns."""
        return self._told(line) or iter(())

    def script(self, lines: str | Iterable[str]) -> Iterator[str]:
        for line in lines.splitlines() if isinstance(lines, str) else lines:
            text = self.execute(line)
            if text is not None:
                yield text

    # Names

    def _bound(self, name: str) -> Vector | Scalar:
        if name not in self.pool:
            raise UnknownVariable(f"nothing is called {name}")
        return self.pool[name]

    def vector(self, name: str) -> Vector:
        found = self._bound(name)
        if not isinstance(found, Vector):
            raise UnknownVariable(f"{name} is not a vector")
        return found

    def _values(self, name: str, other: str | None = None) -> Vector:
        """A vector by its name, or a whole column. Columns of one table named together share a scan."""
        if "." not in name:
            return self.vector(name)
        table, column = self.catalog.column(name)
        inst, frame = selection.whole(table)
        return Vector(frame, selection.named(inst, column))

    def _together(self, names: list[str]) -> list[Vector | Scalar]:
        frames: dict = {}
        out = []
        for name in names:
            if "." not in name:
                out.append(self._bound(name))
                continue
            table, column = self.catalog.column(name)
            if table.full_name not in frames:
                frames[table.full_name] = selection.whole(table)
            inst, frame = frames[table.full_name]
            out.append(Vector(frame, selection.named(inst, column)))
        return out

    # Statements

    def run(self, s: Statement) -> Iterator[str] | None:
        done = getattr(self, f"_{s.op}")(s)
        if isinstance(done, Iterator):
            return done
        if done is not None:
            results = done if isinstance(done, tuple) else (done,)
            self.pool.update(zip(s.handles, results, strict=True))
        return None

    def _create(self, s: Statement):
        match s.args:
            case ("db", name):
                self.catalog.create_db(name.value)
            case ("tbl", name, db, slots):
                self.catalog.create_table(name.value, db, slots)
            case ("col", name, table):
                self.catalog.create_column(name.value, table)
            case ("idx", column, kind, clustering):
                self.catalog.create_index(column, kind, clustering)

    def _use(self, s: Statement):
        for name in s.args:
            self.catalog.db(name)

    def _load(self, s: Statement):
        path = s.args[0].value
        head = self.spark.read.text(path).first()
        if head is None:
            raise ParseError(f"{path} has no head line")
        table = self.catalog.table(head[0].split(",")[0].strip().rpartition(".")[0])
        table.load_csv(path)

    def _relational_insert(self, s: Statement):
        self.catalog.table(s.args[0]).insert(list(s.args[1:]))

    def _relational_delete(self, s: Statement):
        changes.delete(self.catalog.table(s.args[0]), self.vector(s.args[1]))

    def _relational_update(self, s: Statement):
        table, column = self.catalog.column(s.args[0])
        changes.update(table, column, self.vector(s.args[1]), s.args[2])

    def _select(self, s: Statement):
        *names, low, high = s.args
        if len(names) == 2:
            return selection.refine(self.vector(names[0]), self._values(names[1]), low, high)
        if "." in names[0]:
            return selection.select(*self.catalog.column(names[0]), low, high)
        return selection.select_values(self.vector(names[0]), low, high)

    def _fetch(self, s: Statement):
        return selection.fetch(*self.catalog.column(s.args[0]), self.vector(s.args[1]))

    def _join(self, s: Statement):
        return joins.join(*(self.vector(n) for n in s.args[:4]), *s.args[4:])

    def _aggregate(self, s: Statement):
        name = s.args[-1]
        if len(s.args) == 2:
            positions = None if s.args[0] is None else self.vector(s.args[0])
            return aggregates.extremum(s.op, positions, self._values(name))
        values = self._values(name)
        return aggregates.of_column(s.op, *self.catalog.column(name), values) if "." in name else aggregates.aggregate(s.op, values)

    _sum = _avg = _min = _max = _aggregate

    def _add(self, s: Statement):
        a, b = self._together(list(s.args))
        for x in (a, b):
            if not isinstance(x, Vector):
                raise UnknownVariable(f"{s.op} takes vectors")
        return arithmetic.combine("+" if s.op == "add" else "-", a, b)

    _sub = _add

    def _print(self, s: Statement) -> Iterator[str]:
        return printing.lines(self._together(list(s.args)))

    def _batch_queries(self, s: Statement):
        self.queue = []

    def _batch_execute(self, s: Statement) -> Iterator[str] | None:
        """The queued selections of each table share a scan; then the rest runs in order.
        A selection is shared unless something queued before it changes its table. Rows kept for the batch before
        are let go: vectors of that one read the table again."""
        queue, self.queue = self.queue or [], None
        self._release()
        groups: dict[str, list[int]] = {}
        wanted: dict[str, list[str]] = {}
        fixed = True
        for i, q in enumerate(queue):
            fixed = fixed and q.op in ("select", "fetch", "print", "sum", "avg", "min", "max", "add", "sub", "join", "timer")
            if fixed and q.op == "select" and len(q.args) == 3 and "." in q.args[0]:
                groups.setdefault(q.args[0].rpartition(".")[0], []).append(i)
            elif q.op == "fetch":
                wanted.setdefault(q.args[0].rpartition(".")[0], []).append(q.args[0].rpartition(".")[2])
        ready: dict[int, Vector] = {}
        for name, at in groups.items():
            table = self.catalog.table(name)
            ranges = [(self.catalog.column(queue[i].args[0])[1], *queue[i].args[1:]) for i in at]
            vectors, kept = shared_scan.select_all(table, ranges, wanted.get(name, []))
            ready |= dict(zip(at, vectors, strict=True))
            self.kept += kept
        out = []
        for i, q in enumerate(queue):
            if i in ready:
                self.pool[q.handles[0]] = ready[i]
            elif (told := self.run(q)) is not None:
                out.append(told)
        return itertools.chain(*out) if out else None

    def _release(self):
        for df in self.kept:
            df.unpersist()
        self.kept = []

    def _timer(self, s: Statement) -> Iterator[str] | None:
        if s.args[0] == "start" or self.began is None:
            self.began = time.perf_counter()
            return None
        return iter([f"{time.perf_counter() - self.began:f}"])

    def _shutdown(self, s: Statement):
        self.catalog.flush()
        self.pool.clear()
        self._release()
