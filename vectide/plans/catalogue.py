"""The registered queries of the column language, each beside its SQL.

Every query runs statements of the language in a session over the given tables and returns
the vectors it names, as aligned columns (rows in no order) or scalars as one row. Positions are the
places of rows in their Parquet file; in SQL they are row numbers less one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.functions.ints import wrapped
from vectide.operators import changes, printing, shared_scan
from vectide.plans.vectors import POS, Scalar, Vector, ordinals, widest
from vectide.session import Session
from vectide.sources.catalog import positioned

#: Columns of the test tables that are used as 32-bit integers.
INTS = {
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"],
    "orders": ["o_orderkey", "o_custkey"],
}
Query = Callable[[SparkSession, str], DataFrame]


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session with the tables attached under the database ``t``."""
    s = Session(spark)
    for name, columns in INTS.items():
        rows = positioned(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))
        s.catalog.attach("t", name, rows.select(POS, *[F.col(c).cast("int").alias(c) for c in columns]))
    return s


def result(s: Session, **named: str) -> DataFrame:
    """The vectors called by these names as columns, or the scalars as a row."""
    found = {k: s.pool[v] for k, v in named.items()}
    scalars = {k: v for k, v in found.items() if isinstance(v, Scalar)}
    if not scalars:
        return printing.table_of(list(found.values()), list(found))
    frames = widest(v.frame for v in scalars.values())
    if len(frames) > 1 or len(scalars) < len(found):
        raise ValueError("scalars of one frame make a row")
    sought = [F.expr(v.sql).alias(k) for k, v in scalars.items() if v.value is None]
    row = frames[0].df.agg(*sought) if sought else s.spark.range(1)
    return row.select(*[k if v.value is None else F.lit(v.value).cast("long").alias(k) for k, v in scalars.items()])


def scripted(lines: str, **named: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        for _ in s.script(lines):
            pass
        return result(s, **named)

    return run


LI = "WITH li AS (SELECT row_number() OVER () - 1 AS pos, CAST(l_orderkey AS INT) AS l_orderkey, CAST(l_partkey AS INT) AS l_partkey, CAST(l_suppkey AS INT) AS l_suppkey, l_linenumber, CAST(l_quantity AS INT) AS l_quantity FROM lineitem)"
BOTH = LI + ", o AS (SELECT row_number() OVER () - 1 AS pos, CAST(o_orderkey AS INT) AS o_orderkey, CAST(o_custkey AS INT) AS o_custkey FROM orders)"
TEN = "p=select(t.lineitem.l_quantity,10,20)\n"
JOINED = """
p1=select(t.lineitem.l_quantity,40,null)
p2=select(t.orders.o_custkey,null,500)
v1=fetch(t.lineitem.l_orderkey,p1)
v2=fetch(t.orders.o_orderkey,p2)
r1,r2=join(v1,p1,v2,p2,{})
"""
JOIN_FROM = "FROM li JOIN o ON li.l_orderkey = o.o_orderkey WHERE li.l_quantity >= 40 AND o.o_custkey < 500"

#: name: (script, result columns, SQL)
SCRIPTS: dict[str, tuple[str, dict[str, str], str]] = {
    "select_range": (TEN, {"pos": "p"}, f"{LI} SELECT pos FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "select_low_null": ("p=select(t.lineitem.l_quantity,null,5)", {"pos": "p"}, f"{LI} SELECT pos FROM li WHERE l_quantity < 5"),
    "select_high_null": ("p=select(t.lineitem.l_quantity,45,null)", {"pos": "p"}, f"{LI} SELECT pos FROM li WHERE l_quantity >= 45"),
    "select_zero_bound": ("p=select(t.lineitem.l_suppkey,0,3)", {"pos": "p"}, f"{LI} SELECT pos FROM li WHERE l_suppkey >= 0 AND l_suppkey < 3"),
    "select_refine": (
        TEN + "v=fetch(t.lineitem.l_linenumber,p)\nq=select(p,v,2,4)",
        {"pos": "q"},
        f"{LI} SELECT pos FROM li WHERE l_quantity >= 10 AND l_quantity < 20 AND l_linenumber >= 2 AND l_linenumber < 4",
    ),
    "select_refine_twice": (
        "create(idx,t.lineitem.l_partkey,sorted,clustered)\np=select(t.lineitem.l_partkey,100,900)\nv=fetch(t.lineitem.l_quantity,p)\nq=select(p,v,10,30)\nw=fetch(t.lineitem.l_linenumber,q)\nr=select(q,w,null,4)\nx=fetch(t.lineitem.l_partkey,r)",
        {"pos": "r", "l_partkey": "x"},
        f"{LI} SELECT pos, l_partkey FROM li WHERE l_partkey >= 100 AND l_partkey < 900 AND l_quantity >= 10 AND l_quantity < 30 AND l_linenumber < 4",
    ),
    "select_values": (
        TEN + "v=fetch(t.lineitem.l_partkey,p)\nq=select(v,100,200)",
        {"place": "q"},
        f"{LI} SELECT place FROM (SELECT row_number() OVER (ORDER BY pos) - 1 AS place, l_partkey FROM li WHERE l_quantity >= 10 AND l_quantity < 20) x WHERE l_partkey >= 100 AND l_partkey < 200",
    ),
    "fetch_values": (TEN + "v=fetch(t.lineitem.l_partkey,p)", {"l_partkey": "v"}, f"{LI} SELECT l_partkey FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "fetch_multi": (
        TEN + "a=fetch(t.lineitem.l_orderkey,p)\nb=fetch(t.lineitem.l_partkey,p)\nc=fetch(t.lineitem.l_suppkey,p)",
        {"l_orderkey": "a", "l_partkey": "b", "l_suppkey": "c"},
        f"{LI} SELECT l_orderkey, l_partkey, l_suppkey FROM li WHERE l_quantity >= 10 AND l_quantity < 20",
    ),
    "sum_vector": (TEN + "v=fetch(t.lineitem.l_partkey,p)\ns=sum(v)", {"total": "s"}, f"{LI} SELECT CAST(COALESCE(SUM(l_partkey), 0) AS BIGINT) AS total FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "sum_column": ("s=sum(t.lineitem.l_partkey)", {"total": "s"}, f"{LI} SELECT CAST(COALESCE(SUM(l_partkey), 0) AS BIGINT) AS total FROM li"),
    "avg_vector": (TEN + "v=fetch(t.lineitem.l_partkey,p)\na=avg(v)", {"mean": "a"}, f"{LI} SELECT COALESCE(AVG(CAST(l_partkey AS DOUBLE)), 0) AS mean FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "avg_empty": ("p=select(t.lineitem.l_quantity,5,5)\nv=fetch(t.lineitem.l_partkey,p)\na=avg(v)\ns=sum(v)\nm=min(v)", {"mean": "a", "total": "s", "least": "m"}, "SELECT CAST(0 AS DOUBLE) AS mean, CAST(0 AS BIGINT) AS total, CAST(NULL AS BIGINT) AS least"),
    "avg_column": ("a=avg(t.lineitem.l_quantity)", {"mean": "a"}, f"{LI} SELECT AVG(CAST(l_quantity AS DOUBLE)) AS mean FROM li"),
    "min_vector": (TEN + "v=fetch(t.lineitem.l_partkey,p)\nm=min(v)", {"least": "m"}, f"{LI} SELECT CAST(MIN(l_partkey) AS BIGINT) AS least FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "max_vector": (TEN + "v=fetch(t.lineitem.l_partkey,p)\nm=max(v)", {"most": "m"}, f"{LI} SELECT CAST(MAX(l_partkey) AS BIGINT) AS most FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "min_column": ("m=min(t.lineitem.l_orderkey)", {"least": "m"}, f"{LI} SELECT CAST(MIN(l_orderkey) AS BIGINT) AS least FROM li"),
    "max_column": ("m=max(t.lineitem.l_orderkey)", {"most": "m"}, f"{LI} SELECT CAST(MAX(l_orderkey) AS BIGINT) AS most FROM li"),
    "argmin": (
        "p=select(t.lineitem.l_quantity,10,null)\nv=fetch(t.lineitem.l_partkey,p)\nq,m=min(p,v)",
        {"pos": "q"},
        f"{LI} SELECT pos FROM li WHERE l_quantity >= 10 AND l_partkey = (SELECT MIN(l_partkey) FROM li WHERE l_quantity >= 10)",
    ),
    "argmax": (
        "p=select(t.lineitem.l_quantity,10,null)\nv=fetch(t.lineitem.l_partkey,p)\nq,m=max(p,v)",
        {"pos": "q"},
        f"{LI} SELECT pos FROM li WHERE l_quantity >= 10 AND l_partkey = (SELECT MAX(l_partkey) FROM li WHERE l_quantity >= 10)",
    ),
    "argmin_null_positions": (
        "p=select(t.lineitem.l_quantity,10,null)\nv=fetch(t.lineitem.l_partkey,p)\nq,m=min(null,v)",
        {"place": "q"},
        f"{LI} SELECT place FROM (SELECT row_number() OVER (ORDER BY pos) - 1 AS place, l_partkey, MIN(l_partkey) OVER () AS m FROM li WHERE l_quantity >= 10) x WHERE l_partkey = m",
    ),
    "add_vectors": (
        TEN + "a=fetch(t.lineitem.l_partkey,p)\nb=fetch(t.lineitem.l_suppkey,p)\nc=add(a,b)",
        {"total": "c"},
        f"{LI} SELECT {wrapped('+', 'l_partkey', 'l_suppkey')} AS total FROM li WHERE l_quantity >= 10 AND l_quantity < 20",
    ),
    "sub_vectors": (
        TEN + "a=fetch(t.lineitem.l_partkey,p)\nb=fetch(t.lineitem.l_suppkey,p)\nc=sub(a,b)",
        {"rest": "c"},
        f"{LI} SELECT {wrapped('-', 'l_partkey', 'l_suppkey')} AS rest FROM li WHERE l_quantity >= 10 AND l_quantity < 20",
    ),
    "add_columns": ("c=add(t.lineitem.l_partkey,t.lineitem.l_suppkey)", {"total": "c"}, f"{LI} SELECT {wrapped('+', 'l_partkey', 'l_suppkey')} AS total FROM li"),
    "add_wrap": (
        "a=add(t.lineitem.l_partkey,t.lineitem.l_partkey)\n" + "a=add(a,a)\n" * 22,
        {"total": "a"},
        f"{LI} SELECT CAST(((CAST(l_partkey AS BIGINT) * 8388608 + 2147483648) & 4294967295) - 2147483648 AS INT) AS total FROM li",
    ),
    "add_cross_frame": (
        "p=select(t.lineitem.l_linenumber,1,2)\nq=select(t.lineitem.l_linenumber,1,2)\na=fetch(t.lineitem.l_partkey,p)\nb=fetch(t.lineitem.l_suppkey,q)\nc=add(a,b)",
        {"total": "c"},
        f"{LI} SELECT {wrapped('+', 'l_partkey', 'l_suppkey')} AS total FROM li WHERE l_linenumber >= 1 AND l_linenumber < 2",
    ),
    "join_hash": (JOINED.format("hash"), {"p1": "r1", "p2": "r2"}, f"{BOTH} SELECT li.pos AS p1, o.pos AS p2 {JOIN_FROM}"),
    "join_nested_loop": (JOINED.format("nested-loop"), {"p1": "r1", "p2": "r2"}, f"{BOTH} SELECT li.pos AS p1, o.pos AS p2 {JOIN_FROM}"),
    "join_sort_merge": (JOINED.format("sort-merge"), {"p1": "r1", "p2": "r2"}, f"{BOTH} SELECT li.pos AS p1, o.pos AS p2 {JOIN_FROM}"),
    "join_many_to_many": (
        "p1=select(t.lineitem.l_quantity,null,2)\np2=select(t.lineitem.l_quantity,null,2)\nv1=fetch(t.lineitem.l_suppkey,p1)\nv2=fetch(t.lineitem.l_suppkey,p2)\nr1,r2=join(v1,p1,v2,p2,hash)",
        {"p1": "r1", "p2": "r2"},
        f"{LI} SELECT a.pos AS p1, b.pos AS p2 FROM li a JOIN li b ON a.l_suppkey = b.l_suppkey WHERE a.l_quantity < 2 AND b.l_quantity < 2",
    ),
    "join_self": (
        "p=select(t.lineitem.l_quantity,null,2)\nv=fetch(t.lineitem.l_orderkey,p)\nr1,r2=join(v,p,v,p,hash)\nx=fetch(t.lineitem.l_partkey,r1)\ny=fetch(t.lineitem.l_partkey,r2)",
        {"x": "x", "y": "y"},
        f"{LI} SELECT a.l_partkey AS x, b.l_partkey AS y FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey WHERE a.l_quantity < 2 AND b.l_quantity < 2",
    ),
    "join_then_fetch_sum": (
        JOINED.format("hash") + "f=fetch(t.lineitem.l_partkey,r1)\ng=fetch(t.orders.o_custkey,r2)\ns=sum(f)\na=avg(g)",
        {"total": "s", "mean": "a"},
        f"{BOTH} SELECT CAST(SUM(l_partkey) AS BIGINT) AS total, AVG(CAST(o_custkey AS DOUBLE)) AS mean {JOIN_FROM}",
    ),
    "join_after_index": (
        "create(idx,t.lineitem.l_quantity,sorted,clustered)" + JOINED.format("hash") + "f=fetch(t.lineitem.l_partkey,r1)",
        {"p1": "r1", "p2": "r2", "l_partkey": "f"},
        f"{BOTH} SELECT li.pos AS p1, o.pos AS p2, l_partkey {JOIN_FROM}",
    ),
    "index_clustered_fetch": (
        "create(idx,t.lineitem.l_partkey,sorted,clustered)\np=select(t.lineitem.l_partkey,100,200)\na=fetch(t.lineitem.l_partkey,p)\nb=fetch(t.lineitem.l_suppkey,p)",
        {"l_partkey": "a", "l_suppkey": "b"},
        f"{LI} SELECT l_partkey, l_suppkey FROM li WHERE l_partkey >= 100 AND l_partkey < 200",
    ),
    "index_btree_select": (
        "create(idx,t.lineitem.l_partkey,btree,unclustered)\np=select(t.lineitem.l_partkey,null,150)\nb=fetch(t.lineitem.l_quantity,p)",
        {"pos": "p", "l_quantity": "b"},
        f"{LI} SELECT pos, l_quantity FROM li WHERE l_partkey < 150",
    ),
    "batch_mixed_columns": (
        "batch_queries()\np=select(t.lineitem.l_quantity,10,20)\nq=select(t.lineitem.l_partkey,100,200)\nr=select(t.orders.o_custkey,null,500)\nv=fetch(t.lineitem.l_suppkey,p)\nw=fetch(t.lineitem.l_suppkey,q)\nbatch_execute()\nx=select(p,v,5,9)\ny=fetch(t.lineitem.l_orderkey,x)",
        {"pos": "x", "l_orderkey": "y"},
        f"{LI} SELECT pos, l_orderkey FROM li WHERE l_quantity >= 10 AND l_quantity < 20 AND l_suppkey >= 5 AND l_suppkey < 9",
    ),
    "print_tuple": (
        TEN + "a=fetch(t.lineitem.l_orderkey,p)\nb=fetch(t.lineitem.l_quantity,p)",
        {"l_orderkey": "a", "l_quantity": "b"},
        f"{LI} SELECT l_orderkey, l_quantity FROM li WHERE l_quantity >= 10 AND l_quantity < 20",
    ),
    "scalars_of_one_frame": (
        TEN + "v=fetch(t.lineitem.l_partkey,p)\na=sum(v)\nb=avg(v)\nc=min(v)\nd=max(v)",
        {"total": "a", "mean": "b", "least": "c", "most": "d"},
        f"{LI} SELECT CAST(SUM(l_partkey) AS BIGINT) AS total, AVG(CAST(l_partkey AS DOUBLE)) AS mean, CAST(MIN(l_partkey) AS BIGINT) AS least, CAST(MAX(l_partkey) AS BIGINT) AS most FROM li WHERE l_quantity >= 10 AND l_quantity < 20",
    ),
}


def print_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar beside a vector: it stands on every row."""
    s = session(spark, sf_dir)
    list(s.script(TEN + "v=fetch(t.lineitem.l_partkey,p)\ns=sum(v)"))
    total, values = s.pool["s"], s.pool["v"]
    one = total.frame.df.agg(F.expr(total.sql).alias("total"))
    return values.frame.df.select(F.expr(values.sql).alias("l_partkey"), one.scalar().alias("total"))


def batch_shared_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, pos) of two ranges over one scan."""
    table = session(spark, sf_dir).catalog.table("t.lineitem")
    return shared_scan.tagged(table, [("l_quantity", None, 5), ("l_quantity", 3, 8)]).withColumnRenamed(POS, "pos")


def index_sorted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place and position of the rows of an indexed select, in the order that print shows."""
    s = session(spark, sf_dir)
    list(s.script("create(idx,t.lineitem.l_partkey,sorted,unclustered)\np=select(t.lineitem.l_partkey,100,300)"))
    p: Vector = s.pool["p"]
    return ordinals(p.frame, [p.sql], ["pos"], "place").select("place", "pos")


def join_order(kind: str) -> Query:
    """Place and positions of the pairs of a join, in the order that print shows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        list(s.script(JOINED.format(kind)))
        a, b = s.pool["r1"], s.pool["r2"]
        return ordinals(a.frame, [a.sql, b.sql], ["p1", "p2"], "place").select("place", "p1", "p2")

    return run


def _managed(spark: SparkSession, sf_dir: str, index: str = "", cuts: tuple[int, ...] = ()) -> Session:
    """The orders as a managed table ``m.o``, loaded from a CSV file written of them, or from a folder of files that
    begin at the positions ``cuts``."""
    s = Session(spark)
    rows = positioned(spark.read.parquet(f"{sf_dir}/orders.parquet").select(*INTS["orders"]))
    list(s.script(f'create(db,"m")\ncreate(tbl,"o",m,2)\ncreate(col,"k",m.o)\ncreate(col,"c",m.o)\n{index}'))
    csv = f"{s.catalog.root}/orders.csv"
    # In the order of positions, as a client's CSV file is.
    flat = rows.select(POS, F.col("o_orderkey").cast("int").alias("m.o.k"), F.col("o_custkey").cast("int").alias("m.o.c"))
    part = sum((F.when(F.col(POS) >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    flat.withColumn("_part", part).repartitionById(len(cuts) + 1, "_part").sortWithinPartitions(POS).drop(POS, "_part").write.csv(csv, header=True)
    s.execute(f'load("{csv}")')
    return s


def load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _managed(spark, sf_dir)
    return s.catalog.table("m.o").scan().select(F.col(POS).alias("pos"), "k", "c")


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _managed(spark, sf_dir)
    list(s.script("relational_insert(m.o,-1,-11)\nrelational_insert(m.o,-2,-22)"))
    return s.catalog.table("m.o").scan().select(F.col(POS).alias("pos"), "k", "c")


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _managed(spark, sf_dir)
    list(s.script("p=select(m.o.c,100,500)\nrelational_delete(m.o,p)"))
    return s.catalog.table("m.o").scan().select(F.col(POS).alias("pos"), "k", "c")


def update_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _managed(spark, sf_dir)
    list(s.script("p=select(m.o.c,100,500)\nrelational_update(m.o.c,p,7)"))
    return s.catalog.table("m.o").scan().select(F.col(POS).alias("pos"), "k", "c")


def load_csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of very different sizes: positions follow the files' names and not what Spark reads first."""
    s = _managed(spark, sf_dir, cuts=(3, 50, 700))
    return s.catalog.table("m.o").scan().select(F.col(POS).alias("pos"), "k", "c")


def index_of_loaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _managed(spark, sf_dir, "create(idx,m.o.c,sorted,clustered)")
    list(s.script("p=select(m.o.c,100,400)\nv=fetch(m.o.k,p)"))
    return result(s, pos="p", k="v")


def statistics_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, minimum and maximum of whole columns, as the table keeps them, after a load and an insert."""
    s = _managed(spark, sf_dir)
    list(s.script("relational_insert(m.o,-5,1000000)\na=sum(m.o.k)\nb=min(m.o.k)\nc=max(m.o.k)"))
    scalars = [s.pool[x] for x in "abc"]
    if any(x.value is None for x in scalars):
        raise ValueError("a statistic is missing")
    return spark.range(1).select(*[F.lit(x.value).cast("long").alias(n) for x, n in zip(scalars, ("total", "least", "most"), strict=True)])


def fetch_bound_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions bound before an update fetch the values of before."""
    s = _managed(spark, sf_dir, "create(idx,m.o.c,sorted,unclustered)")
    list(s.script("p=select(m.o.c,100,500)\nq=select(m.o.k,0,100)\nrelational_update(m.o.k,p,7)\nv=fetch(m.o.k,p)"))
    return result(s, pos="p", k="v")


def delete_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a delete leaves of a table that is only attached, under the old positions."""
    s = session(spark, sf_dir)
    list(s.script(TEN))
    rows = changes.remaining(s.catalog.table("t.lineitem"), s.pool["p"])
    return rows.select(F.col(POS).alias("pos"), "l_quantity")


O = "WITH o AS (SELECT row_number() OVER () - 1 AS pos, CAST(o_orderkey AS INT) AS k, CAST(o_custkey AS INT) AS c FROM orders)"
OTHERS: dict[str, tuple[Query, str]] = {
    "print_scalars": (print_scalars, f"{LI} SELECT l_partkey, CAST(SUM(l_partkey) OVER () AS BIGINT) AS total FROM li WHERE l_quantity >= 10 AND l_quantity < 20"),
    "batch_shared_scan": (batch_shared_scan, f"{LI} SELECT CAST(0 AS INT) AS qid, pos FROM li WHERE l_quantity < 5 UNION ALL SELECT CAST(1 AS INT), pos FROM li WHERE l_quantity >= 3 AND l_quantity < 8"),
    "index_sorted_order": (index_sorted_order, f"{LI} SELECT row_number() OVER (ORDER BY l_partkey, pos) - 1 AS place, pos FROM li WHERE l_partkey >= 100 AND l_partkey < 300"),
    "join_order": (join_order("hash"), f"{BOTH} SELECT row_number() OVER (ORDER BY o.pos, li.pos) - 1 AS place, li.pos AS p1, o.pos AS p2 {JOIN_FROM}"),
    "join_order_nested_loop": (
        join_order("nested-loop"),
        f"{BOTH}, n AS (SELECT (SELECT COUNT(*) FROM li WHERE l_quantity >= 40) >= (SELECT COUNT(*) FROM o WHERE o_custkey < 500) AS left_outer) "
        f"SELECT row_number() OVER (ORDER BY CASE WHEN left_outer THEN li.pos ELSE o.pos END, CASE WHEN left_outer THEN o.pos ELSE li.pos END) - 1 AS place, li.pos AS p1, o.pos AS p2 {JOIN_FROM.replace(' WHERE', ' CROSS JOIN n WHERE')}",
    ),
    "load_csv_files": (load_csv_files, f"{O} SELECT pos, k, c FROM o"),
    "index_of_loaded_table": (index_of_loaded_table, f"{O} SELECT pos, k FROM o WHERE c >= 100 AND c < 400"),
    "statistics_of_columns": (statistics_of_columns, f"{O} SELECT CAST(SUM(k) - 5 AS BIGINT) AS total, CAST(LEAST(MIN(k), -5) AS BIGINT) AS least, CAST(MAX(k) AS BIGINT) AS most FROM o"),
    "fetch_bound_version": (fetch_bound_version, f"{O} SELECT pos, k FROM o WHERE c >= 100 AND c < 500"),
    "load_csv": (load_csv, f"{O} SELECT pos, k, c FROM o"),
    "insert_rows": (insert_rows, f"{O} SELECT pos, k, c FROM o UNION ALL SELECT (SELECT COUNT(*) FROM o), -1, -11 UNION ALL SELECT (SELECT COUNT(*) FROM o) + 1, -2, -22"),
    "delete_rows": (delete_rows, f"{O} SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, k, c FROM o WHERE NOT (c >= 100 AND c < 500)"),
    "update_rows": (update_rows, f"{O} SELECT pos, k, CASE WHEN c >= 100 AND c < 500 THEN 7 ELSE c END AS c FROM o"),
    "delete_lineitem": (delete_lineitem, f"{LI} SELECT pos, l_quantity FROM li WHERE NOT (l_quantity >= 10 AND l_quantity < 20)"),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Select on both sides, join, fetch a column of either side through the join."""
    script = JOINED.format("hash") + "f=fetch(t.lineitem.l_partkey,r1)\ng=fetch(t.orders.o_custkey,r2)"
    return scripted(script, l_partkey="f", o_custkey="g")(spark, sf_dir)


def queries() -> dict[str, Query]:
    out = {name: scripted(lines, **columns) for name, (lines, columns, _) in SCRIPTS.items()}
    return out | {name: q for name, (q, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, _, sql) in SCRIPTS.items()} | {name: sql for name, (_, sql) in OTHERS.items()}
