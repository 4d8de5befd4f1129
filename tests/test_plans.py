"""Plans: pushed filters, one scan for a batch, no Python."""

import re

import pytest

from vectide.operators import printing
from vectide.plans import catalogue
from vectide.session import Session

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalogue.queries()["fetch_values"](spark, SF))
    assert "PushedFilters: [" in text and "l_extendedprice" not in text
    assert text.count("FileScan") == 1


def test_refinements_are_one_filter(spark):
    text = plan(catalogue.queries()["select_refine"](spark, SF))
    assert text.count("FileScan") == 1 and len(re.findall(r"Filter \(", text)) == 1 and "Join" not in text


def test_fetch_through_a_join_is_a_projection(spark):
    text = plan(catalogue.flagship(spark, SF))
    assert text.count("FileScan") == 2 and len(re.findall(r"\w+Join", text)) <= 2
    assert "Python" not in text and "Arrow" not in text


def test_sort_merge_is_a_hint(spark):
    assert "SortMergeJoin" in plan(catalogue.queries()["join_sort_merge"](spark, SF))


def test_a_batch_scans_once(spark):
    text = plan(catalogue.batch_shared_scan(spark, SF))
    assert text.count("FileScan") == 1 and "Generate explode" in text


def test_scalars_of_a_frame_share_an_aggregation(spark):
    s = catalogue.session(spark, SF)
    list(s.script("p=select(t.lineitem.l_quantity,10,20)\nv=fetch(t.lineitem.l_partkey,p)\na=sum(v)\nb=avg(v)\nc=min(v)"))
    assert len(printing.scalar_values([s.pool[x] for x in "abc"])) == 3


@pytest.mark.parametrize("name, scans", [("index_clustered_fetch", 1), ("index_btree_select", 2), ("select_refine_twice", 1), ("join_after_index", 2)])
def test_indexed_selects_read_their_copy(spark, name, scans):
    """The sorted copy is written and scanned; a clustered one holds what is fetched, an unclustered one joins the table."""
    df = catalogue.queries()[name](spark, SF)
    folders = {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
    assert sum(f.startswith("index-l_") for f in folders) == 1 and plan(df).count("FileScan") == scans
    assert "PushedFilters: [Is" in plan(df)


def test_a_copy_of_a_loaded_table_is_read(spark):
    df = catalogue.queries()["index_of_loaded_table"](spark, SF)
    assert all("/index-c-" in f for f in df.inputFiles()) and plan(df).count("FileScan") == 1


def test_batches_keep_rows_once_and_let_them_go(spark):
    s = catalogue.session(spark, SF)
    lines = "batch_queries()\n" + "\n".join(f"p{i}=select(t.lineitem.l_partkey,{i},{i + 50})" for i in range(40)) + "\nbatch_execute()"
    list(s.script(lines))
    (rows,) = s.kept
    assert rows.is_cached and rows.count() == s.catalog.table("t.lineitem").scan().where("l_partkey < 89").count()
    assert plan(s.pool["p3"].frame.df).count("InMemoryTableScan") == 1
    list(s.script("batch_queries()\nq=select(t.lineitem.l_partkey,5,6)\nbatch_execute()"))
    assert not rows.is_cached and s.pool["p3"].frame.df.count() > 0
    s.execute("shutdown")


def test_a_delete_writes_once(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db")
    list(s.script('create(db,"d")\ncreate(tbl,"t",d,1)\ncreate(col,"a",d.t)\n' + "\n".join(f"relational_insert(d.t,{i})" for i in range(9)) + "\np=select(d.t.a,2,4)"))
    s.execute("relational_delete(d.t,p)")
    assert len(list((tmp_path / "db/d/t").glob("part-*"))) == 2
    assert list(s.script("q=select(d.t.a,null,null)\nv=fetch(d.t.a,q)\nprint(q,v)")) == ["0,0\n1,1\n2,4\n3,5\n4,6\n5,7\n6,8"]
