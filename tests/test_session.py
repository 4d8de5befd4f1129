"""Scripts and what they print."""

import io

import pytest

from vectide.cli import main
from vectide.errors import ArityError, LengthMismatch, UnknownObject, UnknownVariable
from vectide.session import Session


@pytest.fixture
def session(spark, tmp_path):
    return Session(spark, f"file://{tmp_path}/db")


def out(session, text):
    return list(session.script(text))


def filled(session, rows, columns=("a", "b"), index=""):
    lines = ['create(db,"d")', f'create(tbl,"t",d,{len(columns)})', *(f'create(col,"{c}",d.t)' for c in columns), index]
    lines += [f"relational_insert(d.t,{','.join(map(str, r))})" for r in rows]
    out(session, "\n".join(lines))
    return session


def csv(tmp_path, text, name="x.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


SAMPLE = 'create(db,"db1")\ncreate(tbl,"tbl1",db1,2)\ncreate(col,"col1",db1.tbl1)\ncreate(col,"col2",db1.tbl1)\n'
ASK = "s1=select(db1.tbl1.col1,-45869,34131)\nf1=fetch(db1.tbl1.col2,s1)\na1=sum(f1)\nprint(a1)"


def sample(tmp_path):
    return csv(tmp_path, "db1.tbl1.col1,db1.tbl1.col2\n" + "".join(f"{i},{i + 10}\n" for i in range(1000)))


def test_sample_without_its_inserts(session, tmp_path):
    out(session, SAMPLE + f'load("{sample(tmp_path)}")')
    with pytest.raises(UnknownObject):
        session.execute("relational_insert(db1tbl1,-1,-11)")
    assert out(session, ASK) == ["509500"]


def test_sample_with_its_inserts(session, tmp_path):
    rows = "\n".join(f"relational_insert(db1.tbl1,-{i},-{i * 11})" for i in range(1, 10))
    assert out(session, SAMPLE + f'load("{sample(tmp_path)}")\n{rows}\n{ASK}') == ["509005"]


def test_load_binds_by_place_and_keeps_order(session, tmp_path):
    out(session, 'create(db,"foo")\ncreate(tbl,"t1",foo,2)\ncreate(col,"a",foo.t1)\ncreate(col,"b",foo.t1)')
    path = csv(tmp_path, "foo.t1.a,foo.t1.b\n10,-23\n-22,910")
    assert out(session, f'load("{path}")\ns=select(foo.t1.a,null,null)\nx=fetch(foo.t1.b,s)\nprint(x)') == ["-23\n910"]


def test_empty_range(session):
    filled(session, [(1, 2), (5, 6)])
    assert out(session, "s=select(d.t.a,5,5)\nx=fetch(d.t.b,s)\nu=sum(x)\nv=avg(x)\nw=min(x)\nprint(u)\nprint(v)\nprint(w)\nprint(x)") == ["0", "0.00", "", ""]


def test_half_open(session):
    filled(session, [(1, 0), (2, 0), (3, 0)])
    assert out(session, "s=select(d.t.a,1,3)\nprint(s)") == ["0\n1"]


def test_wrap(session):
    filled(session, [(2147483647, 1), (-2147483648, -1)])
    assert out(session, "x=add(d.t.a,d.t.b)\nprint(x)\ny=sub(d.t.a,d.t.b)\nprint(y)") == ["-2147483648\n2147483647", "2147483646\n-2147483647"]


JOIN = "p1=select(d.t.g,1,2)\np2=select(d.t.g,2,3)\nv1=fetch(d.t.a,p1)\nv2=fetch(d.t.a,p2)\nr1,r2=join(v1,p1,v2,p2{})\nprint(r1,r2)"
PAIRS = [(7, 1), (7, 1), (8, 1), (0, 0), (0, 0), (8, 2), (7, 2)]


@pytest.mark.parametrize("kind, rows", [(",hash", "2,5\n0,6\n1,6"), ("", "2,5\n0,6\n1,6"), (",nested-loop", "0,6\n1,6\n2,5"), (",sort-merge", "2,5\n0,6\n1,6")])
def test_join_order(session, kind, rows):
    filled(session, PAIRS, ("a", "g"))
    assert out(session, JOIN.format(kind)) == [rows]


def test_join_of_a_vector_with_itself(session):
    filled(session, [(1, 10), (1, 20), (2, 30)])
    text = "p=select(d.t.a,null,null)\nv=fetch(d.t.a,p)\nr1,r2=join(v,p,v,p,hash)\nx=fetch(d.t.b,r1)\ny=fetch(d.t.b,r2)\nprint(x,y)"
    assert out(session, text) == ["10,10\n20,10\n10,20\n20,20\n30,30"]


def test_float_text(session):
    filled(session, [(1, 0), (2, 0)])
    assert out(session, "x=avg(d.t.a)\ny=sum(d.t.a)\nprint(x)\nprint(y,x)") == ["1.50", "3,1.50"]


def test_float_text_rounds_as_binary(session):
    filled(session, [(0, 0)] * 7 + [(1, 0)])
    assert out(session, "x=avg(d.t.a)\nprint(x)") == ["0.12"]


@pytest.mark.parametrize("kind", ["sorted,clustered", "sorted,unclustered", "btree,clustered", "btree,unclustered"])
def test_index(session, kind):
    filled(session, [(3, 30), (1, 10), (2, 20), (1, 11)], index=f"create(idx,d.t.a,{kind})")
    assert out(session, "s=select(d.t.a,null,null)\nx=fetch(d.t.a,s)\ny=fetch(d.t.b,s)\nprint(x)\nprint(s)\nprint(s,y)") == ["1\n1\n2\n3", "1\n3\n2\n0", "1,10\n3,11\n2,20\n0,30"]
    assert out(session, "relational_insert(d.t,0,5)\ns=select(d.t.a,0,2)\nx=fetch(d.t.b,s)\nprint(x)\ny=fetch(d.t.a,s)\nz=select(s,y,1,null)\nprint(z)") == ["5\n10\n11", "1\n3"]


def test_index_with_bound_zero(session):
    filled(session, [(-1, 0), (0, 0), (1, 0)], index="create(idx,d.t.a,sorted,clustered)")
    assert out(session, "s=select(d.t.a,0,null)\nx=fetch(d.t.a,s)\nprint(x)") == ["0\n1"]


def test_extrema_with_positions(session):
    filled(session, [(5, 0), (2, 1), (7, 1), (2, 1), (1, 0)])
    text = "p=select(d.t.b,1,2)\nv=fetch(d.t.a,p)\nq,m=min(p,v)\nprint(q)\nprint(m)\nr,n=max(null,v)\nprint(r)\nprint(n)\nprint(q,m)"
    assert out(session, text) == ["1\n3", "2", "1", "7", "1,2\n3,2"]


def test_select_over_values(session):
    filled(session, [(5, 1), (6, 0), (7, 1), (8, 1)])
    assert out(session, "p=select(d.t.b,1,2)\nv=fetch(d.t.a,p)\nq=select(v,6,null)\nprint(q)") == ["1\n2"]


def test_delete_and_update_leave_old_vectors_alone(session):
    filled(session, [(1, 10), (2, 20), (3, 30)])
    assert out(session, "p=select(d.t.a,2,3)\nv=fetch(d.t.b,p)\nrelational_update(d.t.b,p,99)\nprint(v)\nw=select(d.t.a,null,null)\nx=fetch(d.t.b,w)\nprint(x)") == ["20", "10\n99\n30"]
    assert out(session, "relational_delete(d.t,p)\ny=select(d.t.a,null,null)\nz=fetch(d.t.a,y)\nprint(y,z)\nprint(x)") == ["0,1\n1,3", "10\n99\n30"]


def test_batch(session):
    filled(session, [(95, 1), (85, 2), (101, 3), (70, 4)])
    text = "batch_queries()\na=select(d.t.a,90,100)\nb=select(d.t.a,80,90)\nc=select(d.t.a,95,105)\ni=fetch(d.t.b,a)\nprint(c)\nbatch_execute()\nprint(a)\nprint(b)\nprint(i)"
    assert out(session, text) == ["0\n2", "0", "1", "1"]


def test_whole_columns(session):
    filled(session, [(1, 10), (2, 20)])
    assert out(session, "print(d.t.b,d.t.a)\nm=max(d.t.b)\nn=min(d.t.a)\nprint(m,n)") == ["10,1\n20,2", "20,1"]


def test_lengths_must_agree(session):
    filled(session, [(1, 10), (2, 20)])
    out(session, "p=select(d.t.a,1,2)\nx=fetch(d.t.a,p)\nq=select(d.t.a,1,3)\ny=fetch(d.t.a,q)")
    with pytest.raises(LengthMismatch):
        session.execute("z=add(x,y)")


def test_vectors_of_different_frames_align_by_place(session):
    filled(session, [(1, 10), (2, 20), (3, 30), (4, 40)])
    assert out(session, "p=select(d.t.a,1,3)\nx=fetch(d.t.a,p)\nq=select(d.t.a,3,5)\ny=fetch(d.t.b,q)\nz=add(x,y)\nprint(z)\nprint(x,y)") == ["31\n42", "1,30\n2,40"]


def test_errors(session):
    filled(session, [(1, 2)])
    for line, error in (("print(nothing)", UnknownVariable), ("p=select(d.t.z,1,2)", UnknownObject), ("relational_insert(d.t,1)", ArityError), ("relational_insert(d.t,1,3000000000)", ArityError), ('create(col,"c",d.t)', UnknownObject)):
        with pytest.raises(error):
            session.execute(line)


def test_tables_outlive_the_session_and_vectors_do_not(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    first = filled(Session(spark, root), [(3, 1), (1, 2)], index="create(idx,d.t.a,sorted,clustered)")
    out(first, "p=select(d.t.a,null,null)\nshutdown")
    second = Session(spark, root)
    with pytest.raises(UnknownVariable):
        second.execute("print(p)")
    assert out(second, 'create(db,"d")\np=select(d.t.a,null,null)\nx=fetch(d.t.b,p)\nprint(x)\ns=sum(d.t.a)\nprint(s)') == ["2\n1", "4"]


def test_timer_and_command_line(spark, tmp_path):
    text, errors = io.StringIO(), io.StringIO()
    main(['create(db,"d")', "use d", "timer(start)", "print(x)", "timer(end)", "shutdown", "print(y)"], f"file://{tmp_path}/cli", text, errors)
    assert float(text.getvalue()) >= 0 and errors.getvalue().count("UnknownVariable") == 1


@pytest.mark.parametrize("index", ["", "create(idx,d.t.a,sorted,unclustered)", "create(idx,d.t.a,sorted,clustered)"])
def test_a_fetch_sees_the_version_of_its_positions(session, index):
    filled(session, [(1, 10), (2, 20)], index=index)
    text = "p=select(d.t.a,null,null)\nq=select(d.t.a,2,3)\nrelational_update(d.t.b,q,77)\nv=fetch(d.t.b,p)\nprint(v)\nr=select(d.t.a,null,null)\nw=fetch(d.t.b,r)\nprint(w)"
    assert out(session, text) == ["10\n20", "10\n77"]


def test_changes_outlive_a_session_that_never_shuts_down(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    filled(Session(spark, root), [(3, 1), (1, 2)])
    third = Session(spark, root)
    assert out(third, "p=select(d.t.a,null,null)\nx=fetch(d.t.b,p)\nprint(x)") == ["1\n2"]
    out(third, "relational_insert(d.t,9,9)\nq=select(d.t.a,3,4)\nrelational_delete(d.t,q)\nrelational_insert(d.t,8,8)")
    assert out(Session(spark, root), "p=select(d.t.a,null,null)\nx=fetch(d.t.a,p)\nprint(p,x)") == ["0,1\n1,9\n2,8"]
    assert len([p for p in (tmp_path / "db/d").iterdir() if p.name.startswith("manifest")]) == 1


def test_a_manifest_half_written_does_not_count(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    filled(Session(spark, root), [(3, 1)])
    (tmp_path / "db/d/manifest-999999999999.json.0.tmp").write_text("{")
    assert out(Session(spark, root), "s=sum(d.t.a)\nprint(s)") == ["3"]


def test_small_folders_become_one(spark, tmp_path):
    s = Session(spark, f"file://{tmp_path}/db")
    filled(s, [])
    for i in range(20):
        out(s, f"relational_insert(d.t,{i},0)\np=select(d.t.a,null,null)")
    assert len(s.catalog.table("d.t").version.folders) < 16
    assert out(s, "v=fetch(d.t.a,p)\nprint(v)\nx=sum(d.t.a)\nprint(x)") == ["\n".join(map(str, range(20))), "190"]


def test_files_of_a_folder_load_in_the_order_of_their_names(session, spark, tmp_path):
    out(session, 'create(db,"d")\ncreate(tbl,"t",d,1)\ncreate(col,"a",d.t)')
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("d.t.a\n0\n1\n2\n")
    (folder / "b.csv").write_text("d.t.a\n" + "".join(f"{100 + i}\n" for i in range(50)))
    (folder / "c.csv").write_text("d.t.a\n7")
    out(session, f'load("file://{folder}")\nload("file://{folder}/c.csv")')
    assert out(session, "p=select(d.t.a,null,null)\nv=fetch(d.t.a,p)\nprint(v)") == ["\n".join(map(str, [0, 1, 2, *range(100, 150), 7, 7]))]


def test_an_empty_file_loads_no_row(session, tmp_path):
    out(session, 'create(db,"d")\ncreate(tbl,"t",d,1)\ncreate(col,"a",d.t)')
    out(session, f'load("{csv(tmp_path, "d.t.a" + chr(10))}")')
    assert out(session, "s=sum(d.t.a)\nprint(s)") == ["0"]


def test_a_print_streams(session):
    filled(session, [(i, -i) for i in range(5)])
    lines = session.stream("print(d.t.a,d.t.b)")
    assert next(lines) == "0,0" and list(lines) == ["1,-1", "2,-2", "3,-3", "4,-4"]
    assert list(session.stream("p=select(d.t.a,1,2)")) == []


def test_the_shared_folder_must_be_named_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from vectide.sources.storage import scratch_root

    held = {}
    conf = SimpleNamespace(get=lambda k, d: held.get(k, d), set=held.__setitem__)
    for master, fine in (("local[4]", True), ("local-cluster[2,1,512]", False), ("spark://host:7077", False), ("yarn", False)):
        held.clear()
        session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))
        if fine:
            assert scratch_root(session).startswith("file:")
        else:
            with pytest.raises(ValueError):
                scratch_root(session)


def test_scratch_can_be_cleared(spark):
    from pathlib import Path

    from vectide.sources import storage

    df = storage.scratch_table(spark.range(5), "some")
    folder = Path(df.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and df.count() == 5
    storage.clear_scratch(spark)
    assert not folder.exists()
