"""Statements over a socket."""

import threading
import time

import pytest

from vectide.errors import VectideError
from vectide.server import Client, serve
from vectide.session import Session


def test_clients_share_a_session_one_after_the_other(spark, tmp_path):
    path = str(tmp_path / "s")
    server = threading.Thread(target=serve, args=(path, Session(spark, f"file://{tmp_path}/db")))
    server.start()
    for _ in range(100):
        try:
            first = Client(path)
            break
        except OSError:
            time.sleep(0.1)
    for line in ('create(db,"d")', 'create(tbl,"t",d,2)', 'create(col,"a",d.t)', 'create(col,"b",d.t)', "relational_insert(d.t,1,10)", "relational_insert(d.t,2,-20)", "-- nothing", "p=select(d.t.a,null,null)"):
        assert list(first.ask(line)) == []
    assert list(first.ask("print(d.t.a,d.t.b)")) == ["1,10", "2,-20"]
    with pytest.raises(VectideError, match="UnknownVariable"):
        list(first.ask("print(x)"))
    with pytest.raises(VectideError, match="ParseError"):
        list(first.ask("what is this"))
    first.close()
    second = Client(path)
    assert list(second.ask("q=select(d.t.a,2,3)")) == [] and list(second.ask("v=fetch(d.t.b,q)")) == []
    assert list(second.ask("print(v)")) == ["-20"]
    assert list(second.ask("shutdown")) == []
    second.close()
    server.join(20)
    assert not server.is_alive() and not (tmp_path / "s").exists()
