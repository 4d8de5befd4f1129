"""Random scripts against lists."""

import random

import pytest

from vectide.session import Session


@pytest.mark.parametrize("seed", range(4))
def test_random_scripts(spark, tmp_path, seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 40)
    cols = {c: [rng.randrange(-5, 6) for _ in range(n)] for c in "abc"}
    s = Session(spark, f"file://{tmp_path}/db")
    path = tmp_path / "t.csv"
    path.write_text("d.t.a,d.t.b,d.t.c\n" + "".join(f"{x},{y},{z}\n" for x, y, z in zip(*cols.values(), strict=True)))
    list(s.script('create(db,"d")\ncreate(tbl,"t",d,3)\n' + "".join(f'create(col,"{c}",d.t)\n' for c in "abc") + f'load("{path}")'))
    held: dict[str, list[int]] = {}
    word = lambda x: "null" if x is None else str(x)
    ok = lambda v, lo, hi: (lo is None or v >= lo) and (hi is None or v < hi)
    for k in range(12):
        lo, hi = (rng.choice([None, rng.randrange(-6, 3)]), rng.choice([None, rng.randrange(-2, 7)]))
        c, d = rng.choice("abc"), rng.choice("abc")
        p = f"p{rng.randrange(k)}" if k else None
        if not k or rng.random() < 0.4:
            s.execute(f"p{k}=select(d.t.{c},{word(lo)},{word(hi)})")
            held[f"p{k}"] = [i for i, v in enumerate(cols[c]) if ok(v, lo, hi)]
        elif rng.random() < 0.5:
            list(s.script(f"v{k}=fetch(d.t.{c},{p})\np{k}=select({p},v{k},{word(lo)},{word(hi)})"))
            held[f"p{k}"] = [i for i in held[p] if ok(cols[c][i], lo, hi)]
        else:
            q = f"p{rng.randrange(k)}"
            list(s.script(f"v{k}=fetch(d.t.{c},{p})\nw{k}=fetch(d.t.{d},{q})\np{k},q{k}=join(v{k},{p},w{k},{q},hash)"))
            pairs = [(i, j) for j in held[q] for i in held[p] if cols[c][i] == cols[d][j]]
            held[f"p{k}"], held[f"q{k}"] = [i for i, _ in pairs], [j for _, j in pairs]
            if len(pairs) > 400:
                s.execute(f"p{k}=select(d.t.{c},0,1)")
                held[f"p{k}"] = [i for i, v in enumerate(cols[c]) if v == 0]
    for name in rng.sample(sorted(held), 5):
        got = next(s.script(f"x=fetch(d.t.b,{name})\ny=add(x,x)\ns=sum(x)\nprint({name},y,s)"))
        rows = held[name]
        total = sum(cols["b"][i] for i in rows)
        assert got == "\n".join(f"{i},{2 * cols['b'][i]},{total}" for i in rows)
