import numpy as np
from corpus import closed

from trajframe.llm import inner_product as ip
from trajframe.llm import near_lattice as nl

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, key string, length string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "u", "k", "l") for i, v in rows], SCHEMA)


def clustered(n=150, width=32, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, width))
    rows = [(i, (base[i % 12] + rng.normal(size=width) * (0.02 if i % 3 else 0.2)).astype(np.float32).tolist()) for i in range(n)]
    odd = [(900, None), (901, [0.0] * width), (902, [float("nan")] + [1.0] * (width - 1)), (903, []), (904, [None] + [1.0] * (width - 1)),
           (905, rows[3][1]), (906, rows[3][1]), (907, [1.0]), (908, [float("inf")]), (909, (np.array(rows[3][1]) * 1e30).tolist())]
    return rows + odd


def valid(v, width):
    return v is not None and None not in v and np.isfinite(v).all()


def padded(v, width):
    return np.r_[np.asarray(v, np.float32).astype(float), np.zeros(width - len(v))]


def test_lattice_links_equal_brute_force(spark):
    rows = clustered()
    unit = {}
    for i, v in rows:
        if valid(v, 32) and np.any(padded(v, 32)):
            x = padded(v, 32)
            x = x / np.abs(x).max()
            unit[i] = x / np.sqrt((x * x).sum())
    pairs = [(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.9]
    component = closed({i: 0 for i, _ in rows}, pairs)
    got = {r.vec_id: r for r in nl.near_vectors(table(spark, rows)).collect()}
    links = dict.fromkeys(component, 0)
    for a, b in pairs:
        links[a] += 1
        links[b] += 1
    found = sum(r.n_links for r in got.values())
    assert found >= 0.99 * sum(links.values())
    assert all(got[i].n_links <= links[i] for i in links)
    assert all(got[i].component_id == component[i] and got[i].kept == (component[i] == i) for i in component)


def test_lattice_blocks_of_a_hot_cell(spark, monkeypatch):
    monkeypatch.setattr(nl, "BLOCK", 16)
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.01).tolist()) for i in range(120)]
    assert {(r.n_links, r.component_id) for r in nl.near_vectors(table(spark, rows)).collect()} == {(119, 0)}


def test_nearest_lattice_point():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 2
    home = nl.nearest_e8(x)
    assert ((home * 2 % 1 == 0).all() and (home.sum(1) % 2 == 0).all())
    others = home[:, None, :] + nl.NEIGHBOURS
    assert (((x - home) ** 2).sum(1)[:, None] <= ((x[:, None] - others) ** 2).sum(2) + 1e-9).all()
    assert len(nl.NEIGHBOURS) == 240 and np.allclose((nl.NEIGHBOURS ** 2).sum(1), 2)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    a = nl.unit(rng.normal(size=(1500, 64)))
    r = rng.normal(size=a.shape)
    r = nl.unit(r - (r * a).sum(1, keepdims=True) * a)
    b = 0.9 * a + np.sqrt(1 - 0.81) * r
    project, _ = nl.projections(64)
    hit = np.zeros(len(a), bool)
    for t in range(nl.TABLES):
        keys = []
        for x in (a, b):
            y = x @ project[t]
            home = nl.nearest_e8(y)
            near = np.argsort(-((y - home) @ nl.NEIGHBOURS.T), axis=1)[:, :nl.PROBES]
            keys.append(np.c_[nl.cell_keys(home, t), nl.cell_keys(home[:, None] + nl.NEIGHBOURS[near], t)])
        hit |= (keys[0] == keys[1][:, :1]).any(1) | (keys[1] == keys[0][:, :1]).any(1)
    assert hit.mean() > 0.98


def test_top_products_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ip, "SEEDS", 8)
    monkeypatch.setattr(ip, "CELL", 40)
    monkeypatch.setattr(ip, "GROUP", 3)
    monkeypatch.setattr(ip, "STRIP", 16)
    rows = clustered(180) + [(None, [1.0] * 32)]          # the last of these is too long for 64 bits
    rows = [(i if i is None else i - 60, v) for i, v in rows]          # negative ids too
    rows.append(rows[5])                                               # a repeated row
    ints = {i: np.floor(64 * padded(v, 32)).astype(np.int64) for i, v in rows if i is not None and i != 849 and valid(v, 32)}
    got = {}
    for r in ip.top_products(table(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    queries = [i for i in ints if i % 20 == 0]
    assert sorted(got) == sorted(queries)
    for q in queries:
        best = sorted(((-int(ints[q] @ ints[c]), c) for c in ints if c != q))[:20]
        assert sorted(got[q]) == [(k + 1, c, -s) for k, (s, c) in enumerate(best)]


def test_empty_vectors(spark):
    none = table(spark, [(1, [1.0])]).where("vec_id < 0")
    assert nl.near_vectors(none).collect() == [] and ip.top_products(none).collect() == []
    assert ip.top_products(table(spark, [(20, [1.0])])).collect() == []
    few = ip.top_products(table(spark, [(20, [1.0, 2.0]), (21, [1.0, 0.5]), (22, [1.0, 0.5])])).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(1, 21), (2, 22)]
