import numpy as np
import pytest
from pyspark.sql import types as T

import ratelark.llm.embedding_dedup as module
from ratelark.llm.embedding_dedup import Shard, SmallWorld, embedding_dedup


def brute(rows, least=0.9):
    """(links, component) by id, by comparing all pairs."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = x / np.linalg.norm(x)
    ids = sorted(good)
    root, links = {i: i for i, _ in rows if i is not None}, {i: 0 for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for width in {len(v) for v in good.values()}:
        own = [i for i in ids if len(good[i]) == width]
        x = np.stack([good[i] for i in own])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1))):
            links[own[a]] += 1
            links[own[b]] += 1
            p, q = find(own[a]), find(own[b])
            root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i in root}


@pytest.fixture
def table(spark):
    schema = T.StructType([T.StructField("vec_id", T.LongType()),
                           T.StructField("embedding", T.ArrayType(T.DoubleType())),
                           T.StructField("id", T.StringType()), T.StructField("row", T.LongType())])
    return lambda rows: spark.createDataFrame([(i, v, "x", 1) for i, v in rows], schema)


def run(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
            for r in embedding_dedup(df).collect()}


def test_whole_table(spark, sf, duck):
    rows = duck.execute("select vec_id, embedding from embeddings").fetchall()
    got = run(spark.read.parquet(f"{sf}/embeddings.parquet"))
    want = brute([(i, list(v)) for i, v in rows])
    assert set(got) == set(want)
    found, there = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
    assert found >= 0.99 * there
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_edges(table):
    rng = np.random.default_rng(0)
    base = rng.normal(size=8)
    rows = [(i, (base + 0.05 * rng.normal(size=8)).tolist()) for i in range(40, 60)]
    rows += [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0, None] + [0.0] * 6),
             (5, [float("nan")] * 8), (6, [float("inf")] * 8), (7, [1.0, 0.0]), (8, [2.0, 0.0]),
             (9, [1e200, 1e200]), (10, [1e-200, 1e-200]), (11, base.tolist()), (12, (base * 3).tolist())]
    got = run(table(rows))
    assert got == brute(rows[:-4] + rows[-2:] + [(9, [1.0, 1.0]), (10, [1.0, 1.0])])
    assert run(table([(None, [1.0]), (1, [1.0])])) == {None: (0, None, False), 1: (0, 1, True)}
    twice = embedding_dedup(table([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(twice) == 3 and {r["component_id"] for r in twice} == {1}
    assert run(table([])) == {}
    assert run(table([(1, None)])) == {1: (0, 1, True)}


def test_graph_finds_dense_groups():
    """A group far larger than the beam is found whole."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=32)
    x = np.concatenate([rng.normal(size=(1500, 32)), centre + 0.1 * rng.normal(size=(700, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = SmallWorld.build(x)
    x = x[order]
    shard = Shard(np.arange(len(x)), x, graph, np.arange(len(x)))
    again = Shard.unpack(shard.pack())
    q, node = again.links(np.arange(len(x)), x, 0.9)
    there = (x @ x.T >= 0.9).sum() - len(x)
    assert len(q) == len(set(zip(q, node))) and there > 400_000
    assert len(q) >= 0.99 * there


def test_audit_widens_the_beam(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = SmallWorld.build(x)
    x = x[order]
    graph.layers[-1][:, 1:] = -1                      # nearly all links are lost
    monkeypatch.setattr(module, "BEAM", 1)
    shard = Shard(np.arange(300), x, graph, np.arange(300))
    beams = []
    inner = SmallWorld.within
    monkeypatch.setattr(SmallWorld, "within", lambda self, q, least, beam: (
        beams.append(beam), inner(self, q, least, beam))[1])
    shard.links(np.arange(300), x, 0.9)
    assert beams[0] == 1 and beams[-1] >= 300


def test_parts_the_graph_does_not_reach(monkeypatch):
    """Links come back whole where no beam reaches them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph, order = SmallWorld.build(x)
    x = x[order]
    graph.layers[-1][:, 1:] = -1
    monkeypatch.setattr(module, "CELLS", 1000)
    q, node = Shard(np.arange(300), x, graph, np.arange(300)).links(np.arange(300), x, 0.9)
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    assert sorted(zip(q, node)) == sorted(zip(*np.nonzero(want)))


def test_audit_sees_lost_links_beside_a_dense_group(monkeypatch):
    """A group with nearly all of the pairs does not hide that others lost their few."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 32))
    x = np.concatenate([base, base + 0.02 * rng.normal(size=base.shape),
                        rng.normal(size=32) + 0.02 * rng.normal(size=(300, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    seen = want.copy()
    seen[:600] = False
    monkeypatch.setattr(SmallWorld, "within", lambda self, q, least, beam: np.nonzero(seen))
    monkeypatch.setattr(module, "AUDITED", 64)
    names = np.arange(900)
    q, node = Shard(names, x, SmallWorld(x.astype(np.float32), []), names).links(names, x, 0.9)
    assert sorted(zip(q, node)) == sorted(zip(*np.nonzero(want)))


def test_bound_of_the_audit():
    from ratelark.llm.embedding_dedup import most_lost
    assert most_lost(np.zeros(0), 0) == 0.0 and most_lost(np.array([0.0, 1.0]), 2) == 0.5
    assert 0.0028 < most_lost(np.zeros(1024), 10_000) < 0.003      # 1 - 0.05 ** (1 / 1024)
    assert most_lost(np.array([0.0] * 1020 + [1.0] * 4), 10_000) > 0.009
    assert most_lost(np.ones(10), 100) > 0.99


def test_equal_vectors_are_one_node():
    """Rows of a vector count one by one, those of the same id not at all."""
    from ratelark.llm.embedding_dedup import merged
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 4))
    x = np.concatenate([x, np.repeat(x[:1], 80, 0), x[:20]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.concatenate([np.arange(100), np.arange(40)])
    distinct, at = merged(x)
    assert len(distinct) == 40 and (distinct[at] == x).all()
    graph, order = SmallWorld.build(distinct)
    exact, at = distinct[order], np.argsort(order)[at]
    shard = Shard.unpack(Shard(ids, exact, graph, ids, at).pack())
    want = ((x @ x.T >= 0.9) & (ids[:, None] != ids)).sum(1)
    for some in (np.arange(140), np.arange(0, 140, 3)):
        places, mine = np.unique(at[some], return_inverse=True)
        q, node = shard.links(ids[some], exact[places], 0.9, mine)
        assert (shard.counts(ids[some], mine, q, node) == want[some]).all()
    q, node = shard.links(ids, exact, 0.9, at)
    assert (shard.counts(ids, at, q, node) == want).all()


def test_copies_and_skew(table):
    rng = np.random.default_rng(6)
    copy = rng.normal(size=8)
    rows = [(i, copy.tolist()) for i in range(150)]
    for i in range(150, 350, 2):
        one = rng.normal(size=8)
        rows += [(i, one.tolist()), (i + 1, (one + 0.01 * rng.normal(size=8)).tolist())]
    assert run(table(rows)) == brute(rows)


def test_graphs_are_not_shuffled_and_tables_are_dropped(spark, table, monkeypatch):
    """Pairs of shards are read from the files; of the tables only those of the result stay."""
    plans, made = {}, []

    class Watched(module.Scratch):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def stage(self, df, name):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            return super().stage(df, name)

    monkeypatch.setattr(module, "Scratch", Watched)
    before = {k: spark.conf.get(k, None) for k in module.APART}
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.01]))]
    rows += [(100 + i, v[:3]) for i, v in rows]
    assert run(table(rows)) == brute(rows)
    assert "CartesianProduct" in plans["answers"] and "Exchange" not in plans["answers"]
    assert set(made[0].tables) == {"nodes", "answers"}
    assert {k: spark.conf.get(k, None) for k in module.APART} == before


def test_shards_have_cells_of_their_own():
    mb = 1 << 20
    shards, first, cells = module.deal({64: mb, 32: 1000, 2: 1000})     # 512 MB and little more
    assert shards == {64: 16, 32: 8, 2: 8} and cells == 17
    assert first[64] == 0 and sorted(first.values()) == [0, 16, 24]
    assert module.deal({64: 500}) == ({64: 8}, {64: 0}, 8)
    assert module.deal({2: mb})[0] == {2: 8} and module.deal({1: 2 * mb})[0] == {1: 16}


def test_shard_packs_single_precision_as_it_came():
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(500, 16)).astype(np.float32)
    exact = module.unit(plain)
    graph, order = SmallWorld.build(exact)
    ids, row = np.arange(500) * 3, np.arange(500)[::-1].copy()
    shard = Shard(ids, exact[order], graph, ids, np.argsort(order), row, plain[order])
    raw = shard.pack()
    assert len(raw) < len(Shard(ids, exact[order], graph, ids, np.argsort(order), row).pack())
    again = Shard.unpack(raw)
    assert (again.exact == exact[order]).all() and (again.row == row).all()
    parts = list(again.blocks())
    assert len(parts) == 1 and (parts[0][0] == row).all() and (parts[0][3] == again.at).all()


def test_blocks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(module, "BLOCK", 7)
    rng = np.random.default_rng(9)
    x = module.unit(rng.normal(size=(30, 4)))
    at = rng.integers(0, 30, 90)
    shard = Shard(np.arange(90), x, SmallWorld(x.astype(np.float32), []), np.arange(90), at)
    parts = list(shard.blocks())
    assert len(parts) == 5 and sorted(np.concatenate([p[0] for p in parts])) == list(range(90))
    for row, ids, labels, place, exact in parts:
        assert (row == ids).all() and (labels == ids).all()
        assert (exact[place] == x[at[row]]).all()


def test_components_keep_only_their_last_table(spark, tmp_path, monkeypatch):
    from ratelark.llm import common
    monkeypatch.setattr(common, "new_folder", lambda spark, name: str(tmp_path / name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "u long, v long")
    got = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 50: 50, 51: 50}
    assert len(list((tmp_path / "components").iterdir())) == 1
