"""Upserts against rows taken one by one, and store versions."""

import os
import random

import pytest
from lexiscope.operators import records as r
from lexiscope.sources import stores

FIELDS = {"a": "strict", "b": "strict_case_insensitive", "first": "first_seen", "last": "replace", "tags": "set_union", "log": "append"}
DATA = "a string, b string, first string, last string, tags array<string>, log array<int>"
STORE, ROWS = f"record_id long, identifiers map<string,array<string>>, {DATA}", f"n long, identifiers map<string,array<string>>, {DATA}"


def one_by_one(store, rows):
    """The records after all rows, or the number of the first row in conflict."""
    records, index, top = {}, {}, 0
    for record_id, ids, *values in store:
        records[record_id] = ({k: set(v) for k, v in ids.items()}, dict(zip(FIELDS, values, strict=True)))
        index |= {(k, v): record_id for k, vs in ids.items() for v in vs}
        top = max(top, record_id)
    for n, ids, *values in sorted(rows, key=lambda x: x[0]):
        keys = [(k, v) for k, vs in ids.items() for v in vs]
        hits = {index[k] for k in keys if k in index}
        if len(hits) > 1:
            return n
        if hits:
            at = hits.pop()
        else:
            at = top = top + 1
            records[at] = ({}, dict.fromkeys(FIELDS))
        own, data = records[at]
        for k, v in keys:
            own.setdefault(k, set()).add(v)
            index[k, v] = at
        for (f, kind), new in zip(FIELDS.items(), values, strict=True):
            old = data[f]
            if new is None:
                continue
            if kind in ("set_union", "append"):
                new = [*(old or []), *new]
                data[f] = list(dict.fromkeys(new)) if kind == "set_union" else new
            elif kind == "replace" or old is None:
                data[f] = new
    return sorted((k, tuple(sorted((t, tuple(sorted(v))) for t, v in ids.items())), *(tuple(x) if isinstance(x, list) else x for x in data.values())) for k, (ids, data) in records.items())


def plain(frame):
    return sorted((x.record_id, tuple(sorted((k, tuple(v)) for k, v in x.identifiers.items())), *(tuple(x[f]) if isinstance(x[f], list) else x[f] for f in FIELDS)) for x in frame.collect())


def made(seed, groups, free):
    """Rows of ``groups`` things, each known by a few identifiers; ``free`` lets rows join things."""
    rng = random.Random(seed)
    ids = lambda g: {t: rng.sample([f"{g}-{t}{i}" for i in range(3)], rng.randrange(1, 3)) for t in rng.sample(["x", "y", "z"], rng.randrange(1, 4))}
    def values(g):
        some = lambda v: rng.choice([None, v])
        return some(f"a{g}"), some(rng.choice([f"b{g}", f"B{g}"])), some(str(rng.random())), some(str(rng.random())), some([rng.choice("pqr") for _ in range(rng.randrange(3))]), some([rng.randrange(9)] * rng.randrange(3))
    store = [(7 + g, {"x": [f"{g}-x0"]} if free else {t: [f"{g}-{t}{i}" for i in range(3)] for t in "xyz"}, *values(g)) for g in range(groups // 2)]
    rows = []
    for n in range(groups * 5):
        g = rng.randrange(groups)
        own = ids(g)
        if not free:  # every row shows the thing's own key, so that no two starts meet
            own["key"] = [str(g)]
        rows.append((n * 3, own, *values(g)))
    if not free:
        store = [(k, ids | {"key": [str(k - 7)]}, *v) for k, ids, *v in store]
    rng.shuffle(rows)
    return store, rows


@pytest.mark.parametrize("seed", range(3))
def test_rows_one_by_one(spark, seed):
    store, rows = made(seed, 8, False)
    got = r.upsert(spark.createDataFrame(store, STORE), spark.createDataFrame(rows, ROWS).repartition(3), FIELDS, "n")
    assert plain(got) == one_by_one(store, rows)


def test_conflicts_one_by_one(spark):
    met = 0
    for seed in range(4):
        store, rows = made(seed, 6, True)
        first = one_by_one(store, rows)
        frames = spark.createDataFrame(store, STORE), spark.createDataFrame(rows, ROWS)
        found = sorted(x.n for x in r.conflicts(*frames, "n").collect())
        if isinstance(first, int):
            met += 1
            assert found[0] == first
            with pytest.raises(r.ConflictError, match=str(first)):
                r.upsert(*frames, FIELDS, "n")
        else:
            assert not found and plain(r.upsert(*frames, FIELDS, "n")) == first
    assert met


def test_long_chain_and_order(spark):
    """A chain of 300 rows is one record; the same rows from both ends are a conflict in the middle."""
    chain = [(n, {"x": [str(n), str(n + 1)]}, None, None, str(n), str(n), [str(n % 7)], [n]) for n in range(300)]
    empty = spark.createDataFrame([], STORE)
    (one,) = r.upsert(empty, spark.createDataFrame(chain, ROWS), FIELDS, "n", next_id=40).collect()
    assert (one.record_id, one.first, one.last, one.tags, one.log, len(one.identifiers["x"])) == (40, "0", "299", list("0123456"), list(range(300)), 301)
    two = [(n * 2 if n < 150 else (299 - n) * 2 + 1, *rest) for n, *rest in chain]
    (bad,) = r.conflicts(empty, spark.createDataFrame(two, ROWS), "n").collect()
    assert bad.n == 299 and sorted(bad.first_rows) == [0, 1] and one_by_one([], two) == 299


def test_bad_rows(spark):
    empty = spark.createDataFrame([], STORE)
    row = lambda n, ids, a=None: (n, ids, a, *[None] * 5)
    frame = lambda *rows: spark.createDataFrame(list(rows), ROWS)
    for rows, said in ((frame(row(1, {"x": ["1"]}), row(1, {"x": ["2"]})), "share"), (frame(row(None, {"x": ["1"]})), "share"), (frame(row(-1, {"x": ["1"]})), "share"), (frame(row(1, {})), "identifier"), (frame(row(1, None)), "identifier")):
        with pytest.raises(ValueError, match=said):
            r.upsert(empty, rows, FIELDS, "n")
    with pytest.raises(Exception, match="a: one and two"):
        r.upsert(empty, frame(row(1, {"x": ["1"]}, "one"), row(2, {"x": ["1"]}, "two")), FIELDS, "n").collect()
    assert r.upsert(empty, frame(), FIELDS, "n").count() == 0


def test_nulls_are_not_lost_without_an_order(spark):
    kind = "identifiers map<string,array<string>>, a string, b string"
    store = spark.createDataFrame([], f"record_id long, {kind}")
    rows = spark.createDataFrame([({"p": ["9"]}, "x", None), ({"p": ["9"]}, None, "x")], kind)
    with pytest.raises(r.ConflictError):
        r.upsert(store, rows, {"a": "replace", "b": "replace"})


def test_versions(spark, tmp_path):
    path, kind = f"file://{tmp_path}/s", "record_id long, identifiers map<string,array<string>>, a string"
    df = lambda *rows: spark.createDataFrame(list(rows), kind)
    nothing = stores.current(spark, path)
    assert (nothing.version, nothing.records, nothing.next_id) == (0, None, 1)
    one = stores.commit(df((1, {"x": ["1"]}, "a"), (5, {"x": ["5"]}, None)), path, nothing)
    again = stores.commit(df((5, {"x": ["5"]}, None), (1, {"x": ["1"]}, "a")), path, one)
    assert again is one and stores.current(spark, path).version == 1
    assert stores.commit(df((5, {"x": ["5"]}, None), (1, {"x": ["1"]}, "a")), path, one, force=True).version == 2
    left = r.delete(stores.current(spark, path).records, spark.range(5, 6).withColumnRenamed("id", "record_id"))
    three = stores.commit(left, path, stores.current(spark, path))
    assert three.version == 3 and three.next_id == 6
    rows = spark.createDataFrame([({"x": ["9"]}, "n")], "identifiers map<string,array<string>>, a string")
    four = stores.commit(r.upsert(three.records, rows, {"a": "strict"}, next_id=three.next_id), path, three)
    assert sorted((x.record_id, x.a) for x in stores.current(spark, path).records.collect()) == [(1, "a"), (6, "n")]
    with pytest.raises(stores.StaleStoreError):
        stores.commit(df((1, {"x": ["1"]}, "other")), path, three)
    assert stores.current(spark, path).version == 4 and stores.current(spark, path, 1).records.count() == 2
    with pytest.raises(ValueError, match="not a store"):
        stores.commit(df((1, {"x": ["1"]}, "a"), (2, {"x": ["1"]}, "b")), path, four)
    assert stores.vacuum(spark, path) >= 4 and stores.current(spark, path).records.count() == 2 and len(os.listdir(tmp_path / "s" / "snapshots")) == 1


@pytest.mark.parametrize("step", ["stage", "problems", "_digest", "publish"])
def test_a_dead_writer_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path, kind = f"file://{tmp_path}/s", "record_id long, identifiers map<string,array<string>>"
    first = stores.commit(spark.createDataFrame([(1, {"x": ["1"]})], kind), path, stores.current(spark, path))
    real = getattr(stores, step)

    def die(*args, **named):
        if step == "stage":  # its files are written, and then the writer dies
            real(*args, **named)
        raise KeyboardInterrupt

    monkeypatch.setattr(stores, step, die)
    with pytest.raises(KeyboardInterrupt):
        stores.commit(spark.createDataFrame([(2, {"x": ["2"]})], kind), path, first)
    monkeypatch.undo()
    now = stores.current(spark, path)
    assert now.version == 1 and [x.record_id for x in now.records.collect()] == [1]
    assert stores.commit(spark.createDataFrame([(2, {"x": ["2"]})], kind), path, now).version == 2
