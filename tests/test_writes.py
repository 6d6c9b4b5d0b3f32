"""Inserts under several unique keys against one row after the other; refused batches."""

import random

import pytest

from frameloom.sources import sinks


def one_by_one(ledger, rows, keys):
    taken = [{tuple(r[c] for c in key) for r in ledger} for key in keys]
    out = []
    for r in sorted(rows, key=lambda r: r["n"]):
        own = [tuple(r[c] for c in key) for key in keys]
        if all(None in k or k not in t for k, t in zip(own, taken, strict=True)):
            out.append(r["n"])
            for k, t in zip(own, taken, strict=True):
                t.add(k)
    return out


@pytest.mark.parametrize(("seed", "fold"), [(0, 10**6), (1, 0), (2, 0), (3, 30), (4, 0)])
def test_insert_equals_one_row_after_the_other(spark, monkeypatch, seed, fold):
    monkeypatch.setattr(sinks, "FOLD", fold)
    rnd = random.Random(seed)
    make = lambda n, first: [{"n": first + i, "a": rnd.choice([None, *range(40)]), "b": rnd.choice([None, *range(25)]), "c": rnd.choice("xyz")} for i in range(n)]
    ledger, rows = make(8, 0), make(150, 100)
    keys = (["a"], ["b", "c"], ["n"])
    schema = "n long, a long, b long, c string"
    df = lambda x: spark.createDataFrame([tuple(r.values()) for r in x], schema)
    good, skipped = sinks.insertable(df(ledger), df(rows).repartition(3), *keys, order=["n"])
    want = one_by_one(ledger, rows, keys)
    assert sorted(r.n for r in good.collect()) == want and good.columns == ["n", "a", "b", "c"]
    assert sorted(r.n for r in skipped.collect()) == sorted({r["n"] for r in rows} - set(want))


def test_a_skipped_row_takes_no_key(spark):
    ledger = spark.createDataFrame([(1, "q")], "a long, b string")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y"), (3, "y"), (3, "y")], "a long, b string")
    good, skipped = sinks.insertable(ledger, rows, ["a"], ["b"])
    assert sorted(map(tuple, good.collect())) == [(2, "x"), (3, "y")] and skipped.count() == 3
    assert sinks.insertable(ledger, rows.limit(0), ["a"], ["b"])[0].isEmpty()


@pytest.mark.parametrize("fold", [0, 10**6])
def test_a_long_chain(spark, monkeypatch, fold):
    monkeypatch.setattr(sinks, "FOLD", fold)
    rows = spark.createDataFrame([(i, (i + 1) // 2, i // 2) for i in range(12)], "n long, a long, b long")
    good, _ = sinks.insertable(rows.limit(0), rows, ["a"], ["b"])
    assert sorted(r.n for r in good.collect()) == [0, 2, 4, 6, 8, 10]


def test_batches_with_a_conflict_are_refused(spark):
    schema = "k string, batch string, v string"
    ledger = spark.createDataFrame([("a", "p", "1"), ("b", "q", "old"), ("z", "r", "9"), ("d", "s", "5"), ("d", "s", "5")], schema)
    expected = spark.createDataFrame([("a", "p", "1"), ("c", "p", "2"), ("b", "q", "new"), ("e", "q", "3"), ("f", "r", "9"), ("d", "s", "5"), ("g", "s", "6")], schema)
    after, outcome = sinks.register(ledger, expected, "batch", "k", ["v"], ["v"])
    assert sorted(r.k for r in after.collect()) == ["a", "b", "c", "d", "d", "z"]
    rows = {r.batch: (r.expected, r.refused, r.mismatches, r.already, r.inserted, r.skipped) for r in outcome.collect()}
    assert rows == {"p": (2, False, 0, 1, 1, 0), "q": (2, True, 1, 0, 0, 0), "r": (1, False, 0, 0, 0, 1), "s": (2, True, 0, 0, 0, 0)}
