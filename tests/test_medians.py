"""Running medians by blocks against a plain list."""

import random
import statistics

import pytest

from grovespark.operators import evaluate, ranks


@pytest.mark.parametrize("block_rows", [3, 16, 4096])
def test_medians_of_all_earlier_rows(spark, block_rows):
    pick = random.Random(block_rows)
    kinds = {1: lambda i: float(i), 2: lambda i: -float(i), 3: lambda i: pick.random(), 4: lambda i: float(pick.randint(0, 3)), 5: lambda i: None if i % 3 else pick.random(), None: lambda i: pick.gauss(0, 1)}
    rows = [(k, i * 2, f(i)) for k, f in kinds.items() for i in range(90 if k != 4 else 200)] + [(9, 1, None)]
    df = spark.createDataFrame(rows, "k long, n long, at double").repartition(5)
    got = {(r["k"], r["n"]): (r["med"], r["med_rows"]) for r in evaluate.earlier_medians(df, "k", "n", "at", "med", block_rows).collect()}
    seen, number, want = {}, {}, {}
    for k, n, v in rows:
        own = seen.setdefault(k, [])
        want[k, n] = (statistics.median(own) if own else None, number.get(k, 0))
        number[k] = number.get(k, 0) + 1
        if v is not None:
            own.append(v)
    assert len(got) == len(want)
    for key, (m, n) in want.items():
        assert got[key][1] == n and (got[key][0] is None if m is None else got[key][0] == pytest.approx(m, abs=1e-15)), key
    assert evaluate.earlier_medians(df.limit(0), "k", "n", "at", "med").count() == 0


def test_ranks_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, i, 10 - i, i, i, i) for i in range(10)], "_key0 long, _part long, _n long, _of long, _before long, __part long")
    assert [(r["_n"], r["place"]) for r in ranks.numbered(df, ["_key0"], ["_n"], "place").orderBy("place").collect()] == [(i, i) for i in range(1, 11)]
