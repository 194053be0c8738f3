"""A nested split reads its input once per step, not once per use."""

from tastegrid.operators import split as sp


def test_input_of_nested_folds_is_read_once(spark, ratings):
    calls = spark.sparkContext.accumulator(0)

    def watched(batches):
        for b in batches:
            calls.add(len(b))
            yield b

    table = ratings.select("user", "item", "rating", "ts")
    n = table.count()
    folds = sp.nested(sp.random_leave_n_out(table.mapInPandas(watched, table.schema), 2, 3), 0.2)
    got = folds.collect()
    assert calls.value == n and len(got) == 2 * n
    assert {(r.test_fold, r.part) for r in got} == {(f, p) for f in (0, 1) for p in ("train", "val", "test")}
