from pathlib import Path

import pytest

from pulseloom import shared


def tables(spark):
    return {p.name for p in Path(shared.shared_dir(spark).removeprefix("file:")).glob("table-*")}


def test_tables_are_released(spark):
    one = shared.materialize(spark.range(5))
    before = tables(spark)

    def build():
        inner = shared.keep_only(lambda: shared.materialize(spark.range(7)).filter("id > 2"))
        return inner.unionByName(shared.materialize(spark.range(2)))

    two = shared.keep_only(build)
    assert two.count() == 6 and len(tables(spark) - before) == 1
    with pytest.raises(ZeroDivisionError):
        shared.keep_only(lambda: shared.materialize(spark.range(1)).limit(1 // 0))
    shared.discard(spark.range(3))
    shared.discard(two)
    assert len(tables(spark) - before) == 1 and one.count() == 5  # what failed leaves its table to release()


def test_release_removes_everything(spark, tmp_path):
    before = shared.shared_dir
    try:
        shared.shared_dir = lambda _: f"file://{tmp_path}/app"
        shared.materialize(spark.range(3))
        assert list((tmp_path / "app").iterdir())
        shared.release(spark)
        assert not (tmp_path / "app").exists()
    finally:
        shared.shared_dir = before
