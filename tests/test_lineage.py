from __future__ import annotations

import os

import pytest

from tidemark.plans import lineage


def there(path):
    return os.path.isdir(path.removeprefix("file://"))


def test_what_is_passing_goes(spark):
    kept, inner = lineage.place(spark, "kept"), []
    with lineage.passing(spark):
        first = lineage.stored(spark.range(10), "first")
        inner.append(lineage.place(spark, "made"))
        first.write.parquet(inner[0])
        with lineage.passing(spark):
            inner.append(lineage.place(spark, "within"))
            first.write.parquet(inner[1])
        assert there(inner[0]) and not there(inner[1])
        lineage.place(spark, "never-written")
        first.where("id > 3").write.parquet(kept)
    assert not there(inner[0]) and spark.read.parquet(kept).count() == 6
    after = lineage.stored(spark.range(3), "after")
    assert after.count() == 3


def test_it_goes_after_an_error_too(spark):
    with pytest.raises(ValueError), lineage.passing(spark):
        at = lineage.place(spark, "made")
        spark.range(3).write.parquet(at)
        raise ValueError
    assert not there(at)
