import os

from lectern.llm.tasks import scratch_scope, stored


def test_tables_go_when_the_scope_ends(spark):
    kept = stored(spark.range(5), "kept")
    with scratch_scope(spark):
        inner = stored(spark.range(7), "inner")
        assert inner.count() == 7
        files = inner.inputFiles()
    folders = {os.path.dirname(f.removeprefix("file://")) for f in files}
    assert folders and not any(os.path.exists(f) for f in folders)
    assert kept.count() == 5
