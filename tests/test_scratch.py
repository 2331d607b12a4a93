"""The driver's memory while tables are written."""

import re

from lodegraph import scratch


def test_the_driver_gives_memory_back_after_some_tables_and_at_the_end(spark, monkeypatch):
    said, relieve = [], scratch.relieve
    monkeypatch.setattr(scratch, "relieve", lambda s: said.append(relieve(s)))
    tables = scratch.Scratch(spark)
    for k in range(scratch.RELIEF):
        assert tables.save(spark.range(3), f"t{k}").count() == 3
    assert len(said) == 1
    assert tables.finish(spark.range(3)).count() == 3
    assert len(said) >= 2 and all(x is None or re.search("[Tt]rim", x) for x in said)
