"""What many written tables leave behind in the driver."""

from types import SimpleNamespace

from corollary.llm import common
from corollary.llm.common import Scratch


class Jvm:
    def __init__(self, total: int, most: int):
        self.collected = 0
        heap = SimpleNamespace(totalMemory=lambda: total, maxMemory=lambda: most)
        self.java = SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap)))
        self.System = SimpleNamespace(gc=self.gc)

    def gc(self):
        self.collected += 1


def test_a_large_heap_is_collected():
    for total, times in ((600, 0), (601, 1)):
        jvm = Jvm(total, 1000)
        common.relieve(jvm)
        assert jvm.collected == times


def test_every_written_table_looks_at_the_heap(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "relieve", seen.append)
    scratch = Scratch(spark, "scratch")
    assert scratch.write(spark.range(3), "a").count() == 3 and scratch.write(spark.range(2), "b").count() == 2
    assert len(seen) == 2
