"""What the driver's JVM gives back to the system before a table is written."""

from corollary.llm import common


def ratio(gateway):
    return common.managed(gateway, "HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value")


def test_the_heap_shrinks_and_options_are_restored(spark):
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    heap, usual = jvm.java.lang.Runtime.getRuntime(), ratio(gateway)
    with common.returning(gateway):
        assert ratio(gateway) == "40"
        jvm.System.gc()
    used = heap.totalMemory() - heap.freeMemory()
    assert 0.6 * heap.totalMemory() <= 1.1 * used + (32 << 20)
    assert ratio(gateway) == usual != "40"


def test_every_written_table_and_stage_returns_native_memory(spark, monkeypatch):
    import corpus_pipeline

    asked, managed = [], common.managed
    monkeypatch.setattr(common, "managed", lambda gateway, bean, operation, *words: asked.append(operation) or managed(gateway, bean, operation, *words))
    common.Scratch(spark, "scratch").write(spark.range(3), "a")
    corpus_pipeline.start(spark)
    assert asked.count("systemTrimNativeHeap") == 2


def test_a_jvm_without_these_operations_goes_on(spark, monkeypatch):
    managed = common.managed
    monkeypatch.setattr(common, "managed", lambda gateway, bean, operation, *words: managed(gateway, "Nothing", operation, *words))
    assert common.Scratch(spark, "scratch").write(spark.range(3), "a").count() == 3
