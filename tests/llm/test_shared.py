import re
from pathlib import Path

from rankloom.llm import shared


def test_freed_native_memory_of_the_driver_goes_back(spark):
    """Memory that the JVM has freed, but that lies between pieces in use, doesn't stay with the process."""
    lang, zip_ = spark.sparkContext._jvm.java.lang, spark.sparkContext._jvm.java.util.zip
    status = Path(f"/proc/{lang.ProcessHandle.current().pid()}/smaps_rollup")
    mb = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", status.read_text())[1]) // 1024
    shared.remove()
    before = mb()
    made = [zip_.Deflater() for _ in range(1500)]
    full = mb()
    for k, d in enumerate(made):
        if k % 20:
            d.end()
    for _ in range(2):  # the heap shrinks by this alone
        lang.System.gc()
    freed = mb()
    shared.remove()
    assert full - before > 80
    assert freed - mb() > 0.5 * (full - before), (before, full, freed, mb())
