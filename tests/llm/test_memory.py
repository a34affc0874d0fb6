"""Bounds of batches that go to Python."""

from vigilog.llm.memory import BATCH_BYTES, held, lean, small_batches

NAME = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_unless_they_are_closer(spark):
    before = spark.conf.get(NAME)
    try:
        for given, kept in (("64m", str(BATCH_BYTES)), ("1g", str(BATCH_BYTES)), ("67108864b", str(BATCH_BYTES)), ("1m", "1m"), ("4096", "4096")):
            spark.conf.set(NAME, given)
            small_batches(spark)
            now = spark.conf.get(NAME)
            assert now.rstrip("b") in (kept, str(1 << 20) if kept == "1m" else kept)
    finally:
        spark.conf.set(NAME, before)
    assert lean() is None


def test_what_a_function_holds_goes_with_it():
    made = []

    def make():
        made.append(object())
        return made[-1]

    assert held("a", make) is held("a", make) is made[0]
    assert held("b", make) is made[1]
    assert held("a", make) is made[2]
    lean()
    assert held("a", make) is made[3] and len(made) == 4
