import contextlib
import io

import pytest

from tillroll.operators.joins import bounded_broadcast, might_be_in
from tillroll.session import shared_dir


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain()
    return buf.getvalue()


def test_bounded_broadcast_checks_rows_and_bytes(spark):
    big = spark.range(1000).withColumnRenamed("id", "k")
    small = spark.range(10).withColumnRenamed("id", "k")
    within = big.join(bounded_broadcast(small, max_rows=10), "k")
    assert "BroadcastHashJoin" in _plan(within)
    for beyond in (bounded_broadcast(small, max_rows=9), bounded_broadcast(small, max_bytes=79)):
        joined = big.join(beyond, "k")
        assert "BroadcastExchange" not in _plan(joined)
        assert within.count() == joined.count() == 10


def test_bloom_filter_loses_no_key_and_lets_few_others_through(spark):
    df = spark.range(50_000).selectExpr("id % 1000 - 500 as a", "if(id % 977 = 0, null, cast(id as string)) as b")
    wanted = df.where("a % 50 = 0 or b is null")
    passed = might_be_in(df, wanted, ["a", "b"], blocks=1 << 10)
    assert passed.columns == df.columns
    assert passed.where("a % 50 = 0 or b is null").count() == wanted.count()
    assert passed.count() <= wanted.count() + 1000
    assert might_be_in(df, wanted.limit(0), ["a", "b"]).count() == 0
    crowded = might_be_in(df, wanted, ["a", "b"], blocks=1)
    assert crowded.where("a % 50 = 0 or b is null").count() == wanted.count()


def test_bloom_filter_stands_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    wanted = df.where("id < 3").select("k").groupBy("k").count().select("k")
    tree = _plan(might_be_in(df, wanted, ["k"]).join(wanted, ["k"], "left_semi"))
    lines = tree[:tree.index("BroadcastExchange")]
    assert "BroadcastHashJoin" in lines and lines.index("Exchange hashpartitioning(k") < lines.index("BroadcastHashJoin")


def test_shared_dir_is_the_sessions_checkpoint_folder(spark):
    first = shared_dir(spark)
    assert first and shared_dir(spark) == first
    assert spark.sparkContext.getCheckpointDir().rstrip("/") == first


def test_shared_dir_needs_a_setting_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
