"""Rules are listed in shares and shipped in waves, written tables leave no shuffle files, and only targets leave a ranking."""

import time

from pyspark.sql import functions as F

from tidemark import storage
from tidemark.operators import feedback, fired, rules

MORE = [(u, i, float(1 + (u * 7 + i * 5) % 5)) for u in range(1, 9) for i in range(1, 11) if (u * i) % 3 != 1] + [(20, 3, 1.0), (21, 4, 5.0), (21, 2**61, 5.0)]


def test_shares_and_waves_give_the_same(spark, monkeypatch):
    y = spark.createDataFrame(MORE, "userid long, itemid long, y double").cache()
    users = spark.createDataFrame([(u, u % 2) for u in range(22)], "userid long, cluster int")
    items = spark.createDataFrame([(i, i % 2) for i in [*range(1, 11), 2**61]], "itemid long, cluster int")
    t = rules.tokens(y, users, items).cache()
    found = rules.rules(y, t).cache()
    goal = spark.createDataFrame([(u, i) for u in range(1, 9) for i in range(2, 8)], "userid long, itemid long")
    ids = y.select("userid").distinct()

    def results(s):
        rounded = s.digest().select("userid", "n", F.round("total", 9), F.round("top", 9), "last_item")
        return sorted(rounded.collect()), sorted(s.top(ids, y, 4, goal=goal).collect())

    whole = fired.Fired(t, found, feedback.seen(y), rules.KINDS)
    want, top = results(whole), whole.top(ids, y, 4)
    assert want[1] == sorted(top.join(goal, ["userid", "itemid"], "left_semi").select(*top.columns).collect())
    tables = []
    monkeypatch.setattr(fired, "written", lambda df, name: tables.append(name) or storage.written(df, name))
    for name, value in (("WAVES", 2), ("SHARE", 20), ("SHIPPED", 300), ("LEAST", 2), ("TOGETHER", 7)):
        monkeypatch.setattr(fired, name, value)
    assert results(fired.Fired(t, found.where("kind <> 'item'"), feedback.seen(y), rules.KINDS, item_rules=rules.item_rules(t))) == want
    assert tables.count("lists") == 4 and tables.count("found") == 4


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: {f.getPath() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if "shuffle_" in f.getName()}
    before, setting = files(), spark.conf.get(storage._CLEANUP, None)
    df = spark.range(1000).repartition(4, "id").groupBy("id").count()
    table = storage.written(df, "t")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and table.count() == 1000
    assert spark.conf.get(storage._CLEANUP, None) == setting
