"""SQLite ranges, model artefacts, count windows, episodes and commands."""

import json
import os
import sqlite3
import time

import pytest
from pyspark.sql import functions as F

from loomspan.operators import forecasts as fc
from loomspan.sources import artefacts as af
from loomspan.sources import sqlite as sq
from loomspan.streaming import events as ev
from loomspan.streaming import sinks as sk
from loomspan.streaming import state as ss


@pytest.fixture
def trace(tmp_path):
    path = str(tmp_path / "sim.db")
    with sqlite3.connect(path) as c:
        c.execute("create table trace (user_id integer, action text, info text, created_at text, score real)")
        for i in [*range(1, 40), *range(500, 520), 100_000]:
            action = "refresh" if i % 5 == 0 else "interview" if i % 7 == 0 else "like"
            info = json.dumps({"prompt": f"p{i}", "response": f"r{i}"})
            c.execute("insert into trace (rowid, user_id, action, info, created_at, score) values (?, ?, ?, ?, ?, ?)", (i, i % 4, action, info, f"t{i:06d}", None if i % 3 else i / 2))
    return path


def test_sqlite_ranges_and_filters(spark, trace):
    rows = sq.sqlite_rows(spark, trace, "trace", partitions=7)
    ids = [r["_rowid"] for r in rows.collect()]
    assert sorted(ids) == [*range(1, 40), *range(500, 520), 100_000] and len(ids) == len(set(ids))
    assert rows.schema["score"].dataType.simpleString() == "double" and rows.rdd.getNumPartitions() <= 7
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = sq.sqlite_rows(spark, trace, "trace").where((F.col("_rowid") > 510) & (F.col("action") == "like") & F.col("score").isNull())
        assert sorted(r["_rowid"] for r in some.collect()) == [i for i in [*range(511, 520), 100_000] if i % 5 and i % 7 and i % 3]
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0]  # all three went into the scan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    got, last = sq.actions_after(spark, trace, 505)
    assert last == 100_000 and sorted(r["_rowid"] for r in got.collect()) == [i for i in range(506, 520) if i % 5]
    assert sq.actions_after(spark, trace, 100_000)[1] == 100_000
    talks = sq.interviews(spark, trace, agent=3).collect()
    assert [r["_rowid"] for r in talks] == [i for i in [*range(519, 499, -1), *range(39, 0, -1)] if i % 7 == 0 and i % 5 and i % 4 == 3]
    assert talks[0]["prompt"] == f"p{talks[0]['_rowid']}"


def test_model_artefacts(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler

    rows = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", 2 * F.col("a") - F.col("b"))
    folder, models = str(tmp_path / "models"), []
    for name in ("ridge", "random_forest"):
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b"], outputCol="features"), fc.spark_estimator(name)]).fit(rows)
        rmse = model.transform(rows).agg(F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2))).first()[0]
        models.append(model)
        assert af.save_model(spark, model, folder, "spy", {"rmse": rmse}, {"model": name}) == len(models)
    assert af.latest(spark, folder, "spy") == 2 and af.versions(spark, folder, "spy") == [1, 2]
    for version, model in enumerate(models, 1):
        before, after = (m.transform(rows).select("a", "b", "p") for m in (model, af.load_model(spark, folder, "spy", version)))
        assert before.exceptAll(after).count() == 0
    table = af.catalogue(spark, folder).orderBy("version").collect()
    assert [(r["version"], r["parameters"]["model"]) for r in table] == [(1, "ridge"), (2, "random_forest")]
    assert af.best(af.catalogue(spark, folder), "rmse").first()["version"] == 1
    af.set_latest(spark, folder, "spy", 1)
    assert af.latest(spark, folder, "spy") == 1
    os.makedirs(f"{folder}/spy/v000003/model")  # a writer that stopped midway
    assert af.versions(spark, folder, "spy") == [1, 2] and af.latest(spark, folder, "spy") == 1
    assert af.save_model(spark, models[0], folder, "spy") == 4


def test_count_windows_over_a_restart(spark, tmp_path):
    src, out, cp, log = (str(tmp_path / n) for n in ("in", "out", "cp", "log"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ss.STORE)
    add = lambda a, b: spark.range(a, b).selectExpr("id event_id", "if(id % 2 = 0, 'twitter', 'reddit') platform", "if(id % 9 = 8, 'DO_NOTHING', 'LIKE') action_type").coalesce(1).write.mode("append").parquet(src)
    try:
        add(0, 25)
        run = lambda: ss.drain_counted(ss.count_windows(ss.observed(ev.parquet(spark, src))), out, cp, log)
        assert run() == {"seen": 25, "skipped": 2, "failed": 0}
        first = spark.read.parquet(out).count()
        kept = {r["platform"]: r["n"] for r in ss.left_over(spark, cp).collect()}
        live = {p: len([i for i in range(25) if i % 9 != 8 and i % 2 == k]) for k, p in enumerate(("twitter", "reddit"))}
        assert kept == {p: n % 5 for p, n in live.items() if n % 5} and first == sum(n // 5 for n in live.values())
        add(25, 40)
        assert run() == {"seen": 40, "skipped": 4, "failed": 0}
        live = {p: len([i for i in range(40) if i % 9 != 8 and i % 2 == k]) for k, p in enumerate(("twitter", "reddit"))}
        full = spark.read.parquet(out).collect()
        assert len(full) == sum(n // 5 for n in live.values()) and all(r["n"] == 5 and r["full"] for r in full)
        assert {r["platform"]: r["n"] for r in ss.left_over(spark, cp).collect()} == {p: n % 5 for p, n in live.items() if n % 5}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_idle_windows_are_flushed(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.range(7).selectExpr("id event_id", "'twitter' platform", "'LIKE' action_type").coalesce(1).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ss.STORE)
    try:
        query = ss.count_windows(ev.parquet(spark, src), idle=500).writeStream.format("memory").queryName("idle_windows").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="300 milliseconds").start()
        for _ in range(120):
            if spark.table("idle_windows").count() == 2:
                break
            time.sleep(0.5)
        query.stop()
        assert sorted((r["n"], r["full"]) for r in spark.table("idle_windows").collect()) == [(2, False), (5, True)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_episodes_are_written_once(spark, tmp_path):
    src, out, cp, mark = (str(tmp_path / n) for n in ("in", "out", "cp", "mark"))
    spark.range(0, 40, 1, 4).selectExpr("if(id % 2 = 0, 'twitter', 'reddit') platform", "id agent_id", "concat('did ', id) text").write.parquet(src)

    def fails_once(batches):
        for pdf in batches:
            if 27 in pdf["agent_id"].tolist() and not os.path.exists(mark):
                time.sleep(1)  # other tasks have written their drafts
                open(mark, "w").close()
                raise RuntimeError("lost midway")
            yield pdf

    stream = lambda: ev.parquet(spark, src).mapInPandas(fails_once, sk.EPISODE)
    with pytest.raises(Exception, match="lost midway"):
        sk.write_episodes(stream(), out, cp)
    assert not os.path.exists(f"{out}/episodes/0")
    sk.write_episodes(stream(), out, cp)
    got = sk.episodes(spark, out)
    assert sorted(r["agent_id"] for r in got.collect()) == list(range(40))
    writer = sk.EpisodeWriter(out)  # a batch that is committed again changes nothing
    writer.commit([writer.write(iter([]))], 0)
    assert sk.episodes(spark, out).count() == 40


def test_commands_one_file_a_trigger(spark, tmp_path):
    folder = tmp_path / "commands"
    folder.mkdir()
    texts = {"c": {"command_id": "3", "command_type": "close_env"}, "a": {"command_id": "1", "command_type": "interview", "args": {"agent_id": 4, "prompt": "é"}}, "b": "{broken", "d": {"command_type": "interview"}, "e": {"command_id": "5", "command_type": "dance"}}
    for k, name in enumerate("abcde"):
        p = folder / f"{name}.json"
        p.write_text(texts[name] if isinstance(texts[name], str) else json.dumps(texts[name]))
        os.utime(p, (1_700_000_000 + k, 1_700_000_000 + k))
    seen = []
    sk.run_commands(sk.command_stream(spark, str(folder)), lambda batch, number: seen.extend((number, r["command_id"], r["args"]) for r in batch.collect()), str(tmp_path / "bad"), str(tmp_path / "cp"))
    assert [s[1] for s in seen] == ["1", "3"] and seen[0][0] < seen[1][0] and json.loads(seen[0][2]) == {"agent_id": 4, "prompt": "é"}
    bad = {r["file"]: r["reason"] for r in spark.read.json(str(tmp_path / "bad")).collect()}
    assert bad == {"b.json": "not JSON", "d.json": "no command_id", "e.json": "unknown type"}
