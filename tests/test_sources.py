"""Sources and sinks on small files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as tx
from loomspan.sources import files as fs


def test_wide_csv(spark, tmp_path):
    p = tmp_path / "prices.csv"
    p.write_text("date,A,B\n2020-01-01,1.5,\n2020-01-02,1.6,2\n")
    got = {(str(r["dt"]), r["asset"], r["px"]) for r in fs.wide_csv(spark, str(p), ["A", "B"]).collect()}
    assert got == {("2020-01-01", "A", 1.5), ("2020-01-02", "A", 1.6), ("2020-01-02", "B", 2.0)}


def test_results_union_and_floor(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text('experiment,sharpe,sortino,description\nA1,0.5,0.6,"two\nlines"\nA2,0.9,1.0,x\n')
    b.write_text("experiment,sharpe,desc\nB1,0.7,y\n")
    r = fs.results(spark, [str(a), str(b)])
    assert [x["experiment"] for x in fs.top_results(r, 2).collect()] == ["A2", "B1"]
    assert {x["source"] for x in r.collect()} == {"a.csv", "b.csv"}
    assert fs.best_result(r, 0.8).count() == 1 and fs.best_result(r, 0.95).count() == 0


def test_simulation_and_weights(spark, tmp_path):
    doc = {"rounds": [{"round": 1, "date": "2022-01-03", "agent_signals": {"a": [0.1, 0.2]}, "ensemble": [0.1, 0.2], "agreement": 0.4, "market_state": {"vix": 20.0, "regime": "calm"}}]}
    p, w = tmp_path / "sim.json", tmp_path / "w.json"
    p.write_text(json.dumps(doc, indent=1))
    w.write_text(json.dumps([{"A": 0.6, "B": 0.4}, {"A": 1.0}]))
    rounds = fs.simulation(spark, str(p))
    assert rounds.first()["agent_signals"]["a"] == [0.1, 0.2]
    assert {(r["asset"], r["weight"]) for r in fs.weights(spark, str(w), rounds).collect()} == {("A", 0.6), ("B", 0.4)}


def test_action_logs(spark, tmp_path):
    for name in ("twitter", "reddit"):
        (tmp_path / name).mkdir()
        rows = [{"round": 1, "timestamp": "2024-01-01T00:00:00", "agent_id": 7, "action_type": "LIKE_POST", "action_args": {"k": "1"}}, {"event_type": "round_end", "round": 1}, {"round": 2, "action_type": "X"}]
        (tmp_path / name / "actions.jsonl").write_text("\n".join([*map(json.dumps, rows), "", "{broken"]))
    got = fs.all_actions(spark, str(tmp_path))
    assert sorted(r["platform"] for r in got.collect()) == ["reddit", "twitter"]
    one = fs.action_log(spark, str(tmp_path / "twitter" / "actions.jsonl"), agent=7, round_num=1)
    assert one.count() == 1
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "actions.jsonl").write_text(json.dumps({"round": 1, "agent_id": 1, "platform": "p"}))
    assert fs.all_actions(spark, str(tmp_path / "old")).first()["platform"] == "p"


def test_factor_file_and_texts(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("A header line\n,Mkt-RF,SMB\n20200102, 1.5,-0.5\n20200103,0.5,0.25\n99999999,1,1\nCopyright\n")
    got = fs.factor_file(spark, str(p), ["mkt", "smb"]).orderBy("dt").collect()
    assert [(str(r["dt"]), r["mkt"]) for r in got] == [("2020-01-02", 0.015), ("2020-01-03", 0.005)]
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.txt").write_bytes("né".encode())
    (d / "b.md").write_bytes("né".encode("latin-1"))
    (d / "c.bin").write_bytes(b"x")
    assert sorted(r["text"] for r in fs.texts(spark, str(d)).collect()) == ["né", "né"]


def test_series_source(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"series": "VIX", "observations": [{"date": "2020-01-01", "value": "."}, {"date": "2020-01-02", "value": "3.5"}]}))
    spark.dataSource.register(fs.SeriesSource)
    got = spark.read.format("series").option("files", str(p)).load().orderBy("dt").collect()
    assert [r["value"] for r in got] == [None, 3.5]
    with pytest.raises(Exception):  # noqa: B017
        spark.read.format("series").option("files", str(tmp_path / "none.json")).option("retries", 1).load().collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2020-01-01", "A", 1.0)], "dt string, asset string, px double").withColumn("dt", F.to_date("dt"))
    fs.write_panel(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert [fs.versioned_json(df, str(tmp_path / "fb")) for _ in range(2)] == [1, 2]
    fs.write_lines(df, str(tmp_path / "l"))
    fs.write_lines(df, str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).count() == 2
    assert r"A & 1.0000 \\" in fs.latex(df, "c", "l")
    with pytest.raises(ValueError):
        fs.latex(spark.range(300).toDF("n"), rows=200)
    calls = []
    for _ in range(2):
        fs.load_or_compute(spark, str(tmp_path / "c"), lambda: calls.append(1) or df)
    assert len(calls) == 1


def test_text_functions(spark):
    d = spark.createDataFrame([("a\r\nb\r\r\r\rc  \n  d ",)], "t string")
    assert d.select(tx.normalised(F.col("t")).alias("t")).first()["t"] == "a\nb\n\nc\nd"
    assert list(tx.chunks("x" * 120, 50, 10)) == [(0, "x" * 50), (1, "x" * 50), (2, "x" * 40)]
    got = list(tx.chunks("One two. " * 20, 50, 10))
    assert all(c.endswith(".") for _, c in got) and got[0][0] == 0
    assert list(tx.chunks(None)) == [] and list(tx.chunks("  ")) == []
    tx.register(spark)
    assert spark.sql("select c.chunk_no from (select repeat('ab ', 300) t), lateral text_chunks(t, 500, 50) c").count() == 2
    for bad, good in (('{"a": [1, 2', {"a": [1, 2]}), ('{"a": "b', {"a": "b"}), ('{"a": {"b": 1,', {"a": {"b": 1}}), ('{"a":', {"a": None})):
        assert json.loads(tx.repaired(bad)) == good
    j = spark.createDataFrame([('{"a": 1}',), ('{"a": [1',), (None,)], "j string")
    assert [r["j"] for r in tx.repair_json(j, "j").collect()].count(None) == 1
    assert d.select(tx.gender(F.lit(" Woman ")).alias("g"), tx.percent(F.lit(0.1234)).alias("p")).first()[:] == ("female", "12.34%")


def test_retry_commands_model_files_and_summary(spark, tmp_path):
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return "done"

    assert fs.with_retry(call, 3, 0.5, waits.append) == "done" and waits == [0.5, 1.0]
    with pytest.raises(OSError):
        fs.with_retry(lambda: (_ for _ in ()).throw(OSError()), 2, 0, waits.append)
    queue = tmp_path / "queue"
    queue.mkdir()
    for k, text in enumerate(['{"command_id": "b", "command_type": "stop"}', "{broken", '{"command_id": "a", "command_type": "go"}']):
        (queue / f"{k}.json").write_text(text)
        os.utime(queue / f"{k}.json", (1000 + k, 1000 + k))
    assert [r["command_id"] for r in fs.commands(spark, str(queue)).collect()] == ["b", "a"]
    models = tmp_path / "models"
    models.mkdir()
    for n in ("ridge_SPY_ret.bin", "lasso_TLT_fwd.bin", "readme.txt"):
        (models / n).write_bytes(b"x")
    assert sorted((r["model"], r["ticker"], r["kind"]) for r in fs.model_files(spark, str(models)).collect()) == [("lasso", "TLT", "fwd"), ("ridge", "SPY", "ret")]
    assert fs.summary_text(spark.createDataFrame([("a", 0.5)], "name string, sharpe double"), "Runs") == "Runs\n====\n\nname   : a\nsharpe : 0.5000\n"
