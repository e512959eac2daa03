"""The registered SQL against the operators: on the given tables and on odd rows; sharding against a fill written anew."""

import hashlib
import numbers

import duckdb
import pandas as pd
import pytest

from loomspan.llm import chat, licenses, linededup, queries, sharding, urlfilter

SF = "/root/testdata/sf0.001"


def compare(got, want):
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda df: sorted((tuple(None if pd.isna(v) else float(v) if isinstance(v, numbers.Number) else v for v in r) for r in df[names].itertuples(index=False, name=None)), key=str)
    got, want = rows(got), rows(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, nan_ok=True), (a, b)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = db.execute(queries.ORACLES[name]).df()
    compare(queries.QUERIES[name](spark, SF).toPandas()[list(sql.columns)], sql)


@pytest.mark.parametrize("name, sql, columns", [("op8_license_scan", licenses.SQL, []), ("op5_url_filter", urlfilter.SQL, ["ruled"])])
def test_some_columns_same_as_sql(spark, name, sql, columns):
    """Labels and verdicts beyond these are the method's own."""
    db = duckdb.connect()
    for t in ("documents", "pages"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = db.execute(sql).df(), queries.QUERIES[name](spark, SF).toPandas()
    if columns:
        got["ruled"] = got["verdict"].where(got["rule"].notna(), None)
    compare(got[list(want.columns)], want)


def test_chat_roles_stay_as_the_table_has_them(spark):
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = [(1, 0, "user|assistant", "a"), (2, 0, "human", "b"), (2, 1, "gpt", "c"), (3, 0, None, "d"), (4, 0, "user", None), (4, 1, "assistant", "x</s>"), (None, 0, "user", "e"), (None, 1, "assistant", "f"), (5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "v"), (6, 0, "user", "u"), (6, 0, "user", "u")]
    rows += [(7, i, "assistant" if i % 2 else "user", f"[INST] é🎉 {i}") for i in range(101)]
    db.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    compare(chat.chat_format(table).toPandas(), db.execute(chat.SQL).df())


def test_loss_spans_cover_assistant_texts(spark):
    import json

    texts = [f"{i} é🎉[INST]" for i in range(50)]
    record = json.dumps({"messages": [{"role": "user" if i % 2 else "assistant", "content": t} for i, t in enumerate(texts)]})
    r = chat.format_chats(spark.createDataFrame([(record, 1)], "record string, formatted int")).first()
    cut = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
    assert cut == [t.replace("[INST]", "[\\INST]") for t in texts[::2]] and r["formatted_0"] == 1


def test_line_dedup_random(spark):
    import random

    R = random.Random(3)
    lines = ["", " ", "Alpha", "alpha\t", "beta", "ÄB", "äb", "gamma x", "\x0bgamma x"]
    rows = [(R.choice([None, *range(25)]), R.choice([None, "\n".join(R.choice(lines) for _ in range(R.randint(0, 5)))])) for _ in range(120)]
    db = duckdb.connect()
    documents = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], "Int64"), "text": pd.array([t for _, t in rows], "string")})
    db.register("documents", documents)
    compare(linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).toPandas(), db.execute(linededup.SQL).df())


def test_sharding_fill_by_turns(spark):
    shards, slots = [f"s{i}" for i in range(7)], 211
    prefer = {}
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        first, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        prefer[s] = [(first + k * step) % slots for k in range(slots)]
        assert sorted(prefer[s]) == list(range(slots))
    owner, turn = {}, 0
    while len(owner) < slots:
        s = shards[turn % len(shards)]
        owner[next(k for k in prefer[s] if k not in owner)] = turn % len(shards)
        turn += 1
    assert sharding.fill(shards, slots) == [owner[k] for k in range(slots)]
    placed = sharding.place(spark.range(500).withColumnRenamed("id", "_slot"), ["_slot"], shards, slots)
    assert sorted(placed.columns) == ["_shard", "_slot", "_slot_0"] and placed.count() == 500
    assert all(r["_shard"] == owner[r["_slot"]] for r in placed.collect())
