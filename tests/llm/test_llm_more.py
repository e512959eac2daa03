"""Fill-in-middle, token counts and ranked search against brute force, the library and odd rows."""

import hashlib
import json
import math
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomspan.llm import chat, decontam, fim, licenses, search, tokencount, toxicity
from loomspan.llm.bpe import vocabulary_path

R = random.Random(11)
COLUMNS = "doc_id long, text string, _n int, _form string, __key int, _n_tokens int, score int, query int, part int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5, 6) for i, t in rows], COLUMNS)


def odd_texts():
    chars = "ab é中🎉\n\n\t '.<P>S2½"
    out = [None, "", "\n", "\n\n", "one", "one\n", "a<P>b\nc", "x\n<S>", "<M>", "é\n中🎉\nß", "end <|endoftext|> of<|endoftext|>", "don't we'LL  x\t\n", "a" * 3000]
    return out + ["".join(R.choice(chars) for _ in range(R.randint(0, 40))) for _ in range(300)]


UNITS = {"line": "[^\n]*\n|[^\n]+", "word": "^[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", "char": "(?s)."}


@pytest.mark.parametrize("unit", UNITS)
def test_units_are_those_of_the_pattern(unit):
    for t in odd_texts():
        raw, want = (t or "").encode(), re.findall(UNITS[unit], t or "")
        starts = fim.unit_starts(raw, unit)
        assert starts.bit_count() == len(want), t
        places = [fim.select(starts, len(raw), k) for k in range(len(want))]
        assert [raw[a:b].decode() for a, b in zip(places, [*places, len(raw)][1:], strict=True)] == want


def test_select_is_the_rank():
    for _ in range(200):
        width = R.randint(1, 300)
        bits = R.getrandbits(width)
        assert [fim.select(bits, width, k) for k in range(bits.bit_count())] == [i for i in range(width) if bits >> i & 1]


def test_fill_in_middle(spark):
    rows = list(enumerate(odd_texts())) + [(None, "a\nb\n"), (3, "\n\n")]
    out = fim.fill_in_middle(docs(spark, rows))
    assert {"_n_0", "_form_0", "__key_0", "score"} <= set(out.columns)
    got = out.withColumn("back", fim.restored(out["_fim"], out["_form"])).collect()
    forms = set()
    for (i, t), r in zip(rows, got, strict=True):
        t = t or ""
        u = re.findall(UNITS["line"], t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        a, b = sorted(int(h[8 * k : 8 * k + 8], 16) % (len(u) + 1) for k in (0, 1))
        pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
        assert r["_n"] == len(u) and r["back"] == t
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            assert (r["_form"], r["_fim"], r["_prefix_chars"]) == ("plain", t, None)
        else:
            spm = int(h[24:32], 16) % 100 < 50
            assert r["_fim"] == (f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}")
            assert (r["_form"], r["_prefix_chars"], r["_middle_chars"]) == ("spm" if spm else "psm", len(pre), len(mid))
        forms.add(r["_form"])
    assert forms == {"plain", "psm", "spm"}
    plain = fim.fill_in_middle(docs(spark, rows), rate=0).select("_form").distinct().collect()
    assert [r[0] for r in plain] == ["plain"]
    assert fim.fim_digest(docs(spark, rows).limit(0)).count() == 0


def test_long_text_is_cut_whole():
    raw = ("é line\n" * 400_000).encode()
    form, n, before, within, out = fim.cut(raw, "5")
    assert n == 400_000 and len(out) == len(raw) + 9 and before % 7 == 0 and form != "plain"


def test_counts_are_the_librarys(spark):
    path = vocabulary_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    texts = odd_texts() + ["ab ab cd" * 300, "the" * 2000, "!" * 999, " " * 500 + "x", "日本語 🎉​\x1c x\x85y 3½Ⅷ²　 z ", "it's  'S 're've\n\n 'll", "x​ y ßǅ ʰ 12٣"]
    chars = "abcdehinorst  \n'!?.0123éß中Σ🎉-_<|> \x1d"
    texts += ["".join(R.choice(chars) for _ in range(R.randint(0, 60))) for _ in range(600)]
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = tokencount.count_tokens(docs(spark, list(enumerate(texts))), path).collect()
    assert [r["_n_tokens"] for r in got] == want
    assert [r["_n_bytes"] for r in got] == [len((t or "").encode()) for t in texts] and got[0]["_n_tokens_0"] == 3
    digest = tokencount.token_counts(docs(spark, [(1, "a " * 1025), (1, "a " * 1025), (None, None)])).collect()
    assert [r["over_limit"] for r in digest] == [True, True, False] and digest[2]["n_bytes"] == 0
    assert tokencount.token_counts(docs(spark, []).limit(0)).count() == 0


def brute_search(rows, items, k):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    terms = [term(t) for _, t in rows]
    n, total = sum(map(bool, terms)), sum(map(len, terms))
    out = []
    for item, q in items:
        scores = []
        for (i, _), t in zip(rows, terms, strict=True):
            s = 0
            for w in set(term(q)) & set(t):
                df = sum(w in x for x in terms)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 20 * (50 + 50 * len(t) * n // total)))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def rows_and_items():
    vocab = [f"w{i}" for i in range(40)] + ["É", "中文", "A-B", "x_y"]
    rows = [(i, " ".join(R.choice(vocab) for _ in range(R.randint(1, 30)))) for i in range(150)]
    rows += [(i, "w1 w2 Rare w1") for i in range(400, 330, -1)]  # more ties than the list is long
    rows += [(None, "w1 w2 rare w1"), (None, None), (500, ""), (501, "!?"), (502, "rare"), (502, "w3 w3"), (502, "w3 w3"), (7, "rare " * 3000)]
    items = [(1, "w1 w2"), (2, "RARE rare w3"), (2, "RARE rare w3"), (3, None), (4, "?!"), (5, "absent"), (None, "é w9 B"), (6, " ".join(vocab))]
    return rows, items


@pytest.mark.parametrize("whole", [True, False])
def test_ranked_search(spark, monkeypatch, whole):
    rows, items = rows_and_items()
    if not whole:  # many shards and many blocks of queries
        monkeypatch.setattr(search, "SHARD_DOCS", 1)
        monkeypatch.setattr(search, "QUERY_BYTES", 30)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    d, q = docs(spark, rows).repartition(5), spark.createDataFrame(items, "item_id int, text string")
    try:
        got = [tuple(r) for r in search.search(d, q, 50).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == brute_search(rows, items, 50)
    assert search.search(d.limit(0), q).count() == search.search(d, q.limit(0)).count() == 0


def test_search_sql_on_odd_rows(spark):
    rows, items = rows_and_items()
    db = duckdb.connect()
    frame = lambda x, name: pd.DataFrame({name: pd.array([i for i, _ in x], "Int64"), "text": pd.array([t for _, t in x], "string")})
    documents, benchmark = frame(rows, "doc_id"), frame(items, "item_id")
    db.register("documents", documents)
    db.register("benchmark", benchmark)
    got = [tuple(r) for r in db.execute(search.SQL).fetchall()]
    assert sorted(got, key=str) == brute_search(rows, items, 50)


def layouts():
    user, reply = "a</s> é🎉", "[INST] b </s>中"
    return [
        ({"messages": [{"role": "user", "content": user}, {"role": "assistant", "content": reply}]}, "struct<messages:array<struct<role:string,content:string>>>"),
        ({"messages": [{"turn": 0, "role": "user", "text": user}, {"turn": 1, "role": "assistant", "text": reply}]}, "struct<messages:array<struct<turn:int,role:string,text:string>>>"),
        ({"conversations": [{"from": "human", "value": user}, {"from": "gpt", "value": reply}]}, "struct<conversations:array<struct<from:string,value:string>>>"),
        ({"prompt": user, "completion": reply}, "struct<prompt:string,completion:string>"),
        ({"instruction": user, "output": reply}, "struct<instruction:string,output:string>"),
        ({"system": "be", "prompt": user, "response": reply}, "struct<system:string,prompt:string,response:string>"),
        ({"instruction": "be", "input": user, "output": reply}, "struct<instruction:string,input:string,output:string>"),
    ], user, reply


@pytest.mark.parametrize("typed", [True, False])
def test_every_layout_goes_the_querys_path(spark, typed):
    known, user, reply = layouts()
    for value, kind in known:
        d = spark.createDataFrame([(1, json.dumps(value)), (2, None)], "conv_id long, record string")
        if typed:
            d = d.withColumn("record", F.from_json("record", kind))
        got = {r["conv_id"]: r for r in chat.digest(d).collect()}[1]
        system = "be" in value.values()
        turns = [*([("system", "be")] if system else []), ("user", user), ("assistant", reply)]
        assert (got["n_turns"], got["loss_chars"]) == (len(turns), len(reply)), kind
        assert got["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got["loss_sha256"] == hashlib.sha256(reply.encode()).hexdigest()
    hashes = [chat.format_chats(spark.createDataFrame([(json.dumps(v),)], "record string")).first()["schema_hash"] for v, _ in known]
    same = [chat.format_chats(spark.createDataFrame([(json.dumps(v),)], "r string").select(F.from_json("r", k).alias("record"))).first()["schema_hash"] for v, k in known]
    assert hashes == same and len(set(hashes)) == len(known)


def test_the_loss_digest_reads_the_mask(spark):
    rows = [(1, 0, "user", "uu[INST]"), (1, 1, "assistant", "abc</s>é"), (2, 0, "assistant", "xyz"), (2, 1, "assistant", "é🎉")]
    records = chat.as_records(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    right = {r["conv_id"]: r for r in chat.digest(records).collect()}
    assert right[1]["loss_chars"] == 8 and right[2]["loss_chars"] == 5
    shift = F.transform("loss_spans", lambda s: s.withField("byte_start", s["byte_start"] - 1))
    first = F.slice("loss_spans", 1, 1)
    for r in chat.digest(records.where("conv_id = 2"), first).collect():
        assert (r["loss_chars"], r["loss_sha256"]) == (3, hashlib.sha256(b"xyz").hexdigest())
    with pytest.raises(Exception, match="not its code points|MALFORMED"):
        chat.digest(records.where("conv_id = 1"), shift).collect()
    only = records.where("conv_id = 2").select("conv_id", F.struct(F.slice("record.messages", 1, 1).alias("messages")).alias("record"))
    assert chat.digest(only, shift).first()["loss_sha256"] == hashlib.sha256(b"]xy").hexdigest()


def test_paths_to_any_depth(spark):
    value = {"a b": 1, "x,y": {"q": [{"z": 1, "w>": "s"}, {"z": 2.5}]}, "m": [1, "a"], "e": {}, "t`k: ": None, "d.t": {"p": [[{"u": {"v": True}}]]}}
    d = spark.createDataFrame([(json.dumps(value),), ('[{"a":1}]',), ("3",), ("{",)], "r string")
    got = [r[0] for r in d.select(chat.paths(F.col("r"))).collect()]
    assert got[0].split("|") == sorted(["a b", "x,y.q[].z", "x,y.q[].w>", "m[]", "e", "t`k: ", "d.t.p[][].u.v"])
    assert got[1:] == ["[].a", "", None]


def brute_kernel(a, b, lam):
    """The normalised gap-weighted kernel of three letters, by its definition: all triples of places."""
    from itertools import combinations

    def features(s):
        out = {}
        for p in combinations(range(len(s)), 3):
            key = tuple(s[i] for i in p)
            out[key] = out.get(key, 0) + lam ** (p[-1] - p[0] + 1)
        return out

    x, y = features(a), features(b)
    dot = lambda u, v: sum(w * v.get(k, 0) for k, w in u.items())
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y)) if x and y else 0.0


def toxic_fixture(spark):
    pick = random.Random(5)
    plain = [f"{a}{b}{c}" for a in ("bar", "lon", "mit", "ser") for b in ("ta", "li", "no") for c in ("m", "sk", "pel")]
    insults = ["wobblehead", "grimskull", "snotface"]
    rows, labels = [], []
    for i in range(260):
        words = [pick.choice(plain) for _ in range(12)]
        toxic = int(i % 4 == 0)
        if toxic:
            words[3] = pick.choice(insults)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_scores_are_the_kernels(spark):
    docs_, labels = toxic_fixture(spark)
    settings = toxicity.Settings(landmarks=4, powers=(2, 5), lam=0.9)
    model = toxicity.fit(docs_, labels, settings=settings)
    texts = ["barta wobbleehead monol", "grimskull", "w o b b l e h e a d lonlisk", "", None, "barta lonli mitno", "snotface! snot-face barta"]
    got = [r["_score"] for r in toxicity.score(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()]
    for text, score in zip(texts, got, strict=True):
        own = toxicity.tokens_of(text)
        margin = 0.0
        for t in own:
            k = [brute_kernel(toxicity.form(t), s, 0.9) for s in model.landmarks]
            margin += sum(w * v for w, v in zip(model.weights, [x**2 for x in k] + [x**5 for x in k], strict=True))
        margin /= math.sqrt(max(1, len(own)))
        assert score == pytest.approx(1 / (1 + math.exp(-(model.a * (margin + model.constant) + model.b))), abs=1e-4), text
    assert got[0] > 0.5 > got[5]


def test_tuning_never_reads_held_out_labels(spark):
    docs_, labels = toxic_fixture(spark)
    choices = [toxicity.Settings(landmarks=3), toxicity.Settings(landmarks=2, powers=(4,))]
    first = toxicity.tune(docs_, labels, choices, folds=2).collect()
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert first == toxicity.tune(docs_, other, choices, folds=2).collect()
    rest = labels.where(~toxicity.held_out(F.col("doc_id"))).count()
    assert all(r["found"] + r["missed"] + r["flagged"] + r["passed"] == rest for r in first) and first[0]["f1"] > 0.9


def test_best_of_overlapping_spans(spark):
    pick = random.Random(9)
    rows = []
    for k in range(60):
        spans = [(pick.choice([0.8, 0.9, 1.0]), pick.randint(5, 30), pick.choice("abc"), a := pick.randint(0, 150), a + pick.randint(1, 40)) for _ in range(pick.randint(0, 25))]
        rows.append((k, spans))
    d = spark.createDataFrame(rows, f"k int, spans array<{licenses.SPAN}>")
    got = {r["k"]: sorted(map(tuple, r["best"])) for r in d.select("k", licenses.best_of_overlapping(F.col("spans")).alias("best")).collect()}
    for k, spans in rows:
        beaten = lambda s: any(o[3] < s[4] and s[3] < o[4] and o[:3] > s[:3] for o in spans)  # noqa: B023, E731
        assert got[k] == sorted(s for s in spans if not beaten(s))


def test_equal_benchmark_items_part(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 400)
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item)] * 30 + [(2, "x y z")], "item_id int, text string")
    got = decontam.decontaminate(docs(spark, [(5, f"a {item} b"), (6, "x y z"), (7, "none")]), bench).collect()
    assert {r["doc_id"]: r["n_items"] for r in got} == {5: 30, 6: 1, 7: 0}
