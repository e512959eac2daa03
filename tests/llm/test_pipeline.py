"""The pipeline's stages against brute force, each on what its predecessor kept."""

import hashlib

from pyspark.sql import functions as F
from test_llm_small import brute_components, brute_contamination
from tokenizers import Tokenizer

import corpus_pipeline
from loomspan.llm import bpe, toxicity
from loomspan.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "tokens":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
        kept[name] = {r["doc_id"]: r for r in (docs if name != "tokens" else out).collect()}

    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    want = {i for i, r in rows.items() if model.scores([r["text"]])[0] < 0.5}
    assert set(kept["toxicity"]) == want

    strip = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(strip))
    seen = {}
    for i, r in kept["toxicity"].items():
        for k in {key(x) for x in r["text"].split("\n")} - {""}:
            seen.setdefault(k, set()).add(i)
    for i, r in kept["toxicity"].items():
        t = "\n".join(x for x in r["text"].split("\n") if len(seen.get(key(x), ())) < 10)
        assert kept["line dedup"][i]["text"] == t and kept["line dedup"][i]["n_chars"] == len(t)

    ids = sorted(kept["line dedup"])
    comp = brute_components([kept["line dedup"][i]["text"] for i in ids], 4, 5)
    assert set(kept["near dedup"]) == {i for k, i in enumerate(ids) if comp[k][1] == k}

    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    ids = sorted(kept["near dedup"])
    bad = brute_contamination([kept["near dedup"][i]["text"] for i in ids], items)
    assert set(kept["decontamination"]) == {i for k, i in enumerate(ids) if not bad[k][4]}

    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    assert set(kept["tokens"]) == set(kept["decontamination"])
    for i, r in kept["tokens"].items():
        e = lib.encode(kept["decontamination"][i]["text"], add_special_tokens=False)
        assert r["n_tokens"] == len(e.ids)
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_take_odd_rows(spark):
    base = table(spark, SF, "documents")
    rows = [(None, "a b c d e f g", None, None, None), (1, None, None, None, None), (1, "x y z", "en", "s", 5), (2, "", "en", "s", 0), (1, None, None, None, None)]
    odd = spark.createDataFrame(rows, base.schema)
    for d in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            d = spark.createDataFrame((out := stage(spark, d, SF)).collect(), out.schema)
        assert d.count() in (0, 4)


def test_stages_leave_columns_of_any_name(spark):
    names = ["_score", "_found", "n_words", "_n_lines", "__gone", "kept", "component_id", "c", "h", "n"]
    base = table(spark, SF, "documents").limit(60).cache()
    docs = base.select("*", *[F.lit(k).alias(x) for k, x in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame((out := stage(spark, docs, SF)).collect(), out.schema)
        assert docs.columns == [*base.columns, *names], name
        assert {tuple(r) for r in docs.select(names).distinct().collect()} == {tuple(range(len(names)))}


def test_rows_of_one_id(spark):
    """Texts that differ are documents of their own, equal ones are one."""
    base = table(spark, SF, "documents").schema
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "p q r s t u v"), (3, "x y z x y"), (3, "x y z x y"), (0, "a b c d e f g")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], base)
    out = corpus_pipeline.near_copies_go(spark, docs, SF).collect()
    assert sorted(r["text"] for r in out) == sorted({t for _, t in rows})
