"""Corpus operators against brute force, round trips and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from tokenizers import Tokenizer

from loomspan.llm import bpe, chat, decontam, licenses, linededup, media, neardup, sharding, toxicity, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, c long, word string"


def docs(spark, texts, first=0):
    """Texts with columns whose names the operators use inside."""
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or ""), "x", 1, 2, None) for i, t in enumerate(texts)], DOCS)


R = random.Random(7)
VOCAB = [f"w{i}" for i in range(60)]


def words(n):
    return [R.choice(VOCAB) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    out = [None, "", "   ", "one two", "ONE two", "one two", "a\n\nb"]
    base = [words(R.randint(40, 120)) for _ in range(15)]
    for b in base:
        out.append(" ".join(b))
        for _ in range(R.randint(0, 6)):
            c = list(b)
            for _ in range(R.randint(0, 4)):
                c[R.randrange(len(c))] = R.choice(VOCAB)
            out.append(" ".join(c))
    core = words(200)
    out += [" ".join([*core[:k], f"u{k}", *core[k:]]) for k in range(0, 200, 8)]  # a group longer than a short list
    passage = " ".join(words(30))
    out += [passage + " " + " ".join(f"q{i}x{j}" for j in range(60)) for i in range(20)]  # shares a passage, is no copy
    return out + [" ".join(words(30_000))]


def brute_components(texts, num, den):
    def shingles(t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) * den >= len(a | b) * num:
            x, y = find(i), find(j)
            label[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("t", ["0.85", "0.8"])
def test_near_duplicates(spark, texts, t):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs(spark, texts), t).collect()}
    num, den = (85, 100) if t == "0.85" else (4, 5)
    for i, (n, c) in enumerate(brute_components(texts, num, den)):
        assert got[i] == (n, c, c == i), (i, texts[i] and texts[i][:60])


def test_near_duplicates_rest_goes_through_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(neardup, "ROUNDS", 0)
    monkeypatch.setattr(neardup, "SHORT_LIST", 1)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    monkeypatch.setattr(neardup, "RELIST", 64)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, texts), "0.85").collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute_components(texts, 85, 100)]


def test_near_duplicates_of_a_large_group(spark):
    """Copies of one text with up to an eighth of their words changed, near and beyond the threshold: no link is lost."""
    base = [f"b{i}" for i in range(260)]
    group = []
    for k in range(320):
        c = list(base)
        for p in R.sample(range(260), R.randint(0, 8)):
            c[p] = f"e{k}x{p}"
        group.append(" ".join(c))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_dedup(docs(spark, group)).collect()}
    want = [c for _, c in brute_components(group, 85, 100)]
    assert [got[i] for i in range(len(group))] == want and len(set(want)) > 20


def test_near_duplicates_odd_rows(spark):
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_dedup(d).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 1, False), (1, 1, True), (2, 2, True)], key=str)
    assert neardup.near_dedup(d.limit(0)).count() == 0


def test_line_dedup(spark):
    texts = [f"Common line \nown {i}\n\tCOMMON LINE\n" + ("rare\n" if i < 9 else "") for i in range(12)] + [None, "", "\n\n"]
    got = {r["doc_id"]: r for r in linededup.drop_common_lines(docs(spark, texts)).collect()}
    assert got[0]["text"] == "own 0\nrare\n" and got[11]["text"] == "own 11\n"
    assert (got[0]["_n_lines"], got[0]["_n_dropped"]) == (5, 2)
    assert got[12]["text"] == "" and got[12]["_n_lines"] == 1 and got[14]["text"] == "\n\n" and got[14]["_n_dropped"] == 0
    assert got[0]["source"] == "src0" and got[0]["c"] == 2
    same = spark.createDataFrame([(1, "x\ny")] * 12 + [(None, "x")] * 3, "doc_id long, text string")
    assert {r["text"] for r in linededup.drop_common_lines(same).collect()} == {"x\ny", "x"}  # one document, twelve rows
    assert linededup.line_dedup(same.limit(0)).count() == 0


def test_bpe_is_the_library(spark):
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    odd = ["", None, "don't WE'LL  x\t\n", "ΑΣ Σ ςσ İ ß é", "<|endoftext|>a<|startoftext|>", "a" * 4000, "!" * 999, "日本語 🎉​\x1c x\x85y 3½Ⅷ²", "the" * 2000]
    chars = "abcdehinorst  \n'!?.0123éß中Σ🎉-_<|>"
    odd += ["".join(R.choice(chars) for _ in range(R.randint(0, 60))) for _ in range(400)]
    t = bpe.tokenizer(bpe.vocabulary_path())
    for x in odd:
        want = lib.encode(x or "", add_special_tokens=False).ids
        assert t.encode(x or "").tolist() == want, x
        assert t.decode(t.encode(x or "")).decode() == lib.decode(want, skip_special_tokens=False)
    rows = bpe.encode_documents(docs(spark, odd), bpe.vocabulary_path()).collect()
    assert [r["_ids"] for r in rows] == [lib.encode(x or "", add_special_tokens=False).ids for x in odd]
    assert bpe.bpe_round_trip(docs(spark, ["x"]).limit(0)).count() == 0


def brute_contamination(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, found = word(t), set(), set()
        for k, (i, x) in enumerate(items):
            v = word(x)
            n = min(13, len(v))
            for p in range(len(v) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == v[p : p + n]:
                        hit |= set(range(q, q + n))
                        found.add((k, str(i)))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(i for _, i in found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [10**9, 300])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "SHARD_WORDS", 500)
    items = [(i, " ".join(words(R.randint(13, 40)))) for i in range(8)] + [(8, "w1 w2 w3"), (9, ""), (10, None), (11, "w1 w2 w3"), (12, "ünï w5")]
    texts = [None, "", "w1-W2...w3", "Ünï w5"] + [" ".join(words(R.randint(1, 200))) for _ in range(30)]
    for _ in range(20):
        x = items[R.randrange(8)][1].split()
        a = R.randrange(max(1, len(x) - 14))
        texts.append(" ".join([*words(R.randint(0, 300)), *x[a : a + R.randint(12, 25)], *words(R.randint(0, 50))]))
    texts += [items[0][1] + " " + items[0][1], " ".join(["w1 w2 w3"] * 50), " ".join(["w7"] * 400)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontam.decontaminate(docs(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == brute_contamination(texts, items)
    assert all(not r["contaminated"] for r in decontam.decontaminate(docs(spark, texts), bench.limit(0)).collect())
    assert decontam.decontaminate(docs(spark, texts).limit(0), bench).count() == 0


def test_fm_index_finds_every_place():
    import numpy as np

    rng = np.random.default_rng(3)
    s = np.append(rng.integers(0, 4, 3000), 0).astype(np.int32)
    index = decontam.FMIndex(s)
    for n in (1, 2, 5):
        windows = np.array(list(itertools.product([1, 2, 3], repeat=n)), np.int32)
        w, lo, hi = index.search(windows, np.full(len(windows), n))
        got = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(w, lo, hi, strict=True)}
        for k, x in enumerate(windows):
            assert got.get(k, []) == [i for i in range(len(s) - n + 1) if (s[i : i + n] == x).all()]


def test_url_rules(spark):
    urls = ["http://a.com/en/1", "http://www.Example.com/en/70?x", "ftp://net/de/", "http://example.net/de/8", "http://x.net/de#f", "no scheme", None, "", "http://xexample.com/en/7", "https://org/es/", "http://u:p@m.org:80/es/x", "http://a.fr/" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, n int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    want = {0: ("a.com", "/en/1", "com/en/", "block"), 1: ("www.example.com", "/en/70", "example.com/en/7", "allow"), 2: ("net", "/de/", "net/de/", "block"), 3: ("example.net", "/de/8", "example.net/de/8", "block"), 8: ("xexample.com", "/en/7", "com/en/", "block"), 9: ("org", "/es/", "org/es/", "block")}
    for i, w in want.items():
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == w
    assert (got[6]["host"], got[6]["path"], got[6]["rule"]) == ("", "", None) and (got[5]["host"], got[5]["path"]) == ("", "")
    assert (got[10]["host"], got[10]["path"]) == ("u:p@m.org:80", "/es/x") and got[4]["path"] == "/de"
    assert all(r["verdict"] in ("allow", "block") for r in got.values()) and got[0]["n"] == 5
    assert urlfilter.judge(pages.limit(0)).count() == 0


def test_url_trees_learn(spark):
    rows = [(i, f"http://site{i % 7}.example/{'a' * (i % 5)}/{i}" + ("?a=1&b=2&c=3&d=4" if i % 3 == 0 else "")) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = pages.where("page_id % 2 = 0").selectExpr("url", "if(page_id % 3 = 0, 'block', 'allow') verdict")
    got = urlfilter.judge(pages, rules=[("block", "none.invalid", "/")], labelled=labelled).where("page_id % 2 = 1").collect()
    assert sum((r["verdict"] == "block") == (r["page_id"] % 3 == 0) for r in got) / len(got) > 0.95


def test_url_filter_trains_past_a_common_url(spark):
    from pyspark.sql import functions as F

    urls = [f"http://a{i}.com/en/{i}" for i in range(40)] + [f"http://b{i}.x-site.com/en/7{i}" for i in range(40)]
    labelled = spark.createDataFrame([(u, "block" if "x-site" in u else "allow") for u in urls], "url string, verdict string")
    first = labelled.orderBy(F.xxhash64("url")).first()
    hot = labelled.unionByName(spark.createDataFrame([first] * 100, labelled.schema))
    first = first["url"]
    stats = spark.createDataFrame([("com", 1)], "_suffix string, _n long")
    rows = urlfilter.training_rows(hot, stats, 60).collect()
    assert len({r["_url"] for r in rows}) == 60 and {r["_y"] for r in rows} == {0.0, 1.0}
    for y in (0.0, 1.0):  # a class weighs half, a common URL as often as it has rows
        own = [r for r in rows if r["_y"] == y]
        assert sum(r["_w"] for r in own) == pytest.approx(30)
        if hit := [r["_w"] for r in own if r["_url"] == first]:
            assert hit[0] / min(r["_w"] for r in own) == pytest.approx(101)


def brute_url(u):
    at = (u or "").find("://")
    rest = u[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_url_columns_random(spark):
    urls = [None, "", "://", "a://b://c/en/"] + ["".join(R.choice(["http", "://", "ex", "example.com", "EXAMPLE.net", ".", "com", "org", "net", "/en/", "/de/8", "/es/", "7", "?", "#", "/", "é"]) for _ in range(R.randint(1, 9))) for _ in range(400)]
    urls += [f"http://{R.choice(['', 'www.', 'x'])}{h}{p}{R.choice(['', 'x', '?y'])}" for _, h, p in urlfilter.RULES for _ in range(20)]
    pages = spark.createDataFrame([(i, u, 5) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = urlfilter.judge(pages).collect()
    assert {r["host_0"] for r in got} == {5}
    for r in got:
        host, path, rule, verdict = brute_url(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), urls[r["page_id"]]
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")


def test_url_rules_beside_bytes_that_are_not_utf8(spark):
    """Such bytes hide neither the :// nor the / after them, and no letter of a host or path."""
    want = {
        b"http\xc3://com/en/": ("com", "/en/", "com/en/", "block"),
        b"http://a.example.com/en/7\xe9?\xe9": ("a.example.com", "/en/7\ufffd", "example.com/en/7", "allow"),
        b"http://a\xf0.com/en/7": ("a\ufffd.com", "/en/7", "com/en/", "block"),
        b"http://\x80A.net/de/\xc3": ("\ufffda.net", "/de/\ufffd", "net/de/", "block"),
        b"http://a\xe2\x82example.net/de/8": ("a\ufffdexample.net", "/de/8", "net/de/", "block"),
        b"http\xe2\x82://org/es/x\xff#\xff": ("org", "/es/x\ufffd", "org/es/", "block"),
        b"http://a.\xc3com/en/": ("a.\ufffdcom", "/en/", None, None),
        "http://é.🎉.com/en/é🎉".encode(): ("é.🎉.com", "/en/é🎉", "com/en/", "block"),
    }
    pages = spark.createDataFrame([(i, bytearray(u)) for i, u in enumerate(want)], "page_id long, b binary").selectExpr("page_id", "cast(b as string) url")
    got = {r["page_id"]: r for r in urlfilter.url_filter(pages).collect()}
    for i, (u, w) in enumerate(want.items()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"] if w[2] else None) == w, u


def test_url_trees_on_unseen_hosts(spark):
    """Trees of the labelled URLs of four fifths of the hosts rank those of the last fifth, and leave hyphenated names alone."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.sql import functions as F

    labelled = urlfilter.example_urls(spark).cache()
    assert labelled.exceptAll(urlfilter.example_urls(spark)).count() == 0 and labelled.count() < urlfilter.TRAIN_ROWS
    rows = urlfilter.training_rows(labelled, urlfilter.suffix_counts(labelled), urlfilter.TRAIN_ROWS).cache()
    assert rows.select("host").distinct().count() > 2_000
    held = F.pmod(F.xxhash64("host", F.lit(1)), F.lit(5)) == 0
    out = urlfilter.trees(rows.where(~held)).transform(urlfilter.assembled(rows.where(held)))
    assert BinaryClassificationEvaluator(rawPredictionCol="_raw", labelCol="_y").evaluate(out) > 0.95
    clean = ["http://my-bakery.example.com/en-x/1", "https://the-old-book-shop.org/about", "https://www.saint-denis-news.fr/2021/le-grand-prix.html", "https://a-b.de/", "http://ice-cream.example.net/fr/12"]
    thrown = ["http://x7f3k9q2a1b8.info/9f8a7b6c5d4e3f2a1b0c9d8e/a1b2c3d4e5f6", "http://10.3.44.12:8080/go.php?u=http%3A%2F%2Fabc12345def%2Fxx19ab83&id=31245", "http://a.b3.login-1.secure.x9k2.info/w?a=1f3a9&b=2c4d1&c=39a8f&d=4bb10&e=5d2c7&f=6a9e0"]
    got = {r["url"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame([(u,) for u in clean + thrown], "url string")).collect()}
    assert [got[u] for u in clean] == ["allow"] * len(clean) and [got[u] for u in thrown] == ["block"] * len(thrown)


def test_toxicity(spark):
    insults = ["idiot", "moron", "pathetic"]
    clean = [" ".join(words(40)) for _ in range(400)]
    bad = [" ".join([*words(20), R.choice(insults), *words(20)]) for _ in range(80)]
    d = docs(spark, clean + bad)
    labels = spark.createDataFrame([(i, 1, int(i >= 400)) for i in range(480)] + [(0, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, labels)
    odd = ["w1 i-d-i-o-t w2", "w3 idioot", "so p a t h e t i c now", "W4 M0RON!", None, "", "w1 " * 50_000, "x" * 50_000]
    p = model.scores(odd)
    assert all(p[:4] >= 0.5) and all(p[4:] < 0.5)
    got = toxicity.toxicity(d, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["predicted"] == (r["doc_id"] >= 400) for r in held)
    assert toxicity.fit(d, labels.limit(0)).scores(["x"])[0] < 0.5


def test_toxicity_landmarks_reach_a_rare_language(spark):
    often, rare = [f"{a}{b}ck{a}{b}ck" for a in "bdfgklmnprst" for b in "aeiou"], ["ñoquiza", "zoñudo"]
    clean = [" ".join(words(30)) for _ in range(300)]
    bad = [" ".join([*words(15), *R.sample(often, 12), *words(15)]) for _ in range(90)] + [" ".join([*words(30), *rare]) for _ in range(12)]
    labels = spark.createDataFrame([(i, int(i >= 300)) for i in range(402)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, clean + bad), labels, landmarks=48)
    assert {toxicity.form(t) for t in rare} & set(model.landmarks)
    assert all(model.scores(["w1 ñoquiza zoñudo w2"]) >= 0.5) and all(model.scores(["w1 w2 w3"]) < 0.5)


def test_toxicity_kernel_is_the_definition():
    k = toxicity.Kernel(["idiot", "trash"])

    def phi(s):
        out = {}
        for c in itertools.combinations(range(len(s)), 3):
            key = "".join(s[i] for i in c)
            out[key] = out.get(key, 0) + toxicity.LAMBDA ** (c[-1] - c[0] + 1)
        return out

    dot = lambda a, b: sum(v * b.get(u, 0) for u, v in a.items())
    for s in ["idiot", "idioot", "tarsh", "itiot", "trashes", "worthlessandpatheticidiots"]:  # the last is summed letter by letter
        for j, t in enumerate(["idiot", "trash"]):
            want = dot(phi(s), phi(t)) / (dot(phi(s), phi(s)) * dot(phi(t), phi(t))) ** 0.5
            assert k.values([s])[0, j] == pytest.approx(want, abs=1e-5)
    assert k.values(["t.r.a..s.h"])[0, 1] == pytest.approx(1) and (k.values(["at", "", "12"]) == 0).all()
    long = "counterrevolutionaries"  # a landmark counts whole
    whole = toxicity.Kernel([long])
    assert whole.values([long])[0, 0] == pytest.approx(1) and whole.values([long[:14]])[0, 0] < 0.8


def test_columns_named_as_added_ones_are_renamed(spark):
    d = docs(spark, ["x", None]).withColumnsRenamed({"c": "_score", "h": "_ids", "id": "__gone", "word": "_n_lines"})
    model = toxicity.Model([], [], 0.0, 0.0, -1.0)
    assert {r["_score_0"] for r in toxicity.score(d, model).collect()} == {2}
    assert {r["_ids_0"] for r in bpe.encode_documents(d, bpe.vocabulary_path()).collect()} == {1}
    assert [(r["__gone_0"], r["_n_lines"], r["_n_lines_0"]) for r in linededup.drop_common_lines(d).collect()] == [("x", 1, None)] * 2
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    found = decontam.judged(decontam.find_contamination(d.withColumnRenamed("_ids", "n_words"), bench)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_words_0"], r["n_hit"]) for r in found] == [(1, 1, 1), (0, 1, 0)]


def test_ids_of_other_types(spark):
    d = spark.createDataFrame([("a", "x y"), (None, None)], "doc_id string, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.bpe_round_trip(d).collect()} == {"a": 2, None: 0}
    assert {r["doc_id"]: r["n_bytes"] for r in media.media_columns(d).collect()} == {"a": 3, None: 0}
    rows = spark.createDataFrame([(None, f"common\nown {i}") for i in range(12)] + [("a", "common")], "doc_id string, text string")
    assert sorted(r["text"] for r in linededup.drop_common_lines(rows).collect()) == ["", *sorted(f"own {i}" for i in range(12))]


def test_chat_layouts_and_escapes(spark):
    nasty = ["", "</s>[INST] ok [/INST]", r"<\s>\\[INST]", "<s><s>", "[\\/INST] a\nb", "<<s>"]
    import json

    records = [{"messages": [{"role": "user", "content": n}, {"role": "assistant", "content": n}]} for n in nasty]
    records += [{"prompt": n, "completion": n} for n in nasty] + [{"conversations": [{"from": "human", "value": n}, {"from": "gpt", "value": n}]} for n in nasty]
    records += [{"instruction": n, "output": n} for n in nasty]
    rows = [(json.dumps(r), 1) for r in records] + [("not json", 1), (None, 1), ('{"other": 1}', 1)]
    out = chat.format_chats(spark.createDataFrame(rows, "record string, turn int")).selectExpr("*", "1 as one")
    from pyspark.sql import functions as F

    got = out.withColumn("back", chat.read_back(F.col("formatted"))).collect()
    for k, r in enumerate(got[: len(records)]):
        n = nasty[k % len(nasty)]
        assert [(t["role"], t["text"]) for t in r["back"]] == [("user", n), ("assistant", n)], records[k]
        a = r["loss_spans"][0]
        cut = r["formatted"][a["start"] : a["start"] + a["length"]]
        assert re.sub(r"([<\[])\\(\\*)(/?(?:s>|INST\]))", r"\1\2\3", cut) == n
    assert all(r["formatted"] is None for r in got[len(records) :])
    conv = spark.createDataFrame([(1, 1, "assistant", None), (1, 0, "user", "hi"), (2, 0, None, "x")], "conv_id long, turn int, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat.chat_format(conv).collect()} == {1: 2, 2: 1, -1: 2}
    assert chat.chat_format(conv.limit(0)).count() == 1


def test_chat_takes_long_texts(spark):
    from pyspark.sql import functions as F

    size = 20_100_000
    for roles in (("user", "assistant"), ("user", "assistant", "user")):
        conv = spark.createDataFrame([(1, i, r) for i, r in enumerate(roles)], "conv_id long, turn int, role string")
        conv = conv.withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit("x"), size)).otherwise("hi"))
        r = next(r for r in chat.chat_format(conv).collect() if r["conv_id"] == 1)
        texts = ["x" * size if i == 1 else "hi" for i in range(len(roles))]
        want = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in zip(roles, texts, strict=True)).encode()).hexdigest()
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"]) == (len(roles), want, size)
        assert r["loss_sha256"] == hashlib.sha256(texts[1].encode()).hexdigest()
        assert r["formatted_chars"] == sum(20 + len(a) + len(b) for a, b in zip(roles, texts, strict=True))
    long = spark.range(1).select(F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("x"), size), F.lit('","completion":""}')).alias("record"))
    with pytest.raises(Exception, match="does not parse"):
        chat.format_chats(long).select(F.length("formatted")).collect()


def test_license_scan(spark):
    mit = licenses.TEMPLATES[0][1]
    texts = [None, "", "The MIT License and mit  license; CC-BY", "GNU General Public License, apache-license", f"x y {mit} z", mit.replace("free of charge", "free of any charge"), "apache", "mit license " * 5000]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, texts)).collect()}
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    for i, t in enumerate(texts):
        w, places, labels = word(t), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[4]["labels"] == "mit" and got[5]["labels"] == "mit" and got[6]["labels"] == ""
    notice = dict(licenses.TEMPLATES)
    shuffled = notice["mit"].split()
    R.shuffle(shuffled)
    third = notice["bsd"].split()
    more = [notice["lgpl"], notice["gpl"], f"{notice['isc']} then {notice['mpl']}", " ".join(shuffled), " ".join(third[: len(third) // 3]), notice["agpl"] + " mit license"]
    more += [" ".join(w if k % 9 else f"{w} uh" for k, w in enumerate(notice["bsd"].split())), " ".join(reversed(notice["bsd"].split(".")))]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs(spark, [*more, more[0]])).collect()}
    assert [got[i]["labels"] for i in range(len(more))] == ["lgpl", "gpl", "isc,mpl", "", "", "agpl,mit", "bsd", "bsd"]
    assert got[0]["score"] == 1 and 0.5 <= got[6]["score"] < 1 and got[len(more)]["labels"] == "lgpl"
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "cc by"), (1, "cc by")], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["labels"]) for r in licenses.license_scan(twice).collect()) == [("1", "cc-by"), ("1", "mit"), ("1", "mit"), ("None", "cc-by")]
    assert licenses.license_scan(docs(spark, texts).limit(0)).count() == 0


def test_sharding(spark):
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill(names, 2039)
    counts = [table.count(i) for i in range(10)]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.fill(names[:-1], 2039)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.2 * 2039
    got = sharding.sharded(docs(spark, ["x"] * 500)).collect()
    again = {r["doc_id"]: r["shard"] for r in sharding.sharded(docs(spark, ["y"] * 500)).collect()}
    assert len(got) == 500 and all(again[r["doc_id"]] == r["shard"] for r in got)
    big = sharding.fill([f"shard-{i:05d}" for i in range(sharding.SHARDS)])
    assert all(big[r["slot"]] == r["shard"] for r in got)
    with pytest.raises(ValueError):
        sharding.fill(names, 2040)


def test_media_round_trip(spark):
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "ab" * 40_000]
    got = {r["doc_id"]: r for r in media.media_columns(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest())
        assert got[i]["media_bytes"] > len(want)
    kept = {r["doc_id"]: r for r in media.store(docs(spark, texts)).collect()}
    told = {r["doc_id"]: r for r in media.described(media.store(docs(spark, texts))).collect()}
    x = media.inspect(bytes(kept[6]["media"]))
    for i, t in enumerate(texts):
        raw, data = (t or "").encode(), bytes(kept[i]["media"])
        want, keys = raw + b" " * (-len(raw) % 192 if raw else 192), told[i]["keyframes"]
        assert got[i]["tail_crc32"] == zlib.crc32(want[-16:]) and got[i]["media_sha256"] == hashlib.sha256(data).hexdigest()
        assert b"".join(data[k["start"] : k["start"] + k["bytes"]] for k in keys) == want and {k["bytes"] for k in keys[:-1]} <= {25 * 192}
        assert got[i]["feature"] == f"raw 24000 {len(want) / 24000:.3f}s samples={len(want) // 192} keys={len(keys)} first={keys[0]['start']}+{keys[0]['bytes']} last={keys[-1]['start']}+{keys[-1]['bytes']}"
    assert sum(k["bytes"] for k in told[6]["keyframes"]) == 80_064 and x["codec"] == "raw " and x["decode_time"] == x["duration"]
    assert kept[0]["media"] == kept[1]["media"]
    with pytest.raises(ValueError):
        media.inspect(bytes(kept[6]["media"])[:400])
    assert media.media_columns(docs(spark, texts).limit(0)).count() == 0
