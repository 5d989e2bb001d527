import random
import re
from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sightline.llm import byte_cnn, decision_list, license_scan, weak_toxicity

LANGUAGES = {"aa": "kel tor mun sil pra den vos".split(), "bb": "ouille eaux reau quin dée ère çon".split(), "cc": "ung schaft heit über straß öd ich".split()}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def language_rows(n=240):
    rng = random.Random(4)
    return [(k, invented(rng, lang, rng.randrange(5, 200)), lang) for k in range(n) for lang in [list(LANGUAGES)[k % 3]]]


def test_language(spark, docs, empty):
    table = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    model = byte_cnn.fit(table.where("doc_id % 4 <> 0"))
    held = byte_cnn.predict(table, model).where("doc_id % 4 = 0").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    odd = {r["doc_id"]: r for r in byte_cnn.predict(docs, model).where("doc_id < 4").collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (1, 2, 3))
    got = byte_cnn.predict(docs, model)
    assert got.count() == docs.count() and got.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    assert byte_cnn.fit(empty) is None and {r["lang_pred"] for r in byte_cnn.predict(docs, None).collect()} == {"und"}


def test_windows_cover_every_byte():
    for n in (0, 1, 5, 255, 256, 257, 509, 1000):
        rows, weight = byte_cnn.windows(bytes(range(256)) * 5 if n > 1280 else (bytes(range(256)) * 5)[:n])
        step = byte_cnn.WINDOW - max(byte_cnn.WIDTHS) + 1
        assert len(rows) == len(weight) and (len(rows) - 1) * step + byte_cnn.WINDOW >= n
        assert n < 4 or any((rows == 256).any(axis=1)) or (len(rows) - 1) * step + byte_cnn.WINDOW == n


def test_tables_equal_the_network(spark):
    model = byte_cnn.train(np.random.default_rng(1).integers(0, 257, (64, byte_cnn.WINDOW)).astype(np.uint16), np.arange(64) % 2, ["x", "y"], epochs=1)
    x = np.random.default_rng(2).integers(0, 257, (5, byte_cnn.WINDOW)).astype(np.uint16)
    e = model.embedding[x]
    plain = [(sum(e[:, j : j + byte_cnn.WINDOW - w + 1] @ f[j] for j in range(w))).max(axis=1) + b for w, f, b in zip(byte_cnn.WIDTHS, model.filters, model.biases, strict=True)]
    assert np.allclose(byte_cnn.pooled(x, model.tables(), model.biases), np.concatenate(plain, axis=1), atol=1e-4)


def toxic_rows(n=900):
    rng = random.Random(6)
    bad = ["zork", "blarg", "quux", "frobble"]
    rows, labels = [], []
    for k in range(n):
        lang = list(LANGUAGES)[k % 3]
        words = invented(rng, lang, rng.randrange(8, 120)).split()
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad) if lang != "cc" else "grumm" + rng.choice(LANGUAGES["cc"]))
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels + [(5, None), (None, 1)]


def test_toxicity(spark, docs, empty):
    rows, labels = toxic_rows()
    table, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = weak_toxicity.fit(table, known.where("doc_id % 5 <> 0"))
    assert {"zork", "blarg", "quux", "frobble"} <= {x.stem for x in model.lexicon}
    truth = dict(labels)
    held = [r for r in weak_toxicity.predict(table, model).collect() if r["doc_id"] % 5 == 0 and truth[r["doc_id"]] is not None]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    got = weak_toxicity.predict(docs, model)
    assert got.count() == docs.count() and not [r for r in got.collect() if r["predicted"]]
    nothing = weak_toxicity.fit(table, known.limit(0))
    assert all(r["score"] < 0.5 for r in weak_toxicity.predict(docs, nothing).collect())
    assert weak_toxicity.predict(empty, model).count() == 0


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    votes = np.zeros((4000, 6 + len(weak_toxicity.PATTERNS)))
    for j, (a, b) in enumerate([(0.7, 0.02), (0.6, 0.03), (0.65, 0.01)]):
        votes[:, j] = np.where(y, rng.random(4000) < a, rng.random(4000) < b)
    votes[:, 3] = votes[:, 4] = votes[:, 5] = votes[:, 0]
    q = weak_toxicity.label_model(votes)
    assert np.mean((q > 0.5) == y) > 0.93


def statistics_of(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(grams)
    repeated = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in decision_list.SYMBOLS), len(lines) - len(set(lines)), len(repeated)


def test_statistics(docs, rows, empty):
    extra = [(900, "x y z x y z\nx y z\n\n \nx y z\n"), (901, "a|b #c **　d $%&<> e\x0b\x0cf"), (902, "r " * 200)]
    table = docs.select("doc_id", "text", "kept").union(docs.sparkSession.createDataFrame([(*r, None) for r in extra], "doc_id long, text string, kept boolean"))
    got = decision_list.annotate(table, []).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((r["doc_id"] or -1, *(r[n] for n in names)) for r in got) == sorted((i or -1, *statistics_of(t)) for i, t in rows + extra)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and r["kept"] == (not r["base_failed"])
    assert decision_list.annotate(empty, []).count() == 0


def test_decision_list(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        words = invented(rng, "aa", rng.randrange(60, 150)).split()
        kind = rng.random()
        if kind < 0.15:
            words = [w + "$$$" for w in words]
        elif kind < 0.3:
            words = [w.upper() for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind >= 0.3)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (3, None), (None, 0)], "doc_id long, quality int")
    rules = decision_list.fit(docs, known)
    assert 2 <= len(rules) <= 4
    truth = dict(labels)
    got = [r for r in decision_list.annotate(docs, rules).collect() if not r["base_failed"]]
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in got]) > 0.98
    assert all(r["kept"] for r in got if truth[r["doc_id"]])
    plan = decision_list.annotate(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert decision_list.fit(docs, known.limit(0)) == []


def test_licenses(spark, docs, rows, empty):
    texts = license_scan.TEMPLATES
    extra = [(800, "intro line\nReleased under the MIT License.\nend"), (801, texts["MIT"]), (802, texts["ISC"].replace("hereby ", "").upper()), (803, "some words " * 60 + "\n\n" + texts["GPL-3.0 header"] + "\n\nmore " * 40), (804, "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0."), (805, "under the of and")]
    table = docs.select("doc_id", "text", F.lit("x").alias("license")).union(spark.createDataFrame([(*r, "x") for r in extra], "doc_id long, text string, license string"))
    got = license_scan.scan(table).select("doc_id", "license", "dice", "n_matches").collect()
    found = {r["doc_id"]: r["license"] for r in got}
    assert found[800] == "MIT notice" and found[801] == "MIT" and found[802] == "ISC" and found[803] == "GPL-3.0 header" and found[805] is None
    documents = table.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"})
    db = duckdb.connect()
    db.register("documents", documents)
    want = db.sql(license_scan.oracle()).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert license_scan.scan(empty).count() == 0
    plan = license_scan.scan(spark.range(3).selectExpr("id as doc_id", "cast(id as string) as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


MIT_LAYOUT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licenses_inside_longer_texts(spark):
    """In their usual layout of several paragraphs, with either line end, and within a line."""
    rng = random.Random(11)
    around = lambda: "\n\n".join(invented(rng, "aa", 60) for _ in range(4))
    texts = license_scan.TEMPLATES
    header = texts["Apache-2.0 header"].replace("You may obtain a copy of the License at ", "You may obtain a copy of the License at\n\n    ").replace(" Unless required", "\n\nUnless required")
    rows = [
        (1, f"{around()}\n\n{MIT_LAYOUT}\n{around()}", "MIT"),
        (2, f"{around()}\n\n{MIT_LAYOUT}\n{around()}".replace("\n", "\r\n"), "MIT"),
        (3, f"{around()}\n \t\n{header}\n\n{around()}", "Apache-2.0 header"),
        (4, "This text: Released under the MIT License. See more below for details about it.", "MIT notice"),
        (5, f"{around()}\n\n{texts['BSD-3-Clause'].replace(' 1. ', chr(10) * 2 + '1. ').replace(' 2. ', chr(10) * 2 + '2. ').replace(' 3. ', chr(10) * 2 + '3. ').replace(' THIS SOFTWARE IS', chr(10) * 2 + 'THIS SOFTWARE IS')}\n\n{around()}", "BSD-3-Clause"),
        (6, around(), None),
    ]
    docs = spark.createDataFrame([(i, t, "u", "k") for i, t, _ in rows], "doc_id long, text string, units string, known string")
    got = license_scan.scan(docs)
    assert got.columns == ["doc_id", "text", "units", "known", "matches", "license", "dice", "n_matches"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert {i: found[i]["license"] for i, _, _ in rows} == {i: name for i, _, name in rows}
    assert all(r["units"] == "u" and r["known"] == "k" for r in found.values())
    db = duckdb.connect()
    db.register("documents", docs.select("doc_id", "text").toPandas())
    want = db.sql(license_scan.oracle()).fetchall()
    assert sorted((r["doc_id"], r["license"], r["dice"], r["n_matches"]) for r in found.values()) == sorted(want)


def test_signs_lose_no_match():
    rng = random.Random(2)
    rows = license_scan._rows(license_scan.TEMPLATES, 0.8)
    signs = license_scan._signs(rows)
    for r in rows:
        for _ in range(50):
            kept = rng.sample(r["b"], r["lo"])
            assert any(set(x.split()) & set(signs) for x in kept)


def test_every_language_is_a_class(spark):
    rows = [(k, chr(0x400 + 3 * (k % 70)) * 40, f"l{k % 70}") for k in range(280)]
    model = byte_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted({r[2] for r in rows})


def test_language_scores_by_brute_force(spark, docs):
    """predict() against the network evaluated window by window, byte by byte."""
    model = byte_cnn.fit(spark.createDataFrame(language_rows(60), "doc_id long, text string, lang string"))

    def network(window):
        e = model.embedding[window]
        h = [max(0.0, float(max(sum(e[p + j] @ f[j][:, k] for j in range(w)) for p in range(len(window) - w + 1)) + b[k])) for w, f, b in zip(byte_cnn.WIDTHS, model.filters, model.biases, strict=True) for k in range(f.shape[2])]
        z = np.array(h) @ model.weights + model.bias
        return z - z.max() - np.log(np.exp(z - z.max()).sum())

    texts = [(1, "kel tor mun"), (2, "schaft über heit " * 9), (3, "123"), (4, None), (5, "x" + "ère quin " * 60)]
    got = {r["doc_id"]: r for r in byte_cnn.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        if i in (3, 4):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        rows, weight = byte_cnn.windows(t.encode())
        mean = sum(network(r.tolist()) * float(w) for r, w in zip(rows, weight, strict=True)) / float(sum(weight))
        p = np.exp(mean) / np.exp(mean).sum()
        assert got[i]["lang_pred"] == model.languages[int(p.argmax())] and abs(got[i]["score"] - p.max()) < 1e-3


def test_toxicity_scores_by_brute_force(spark, docs):
    """predict() against votes counted by regular expressions, one voter after another."""
    rows, labels = toxic_rows(600)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    model = weak_toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    odd = [(9000, None), (9001, ""), (9002, "ZORK zork!! Zorks zork"), (9003, "blarg " * 40), (9004, "zorkzork éblarg blargé quux-quux"), (9005, "LOUD WORDS!!!!")]

    def score(text):
        low = text.lower()
        hits = [len(re.findall(rf"(?<![^\W\d_]){re.escape(x.stem)}(?=[^\W\d_])" if x.beginning else rf"(?<![^\W\d_]){re.escape(x.stem)}(?![^\W\d_])", low)) for x in model.lexicon]
        words = low.count(" ") + low.count("\n") + 1
        levels = [(True, n > 1, n > 2, n > 1 and n * 250 >= words) for n in hits]
        votes = [float(n > 0 and lv[x.level]) for n, lv, x in zip(hits, levels, model.lexicon, strict=True)]
        n, total = sum(votes), sum(hits)
        votes += [n > 1, n > 2, bool(n) and total * 150 >= words, bool(n) and total * 50 >= words, n == 0, bool(text) and text.isupper(), text.count("!!") * 8 > len(text) / 8]
        return 1 / (1 + np.exp(-np.clip(np.array(votes, float) @ model.weights + model.bias, -30, 30)))

    given = rows + odd
    got = {r["doc_id"]: r for r in weak_toxicity.predict(spark.createDataFrame(given, "doc_id long, text string"), model).collect()}
    for i, t in given:
        want = score(t or "")
        assert abs(got[i]["score"] - want) < 1e-6 and got[i]["predicted"] == int(got[i]["score"] >= 0.5), (i, t)


def test_decision_list_by_brute_force(spark, docs, rows):
    """annotate() against the rules applied to plain statistics, one after another."""
    C = decision_list.Condition
    rules = [[C("repeat_share", True, 0.2), C("words", True, 60.0)], [C("mean_word", False, 3.4)], [C("dup_line_share", True, 0.1)], [C("symbols_per_word", True, 0.01), C("caps_share", True, 0.1)]]
    plain = lambda n, size=7: " ".join(f"{k:x}".rjust(size, "w") for k in range(n))
    extra = [(900, plain(150) + " aaaa bbbb cccc" * 15), (901, plain(90, 2)), (902, plain(200) + "\nsame line here" * 3 + "\nx\ny"), (903, plain(100).upper() + " # #"), (904, plain(80))]
    table = docs.select("doc_id", "text", "kept").withColumn("__words", F.lit(1)).union(spark.createDataFrame([(*r, None, 1) for r in extra], "doc_id long, text string, kept boolean, w int"))
    got = decision_list.annotate(table, rules).collect()

    def want(text):
        n, chars, symbols, dup, repeat = statistics_of(text)
        text = text or ""
        if n < 50 or 100 * repeat > 50 * n:
            return False, 0
        lines = len([x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
        caps = len(re.findall("[A-Z]", text))
        ratio = {"mean_word": chars / n, "symbols_per_word": symbols / n, "dup_line_share": dup / lines if lines else 0, "repeat_share": repeat / n, "caps_share": caps / chars if chars else 0, "words": n}
        for k, rule in enumerate(rules, 1):
            if all(ratio[c.ratio] >= c.threshold if c.above else ratio[c.ratio] < c.threshold for c in rule):
                return False, k
        return True, None

    assert sorted(((r["doc_id"] or -1, r["kept"], r["rule"]) for r in got), key=str) == sorted(((i or -1, *want(t)) for i, t in rows + extra), key=str)
    assert {r["rule"] for r in got} == {0, 1, 2, 3, 4, None} and "__words" in got[0].asDict()


def test_nothing_to_predict(empty):
    model = byte_cnn.train(np.random.default_rng(1).integers(0, 257, (8, byte_cnn.WINDOW)).astype(np.uint16), np.arange(8) % 2, ["x", "y"], epochs=1)
    assert byte_cnn.predict(empty, model).count() == 0
