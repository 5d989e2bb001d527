import random

import corpus_pipeline
from sightline.llm import queries

from .conftest import prose
from .test_models import invented


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(300):
        words = prose(rng, 80) if k % 2 else invented(rng, "bb", 60)
        lang = "en" if k % 2 else "bb"
        toxic = k % 7 == 0
        if toxic:
            words = words.replace(" ", " zork ", 3)
        rows.append((k, words, lang, "s", len(words)))
        labels.append((k, 1, int(toxic)))
    clean = next(r for r in rows if r[0] == 1)
    rows += [(400, clean[1], "en", "s", 0), (401, "12345 67890", "en", "s", 0), (402, None, None, None, None), (None, clean[1] + " more", "en", "s", 0)]
    passage = prose(rng, 120)
    rows += [(500 + k, f"{prose(rng, 150)} {passage} {prose(rng, 150)}", "en", "s", 0) for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen[name] = docs.collect()
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    toxic = {k for k, _, t in labels if t}
    assert not ids("toxicity") & toxic and len(ids("toxicity")) == len({r[0] for r in rows} - toxic)
    assert not ids("language") & {401, 402} and ids("language") >= ids("toxicity") - {401, 402}
    assert 400 not in ids("near_duplicates") and 1 in ids("near_duplicates") and None in ids("language") and None not in ids("near_duplicates")
    left = {r["doc_id"]: r["text"] for r in seen["repeated_passages"]}
    assert all(passage[50:450] not in left[k] and r["n_chars"] == len(r["text"]) for k in range(500, 504) for r in seen["repeated_passages"] if r["doc_id"] == k)
    assert {r["doc_id"] for r in seen["packing"]} == ids("repeated_passages")
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == len(seen["packing"])


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]


def test_texts_that_share_a_doc_id(spark):
    rng = random.Random(10)
    a, b, c = (prose(rng, 200) for _ in range(3))
    d = prose(rng, 200)
    rows = [(1, a), (1, b), (2, b + " more"), (2, c), (2, c), (0, a + " more"), (None, d), (None, d), (None, d + " more"), (None, c + " more"), (-1, None), (None, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {x for x in got if x[0] is not None or x[1] is None} == {(0, a + " more"), (1, b), (2, c), (-1, None), (None, None)}
    assert len([t for i, t in got if i is None and t is not None]) == 1 and len(got) == 6
