import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sightline.llm import edit_counts, open_window_packing, pretokens, word_bpe

from .conftest import thue_morse

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def test_splits():
    rng = random.Random(1)
    letters = " \n\t'strevldmA1é,. 　²中 \r🎉"
    given = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + [""]
    for spaced, pattern in ((True, public_tokenizers.PATTERN), (False, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")):
        split = pretokens.Split(given, spaced)
        words = split.words(np.arange(len(split.starts)))
        for k, text in enumerate(given):
            assert words[split.bounds[k] : split.bounds[k + 1]] == regex.findall(pattern, text)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pretokens, "PIECE", 200)
    rng = random.Random(4)
    text = " ".join(rng.choice(["the", "it's", "12", "x,y", "é", "\n\n", "don't 's"]) for _ in range(800))
    parts = pretokens.pieces(text)
    assert len(parts) > 5 and "".join(parts) == text
    assert [w for p in parts for w in regex.findall(public_tokenizers.PATTERN, p)] == regex.findall(public_tokenizers.PATTERN, text)
    assert pretokens.pieces("x" * 1000) == ["x" * 1000]
    table = open_window_packing.word_ids(WORD)
    whole = open_window_packing.document_ids([text, ""], table)
    assert open_window_packing.document_ids([text], table)[0].tolist() == whole[0].tolist()
    import pyarrow as pa

    def records(rows):
        chunk = word_bpe._Chunk()
        chunk.add(pa.RecordBatch.from_pydict(rows))
        return chunk.records(0, 3)

    a, b = records({"doc_id": [1], "text": [text]}), records({"doc_id": [1, 2], "text": [text, ""]})
    counts = [word_bpe._unpack(r[0][3], "<i8", "u1", "<u4", "<u4") for r in (a, b)]
    assert counts[0][2].tolist() == counts[1][2][:1].tolist() and counts[0][3].tolist() == counts[1][3].tolist() and a[1:] == b[1:]


def test_word_ids_keep_their_bound():
    asked = []

    def encode(words):
        asked.extend(words)
        return [[len(w), 7] for w in words]

    table = pretokens.WordIds(encode, limit=50, recent=10)
    for k in range(20):
        split = pretokens.Split([f"word{chr(97 + k)} the the", f"again{chr(97 + k)} x"], True)
        flat, bounds = table.ids(split)
        assert bounds.tolist() == [0, 6, 10] or len(flat) == bounds[-1]
        assert flat.tolist() == [v for w in split.words(np.arange(len(split.starts))) for v in (len(w), 7)]
        assert sum(len(x[0]) for x in table.levels) <= 60


def test_bpe(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(word_bpe, "BITE_BYTES", 2000)
    enc = word_bpe.encoding(MULTI)
    want = []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i or -1, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [(r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.digests(docs, MULTI).collect()]
    assert sorted(got) == sorted(want)
    ids = {r["doc_id"]: r["ids"] for r in word_bpe.encode(docs.where("doc_id > 3"), PLAIN).collect()}
    assert ids[73] == word_bpe.encoding(PLAIN).encode_ordinary(dict(rows)[73])
    assert word_bpe.digests(empty, MULTI).count() == 0


@pytest.mark.parametrize("held", [700_000, 20])
def test_bpe_in_several_chunks(docs, rows, monkeypatch, held):
    monkeypatch.setattr(word_bpe, "WORDS_HELD", held)
    records = word_bpe.explode(docs.coalesce(1), 5, chunk_bytes=3000)
    assert records.select("chunk").distinct().count() > 1
    both = records.where("kind = 0").union(word_bpe.encode_buckets(records.where("kind = 1"), PLAIN))
    import pyarrow as pa

    got = word_bpe.assemble(both, 5, lambda ids: (len(ids),), "doc_id long, n long", pa.schema([("doc_id", pa.int64()), ("n", pa.int64())])).collect()
    enc = word_bpe.encoding(PLAIN)
    assert sorted((r["doc_id"] or -1, r["n"]) for r in got) == sorted((i or -1, len(enc.encode_ordinary(t or ""))) for i, t in rows)


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.encode_special_tokens = True
    ids = sorted(((i, np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")) for i, x in rows), key=lambda r: (r[0] or -1, len(r[1])))
    out = open_window_packing.pack(docs, WORD, open_windows=4).collect()
    place: dict[int, list] = {}
    for r in out:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for pieces in place.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))]
        size = sum(n for _, n in pieces)
        assert size <= 2048
        total += size if size & (size - 1) == 0 else 2048
    assert total <= 1.01 * sum(len(x) for _, x in ids) + 64
    assert sorted(r["doc_id"] or -1 for r in out if r["start"] == 0) == [i or -1 for i, _ in ids]
    unique = {i: x for i, x in ids if [j for j, _ in ids].count(i) == 1}
    seen: dict[int, int] = {}
    for r in out:
        if r["doc_id"] in unique:
            x = unique[r["doc_id"]]
            assert r["doc_tokens"] == len(x) and r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
            seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + r["length"]
    assert seen == {i: len(x) for i, x in unique.items()}
    assert open_window_packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_edits(seed):
    rng = random.Random(seed)
    letters = " \n\t'strevldmA1,. "
    table, pieces, count = edit_counts._tools(PLAIN)
    for trial in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 1500 if trial % 20 == 0 else 30)))
        p = pieces(text)
        doc = edit_counts.Counted(text, edit_counts.build([len(x) for x in p], [count(x) for x in p]), pieces, count)
        for _ in range(4):
            start, length, new = rng.randrange(-1, len(doc.text) + 3), rng.randrange(0, 12), "".join(rng.choice(letters) for _ in range(rng.randrange(0, 10)))
            at = min(max(start, 0), len(doc.text))
            want = doc.text[:at] + new + doc.text[min(len(doc.text), at + length) :]
            doc.edit(start, length, new)
            assert doc.text == want and list(edit_counts.walk(doc.tree, 0)) == [len(x) for x in pieces(want)]
            assert doc.tree.tokens == sum(map(count, pieces(want)))


def test_recount(docs, rows, spark):
    enc = word_bpe.encoding(PLAIN)

    def after(t):
        n = len(t)
        for start, length, new in ((n // 4, 0, t[max(n // 2 - 1, 0) :][: 24 if n // 2 else 23]), (n // 2, 11, ""), (n * 3 // 4, 5, " it's 2024!\n\n")):
            start = min(start, len(t))
            t = t[:start] + new + t[start + length :]
        return t

    got = edit_counts.recount(docs.select("doc_id", "text", "lang", F.lit(1).alias("n_tokens")).withColumn("edits", edit_counts.sample_edits()), PLAIN).collect()
    want = sorted((i or -1, len(enc.encode_ordinary(t or "")), len(enc.encode_ordinary(after(t or "")))) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_tokens_after"]) for r in got) == want
    long = [r for r in got if r["doc_id"] == 70][0]
    assert long["n_reencoded"] < 60 and long["n_pretokens"] > 20_000
    edits = spark.createDataFrame([(10, 2, 0, 3, ""), (10, 1, 5, 0, "new "), (99, 1, 0, 0, "x"), (None, 1, 0, 0, None)], "doc_id long, seq int, start long, length long, text string")
    made = edit_counts.recount(edit_counts.attach(docs.select("doc_id", "text"), edits), PLAIN).collect()
    t = dict(rows)[10]
    t = t[:5] + "new " + t[5:]
    assert [r["n_tokens_after"] for r in made if r["doc_id"] == 10] == [len(enc.encode_ordinary(t[3:]))] and len(made) == len(rows)


def test_added_tokens_in_texts(spark):
    t = Tokenizer.from_file(WORD)
    given = ["hello <|endoftext|> world", "<|startoftext|>a b<|endoftext|>", "A<|ENDOFTEXT|>b", "plain words", "<|endoftext|>" * 3]
    want = [np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4") for x in given]
    rows = open_window_packing.pack(spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").coalesce(1), WORD).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(x) for i, x in enumerate(want)}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())


@pytest.mark.parametrize("n", [1024, 2048])
def test_patterned_words(spark, n):
    a, b = thue_morse(n)
    rows = [(1, a), (2, b), (3, f"{b} {a}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    enc = word_bpe.encoding(MULTI)
    for r in word_bpe.digests(docs, MULTI).collect():
        text = dict(rows)[r["doc_id"]]
        ids = np.array(enc.encode_ordinary(text), "<u4")
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    t = Tokenizer.from_file(WORD)
    for (_, text), ids in zip(rows, open_window_packing.document_ids([t for _, t in rows], open_window_packing.word_ids(WORD)), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]
    plain = word_bpe.encoding(PLAIN)
    counted = edit_counts.recount(docs.withColumn("edits", edit_counts.sample_edits()), PLAIN).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in counted} == {i: len(plain.encode_ordinary(x)) for i, x in rows}


def test_trees_are_kept_between_runs(spark, docs, rows, tmp_path, monkeypatch):
    """Planted trees are written; two later runs load them, encode only what their edits touch, and agree with counts from the start."""
    enc = word_bpe.encoding(PLAIN)
    edit_counts.plant(docs.select("doc_id", "text"), PLAIN).write.parquet(f"{tmp_path}/0")
    now, rng = {i: t or "" for i, t in rows if i is not None and [j for j, _ in rows].count(i) == 1}, random.Random(8)
    for run in (1, 2):
        trees = spark.read.parquet(f"{tmp_path}/{run - 1}")
        changes = [(i, k, rng.randrange(len(now[i]) + 1), rng.randrange(9), rng.choice(["", " new", "don't", "\n\n12"])) for i in sorted(now) if i % 2 for k in range(3)]
        edits = spark.createDataFrame(changes, "doc_id long, seq int, start long, length long, text string")
        edit_counts.edit(edit_counts.attach(trees, edits), PLAIN).write.parquet(f"{tmp_path}/{run}")
        before = dict(now)
        for i, _, start, length, new in changes:
            now[i] = now[i][:start] + new + now[i][start + length :]
        got = spark.read.parquet(f"{tmp_path}/{run}").collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] in now:
                i = r["doc_id"]
                assert (r["text"], r["n_tokens"], r["n_tokens_after"]) == (now[i], len(enc.encode_ordinary(before[i])), len(enc.encode_ordinary(now[i])))
                assert list(edit_counts.walk(edit_counts.loaded(r["tree"]), 0)) == [len(x) for x in regex.findall(public_tokenizers.PATTERN, now[i])]
                assert r["n_reencoded"] <= 3 * 20 and (r["n_reencoded"] == 0) == (i % 2 == 0)
        trees = trees.drop(*edit_counts.COUNTS)


def test_recount_of_nothing(empty):
    assert edit_counts.recount(empty.select("doc_id", "text").withColumn("edits", edit_counts.sample_edits()), PLAIN).count() == 0
