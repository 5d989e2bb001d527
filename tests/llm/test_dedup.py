import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from sightline.llm import components, cover_tree_dedup, lsh_forest, pretokens, suffix_dedup

from .conftest import thue_morse


def groups(ids, edges):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in (e for e in edges if e[0] != e[1]):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5000, 5001 + k) for k in range(200)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges + edges[:50] + [(7, 7), (None, 3)], "a long, b long")).collect()}
    ids = {x for e in edges for x in e if e[0] != e[1]}
    assert got == groups(ids, edges)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("words", [4, 5])
def test_lsh_forest(docs, rows, words, monkeypatch):
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 6)  # so that clusters need several blocks
    got = lsh_forest.near_duplicates(docs, words, 80).collect()
    assert len(got) == len(rows)
    known = [(i, shingles(t, words)) for i, t in rows]
    ids = [i for i, _ in known if i is not None]
    edges = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = groups(ids, edges)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert sorted((r["doc_id"] or -1, r["n_shingles"]) for r in got) == sorted((i or -1, len(s)) for i, s in known)


def test_long_texts_in_slabs(monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join(f"W{k}\t" for k in rng.integers(0, 50, 900))
    want = lsh_forest.shingle_sets([text, "x"], 4)[0]
    monkeypatch.setattr(lsh_forest, "SLAB", 100)
    assert (lsh_forest.shingle_sets([text], 4)[0] == want).all() and len(want) == len(shingles(text, 4))


def test_lsh_forest_empty(empty):
    assert lsh_forest.near_duplicates(empty).count() == 0


def test_lsh_forest_large_clusters(spark):
    """Copies that are near one base but not each other: no link may be lost in clusters of many blocks."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, 400):
        w = list(base)
        for p in rng.integers(0, 150, rng.integers(3, 9)):
            w[p] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    sets = [shingles(t, 4) for _, t in rows]
    edges = [(a, b) for a in range(400) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(range(400), edges)
    assert got == want and len(set(want.values())) > 1


def removed(texts, width=suffix_dedup.WIDTH):
    seen: dict[bytes, list] = {}
    for k, b in enumerate(texts):
        for s in range(len(b) - width + 1):
            seen.setdefault(b[s : s + width], []).append((k, s))
    marks = [np.zeros(len(b), bool) for b in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, s in places:
                marks[k][s : s + width] = True
    out = []
    for b, m in zip(texts, marks, strict=True):
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        out.append((len(b), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(np.int8)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [192, 2])
def test_suffix_dedup(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SLAB", 1 << 14)
    rows = [(i, t) for i, t in rows]
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(docs).collect())
    want = sorted((i or -1, *x) for (i, _), x in zip(rows, removed([(t or "").encode() for _, t in rows]), strict=True))
    assert got == want


def test_tiles_of_large_clusters(spark, monkeypatch):
    """The same links with tiles of a few sets, for sets of very different sizes in one cluster."""
    monkeypatch.setattr(lsh_forest, "BLOCK_ROWS", 8)
    monkeypatch.setattr(lsh_forest, "TILE_ROWS", 5)
    monkeypatch.setattr(lsh_forest, "PIVOTS", 4)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(160):
        w = base[: int(rng.choice([60, 90, 120, 300, 400]))]
        for p in rng.integers(0, len(w), rng.integers(0, len(w) // 25 + 1)):
            w[p] = f"x{rng.integers(10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t, 4) for _, t in rows]
    edges = [(a, b) for a in range(160) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(range(160), edges)
    together = spark.createDataFrame([(k, 0, len(s)) for k, s in enumerate(sets)], "rep long, cluster long, n_shingles long")
    links = [(r["a"], r["b"]) for r in lsh_forest.confirm(docs, together, 4, 80).collect()]
    assert not {frozenset(x) for x in links} - {frozenset(e) for e in edges}
    assert groups(range(160), links) == want and 3 < len(set(want.values())) < 160


def test_what_is_cut_goes(spark, docs):
    import os

    from sightline.plans.shared import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    out = lsh_forest.near_duplicates(docs)
    left = set(os.listdir(folder)) - before
    assert len(left) == 3 and out.count() == docs.count()


def test_suffix_dedup_texts(docs, empty):
    out = suffix_dedup.deduplicate(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("k1 <> 'k'").count() == 0
    assert suffix_dedup.digests(empty).count() == 0 and suffix_dedup.deduplicate(empty).count() == 0


def passages_removed(texts, width=51):
    """By brute force: what is left when every run of so many words that starts anywhere else too is out."""
    words = [[(m.start(), m.end(), re.sub(r"^[\x00-\x2f:-@\[-`{-\x7f]+|[\x00-\x2f:-@\[-`{-\x7f]+$", "", m[0]) or m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    count = Counter(tuple(w[2] for w in ws[i : i + width]) for ws in words for i in range(len(ws) - width + 1))
    out = []
    for t, ws in zip(texts, words, strict=True):
        gone = [False] * len(t)
        for i in range(len(ws) - width + 1):
            if count[tuple(w[2] for w in ws[i : i + width])] > 1:
                gone[ws[i][0] : ws[i + width - 1][1]] = [True] * (ws[i + width - 1][1] - ws[i][0])
        out.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [256, 3])
def test_frequent_passages(spark, monkeypatch, hot):
    """Passages with other neighbours in every text, cut off at different places: the anchors at their edges have many different runs, whose slices are clipped."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = letters(1500), letters(700)
    rows = [(k, letters(rng.randrange(300)) + passage[rng.randrange(60) : len(passage) - rng.randrange(60)] + letters(rng.randrange(300))) for k in range(60)]
    rows += [(100 + k, letters(200) + other[k % 5 :] + letters(k % 3 * 40) + passage[:500]) for k in range(30)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == removed([t.encode() for _, t in rows])


def test_words_in_passages(docs, rows):
    got = sorted((r["doc_id"] or -1, r["n_passage_words"]) for r in suffix_dedup.digests(docs).collect())
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    given = [t or "" for _, t in rows]
    assert got == sorted((i or -1, words(t) - words(left)) for (i, _), t, left in zip(rows, given, passages_removed(given), strict=True)) and max(n for _, n in got) > 50


@pytest.mark.parametrize("hot", [192, 2])
def test_passages_of_over_50_words(docs, rows, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SLAB", 1 << 14)
    got = sorted((r["doc_id"] or -1, r["text"] or "") for r in suffix_dedup.deduplicate(docs, (suffix_dedup.PASSAGES,)).collect())
    assert got == sorted((i or -1, t) for (i, _), t in zip(rows, passages_removed([t or "" for _, t in rows]), strict=True))


def test_short_words_of_passages(spark):
    """Passages of 51 to 60 words of one to three letters are far under 400 bytes; one of 50 words stays."""
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    text = lambda n, most: " ".join(word(rng.randrange(1, most)) for _ in range(n))
    planted = {n: text(n, 4) for n in range(50, 61)}
    frames = ["{} {} {}", "{}\n{}\n{}", '{} "{}" {}', "{}\r\n({}),\t{}"]
    rows = [(100 * n + k, frame.format(text(70, 9), p.replace(" ", "\n", k), text(70, 9))) for n, p in planted.items() for k, frame in enumerate(frames)]
    rows.append((1, f"{text(5, 9)} {planted[60]} {planted[51]} {text(5, 9)}"))
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars"), "").collect()}
    for i, t in rows:
        n = i // 100
        assert len(got[i].split()) == (10 if i == 1 else 140 if n > 50 else 190), (i, t, got[i])


def test_deep_shallow_order():
    rng = np.random.default_rng(2)
    strings = [b"same beginning " * 4 + bytes(rng.integers(97, 99, rng.integers(0, 80)).astype(np.uint8)) for _ in range(300)] + [b"", b"a", b"a\0", b"a"]
    group = rng.integers(0, 4, len(strings))
    order = suffix_dedup.deep_shallow(group, strings)
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], strings[i]) for i in range(len(strings)))


def test_cover_tree_traversal():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.normal(size=(5, 4))
        x, y = (cover_tree_dedup.unit(base[rng.integers(0, 5, n)] + rng.normal(size=(n, 4)) * rng.choice([0.01, 0.1, 0.3])) for n in rng.integers(1, 60, 2))
        wx, wy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
        linked = x @ y.T >= 0.98
        a, b, _ = cover_tree_dedup.dual_traversal(cover_tree_dedup.CoverTree.grown(x), cover_tree_dedup.CoverTree.grown(y), wx, wy, 0.98, False)
        assert (a == linked @ wy).all() and (b == linked.T @ wx).all()


def clustered(rng, n, size=40):
    """n unit vectors in clusters of about `size`, with a radius of about 0.06."""
    base = rng.normal(size=(max(1, n // size), 16))
    return cover_tree_dedup.unit(base[rng.integers(0, len(base), n)] + rng.normal(size=(n, 16)) * 0.05)


@pytest.mark.parametrize("same", [True, False])
def test_traversal_compares_few_of_clustered_vectors(same):
    rng = np.random.default_rng(7)
    shares = []
    for n in (400, 1600):
        both = clustered(rng, n if same else 2 * n)
        x, y = (both, both) if same else (both[:n], both[n:])
        t = cover_tree_dedup.CoverTree.grown(x)
        t = cover_tree_dedup.CoverTree.unpacked(x, t.packed())
        u = t if same else cover_tree_dedup.CoverTree.grown(y)
        tally: dict = {}
        one, other = np.ones(len(x), np.int64), np.ones(len(y), np.int64)
        a, b, links = cover_tree_dedup.dual_traversal(t, u, one, other, 0.98, same, tally)
        linked = x @ y.T >= 0.98
        if same:
            np.fill_diagonal(linked, False)
            assert (a + b == linked.sum(axis=1)).all()
        else:
            assert (a == linked.sum(axis=1)).all() and (b == linked.sum(axis=0)).all()
        offset = 0 if same else n
        edges = [(i, j + offset) for i, j in zip(*(z.tolist() for z in np.nonzero(linked)), strict=True)]
        assert groups(range(n + offset), [(i, j + offset) for i, j in links]) == groups(range(n + offset), edges)
        shares.append(tally["distances"] / (n * n))
    assert shares[1] < 0.06 and shares[1] < 0.6 * shares[0]


@pytest.mark.parametrize("split", [65_536, 20])
def test_cover_tree(spark, monkeypatch, split):
    monkeypatch.setattr(cover_tree_dedup, "BLOCK_ROWS", 16)
    monkeypatch.setattr(cover_tree_dedup, "SPLIT_ROWS", split)
    if split == 20:
        monkeypatch.setattr(cover_tree_dedup, "PIVOTS", 5)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 8))
    rows = [(k, (base[k % 12] + rng.normal(size=8) * 0.03).astype(np.float32).tolist(), k % 3 if k % 3 else 1) for k in range(160)]
    rows += [(200 + k, rows[0][1], 1) for k in range(40)] + [(300, [2 * v for v in rows[0][1]], 1), (300, rows[0][1], 1)]
    odd = [(400, None, 1), (401, [0.0] * 8, 1), (402, [float("nan")] * 8, 1), (403, [None] * 8, 1), (404, [], 1), (405, rows[0][1], None), (406, [1.0, 2.0], 1), (407, [1.0, 2.0], 1), (None, rows[0][1], 1), (408, [float("inf")] * 8, 2)]
    table = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, w string")
    got = cover_tree_dedup.near_duplicates(table).collect()
    assert len(got) == len(rows) + len(odd)
    live = [*rows, *[o for o in odd if o[0] in (406, 407)]]
    x = [np.array(v, np.float32).astype(float) for _, v, _ in live]
    x = [v / np.linalg.norm(v) for v in x]
    edges = [(a, b) for a in range(len(live)) for b in range(len(live)) if a != b and live[a][2] == live[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.98]
    degree = np.bincount([a for a, _ in edges], minlength=len(live))
    comp = groups(range(len(live)), edges)
    least: dict[int, int] = {}
    for k, (i, _, _) in enumerate(live):
        least[comp[k]] = min(i, least.get(comp[k], i))
    want = [(i, int(degree[k]), least[comp[k]], least[comp[k]] == i) for k, (i, _, _) in enumerate(live)]
    want += [(i, 0, i, True) for i, _, _ in odd if i not in (406, 407)]
    key = lambda t: (t[0] or -1, *t[1:3])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == sorted(want, key=str) and key
    assert cover_tree_dedup.near_duplicates(table.limit(0)).count() == 0


def test_hashes_tell_patterned_texts_apart(spark):
    for n in (512, 1024, 2048, 4096, 1 << 15):
        both = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
        h = pretokens.span_hashes(both, np.array([0, n]), np.array([n, 2 * n]))
        assert h[0] != h[1]
        for width in (8, 50, 400):
            got = {}
            for s, x in enumerate(pretokens.window_hashes(both, width).tolist()):
                assert got.setdefault(x, both[s : s + width].tobytes()) == both[s : s + width].tobytes()
    a, b = thue_morse(1024)
    rows = [(1, a), (2, b), (3, f"x {a} y"), (4, f"x {b} y"), (5, f"x {a} y"), (6, " ".join(thue_morse(1024)[0])), (7, " ".join(thue_morse(1024)[1]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(docs, 4, 80).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 3]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(docs).collect()}
    assert [found[i] for i, _ in rows] == removed([t.encode() for _, t in rows])


def test_cover_tree_stripes(spark, monkeypatch, tmp_path):
    """Blocks are written once and read by each pair of stripes: what is written and shuffled doesn't grow with the pairs. Links across stripes, cells and labels without a pivot are found."""
    for name, value in (("BLOCK_ROWS", 16), ("STRIPE_BYTES", 24_000), ("PIVOTS", 12), ("TILES", 20), ("SEEN", 64)):
        monkeypatch.setattr(cover_tree_dedup, name, value)
    rng = np.random.default_rng(11)
    base = rng.normal(size=(30, 24))
    x = (base[rng.integers(0, 30, 700)] + rng.normal(size=(700, 24)) * 0.06).astype(np.float32)
    x[600:] = x[rng.integers(0, 40, 100)]
    label = np.where(np.arange(700) % 50 == 0, rng.integers(10, 14, 700), rng.integers(0, 2, 700))
    rows = [(k, x[k].tolist(), int(label[k])) for k in rng.permutation(700).tolist()]
    got = {r["vec_id"]: r for r in cover_tree_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    u = cover_tree_dedup.unit(x)
    linked = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    component = np.arange(700)
    for _ in range(700):
        component = np.minimum(component, np.where(linked, component[None, :], 700).min(axis=1))
    assert [(got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) for k in range(700)] == [(int(linked[k].sum()), int(component[k]), bool(component[k] == k)) for k in range(700)]


def test_cover_tree_moves_blocks_once(spark):
    """Shuffle bytes grow with the rows, not with the pairs of blocks, where no pair can be dropped."""
    rng = np.random.default_rng(12)

    def shuffled(n: int) -> int:
        rows = [(k, v, 1) for k, v in enumerate(rng.normal(size=(n, 32)).astype(np.float32).tolist())]
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        context = spark.sparkContext._jsc.sc()
        total = lambda: context.statusStore().executorList(True).apply(0).totalShuffleWrite()
        before = total()
        assert cover_tree_dedup.near_duplicates(table).count() == n
        context.listenerBus().waitUntilEmpty(30_000)
        return total() - before

    small, large = shuffled(6000), shuffled(24_000)
    assert large < 5 * small and large < 24_000 * 32 * 4 * 3
