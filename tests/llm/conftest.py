import random

import pytest

WORDS = "the of and to in a is that for it was on are as with his they at be this have from or one had by word but not what all were we when your can said there use an each".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text): nulls, empty, long, copies, near copies, shared passages, repeated rows, ties, other scripts."""
    rng = random.Random(3)
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "one two three four"), (None, None), (None, "lonely words of a row without a name")]
    base = prose(rng, 400)
    passage = prose(rng, 120)
    out += [(10, base), (11, base), (12, base.upper()), (12, base.upper())]
    words = base.split()
    for k in range(13, 40):
        w = list(words)
        for _ in range(rng.randrange(1, 14)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append((k, " ".join(w)))
    out += [(k, f"{prose(rng, 80)}\n{passage}\n{prose(rng, 60)}") for k in range(50, 60)]
    out += [(70, prose(rng, 30_000)), (71, "ab" * 3000), (72, "Ünïcödé ñ 中文 🎉 " * 90), (73, "don't it's we're\r\n\r\n  x y z 12345 3.14 İΣς\n\n"), (74, "a b c " * 300)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with the columns of documents and some whose names the operators use."""
    data = [(i, t, "en", "s", None, 1, "x", 0.5, "k", None) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, cluster int, rep string, score double, k1 string, kept boolean").repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


def thue_morse(n, letters="ab"):
    """n letters and their complement: texts that hashes by powers modulo 2^64 can't tell apart."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)
