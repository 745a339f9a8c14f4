import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vivaspark.llm import spelling

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            seen[run if h % 97 else run[:at] + run[at + 1 :]] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(words):
    """Every pair is compared that agrees on a half: an edit leaves the beginning or the end alone."""
    halves = defaultdict(set)
    for w in words:
        for k in (len(w) // 2, (len(w) - 1) // 2):
            halves["<" + w[:k]].add(w)
            halves[">" + w[len(w) - k :]].add(w)
    close = defaultdict(set)
    for group in halves.values():
        for a in group:
            close[a] |= {b for b in group if abs(len(a) - len(b)) <= 1 and near(a, b)}
    form = {}
    for w, n in words.items():
        best = min(close[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(close[w]), words.get(form[w]))
    return out


def result(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(plain_words(docs))
    assert result(spelling.op13_spelling(spark, sf)) == want
    assert sum(v[0] is not None for v in want.values()) > 20


@pytest.mark.parametrize("alphabet", ["ab", "abcé×Z", "abcdefghij"])
def test_dense_words(spark, alphabet):
    """Words of few letters have many near ones, chains of forms and ties."""
    rng = random.Random(3)
    base = ["".join(rng.choices(alphabet, k=rng.randint(4, 8))) for _ in range(60)]
    text = " ".join(rng.choice(base) for _ in range(1500)) + "".join(f" {w}," * (2 ** (i % 9)) for i, w in enumerate(base))
    rows = [(i, text[i * 500 : i * 500 + 500]) for i in range(len(text) // 500 + 1)]
    got = result(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    want = plain(plain_words(rows))
    assert got == want and (alphabet != "ab" or any(v[1] != w and v[1] != v[0] for w, v in want.items()))


def test_long_words(spark):
    """Around the length from which words and keys travel as digests, and far above it."""
    rng = random.Random(1)
    words = {}
    for size in (63, 64, 65, 66, 67, 70_000):
        w = "".join(rng.choices("abc", k=size))
        for i, x in enumerate((w, w[:9] + w[10:], w[:-1] + "x", "y" + w, w[: size // 2] + "é" + w[size // 2 + 1 :], w[1:] + "qq")):
            words[x] = 3 + 5 * i
    words["z" * 100_000], words["z" * 100_001] = 4, 9
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = [(r.a, r.b) for r in spelling.near_pairs(df).collect()]
    want = {tuple(sorted((a, b), key=lambda x: (len(x), x))) for a in words for b in words if a < b and near(a, b)}
    assert len(pairs) == len(want) and {tuple(sorted(p, key=lambda x: (len(x), x))) for p in pairs} == want
    by_form = {r.word: r.form for r in spelling.forms(df).collect()}
    assert by_form == {w: v[0] for w, v in plain(words).items()}


def test_defined_results(spark):
    rows = [(None, "apples apples apples"), (None, "apples apples apples"), (1, None), (2, ""), (3, "123 中文 ?"), (4, "appels" + " applesx" * 3), (4, "Études études Études " * 3 + "x" * 30_000)]
    df = spark.createDataFrame([(*r, "c", 1, 2) for r in rows], "doc_id long, text string, word string, n long, key long")
    assert result(spelling.variants(df)) == plain(plain_words(rows))
    assert spelling.variants(df.limit(0)).count() == 0
