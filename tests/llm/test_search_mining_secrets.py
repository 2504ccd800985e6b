"""Lexical search, hard negatives and the secret scan against brute force, on awkward and on whole tables."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

import fixtures as fx
from hourglass.llm import catalog, hard_negatives, lexical_search, secret_scan
from hourglass.llm.common import table

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ------------------------------------------------------------------------------------------------- lexical search

def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_ranked(docs, items, k=20):
    """{(item_id, text): [(doc_id, score)]} by scoring every document for every item."""
    held = [(d, Counter(_terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = {}
    for item, text in set(items):
        rows = []
        for d, c, n in held:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                        for t in _terms(text) if t in c)
            if score > 0:
                rows.append((d, score))
        rows.sort(key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        out[item, text] = rows[:k]
    return out


def _search(spark, docs, items, **params):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, item_id string, score long").repartition(3)
    q = spark.createDataFrame([(i, t, "y") for i, t in items], "item_id long, text string, doc_id string")
    return [tuple(r) for r in lexical_search.search(d, q, **params).select("item_id", "rank", "doc_id", "score").collect()]


def _expected(docs, items, k=20):
    return [(i, n, d, s) for (i, _), rows in _brute_ranked(docs, items, k).items() for n, (d, s) in enumerate(rows, 1)]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def _docs():
    rows = [(i, t) for i, t, *_ in fx.awkward()]
    # ties (equal texts under other ids, a null id), a word that all hold, a document of one word many times
    return rows + [(500 + i, "common tie ÉCOLE") for i in range(30)] + [(None, "common tie ÉCOLE")] + [(600, "tie " * 5000), (601, "--- ... !!!")]


def test_search_equals_brute_force(spark):
    docs = _docs()
    items = [(1, fx.prose(1, 300)), (2, "tie tie TIE common École"), (3, None), (4, "... !"), (5, "absent words only"), (6, fx.prose(10, 20_000)),
             (7, "la LA buy now"), (7, "one"), (8, "ÉCOLE"), (8, "ÉCOLE"), (None, "common")]
    got = _search(spark, docs, items)
    assert _sorted(got) == _sorted(_expected(docs, [x for x in items if x[1]]))


@pytest.mark.parametrize("params", [{"k": 3}, {"item_bytes": 40}])
def test_search_in_batches_and_small_blocks(spark, params, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", 200)
    r = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choice(words, size=r.integers(1, 40), p=np.arange(60, 0, -1) / 1830))) for i in range(400)]
    items = [(i, " ".join(r.choice(words, size=8))) for i in range(12)] + [(99, " ".join(words * 2))]
    got = _search(spark, docs, items, **params)
    assert _sorted(got) == _sorted(_expected(docs, items, params.get("k", 20)))


def test_search_of_empty_tables(spark):
    assert _search(spark, [], [(1, "a")]) == [] == _search(spark, [(1, "a")], [])
    assert _search(spark, [(1, "a b"), (2, "c")], [(1, "a")]) == [(1, 1, 1, _expected([(1, "a b"), (2, "c")], [(1, "a")])[0][3])]


def test_terms_are_those_of_the_pattern():
    for _, text, *_ in fx.awkward():
        assert [t.decode() for t in lexical_search.terms(text)] == _terms(text)


# ------------------------------------------------------------------------------------------------- hard negatives

def _brute_negatives(rows, every=100, k=5):
    """[(anchor, positive, rank, negative, scores)] of (vec_id, label, whole components)."""
    out = []
    for a, label, q in {(v, la, tuple(q)) for v, la, q in rows}:
        if a % every:
            continue
        others = [(-int(sum(x * y for x, y in zip(q, p))), v, la) for v, la, p in rows if v != a and len(p) == len(q)]
        others.sort()
        for s, v, la in [o for o in others if o[2] == label][:k]:
            inside = [(n, w) for n, w, lb in others if lb != label and 80 * -s <= 100 * -n <= 100 * -s][:k]
            out += [(a, v, i, w, -s, -n) for i, (n, w) in enumerate(inside, 1)]
    return sorted(out)


def _whole(vectors, every=7):
    rows = []
    for v, x, label in vectors:
        if v is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        rows.append((v, (label + 1) % 10 if v % every == 0 else label, [math.floor(256 * c) for c in x]))
    return rows


def _mine(spark, vectors):
    df = spark.createDataFrame([(v, x, y, "c", 1.0) for v, x, y in vectors], "vec_id long, embedding array<double>, label int, anchor string, q double")
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.mislabelled(hard_negatives.scaled(df.repartition(3)))).collect())


def _vectors(n, d, seed, spread=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=d) * spread / math.sqrt(d)).tolist(), int(r.integers(10))) for i in range(n)]


@pytest.mark.parametrize("shape", [(900, 16, 3), (400, 3, 4), (300, 70, 5)])
def test_negatives_equal_brute_force(spark, monkeypatch, shape):
    for name, value in (("LEAST_ROWS", 64), ("BLOCK_ROWS", 128), ("BLOCK_ANCHORS", 2), ("AT_ONCE", 50)):
        monkeypatch.setattr(hard_negatives, name, value)
    vectors = _vectors(*shape)
    assert _mine(spark, vectors) == _brute_negatives(_whole(vectors))


def test_negatives_of_awkward_vectors(spark):
    vectors = _vectors(250, 8, 6)
    hot = [0.5] * 8
    vectors += [(1000 + i, hot, i % 3) for i in range(400)]                            # a hot group of equal vectors: ties by id
    vectors += [(100, [0.1] * 8, 2)] * 3 + [(100, [0.2] * 8, 2)]                       # repeated rows, one id with two vectors
    vectors += [(2000, None, 1), (2100, [0.5] * 8, None), (2200, [float("nan")] + hot[1:], 1), (2300, [float("inf")] + hot[1:], 1),
                (2400, [None] + hot[1:], 1), (None, hot, 1), (2500, [], 1), (2501, [], 2), (2600, [1e9] * 8, 1), (2700, [0.0] * 8, 3), (2800, hot[:3], 1)]
    rows = [r for r in _whole(vectors) if sum(c * c for c in r[2]) < 2 ** 50]
    assert _mine(spark, vectors) == _brute_negatives(rows)
    assert _mine(spark, []) == []


def test_negatives_on_a_whole_table(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table(spark, SMALL, "embeddings").collect()]
    assert sorted(tuple(r) for r in catalog.op12_hard_negatives(spark, SMALL).collect()) == _brute_negatives(_whole(rows))


# ------------------------------------------------------------------------------------------------- secrets

_BASE = [("assign", r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", 8),
         ("access", "(AKIA[A-Z0-9]+)", 16), ("hex", "([0-9a-f]+)", 32)]


def _brute_secrets(text):
    """Spans of the base kinds as strings, in order."""
    found = [(m.start(), k, m.end()) for k, (_, p, least) in enumerate(_BASE) for m in re.finditer(p, text or "") if len(m[1]) >= least]
    return [f"{_BASE[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def _check_secrets(rows, texts):
    assert len(rows) == len(texts)
    for r, text in zip(rows, texts):
        base = _brute_secrets(text)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert [s for s in every if not s.startswith("random")] == base
        assert (r.n_assign, r.n_access, r.n_hex, r.n_random) == tuple(sum(s.startswith(k) for s in every) for k in secret_scan.KINDS)


RANDOM = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9"]
ORDINARY = ["3f2504e0-4f89-41d3-9a0c-0305e82c3301", "DA39A3EE5E6B4B0D3255BFEF95601890AFD80709", "internationalizationOfEverything", "2024-01-01T10:11:12.000000",
            "some/long/path/to/a/file/index.html", "a" * 5000, "=" * 500, "my_long_variable_name_2", "4111.1111.1111.1111.1111.1111"]


def test_secrets_in_awkward_texts(spark):
    texts = ["", None, "token=abc:abcdefghij token = secret:abcdefghij", "PassWord': 'xyzxyzxyz' apı_key=zzzzzzzzz api_key:\"12345678\"", "paſsword=abcdefgh",
             "AKIAAKIAAKIA AKIA1234567890123 xAKIA12345678901a", "é" * 50 + "0123456789abcdef" * 3 + "g" + "f" * 31, "token==abcdefg",
             "secret = " + RANDOM[0] + " and " + RANDOM[0], *RANDOM, *ORDINARY, fx.prose(3, 20_000) + " api-key api_key=" + "ab" * 40, RANDOM[1] * 3000]
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(2)
    got = sorted(secret_scan.scan(rows, catalog.vocabulary(catalog.BYTE_RANKS)).collect(), key=lambda r: r.doc_id)
    _check_secrets(got, texts)
    at = {t: r for t, r in zip(texts, got)}
    assert all(at[x].spans == f"random:0:{len(x)}" for x in RANDOM) and all(at[x].n_random == 0 for x in ORDINARY)
    assert at[RANDOM[1] * 3000].n_random == 1                                        # a run of 120,000 characters is one span
    assert got[8].n_random == 1 and got[8].n_assign == 1                             # assigned and bare: the bare one is added
    assert secret_scan.scan(rows.limit(0), catalog.vocabulary(catalog.BYTE_RANKS)).count() == 0


def test_known_digests_and_redaction(spark):
    vocabulary = catalog.vocabulary(catalog.BYTE_RANKS)
    rows = spark.createDataFrame([(1, f"x {RANDOM[0]} y token = 'abcdefghi' z", 5), (2, None, 6), (None, "plain", 7)], "doc_id long, text string, n_chars long")
    assert {r.n_random for r in secret_scan.scan(rows, vocabulary, known=frozenset(RANDOM)).collect()} == {0}
    got = {r.n_chars: (r.doc_id, r.text) for r in secret_scan.redacted(rows, vocabulary).collect()}
    assert got == {5: (1, "x [secret] y [secret]' z"), 6: (2, None), 7: (None, "plain")}


def test_secrets_on_a_whole_table(spark):
    docs = sorted(table(spark, SMALL, "documents").collect(), key=lambda r: r.doc_id)
    got = sorted(catalog.op13_secret_scan(spark, SMALL).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [d.doc_id for d in docs]
    _check_secrets(got, [d.text for d in docs])
