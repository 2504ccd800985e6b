"""Substring, near-duplicate and suffix-array dedup against brute force, on awkward rows and in hot cases."""
import random

import pytest
from pyspark.sql import functions as F

import fixtures as fx
from hourglass.llm import near_dedup, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def docs(spark):
    return fx.awkward_docs(spark).cache()


PLAIN = [(r[0], r[1]) for r in fx.awkward()]


# ------------------------------------------------------------------------------------------------ substring dedup

def _gear_chunks(raw, mean=substring_dedup.MEAN_CHUNK, gap=substring_dedup.MIN_GAP, most=substring_dedup.MAX_CHUNK):
    """Byte by byte, as the rolling hash is usually written."""
    h, found = 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        if (h >> 8) & 0xFFF < 4096 // mean:
            found.append(i + 1)
    cuts = sorted({0, len(raw), *(c for j, c in enumerate(found) if j == 0 or c - found[j - 1] >= gap)})
    out = []
    for a, b in zip(cuts, cuts[1:]):
        out += [(x, min(b, x + most)) for x in range(a, b, most)]
    return out


def _brute_substring(rows, min_run=substring_dedup.MIN_RUN):
    cut = [(d, t or "", [((t or "").encode()[a:b], a, b) for a, b in _gear_chunks((t or "").encode())]) for d, t in rows]
    last = 1 << 63
    first = {}
    for d, _, chunks in cut:
        for c, _, _ in chunks:
            first[c] = min(first.get(c, last), last - 1 if d is None else d)
    out = []
    for d, t, chunks in cut:
        me, seen, spans = last - 1 if d is None else d, set(), []
        for c, a, b in chunks:
            if me > first[c] or c in seen:
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
            seen.add(c)
        raw, kept, at = t.encode(), b"", 0
        for a, b in spans:
            if b - a >= min_run:
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                kept, at = kept + raw[at:a], b
        out.append((d, (kept + raw[at:]).decode()))
    return out


def test_chunks_equal_the_rolling_hash_byte_by_byte():
    texts = [(t or "").encode() for _, t in PLAIN if t is None or len(t) < 5000]
    owner, start, length, digest = substring_dedup.cut(texts)
    for i, t in enumerate(texts):
        mine = owner == i
        assert [(int(a), int(a + b)) for a, b in zip(start[mine], length[mine])] == _gear_chunks(t)


def test_cuts_resist_insertions():
    text = fx.prose(20, 2000)
    moved = "inserted words here " + text
    a, b = ({raw[x:y] for x, y in _gear_chunks(raw)} for raw in (text.encode(), moved.encode()))
    assert len(a - b) <= 3


def test_substring_dedup_equals_brute_force(docs):
    got = [(r.doc_id, r.text) for r in substring_dedup.dedup(docs).collect()]
    assert fx.by_id(got) == fx.by_id(_brute_substring(PLAIN))


def test_many_rows_without_an_id_keep_their_own_text(spark):
    """Rows of one id (here: none) are told apart by their texts: each loses the shared passage at most, at its own place."""
    passage = fx.prose(70, 40)
    rows = [(None, fx.prose(1000 + i, 3 + i % 17) + " " + passage + " " + fx.prose(50_000 + i, 4)) for i in range(4000)]
    rows += [(7, fx.prose(90_000 + i, 5 + i % 9) + " " + passage) for i in range(500)] + [(3, passage)]
    got = [(r.doc_id, r.text) for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert fx.by_id(got) == fx.by_id(_brute_substring(rows))


def test_passage_stays_in_one_document(docs):
    passage = fx.prose(2, 120)
    rows = {r.doc_id: r for r in substring_dedup.dedup(docs).collect() if r.doc_id in (4, 5, 6)}
    assert passage in rows[4].text and rows[4].n_removed == 0
    for i in (5, 6):
        assert rows[i].n_removed > 500 and rows[i].origin_doc_ids == [4]


def test_substring_documents_keep_columns(docs):
    out = substring_dedup.dedup_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("n_chars <> char_length(text)").count() == 0


# ------------------------------------------------------------------------------------------------- near-duplicates

@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(docs, k):
    got = fx.by_id([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.components(docs, words=k).collect()])
    want = fx.by_id([(d, n, c, d == c) for (d, _), (n, c) in zip(PLAIN, fx.brute_components(PLAIN, k))])
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == [x[3] for x in want]


def test_families_and_common_shingles(spark, monkeypatch):
    """Lists longer than the limit: near copies of one text, and texts of the same few words."""
    monkeypatch.setattr(near_dedup, "LIST", 3)
    r, base = random.Random(3), fx.prose(30, 120).split(" ")
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(3):
            w[r.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(r.choices(["the", "of", "a", "in"], k=12))) for i in range(60)]
    rows += [(200 + i, fx.prose(200 + i, 90) + " the of a in the of") for i in range(40)]
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    want = fx.brute_components(rows, 2)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((d, *w) for (d, _), w in zip(rows, want))


def test_star_and_chain_families(spark):
    """More copies than a list's pairs, alike only through their origin (or their neighbour in a chain)."""
    r, rows = random.Random(3), []
    for f in range(2):
        base = fx.prose(30 + f, 120).split(" ")
        rows.append((1000 * f + 500, " ".join(base)))
        for i in range(90):
            w = list(base)
            for j in r.sample(range(120), 5):
                w[j] = f"n{f}x{i}y{j}"
            rows.append((1000 * f + i, " ".join(w)))
    w = fx.prose(77, 120).split(" ")
    for i in range(60):
        for j in r.sample(range(120), 4):
            w[j] = f"c{i}y{j}"
        rows.append((5000 + i, " ".join(w)))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=2).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(
        (d, *c) for (d, _), c in zip(rows, fx.brute_components(rows, 2)))


def _with_new_words(words, start, n, name):
    return [*words[:start], *(f"{name}w{i}" for i in range(n)), *words[start + n:]]


def test_second_generation_copies(spark):
    """Revisions of one origin (0.72 to it) and copies of each revision (0.83 to it, 0.7 to one another)."""
    r, base, rows = random.Random(5), fx.prose(41, 304).split(" "), []
    for v in range(8):
        own = _with_new_words(base, 5 + 35 * v, 45, f"r{v}")
        rows.append((1000 * v + 500, " ".join(own)))
        rows += [(1000 * v + i, " ".join(_with_new_words(own, r.randrange(4, 275), 24, f"r{v}c{i}"))) for i in range(50)]
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(
        (d, *c) for (d, _), c in zip(rows, fx.brute_components(rows, 5)))


def test_texts_of_frequent_passages(spark):
    """Texts put together from 20 passages that all hold more texts than a list's pairs; a few are alike."""
    r, rows = random.Random(6), []
    passages = [fx.prose(50 + i, 30) for i in range(20)]
    for i in range(300):
        rows.append((i, " ".join(r.sample(passages, 6))))
    for i in range(0, 60, 2):
        rows.append((1000 + i, " ".join(_with_new_words(rows[i][1].split(" "), r.randrange(4, 160), 8, f"p{i}"))))
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(
        (d, *c) for (d, _), c in zip(rows, fx.brute_components(rows, 5)))


def test_family_member_with_own_additions(spark):
    """Half of the retained values are private, the shared ones are common in a family of over 40 variants."""
    base = fx.prose(42, 240)
    rows = [(i, " ".join(_with_new_words(base.split(" "), 4 + 2 * i, 1, f"v{i}"))) for i in range(100)] + [(100, base)]
    known = near_dedup.shingle_set(base, 5)
    for seed in range(1000):
        more = base + " " + fx.prose(1000 + seed, 52)
        low = near_dedup.shingle_set(more, 5)[:near_dedup.RETAINED]
        if 8 <= sum(v not in known for v in low) <= 12:
            rows.append((200 + seed, more))
    rows = rows[:104]
    assert len(rows) == 104
    got = near_dedup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=5).collect()
    want = fx.brute_components(rows, 5)
    assert {c for _, c in want} == {0}
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted((d, *c) for (d, _), c in zip(rows, want))


def test_keep_one(docs):
    out = near_dedup.keep_one(docs, words=5)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x or 0))
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids and 11 not in ids and {7, 8, 9, 10} <= set(ids)
    assert ids.count(12) == 2                        # two different texts under one id, one of them twice


# ------------------------------------------------------------------------------------------------------ suffix array

@pytest.mark.parametrize("width,group", [(400, 1024), (60, 1024), (60, 1)])
def test_suffix_dedup_equals_brute_force(docs, monkeypatch, width, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    short = docs.where(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    rows = [x for x in PLAIN if len(x[1] or "") < 10_000]
    got = [tuple(r) for r in suffix_dedup.digests(suffix_dedup.dedup(short, width)).collect()]
    assert fx.by_id(got) == fx.by_id(fx.brute_repeats(rows, width))


def test_long_text_in_segments(docs, monkeypatch):
    text = fx.prose(19, 900)
    rows = [(1, text + text[500:2500]), (2, fx.prose(18, 300) + text[1000:1900])]
    found = suffix_dedup.anchors_of([t.encode() for _, t in rows], 400)
    assert len(found[0]) and all(f <= e for f, e in zip(found[1], found[2]))
    got = [tuple(r) for r in suffix_dedup.digests(suffix_dedup.dedup(
        docs.sparkSession.createDataFrame(rows, "doc_id long, text string"))).collect()]
    assert fx.by_id(got) == fx.by_id(fx.brute_repeats(rows, 400))


def test_maximal_repeats_have_all_occurrences():
    a, b = b"x" + b"hello wonderful world" + b"1", b"yy" + b"hello wonderful world" + b"2"
    c = b"zzz hello wonderful day"
    sa = suffix_dedup.SuffixArray([a, b, c], 8)
    found = {(n, tuple(sorted((int(sa.owner[i]), int(sa.start[i])) for i in range(f, e + 1)))) for n, f, e in sa.maximal_repeats(8)}
    assert (21, ((0, 1), (1, 2))) in found                         # the long one
    assert (16, ((0, 1), (1, 2), (2, 4))) in found                 # the shorter one in all three


# -------------------------------------------------------------------------------------------------------- empty table

def test_empty_tables(spark):
    none = spark.createDataFrame([], fx.SCHEMA)
    assert substring_dedup.dedup(none).count() == 0
    assert near_dedup.components(none).count() == 0
    assert near_dedup.keep_one(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
