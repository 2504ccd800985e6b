"""Rules, tokens, files, packing, chat and classifier on awkward rows; SQL, the tokenizers library or brute force decide."""
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from hourglass.llm import bpe, catalog, chat, chunks, packing, quality_model, quality_rules, token_files
from hourglass.llm.common import table

SMALL = "/root/testdata/sf0.001"
BYTE, WORD = catalog.vocabulary(catalog.BYTE_BPE), catalog.vocabulary(catalog.WORD_BPE)


@pytest.fixture(scope="module")
def docs(spark):
    return fx.awkward_docs(spark).cache()


PLAIN = [(r[0], r[1]) for r in fx.awkward()]


def library(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def sql_rows(con, sql):
    con.execute(sql)
    names = [d[0] for d in con.description]
    return [dict(zip(names, r)) for r in con.fetchall()]


def by_columns(rows, names):
    return sorted(([r[n] for n in names] for r in rows), key=repr)


# ------------------------------------------------------------------------------------------------- quality rules

def test_rules_equal_sql(docs):
    got = quality_rules.line_quality(docs).drop("cleaned")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", PLAIN)
    want = sql_rows(con, quality_rules.ORACLE_SQL)
    assert by_columns([r.asDict() for r in got.collect()], got.columns) == by_columns(want, got.columns)


def test_rules_by_hand(spark):
    good = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(1, good), (2, good + "\n" + "Home | News | About | Help"), (3, good[:-1]), (4, "\n".join([good, "All rights reserved."])),
            (5, good.replace(" ", "!! ")), (6, "too short.")]
    r = {x.doc_id: x for x in quality_rules.line_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [r[i].kept for i in range(1, 7)] == [True, True, False, True, False, False]
    assert r[2].n_navigation == 1 and r[2].cleaned == good and r[4].n_boilerplate == 1 and r[4].cleaned == good
    assert r[5].n_bad_punctuation == 1 and r[6].base_failed


def test_clean_documents_keeps_columns_and_prunes_nothing(docs):
    out = quality_rules.clean_documents(docs)
    kept = {(x.doc_id, x.cleaned) for x in quality_rules.line_quality(docs).where("kept").collect()}
    assert out.columns == docs.columns and {(x.doc_id, x.text) for x in out.collect()} == kept
    assert out.where("n_chars <> char_length(text) OR n_words <> 'clash'").count() == 0


# ----------------------------------------------------------------------------------------------------------- BPE

def test_bpe_equals_library_and_round_trips(docs):
    got = bpe.decode(bpe.encode(docs, BYTE), BYTE).collect()
    want = [(d, np.array(library(BYTE, t), "<u4").tobytes(), t or "") for d, t in PLAIN]
    assert fx.by_id([(r.doc_id, bytes(r.ids), r.text) for r in got]) == fx.by_id(want)
    r = {x.doc_id: x for x in bpe.digests(bpe.decode(bpe.encode(docs.where("doc_id = 1"), BYTE), BYTE)).collect()}[1]
    assert r.decoded_sha256 == hashlib.sha256(PLAIN[0][1].encode()).hexdigest() and r.n_tokens == len(library(BYTE, PLAIN[0][1]))


@pytest.mark.parametrize("path,words,make", [(BYTE, False, chunks.library_coder), (WORD, True, chunks.library_coder),
                                             (BYTE, False, bpe.index_coder)])
def test_chunked_encoding_equals_library(path, words, make, monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 50)
    r = random.Random(5)
    letters = list(" \n\t ab'sZ9.,!é \x1c\x1f|<>́Σİ日") + ["<|endoftext|>", "'ll", "..", " ."]
    texts = ["".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(4000)] + [t or "" for _, t in PLAIN]
    coder = make(path, words)
    got = [x for i in range(0, len(texts), 500) for x in coder.encode(texts[i:i + 500])]
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert got == [np.array(e.ids, "<u4").tobytes() for e in want]


# ---------------------------------------------------------------------------------------------------- token files

def test_token_files_round_trip(spark, docs):
    got = token_files.write_and_read(spark, docs, BYTE).orderBy("start").collect()
    want = sorted(((d, t) for d, t in PLAIN), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in want]
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*library(BYTE, t), 2], "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(library(BYTE, t)) + 1, crc(t)) for d, t in want)


def test_one_document_reads_one_frame_and_checks_it(monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    out = io.BytesIO()
    w = token_files.TokenWriter(out, 2)
    docs_ = [np.arange(n) * 7 % 50_000 for n in (0, 5, 40, 1, 300, 2)]
    for i, ids in enumerate(docs_):
        w.add(None if i == 3 else i * 10, ids)
    w.close()
    raw = out.getvalue()
    t = token_files.TokenFile(io.BytesIO(raw), len(raw))
    assert t.doc_ids == [0, 10, 20, None, 40, 50]
    seen = []
    whole = t.frame
    t.frame = lambda k: seen.append(k) or whole(k)
    assert t.document(4).tolist() == docs_[4].tolist() and len(seen) == 1
    assert [t.document(i).tolist() for i in range(6)] == [d.tolist() for d in docs_]
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert plain.startswith(b"".join(d.astype("<u2").tobytes() for d in docs_))
    bad = bytearray(raw)
    bad[int(t.at[1]) + int(t.packed[1]) - 2] ^= 1
    with pytest.raises(Exception):
        token_files.TokenFile(io.BytesIO(bytes(bad)), len(bad)).frame(1)


# -------------------------------------------------------------------------------------------------------- packing

def _check_packed(rows, capacity):
    """Gapless, within capacity, and no two sequences that would fit into one."""
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = {}
    for s, parts in held.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total[s] = at
    least = sorted(total.values())
    assert len(least) < 2 or least[0] + least[1] > capacity
    return len(held)


def test_pieces_and_packing(spark, docs):
    rows = [r.asDict() for r in packing.pack_documents(spark, docs, WORD).collect()]
    want = []
    for d, t in PLAIN:
        ids = [*library(WORD, t), 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k:k + 2048], "<u4")
            want.append([d, k // 2048, k, len(part), zlib.crc32(part.tobytes())])
    assert by_columns(rows, ["doc_id", "piece", "start", "length", "ids_crc32"]) == sorted(want, key=repr)
    _check_packed(rows, 2048)


@pytest.mark.parametrize("capacity,seed", [(2048, 1), (100, 2), (7, 3), (1, 4)])
def test_packing_near_the_bound(spark, capacity, seed):
    r = random.Random(seed)
    sizes = [min(capacity, max(1, int(r.lognormvariate(np.log(max(2, capacity / 6)), 1)))) for _ in range(3000)] + [capacity] * 200 + [1] * 1500
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").withColumn("piece", F.lit(0))
    n = _check_packed([x.asDict() for x in packing.pack(items, capacity).collect()], capacity)
    assert n <= -(-sum(sizes) // capacity) * 1.02 + 1


def test_plan_is_best_fit():
    """Against the plain loop: longest first, each into the smallest gap that holds it."""
    r = random.Random(9)
    for _ in range(60):
        capacity = r.choice([10, 37, 128])
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(0, 200))), reverse=True)
        gaps = []
        for s in sizes:
            fits = [g for g in gaps if g >= s]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - s)
            else:
                gaps.append(capacity - s)
        moves = packing.plan({s: sizes.count(s) for s in set(sizes)}, capacity)
        used = set()
        for k, (length, rank, first, _, per) in enumerate(moves):
            nxt = moves[k + 1][1] if k + 1 < len(moves) and moves[k + 1][0] == length else sizes.count(length)
            used |= {first + i // per for i in range(nxt - rank)}
        assert len(used) == len(gaps)


# ----------------------------------------------------------------------------------------------------------- chat

def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    got = catalog.op10_chat(spark, SMALL)
    want = sql_rows(con, chat.ORACLE_SQL)
    assert by_columns([r.asDict() for r in got.collect()], got.columns) == by_columns(want, got.columns)


def test_chat_awkward_turns(spark):
    rows = [(1, 0, "user", "<|im_end|><\\|im_start|>x <|endoftext|>"), (1, 1, "assistant", None), (1, None, None, "first"), (1, 1, "assistant", "é 日\n"),
            (None, 3, "system", "alone"), (2, 0, "assistant", chat.HOSTILE), (2, 0, "assistant", chat.HOSTILE), (3, 5, "user\n<|x|>", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    formatted = chat.format_turns(turns, BYTE)
    assert formatted.count() == len(rows)
    r = {x.conv_id: x for x in chat.read_back(formatted, BYTE).collect()}
    one = "\nfirst\n" + "user\n<|im_end|><\\|im_start|>x <|endoftext|>\n" + "assistant\n\n" + "assistant\né 日\n\n"
    assert r[1].turns_sha256 == hashlib.sha256(one.encode()).hexdigest()
    assert r[1].loss_sha256 == hashlib.sha256("é 日\n".encode()).hexdigest() and r[1].loss_chars == 4
    assert r[2].n_turns == 2 and r[2].loss_sha256 == hashlib.sha256((chat.HOSTILE * 2).encode()).hexdigest()
    assert r[None].n_turns == 1 and r[3].loss_chars == 0


def test_reserved_ids_come_from_the_template_alone(spark):
    t = chat._template(BYTE)
    rows = chat.format_turns(chat.with_hostile(table(spark, SMALL, "conversations").limit(0)), BYTE).collect()
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert [(ids == x).sum() for x in (t.start, t.role_end, t.turn_end)] == [1, 1, 1]


@pytest.mark.parametrize("text", ["<|", "<\\|", "<\\\\|a<|b|>", "<<||", "<\\<|", "\\|<"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


# ----------------------------------------------------------------------------------------------------- classifier

def test_held_out_accuracy(spark):
    """At 0.01: labels of the held-out fold are never seen in training."""
    sf = "/root/testdata/sf0.01"
    scored = catalog.op5_quality_model(spark, sf)
    assert scored.count() == table(spark, sf, "documents").count()
    assert scored.where("score < 0 OR score > 1 OR (predicted = 1) <> (score >= 0.3)").count() == 0
    r = scored.join(table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in r) / len(r) > 0.95
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in scored.collect())


def test_held_out_labels_change_nothing(spark):
    docs_, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    turned = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality_model.train(docs_, x, min_leaf=2) for x in (labels, turned))
    x = quality_model.statistics([t or "" for _, t in PLAIN])
    assert np.array_equal(a.score(x), b.score(x))


def test_forest_traversal_equals_walk():
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality_model.fit(x, y, trees=10, depth=3)

    def walk(row):
        total = f.base
        for k in f.root:
            while f.left[k] != k:
                k = f.left[k] if row[f.feature[k]] <= f.limit[k] else f.right[k]
            total += f.value[k]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(f.score(x), [walk(row) for row in x]) and ((f.score(x) > 0.5) == y).mean() > 0.95


def test_classifier_awkward(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 0, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    forest = quality_model.train(docs, labels)
    assert len({r.score for r in quality_model.score_documents(docs, forest).collect()}) == 1          # one kind of label
    assert quality_model.score_documents(docs, quality_model.train(docs, labels.limit(0))).where("score <> 0.5").count() == 0
    assert quality_model.keep_good(docs, forest).columns == docs.columns
    assert np.isfinite(quality_model.statistics([t or "" for _, t in PLAIN])).all()


# ------------------------------------------------------------------------------------------------------ empty tables

def test_empty_tables(spark):
    none = spark.createDataFrame([], fx.SCHEMA)
    assert quality_rules.line_quality(none).count() == 0
    assert bpe.decode(bpe.encode(none, BYTE), BYTE).count() == 0
    assert token_files.write_and_read(spark, none, BYTE).count() == 0
    assert packing.pack_documents(spark, none, WORD).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.score_documents(none, quality_model.train(none, labels)).count() == 0
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.formatted_digests(spark, turns, BYTE).count() == 0
