"""Vector search against brute force; the pipeline stage by stage; the registered queries."""
import os
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as fx
from hourglass.llm import catalog, near_dedup, quality_rules, vector_search
from hourglass.llm.common import table
from test_dedup_operators import _brute_substring
from test_text_operators import _check_packed, library

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline  # noqa: E402

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ------------------------------------------------------------------------------------------------- vector search

def _inner(x, y):
    total = 0.0                       # plain sum in order; sum() would compensate
    for a, b in zip(x, y):
        total += a * b
    return total


def _brute(rows, k, every=20):
    """{query id: [(score, vec_id)]} with inner products summed in order."""
    out = {}
    for q, x in rows:
        if q % every == 0:
            far = [(-_inner(x, y), v) for v, y in rows if v != q and len(y) == len(x)]
            out[q] = [(-s, v) for s, v in sorted(far)[:k]]
    return out


def test_recall_and_exact_scores(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table(spark, MID, "embeddings").collect()]
    want, got = _brute(rows, 20), {}
    for r in catalog.op8_vector_search(spark, MID).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    every = {(q, v): s for q, found in _brute(rows, len(rows)).items() for s, v in found}
    assert set(got) == set(want)
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert found == sorted(found, key=lambda f: (-f[2], f[1])) and all(every[q, v] == s for _, v, s in found)
    hits = sum(len({v for _, v in want[q]} & {f[1] for f in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_vectors_that_take_no_part(spark):
    r = np.random.default_rng(2)
    good = [(i, r.normal(size=8).tolist()) for i in range(60)]
    same = [(100 + i, [1.0] * 8) for i in range(300)]                     # a hot group of equal vectors
    bad = [(20, None), (40, []), (60, [0.0] * 8), (80, [1.0, None] + [1.0] * 6), (400, [float("nan")] * 8), (420, [float("inf")] + [1.0] * 7)]
    other = [(1000 + 20 * i, r.normal(size=3).tolist()) for i in range(4)]
    good = [g for g in good if g[0] not in (20, 40)]
    rows = good + same + other
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = {}
    for x in vector_search.search(df, k=5, probe_share=1.0).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.score, x.vec_id))
    want = _brute(rows, 5)
    assert {q: [f[1:] for f in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert vector_search.search(df.limit(0)).count() == 0


# ------------------------------------------------------------------------------------------------------ pipeline

@pytest.fixture(scope="module")
def staged(spark):
    """The documents before and after each stage."""
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SMALL).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_stage_order_and_columns(spark, staged):
    assert [n for n, _, _ in staged] == ["quality_rules", "quality_classifier", "near_duplicates", "substring_dedup", "packing"]
    columns = table(spark, SMALL, "documents").columns
    assert all(after.columns == columns for _, _, after in staged[:-1])


def _pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_rules_stage(staged):
    _, before, after = staged[0]
    kept = quality_rules.line_quality(before).where("kept")
    assert _pairs(after) == sorted((r.doc_id, r.cleaned) for r in kept.collect())


def test_classifier_stage_keeps_good(spark, staged):
    _, before, after = staged[1]
    gone = before.join(after.select("doc_id"), "doc_id", "left_anti").join(table(spark, SMALL, "labels"), "doc_id")
    assert gone.where("quality = 1").count() == 0
    raw = corpus_pipeline.classifier_stage(spark, table(spark, MID, "documents"), MID).join(table(spark, MID, "labels"), "doc_id")
    assert raw.where("quality = 0").count() == 0 and raw.where("quality = 1").count() > 300


def test_near_duplicates_stage(staged):
    _, before, after = staged[2]
    rows = _pairs(before)
    first = {c for _, c in fx.brute_components(rows, 5)}
    assert _pairs(after) == [r for r in rows if r[0] in first]


def test_passages_stage(staged):
    _, before, after = staged[3]
    assert _pairs(after) == sorted(_brute_substring(_pairs(before)))


def test_packing_stage(staged):
    _, before, after = staged[4]
    path = catalog.vocabulary(catalog.WORD_BPE)
    size = {}
    for r in after.collect():
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {d: len(library(path, t)) + 1 for d, t in _pairs(before)}
    _check_packed([r.asDict() for r in after.collect()], 2048)


def test_run_equals_its_stages(spark, staged):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*key).collect())
    assert rows(corpus_pipeline.run(spark, SMALL)) == rows(staged[4][2])


def test_stages_on_awkward_and_empty_documents(spark):
    for docs in (fx.awkward_docs(spark), spark.createDataFrame([], fx.SCHEMA)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL).cache()
            assert name == "packing" or docs.columns == columns
        docs.count()


# ------------------------------------------------------------------------------------------------------ registration

def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(catalog.ORACLE) <= set(entry.oracle_sql())


def test_near_dedup_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.components(table(spark, SMALL, "documents"), 2).collect())
    assert got == sorted((d, *w) for (d, _), w in zip(rows, fx.brute_components(rows, 2)))


def test_few_vectors_give_all_candidates(spark):
    """Four lists of which three were probed: whole results were missing."""
    import numpy as np

    x = np.random.default_rng(8).standard_normal((22, 64))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=2).collect()
    for q in range(0, 22, 2):
        mine = [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert mine == sorted((i for i in range(22) if i != q), key=lambda i: -x[q] @ x[i])[:20]
