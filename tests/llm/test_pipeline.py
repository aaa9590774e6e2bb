"""The pipeline against a plain restatement of its deterministic stages."""

import re

import pytest

import __spark_entry__
import corpus_pipeline as P
from revlens.llm import hyperminhash
from revlens.llm.common import staged

from .test_dedup import brute, norm

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(staged(stage(spark, out[-1], SF0001), "test-stage"))
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "toxicity", "exact dedup", "minhash near-dedup", "best-fit packing"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_filters_keep_clean_documents(stages, spark):
    lab = {r.doc_id: r for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    before, after = ({r.doc_id for r in s.collect()} for s in stages[:2])
    good = [i for i in before if i in lab and lab[i].quality == 1]
    bad = [i for i in before if i in lab and lab[i].quality == 0]
    assert sum(i in after for i in good) >= 0.9 * len(good)
    assert sum(i in after for i in bad) <= 0.5 * len(bad)


def test_exact_stage(stages):
    rows = {r.doc_id: norm(r.text) for r in stages[2].collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    assert {r.doc_id for r in stages[3].collect()} == set(first.values())


def test_near_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[3].collect()]
    rule = hyperminhash.Rule()
    want = {i for i, root in brute(rows, rule.shingle, rule.percent).items() if i == root}
    assert {r.doc_id for r in stages[4].collect()} == want


def test_packing_stage(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_registered():
    q = __spark_entry__.queries()
    names = [n for n in q if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert q["pipeline"] is P.run
