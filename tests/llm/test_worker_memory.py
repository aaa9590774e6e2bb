"""What tasks leave in a Python worker: workers outlive their operator, and in
the pipeline the next operator's tasks run in them."""

import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from revlens.llm import common, hyperminhash, quality, tokens, toxicity


@pytest.fixture
def left_over():
    """Stands for the encoder that a task of another operator cached."""
    tokens.worker_cache()["encoder x"] = bytes(10)
    yield lambda: "encoder x" in tokens.worker_cache()
    tokens.worker_cache().pop("encoder x", None)


def scorer(monkeypatch, op, docs, model):
    """The function that the operator's scoring tasks run."""
    got, real = [], F.pandas_udf
    monkeypatch.setattr(F, "pandas_udf", lambda kind: lambda f: got.append(f) or real(kind)(f))
    op.score(docs, model)
    return got[0]


def zeros(n):
    return np.zeros(n, np.float32)


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scoring_tasks_make_room_and_release(monkeypatch, spark, documents, left_over, op):
    if op is quality:
        model = {"word": zeros(1 << quality.BITS), "gram": zeros(1 << quality.BITS), "bias": 0.0}
    else:
        member = toxicity.train_member([[b"a dreadful slur"] * 9], [[b"a pleasant thing"] * 9], 0)
        model = {"members": [member], "mu": np.zeros(6), "sd": np.ones(6), "w": np.zeros(7)}
    score, calls = scorer(monkeypatch, op, documents, model), []
    monkeypatch.setattr(op, "release", lambda: calls.append(1))
    out = list(score(iter([pd.Series(["one two", ""]), pd.Series(["three"])])))
    assert [list(s) for s in out] == [[0.5, 0.5], [0.5]]
    assert not left_over() and calls == [1]


def test_members_are_trained_from_batches(monkeypatch, spark, documents, labels, left_over):
    """A member's task takes its rows batch by batch, in any order, and the
    result is that of the whole rows in the order of their ids."""
    got, real = [], PandasGroupedOpsMixin.applyInPandas

    def applied(self, f, schema):
        if "member int" in schema:
            got.append(f)
        return real(self, f, schema)

    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", applied)
    sample = quality.labelled_sample(documents, labels, "toxic", 100)[0].toPandas().sort_values("doc_id")
    members = toxicity.fit(documents, labels, max_rows=100)["members"]
    w, y = [toxicity.windows(t) for t in sample["text"]], sample["y"].tolist()
    want = toxicity.train_member([x for x, v in zip(w, y) if v == 1], [x for x, v in zip(w, y) if v == 0], 3)
    rows = sample.assign(member=3)
    for parts in ([rows], [rows[40:], rows[:40]]):
        model = pickle.loads(next(got[0](iter(parts)))["model"][0])
        for m in (model, members[3]):
            assert m["toxic"] == want["toxic"] and m["ordinary"] == want["ordinary"] and (m["table"] == want["table"]).all()
    assert not left_over()


def test_shingle_sets_whatever_the_slice(monkeypatch):
    texts = ["one two three four five six " * 40, "", "x", "a b " * 3000, "y" * 5000 + " z", None]
    want = hyperminhash.shingle_sets(texts, 5)
    monkeypatch.setattr(hyperminhash, "SET_BYTES", 64)
    for a, b in zip(want, hyperminhash.shingle_sets(texts, 5)):
        assert (a == b).all()


def test_own_state_stays(left_over):
    common.release()
    common.trim()
    assert left_over()
    common.make_room()
    assert not left_over()
