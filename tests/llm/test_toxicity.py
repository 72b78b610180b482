import random

import numpy as np

from corpusmap.llm.toxicity import Automaton, Lexicon, Sample, features, fit_logistic, learn, toxicity
from tests.llm.common import awkward, frame, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _next(row, x, b, i)
    return row[-1]


def _next(row, x, b, i):
    out = [i]
    for j, y in enumerate(b, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (x != y)))
    return out


def test_automaton_equals_dynamic_programming():
    rng = random.Random(3)
    terms = ["idiot", "moron", "worthless", "morose", "wort"]
    for edits in (0, 1, 2):
        automaton = Automaton([(i, t, False) for i, t in enumerate(terms)], edits)
        for _ in range(1500):
            word = list(rng.choice(terms))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(word) + 1)
                word[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t"])
            word = "".join(word)
            best = min(distance(word, t) for t in terms)
            got = automaton.match(word)
            assert (got is None) if best > edits else (got[0] == best and distance(word, terms[got[1]]) == best), word


def test_stems_and_near_words():
    lexicon = Lexicon(["achli*", "stupid"], [1.0, 1.0], frozenset({"stupit"}))
    assert lexicon.find("achlich") == (0, 0) and lexicon.find("achli") == (0, 0) and lexicon.find("achl") is None
    assert lexicon.find("stuupid")[0] == 1 and lexicon.find("stupit") is None and lexicon.find("5tup1d")[0] == 1


def test_context_tells_quotation_from_abuse():
    import pyarrow as pa

    lexicon = Lexicon(["idiot"], [1.0])
    abuse, quote, said, clean = features(pa.array([
        "you are an idiot today", 'he was "an idiot" there', "she said idiot once", "nothing here"]), lexicon)
    assert abuse[0] > 0 and abuse[2] > 0 and abuse[1] == 0
    assert quote[0] == 0 and quote[1] > 0 and said[1] > 0 and not clean.any()


def test_logistic_regression_at_its_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x @ [2, -1, 0] + rng.normal(size=400) > 0).astype(float)
    w = fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(np.column_stack([x, np.ones(400)]) @ w)))
    assert np.allclose(np.column_stack([x, np.ones(400)]).T @ (y - p), [w[0], w[1], w[2], 0], atol=1e-6)


def test_held_out_accuracy_and_awkward_rows(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = prose(40, i).split()
        for term in rng.sample(["idiot", "moron", "scumbag", "worthless"], 2) * bad:
            text.insert(rng.randrange(len(text)), term)
        rows.append((1000 + i, " ".join(text)))
        labels.append((1000 + i, int(bad)))
    docs = frame(spark, rows + awkward(), extra=True)
    marks = spark.createDataFrame(labels[:300] + [(None, 1), (1001, None), (1000, 1)], "doc_id bigint, toxic int")
    model = learn(docs, marks, Sample(min_docs=5))
    assert {"idiot", "moron", "scumbag", "worthless"} <= {t.rstrip("*") for t in model.lexicon.terms} | set(model.lexicon.terms)
    done = toxicity(docs, model)
    assert done.columns == [*docs.columns, "toxicity"]
    got = {r["doc_id"]: r["toxicity"] for r in done.collect()}
    held = [(got[d] >= 0.5) == bool(t) for d, t in labels[300:]]
    assert sum(held) >= 98 and all(0 <= s <= 1 for s in got.values()) and got[20] < 0.5
    assert toxicity(docs.where("false"), model).count() == 0


def test_without_labels_the_score_is_a_constant(spark):
    docs = frame(spark, awkward())
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    scores = {r["toxicity"] for r in toxicity(docs, learn(docs, none)).collect()}
    assert len(scores) == 1
