"""Quality and toxicity: held-out accuracy, odd rows, missing labels, gradients."""

import numpy as np
import pytest

from chronolith.llm import attention_quality as q
from chronolith.llm import weak_toxicity as t
from chronolith.llm.common import labelled_texts

SF = "/root/testdata/sf0.1"  # of the smaller tables a class has too few rows


def judged(spark, rows, column):
    return rows.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", column).collect()


def test_quality_held_out(spark):
    rows = judged(spark, q.op9_attention_quality(spark, SF), "quality")
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_held_out(spark):
    rows = t.op10_weak_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").filter("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in toxic]) >= 0.9
    assert np.mean([r.predicted for r in rows if r.toxic == 0]) <= 0.005
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    # what is missed holds nothing that the labelled toxic texts have in common: no entry of the model fires in it
    base = min(r.score for r in rows)
    assert all(r.score < base + 0.05 for r in toxic if not r.predicted)


LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "x")], [(i, i % 2, i % 2, None) for i in range(40)] + [(None, 1, 1, None), (3, None, None, None), (2, 0, 1, None), (2, 1, 0, None)]])
def test_odd_rows(spark, odd_docs, no_docs, labels):
    frame = spark.createDataFrame(labels, LABELS)
    quality = q.score_quality(odd_docs, q.fit(labelled_texts(odd_docs, frame, "quality", 50, 10_000))).collect()
    toxicity = t.score_toxicity(odd_docs, t.fit(labelled_texts(odd_docs, frame, "toxic", 50, 10_000))).collect()
    assert len(quality) == len(toxicity) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in [*quality, *toxicity])
    assert q.score_quality(no_docs, 0.5).count() == t.score_toxicity(no_docs, None).count() == 0


def test_sample_is_bounded_and_never_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    got = labelled_texts(docs, labels, "quality", 30, 3000)
    assert len(got) <= 60 and all(len(x) <= 3000 for x, _ in got)
    from pyspark.sql import functions as F

    from chronolith.llm.common import held_out

    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert labelled_texts(docs, flipped, "quality", 30, 3000) == got


def test_sample_is_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (6, 0)], "doc_id long, quality int")
    assert len(labelled_texts(docs, labels, "quality", 2, 100)) <= 4


def test_label_model_finds_accuracies_and_groups():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    fires = lambda hit, miss: rng.random(4000) < np.where(y, hit, miss)
    good, weak, blind = fires(0.8, 0.02), fires(0.5, 0.2), fires(0.5, 0.5)
    fired = np.stack([good, good, good, weak, fires(0.6, 0.05), blind, ~good & ~weak], axis=1)
    abstains = np.array([False] * 4 + [True] + [False] * 2)
    model = t.LabelModel(fired, np.where(good, 0.9, 0.1), 0.3, abstains, y ^ (rng.random(4000) < 0.05))
    assert model.tied[0, :3].tolist() == [1, 1, 1] and model.tied[3].sum() == 1
    # how often the class that a voter speaks for holds where it fires, against the truth
    for j in range(7):
        assert abs(model.accuracy[j] - np.mean(y[fired[:, j]] == model.speaks[j])) < 0.2
    assert model.accuracy[0] > model.accuracy[3] > 0.4 and model.useful[0] and not model.speaks[6]
    assert np.mean((model.posterior(fired) > 0.5) == y) > 0.8
    # by hand: prior odds, and one vote a group of the voters that fire, useful ones only
    for i in range(50):
        on = [j for j in range(7) if (fired[i, j] or not abstains[j]) and model.useful[j]]
        r = np.where(fired[i], model.rates, 1 - model.rates)
        odds = np.log(0.3 / 0.7) + sum(np.log(r[1, j] / r[0, j]) / sum(model.tied[j, k] for k in on) for j in on)
        assert abs(model.posterior(fired[i : i + 1])[0] - 1 / (1 + np.exp(-np.clip(odds, -30, 30)))) < 1e-9


def test_linear_gradient():
    rng = np.random.default_rng(2)
    rows, cols, post = rng.integers(0, 12, 60), rng.integers(0, 5, 60), rng.random(12)
    w, b = rng.normal(size=5), 0.3
    _, grad = t.linear_loss(w, b, rows, cols, post)
    for k in range(6):
        step = np.zeros(6)
        step[k] = 1e-6
        up, down = (t.linear_loss(w + s * step[:5], b + s * step[5], rows, cols, post)[0] for s in (1, -1))
        assert abs((up - down) / 2e-6 - grad[k]) < 1e-6


def test_scores_equal_sums_over_what_fires():
    model = ({"bad": 2.0, "wors*": 1.0, "wors@": 3.0, "wor*": 0.5}, -2.0)
    scorer = t.Scorer(model)
    for text in ("", None, "bad", "Bad, BAD worst", "worst worse words", "word " * 3000 + "bad worst", "x bad" * 3, "fine words " * 40 + "worst worse"):
        found = t.entries_of(text or "")
        want = 1 / (1 + np.exp(-(model[1] + sum(w for e, w in model[0].items() if e in found))))
        assert abs(scorer.score(text) - want) < 1e-12
    assert scorer.score("word " * 3000 + "bad") < scorer.score("word " * 300 + "bad")  # a chance hit in a long text


def test_attention_finds_the_bad_passage():
    good = "some ordinary words of a text that goes on and says a thing or two, as texts do. " * 8
    bad = "XX!! YY!! ZZ!! QQ!! " * 30
    sample = [(good * (1 + i % 3), 1) for i in range(60)] + [(good + bad + good if i % 2 else bad, 0) for i in range(60)]
    model = q.fit(sample)
    scores = model.score_texts([good * 2, good + bad + good, None])
    assert scores[0] > 0.5 > scores[1] and 0 <= scores[2] <= 1


def test_attention_learns_from_words_alone():
    rng = np.random.default_rng(1)
    words = {1: ["stone", "river", "cloud", "field", "house"], 0: ["plant", "table", "chair", "grass", "night"]}
    texts = [(" ".join(rng.choice(words[i % 2], 60)), i % 2) for i in range(200)]
    model = q.fit(texts[:120])
    assert np.mean((model.score_texts([t for t, _ in texts[120:]]) > 0.5) == [y for _, y in texts[120:]]) > 0.95


def test_attention_gradient():
    rng = np.random.default_rng(3)
    texts = ["one two three " * 40, "", "ONE!! TWO 33", "four five " * 30 + "six"]
    words_of = q.Words()
    bags = [(np.array(f), words_of(w)) for w, f in (q.passages(t) for t in texts)]
    model = q.AttentionModel.drawn(rng, np.zeros(q.N_FEATURES), np.ones(q.N_FEATURES))
    y, weight = np.array([1.0, 0, 0, 1]), np.array([0.5, 1, 2, 1])
    _, grad = model.loss(bags, words_of.parts(), y, weight)
    for k, g in grad.items():
        flat = np.flatnonzero(np.ravel(g))[:40]
        assert len(flat)
        for i in flat:
            values = []
            for step in (1e-6, -1e-6):
                kept = model.p[k]
                moved = np.array(kept, float).ravel()
                moved[i] += step
                model.p[k] = moved.reshape(np.shape(kept))
                values.append(model.loss(bags, words_of.parts(), y, weight)[0])
                model.p[k] = kept
            assert abs((values[0] - values[1]) / 2e-6 - np.ravel(g)[i]) < 1e-6


def test_encoder_is_the_mean_of_the_parts_and_forgets(monkeypatch):
    vectors = np.random.default_rng(4).normal(size=(q.BUCKETS, q.HIDDEN))
    words = [f"w{i % 37}" for i in range(q.STRETCH + 100)]
    want = []
    for a in range(0, len(words), q.WORDS):
        parts = [q.Words.parts_of(w) for w in words[a : a + q.WORDS]]
        want.append(vectors[np.concatenate(parts)].mean(axis=0))
    assert np.allclose(q.Encoder(vectors)(words), want, atol=1e-5)
    monkeypatch.setattr(q, "REMEMBERED", 100)
    assert np.allclose(q.Encoder(vectors)(words), want, atol=1e-5)
    assert q.Encoder(vectors)([]).shape == (1, q.HIDDEN)


def test_shouting_is_heard_in_the_whole_text():
    text = "quiet " * 700 + "LOUD " * 1500
    fired = t.votes([text, text[:4200]], [t.entries_of(text), t.entries_of(text[:4200])], [])
    assert fired[:, t.PATTERNS.index("shouting")].tolist() == [True, False]
