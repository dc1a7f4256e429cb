import random

import numpy as np
from pyspark.sql import functions as F

from plantlens.llm import pu_quality, toxicity
from plantlens.llm.common import fold_of
from tests.llm.fixtures import documents, empty, syllables

INSULTS = ["grobbler", "snivelton", "muckwart", "plonkster", "dregwit"]


def corpus(n=700, seed=1):
    """Texts, of which a quarter hold a few invented insults and a fifth are of low quality."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = syllables(rng, rng.randint(60, 200)).split(" ")
        toxic, good = rng.random() < 0.25, rng.random() < 0.8
        for _ in range(rng.randint(3, 7) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "***" for w in words]
        rows.append((i, " ".join(words), int(toxic), int(good)))
    return rows


def tables(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, t, q) for i, _, t, q in rows], "doc_id long, toxic int, quality int")
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = toxicity.train(docs, labels.where(fold_of("doc_id", 4) != 2))
    got = toxicity.score_documents(docs, model, fold_of("doc_id", 4) == 2).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93 and got.score.between(0, 1).all()


def test_toxic_stretch_late_in_a_long_word():
    rows = corpus()
    model = toxicity.fit_model([t for _, t, x, _ in rows if x], [t for _, t, x, _ in rows if not x], 0.25)
    clean = "_".join(syllables(random.Random(3), 150).split())
    assert len(clean.encode()) > 512
    for at in (0, 200, 256, 300, len(clean)):
        # Insults follow one another in one word, so each stretch that meets them sees several.
        toxic = clean[:at] + "_" + "_".join(INSULTS) + "_" + clean[at:]
        assert model.score(toxic) > model.score(clean), at
        assert model.levels(toxicity.scored_words(toxic))[-1] > model.levels(toxicity.scored_words(clean))[-1], at
    for n in (1, 255, 256, 257, 384, 385, 1000):
        word = "".join(random.Random(n).choices("abcdef", k=n))
        got = toxicity.scored_words(word)
        assert all(len(g) <= toxicity.LONG for g in got) and all(any(word[i : i + 128].encode() in g for g in got) for i in range(max(1, n - 127)))


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    model = pu_quality.train(docs, labels.where(fold_of("doc_id", 5) != 0))
    got = pu_quality.score_documents(docs, model, fold_of("doc_id", 5) == 0).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.predicted.mean() > 0.97 and good.score.min() > bad.score.median() and abs(model.prior - 0.8) < 0.15
    assert got.score.between(0, 1).all()


def test_prior_hangs_on_the_rows_and_not_on_their_order():
    for seed in (1, 2, 7):
        rows = corpus(seed=seed)
        good, texts = [t for _, t, _, g in rows if g][::2], [t for _, t, _, _ in rows]
        priors = []
        for turn in range(2):
            for part in (good, texts):
                random.Random(turn).shuffle(part)
            priors.append(pu_quality.fit_model(good, texts).prior)
        assert abs(priors[0] - priors[1]) < 0.01 and abs(priors[0] - 0.8) < 0.1


def test_labels_of_the_held_out_fold_play_no_part(spark):
    docs, labels = tables(spark)
    turned = labels.withColumns({c: F.when(fold_of("doc_id", 4) == 2, 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    models = [toxicity.train(docs, t.where(fold_of("doc_id", 4) != 2)) for t in (labels, turned)]
    assert models[0].toxic == models[1].toxic and np.allclose(models[0].weights, models[1].weights)


def test_non_negative_risk_holds_the_second_part_at_zero():
    zp, zu = np.full(50, 6.0), np.full(50, -6.0)
    first, rest = pu_quality.pu_risk(zp, zu, 0.9)
    assert first >= 0 and rest < 0
    fit = pu_quality.Fit(steps=200)
    x = np.concatenate([np.ones((40, 1)), np.eye(40)], axis=1).astype(np.float32)
    assert np.isfinite(pu_quality.minimise(x[:20], x, 0.5, fit)).all()


def test_odd_rows_and_empty_tables(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0), (12, 0, 1)], "doc_id long, toxic int, quality int")
    for op in (toxicity, pu_quality):
        for marks in (labels, labels.limit(0)):
            model = op.train(docs, marks)
            rows = op.score_documents(docs, model, F.lit(True)).collect()
            assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
        assert op.score_documents(empty(spark), op.train(empty(spark), labels), F.lit(False)).count() == 0


def test_stems_that_never_repeat_as_whole_words():
    """Toxic texts share the start of a word, each time with another end, which ordinary texts hold only inside words."""
    rng, rows = random.Random(9), []
    for i in range(900):
        words = syllables(rng, 90).split(" ")
        ends = ["".join(rng.choice("bcdfgklmprt") for _ in range(4)) for _ in range(3)]
        words += [f"grobsnivel{e}" if i % 4 == 0 else f"un{e[:2]}snivel{e}" for e in ends]
        rng.shuffle(words)
        rows.append((i % 4 == 0, " ".join(words)))
    toxic, ordinary = ([t for x, t in rows[:600] if x == kind] for kind in (True, False))
    model = toxicity.fit_model(toxic, ordinary, 0.25)
    got = [(x, model.score(t) >= 0.3) for x, t in rows[600:]]
    assert sum(p for x, p in got if x) / sum(x for x, _ in got) > 0.95 and sum(p for x, p in got if not x) / sum(not x for x, _ in got) < 0.05
    telling, known = toxicity.telling_words(toxic, ordinary, toxicity.Fit())
    assert sum(b"grobsnivel" in w for w in telling) > 0.8 * len(telling) and not any(b"snivel" in w and w.startswith(b"un") for w in known)
