import random

from rankloom.llm import toxicity

from .samples import documents, frame


def test_held_out_accuracy_with_unseen_misspellings(spark):
    rng = random.Random(1)
    plain = ["house", "river", "stone", "green", "walk", "table", "winter", "paper", "light", "sound"]
    stems, ends = ["grolk", "vexith"], ["ing", "ed", "er", "ly", "s", "ish", "est", "y"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) + str(rng.randint(0, 40)) for _ in range(rng.randint(20, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                word = rng.choice(stems) + rng.choice(ends)
                if i >= 300:  # misspelt as in no training row: one letter doubled
                    k = rng.randrange(len(word))
                    word = word[:k] + word[k] + word[k:]
                words[rng.randrange(len(words))] = word
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad) if i < 300 else None))
    docs, known = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known, held_out=None)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    late = list(range(300, 400))
    bad, good = ([got[i] for i in late if (i % 3 == 0) == toxic] for toxic in (True, False))
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) >= 0.97
    assert sum((got[i] >= 0.5) == (i % 3 == 0) for i in late) / len(late) >= 0.9
    assert all(0 <= s <= 1 for s in got.values())
    kept = toxicity.clean(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(s < 0.5 for s in got.values())


def test_awkward_rows_and_missing_labels(spark):
    rows = documents(4, 20)
    for labels in ([], [(0, 1)], [(0, 1), (0, 0), (None, 1), (3, None)], [(0, 0), (3, 0)]):
        model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(frame(spark, rows), model)
        scores = got.select("text", "score").collect()
        assert len(scores) == len(rows) and all(0 <= r.score <= 1 for r in scores)
        assert len({r.score for r in scores if not (r.text or "").strip()}) == 1
    assert toxicity.score(frame(spark, []), model).count() == 0
