"""The tuned forest: split by class, folds, importances by name and explanations."""

import random

from lexforge.operators import classifier


def test_training_and_explanations(spark):
    random.seed(2)
    rows = []
    for i in range(900):
        control = random.choice(["high", "low", None])
        rows.append((i, control, random.choice("abc"), str(random.randint(0, 3)), None if i % 50 == 0 else "employee" if (control == "high") != (random.random() < 0.05) else "contractor"))
    df = spark.createDataFrame(rows, "id bigint, control string, noise string, size string, label string")
    t = classifier.train(df, "id", ["noise", "control", "size"], "label", {"maxDepth": [2, 5], "numTrees": [5]}, folds=2)
    assert t.importances[0][0] == "control" and abs(sum(w for _, w in t.importances) - 1) < 1e-9 and {f for f, _ in t.importances} == {"noise", "control", "size"}
    assert t.chosen["maxDepth"] in (2, 5) and t.chosen["numTrees"] == 5 and t.cv_mean > 0.85 and 0 <= t.cv_std < 0.1
    test = t.test.collect()
    assert sorted(t.classes) == ["contractor", "employee"] and sum(r.label == r.predicted for r in test) > 0.85 * len(test)
    for name in t.classes:
        n, held = sum(r[4] == name for r in rows), sum(r.label == name for r in test)
        assert 0.14 * n < held < 0.26 * n
    told = {r.predicted: r.explanation for r in classifier.explained(t.test, t, {"employee": "Likely an employee"}, "Likely a contractor", 1).where("confidence > 0.5").collect()}
    assert told["employee"].startswith("Likely an employee (confidence: ") and told["employee"].endswith("%). Key factors: control.") and told["contractor"].startswith("Likely a contractor")
    unseen = spark.createDataFrame([(1, "never", "z", "9")], "id bigint, control string, noise string, size string")
    assert t.model.transform(unseen).select("prediction").count() == 1
