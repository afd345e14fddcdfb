import random

from graphloom.llm import quality as Q


def rows():
    rng = random.Random(4)
    good = ["the", "of", "river", "stone", "went", "home."]
    docs, labels = [], []
    for i in range(300):
        y = rng.random() < 0.7
        words = [rng.choice(good) for _ in range(rng.randint(5, 80))]
        docs.append((i, " ".join(words) if y else " ".join(w.upper() + "!!" for w in words), 9))
        labels.append((i, int(y), 0))
    return docs, labels


def test_scores(spark):
    docs, labels = rows()
    docs += [(None, "the river", 9), (500, None, 9), (501, "", 9), (1, docs[1][1], 9), (502, "home " * 50_000, 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, label int")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (900, 1, 0)], "doc_id long, quality int, toxic int")
    got = Q.quality_scores(frame, marks).collect()
    assert len(got) == len(docs)
    truth = dict(x[:2] for x in labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len({r.score for r in got if r.doc_id in (500, 501)}) == 1
    kept = Q.keep_quality(frame, marks)
    assert kept.columns == frame.columns and kept.count() == sum(r.predicted for r in got)


def test_without_labels(spark):
    frame = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in Q.quality_scores(frame, none).collect()] == [0.5]
    assert Q.quality_scores(frame.limit(0), none).count() == 0


def test_repeated_ids_are_cut_in_a_fixed_order(spark):
    rows = [(1, f"text {k} of one id" if k % 2 else "bad bad bad") for k in range(40)] + [(5, "good words here"), (3, "bad bad")]
    labels = spark.createDataFrame([(1, 1), (5, 1), (3, 0)], "doc_id long, quality int")
    frame = lambda n: spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
    models = [Q.fit(frame(n), labels, max_rows=7) for n in (1, 3, 8)]
    assert len({(b, w.tobytes()) for b, w in models}) == 1
