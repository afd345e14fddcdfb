import random

import pytest

from graphloom.functions.stem import stem
from graphloom.operators import lineage, search

PAIRS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size
hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc hesitanci hesit
digitizer digit conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize bowdler probate probat
rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "to"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_published_examples(word, to):
    assert stem(word) == to


def corpus(n=500, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    return [(i, " ".join(rng.choices(vocab, weights, k=rng.randrange(5, 80)))) for i in range(n)], vocab


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("every", [False, True])
def test_equals_scoring_everything(spark, every, monkeypatch):
    monkeypatch.setattr(search, "PART", 16)
    docs, vocab = corpus()
    rng = random.Random(4)
    asked = [(i, " ".join([rng.choice(vocab[:4]), *rng.sample(vocab, rng.randrange(0, 4))])) for i in range(25)] + [(90, "nothing known"), (91, None), (92, "")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(asked, "query_id long, text string")
    index = search.build(d, lineage.scratch(spark))
    best, parts = search.search(index, q, 5, every)
    want = rows(search.exhaustive(index, q, 5, every))
    assert rows(best) == want and len(want) > 20
    told = parts.collect()
    assert sum(r.skipped for r in told) > (0 if every else 0.1) * sum(r.parts for r in told)
    again = search.load(spark, index.path)
    assert (again.n, again.mean) == (index.n, index.mean)


def test_upsert_equals_a_new_index_with_the_old_mean(spark):
    docs, vocab = corpus(200)
    changed = [(5, "waa waa wba"), (7, ""), (300, "waa wca brandnew"), (None, "waa")]
    new = dict(docs) | {i: t for i, t in changed if i is not None}
    frame = lambda x: spark.createDataFrame(list(x), "doc_id long, text string")
    q = spark.createDataFrame([(1, "waa"), (2, "wba wca"), (3, "brandnew"), (4, docs[7][1])], "query_id long, text string")
    index = search.upsert(search.build(frame(docs), lineage.scratch(spark)), frame(changed), lineage.scratch(spark))
    fresh = search.build(frame(new.items()), lineage.scratch(spark))
    assert index.n == fresh.n == 201
    whole = frame(new.items())
    postings = search._weights(whole, index.mean)[0]
    assert rows(index.table(spark, "forward").select("doc_id", "term", "w")) == rows(postings)
    assert rows(search.search(index, q, 4)[0]) == rows(search.exhaustive(index, q, 4))
    counts = {(r.term, r.band): r.n for r in index.table(spark, "heads").collect()}
    held = {}
    for r in index.table(spark, "blocks").collect():
        held[r.term, r.band] = held.get((r.term, r.band), 0) + len(r.postings)
    assert counts == held


def test_words_of_one_stem_meet(spark):
    d = spark.createDataFrame([(1, "Connections were failing"), (2, "a connected pipe"), (3, "none")], "doc_id long, text string")
    index = search.build(d, lineage.scratch(spark))
    best, _ = search.search(index, spark.createDataFrame([(1, "connecting fails"), (2, "pipes")], "query_id long, text string"), 5)
    assert {(r.query_id, r.doc_id): r["rank"] for r in best.collect()} == {(1, 1): 1, (1, 2): 2, (2, 2): 1}


def test_empty(spark):
    none, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "query_id long, text string")
    index = search.build(none, lineage.scratch(spark))
    assert search.search(index, q, 3)[0].collect() == [] == search.exhaustive(index, q, 3).collect()


def test_documents_without_words_count_in_the_mean(spark):
    d = spark.createDataFrame([(1, "cat dog dog"), (2, ""), (3, None), (4, "dog"), (4, "dog pig")], "doc_id long, text string").repartition(3)
    postings, n, mean = search._weights(d, None)
    assert (n, mean) == (4, 5 / 4)
    assert {(r.doc_id, r.term) for r in postings.collect()} == {(1, "cat"), (1, "dog"), (4, "dog"), (4, "pig")}
