import hashlib
import random

import pytest

from graphloom.llm import fingerprints as F8

LOW = -(1 << 63)


def corpus():
    rng = random.Random(8)
    common = ["the", "of", "and"]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.3 else f"w{rng.randrange(3000)}" for _ in range(n))
    rows = [(i * 3, say(rng.choice([0, 4, 30, 200, 1500]))) for i in range(120)]
    rng.shuffle(rows)
    return rows + [(2, None), (4, ""), (5, "é" * 10), (None, "the of"), (3, rows[0][1]), (3, rows[0][1])]


@pytest.mark.parametrize("bucket", [2000, 7])
def test_edits_and_likeness(spark, monkeypatch, bucket):
    monkeypatch.setattr(F8, "BUCKET_ROWS", bucket)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, next string, f int").repartition(6)
    got = F8.imatch(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    ties = {}
    for i, t in rows:
        ties.setdefault(LOW if i is None else i, set()).add(t or "")
    order = sorted(ties, reverse=True)
    texts = dict((LOW if i is None else i, t or "") for i, t in rows)
    for r in got:
        i = LOW if r.doc_id is None else r.doc_id
        if len(ties[i]) > 1 or i == 3:
            continue
        nxt = order[(order.index(i) + 1) % len(order)]
        t, m = texts[i], len(texts[i]) // 3
        assert r.n_chars == len(t)
        wants = {hashlib.sha256((t[: len(t) - m] + n[:m]).encode()).hexdigest() for n in ties[nxt]}
        assert r.edited_sha256 in wants
    prints = {}
    for r in got:
        if len(ties.get(LOW if r.doc_id is None else r.doc_id, ())) == 1:
            prints.setdefault(texts[LOW if r.doc_id is None else r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())
    long = [r for r in got if r.n_chars > 600]
    assert sum(r.near_edited for r in long) / len(long) > 0.3 > 0.05 > sum(r.near_next for r in long) / len(long)


def test_small_tables(spark):
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    r = F8.imatch(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()
    assert F8.imatch(one.limit(0)).count() == 0


def test_copies_do_not_empty_the_lexicon(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    copied = say(300)
    rows = [(i, copied if i % 3 == 0 else say(300)) for i in range(180)]
    got = {r.doc_id: r for r in F8.imatch(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    near = [got[i].near_edited for i, t in rows if t == copied]
    assert sum(near) / len(near) > 0.25 and max(got[i].near_next for i, _ in rows) < 0.2


def test_few_terms_in_band_are_compared_over_all(spark):
    rng = random.Random(10)
    common = [f"c{k}" for k in range(60)]
    rows = [(i * 10, " ".join([f"w{rng.randrange(9000)}" for _ in range(200)] + common)) for i in range(150)]
    rows += [(1495, " ".join(common)), (55, " ".join(common[:9]))]
    got = {r.doc_id: r for r in F8.imatch(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1495].near_edited > 0.3 and got[55].near_edited > 0.3


def brute(text, band, levels=61):
    """Hashes of one text by plain loops; ``xx`` is Spark's own hash."""
    import xxhash

    def xx(*values):
        h = 42
        for v in values:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little", signed=True), h)
        return signed(h)

    def signed(h):
        return h - (1 << 64) if h >> 63 else h

    def nth(t, r):  # r has 4 bytes
        return signed(xxhash.xxh64_intdigest(r.to_bytes(4, "little"), xx(t) & (1 << 64) - 1)) | 1

    every = sorted({xx(w.encode()) for w in text.replace("\n", " ").replace("\t", " ").split(" ") if w})
    mine = [t for t in every if band(t)]
    few = len(mine) < len(every) * F8.FEW_SHARE
    out = []
    for r in range(F8.ORDERS):
        hashes = sorted(nth(t, r) for t in (every if few else mine))
        marks = [(k << 61) - (1 << 63) for k in range(8)]
        for b in range(8):
            found = []
            for width in (4, 2):
                x = b // width * width
                top = marks[x + width] if x + width < 8 else 1 << 63
                run = sorted([h for h in hashes if marks[x] <= h < top] + marks[x : x + width])
                found.append(run if len(run) > width else [])
            for k in range(levels):
                found.append([h for h in hashes if marks[b] <= h < marks[b] + (1 << 61 - k)])
            out.append([xx(*x) & 0xFFF for x in found if x])
    return few, out


def test_fingerprints_against_plain_loops(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and t]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = F8.lexicon(docs)
    mask = 64 * len(words.bitmap) - 1
    band = lambda t: words.bitmap[(t & mask) >> 6] >> (t & mask & 63) & 1
    got = F8.with_fingerprint(docs, "text", words, "f").collect()
    for r in got:
        assert (r.f_few, r.f_hashes) == brute(r.text, band)
    from pyspark.sql import functions as F

    a, b = got[0].f_hashes, got[1].f_hashes
    pairs = spark.createDataFrame([(a, b), (a, a), (a, [[]] * F8.STREAMS), ([[]] * F8.STREAMS, [[]] * F8.STREAMS)], "p array<array<int>>, q array<array<int>>")
    alike = lambda p, q: 1.0 if p == q else 1 - 2 ** (-sum(x == y for s, t in zip(p, q) for x, y in zip(s, t)) / F8.STREAMS)
    for r in pairs.select("p", "q", F8.equal_share(F.col("p"), F.col("q")).alias("x")).collect():
        assert abs(r.x - alike(r.p, r.q)) < 1e-12


def test_likeness_estimates_the_terms_in_common(spark):
    rng = random.Random(11)
    rows = []
    for k, share in enumerate([0.2, 0.5, 0.8]):
        for n in (60, 400, 3000):
            same = [f"s{k}x{n}x{i}" for i in range(int(n * share))]
            other = lambda tag: [f"{tag}{k}x{n}x{i}" for i in range((n - len(same)) // 2)]  # noqa: E731,B023
            rows.append((share, " ".join(rng.sample(x := same + other("a"), len(x))), " ".join(same + other("b"))))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "share double, a string, b string")
    for c in "ab":
        df = df.withColumn(f"{c}_hashes", F8.prints(F8.terms(F.col(c)))).withColumn(f"{c}_few", F.lit(False))
    got = df.select("share", F8.likeness("a", "a", "b", "b").alias("x")).collect()
    for share in (0.2, 0.5, 0.8):
        x = [r.x for r in got if r.share == share]
        assert abs(sum(x) / len(x) - share) < 0.15


def test_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(F8, "BUCKET_ROWS", 5)
    rows = [(None, f"text number {i} of many") for i in range(60)] + [(i, f"known {i}") for i in range(5)]
    got = F8.imatch(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    hashes = lambda t, n: hashlib.sha256((t[: len(t) - len(t) // 3] + n[: len(t) // 3]).encode()).hexdigest()
    tie = {r.text: r.h for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "xxhash64(text) h").collect()}
    order = [t for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1]]), reverse=True)]
    assert sorted(r.edited_sha256 for r in got) == sorted(hashes(t, order[(k + 1) % len(order)]) for k, t in enumerate(order))


def test_bias_and_spread_at_true_shares(spark):
    rng = random.Random(12)
    rows = []
    for share in (0.0, 0.1, 0.5, 0.9):
        for k in range(60):
            n = rng.choice([80, 300, 900])
            same = [f"s{share}x{k}x{i}" for i in range(int(n * share))]
            rest = (n - len(same)) // 2
            rows.append((share, " ".join(same + [f"a{share}x{k}x{i}" for i in range(rest)]), " ".join(same + [f"b{share}x{k}x{i}" for i in range(rest)])))
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "share double, a string, b string").repartition(8)
    for c in "ab":
        df = df.withColumn(f"{c}_hashes", F8.prints(F8.terms(F.col(c))))
    got = df.select("share", F8.equal_share(F.col("a_hashes"), F.col("b_hashes")).alias("x")).collect()
    for share, most in ((0.0, 0.1), (0.1, 0.35), (0.5, 0.85), (0.9, 1.0)):
        x = [r.x for r in got if r.share == share]
        mean = sum(x) / len(x)
        spread = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        assert len(x) == 60 and abs(mean - share) < 0.04 and spread < 0.12 and max(x) <= most


def test_texts_are_hashed_once_for_a_likeness(spark):
    rows = [("a b", "a c", True, False, [[1]] * F8.STREAMS, [[1]] * F8.STREAMS)]
    df = spark.createDataFrame(rows, "a string, b string, a_few boolean, b_few boolean, a_hashes array<array<int>>, b_hashes array<array<int>>")
    got = df.select(F8.likeness("a", "a", "b", "b").alias("x"))
    assert got._jdf.queryExecution().analyzed().toString().count("split(translate(") == 2
    assert 0 <= got.first().x <= 1
