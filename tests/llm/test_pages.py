import random
import re

import pytest

from graphloom.llm import html as H
from graphloom.llm import urls as U

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="page"><header><p>Top</p></header><nav><ul><li>Menu</li></ul></nav><!-- ad <article> --><div class="ad">Buy</div>
<article class="post"><header><h1>A &amp; B</h1></header><p>One<b>two</b>  three&nbsp;four.<br>five<p>Open &lt;p&gt; tag<div class="share-buttons">Share</div>
<aside>Side</aside><form><p>Send</p></form><blockquote>Quote</p> on</blockquote><section id="comments"><p>First!</p></section><p>caf&eacute; &#8364; &unknown; 1 < 2</p></article>
<div id="cookieNotice">OK</div><footer>&copy; x"""


def test_article():
    inside, _ = H.blocks(PAGE)
    assert inside == ["A & B", "Onetwo three four. five", "Open <p> tag", "Quote", "on", "café € &unknown; 1 < 2"]


def test_pages(spark):
    chrome = "home news about contact imprint terms privacy help jobs"
    rows = [
        (1, "http://h.example.com/1", PAGE, 5),
        (2, None, None, 5),
        (3, "x", "", 5),
        (4, "http://p.example.com/a", f"<div>{chrome}</div><div>alpha text one</div>", 5),
        (5, "http://p.example.com/b", f"<div>{chrome}</div><div>beta text two <i>{chrome}</i> end</div>", 5),
        (5, "http://p.example.com/b", "<p>only here", 5),
        (6, "http://q.example.com/b", f"<div>{chrome}</div>", 5),
        (7, "http://h.example.com/2", "<main>" + "<p>long</p>" * 30000, 5),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in H.extract_pages(frame).collect()), key=str)
    assert len(got) == len(rows) and all(n == len(t) for *_, t, n in got)
    text = {(i, u): t for i, u, t, _ in got if i != 5}
    assert text[2, None] == "" == text[3, "x"] and text[1, rows[0][1]].startswith("A & B\nOne")
    assert text[4, rows[3][1]] == "alpha text one" and text[6, rows[6][1]] == chrome
    assert sorted(t for i, _, t, _ in got if i == 5) == ["beta text two end", "only here"]
    assert text[7, rows[7][1]].count("\n") == 29999
    assert H.extract_pages(frame.limit(0)).count() == 0


def test_runs_against_brute_force():
    rng = random.Random(3)
    pages = [[" ".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(3)] for _ in range(12)]
    streams = [[w for b in p for w in b.split()] for p in pages]
    for p, page in enumerate(H.unique_runs(pages, 4)):
        gone = set()
        for i in range(len(streams[p]) - 3):
            win = streams[p][i : i + 4]
            if any(s[k : k + 4] == win for q, s in enumerate(streams) if q != p for k in range(len(s) - 3)):
                gone.update(range(i, i + 4))
        assert " ".join(page).split() == [w for i, w in enumerate(streams[p]) if i not in gone]


def test_structure_goes_before_names():
    page = """<article><div class="entry-header"><h1>Title</h1></div><p class="side-effect">Side effects are rare.</p><p>Body</p>
    <p id="search-results">Found</p><div class="comment-list">No</div><div id="userComments">No</div><div role="navigation">No</div><div class="header"><h2>Part</h2></div></article>"""
    assert H.blocks(page)[0] == ["Title", "Side effects are rare.", "Body", "Found", "Part"]
    for empty in ("<nav>Menu</nav><article></article><p>Foot</p>", "<main><nav>x</nav></main><div>rest</div>"):
        assert H.blocks(empty)[0] == []
    for none in ("<!-- <article>no</article> --><p>Text</p>", "<script>'<article>'</script><p>Text</p>", "<aside><article>Teaser</article></aside><p>Text</p>"):
        assert H.blocks(none) == (None, ["Text"])


@pytest.mark.parametrize("host_chars", [1 << 20, 0])
def test_generated_pages_against_plain_python(spark, monkeypatch, host_chars):
    monkeypatch.setattr(H, "HOST_CHARS", host_chars)
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice("abcdefghij") * 2 for _ in range(n))
    hosts = {f"http://h{k}.example.com/": [say(12), say(9), say(20)] for k in range(12)}
    rows, want = [], {}
    for i in range(500):
        url = rng.choice(list(hosts))
        chrome = hosts[url]
        body = [f"w{i} " + " ".join(f"w{i}x{k}" for k in range(rng.randrange(12))) for _ in range(rng.randrange(4))]
        if i % 3 == 0:
            body.append(rng.choice(chrome))
        blocks = [*rng.sample(chrome, rng.randrange(3)), *body]
        page = "".join(f"<div>{b}</div>" for b in blocks)
        marked = i % 2 == 0
        rows.append((i, f"{url}{i}", f"<nav>{say(4)}</nav><article>{page}</article><footer>f</footer>" if marked else page))
        want[i] = (url, marked, [" ".join(b.split()) for b in blocks if b.strip()])
    distinct = {}
    for url, marked, blocks in want.values():
        if not marked:
            distinct.setdefault(url, set()).add("\n".join(blocks))
    seen = {u: [p.split() for p in sorted(pages)] for u, pages in distinct.items()}
    count = {}
    for u, pages in seen.items():
        for n, words in enumerate(pages):
            for k in range(len(words) - H.LONG + 1):
                count.setdefault((u, *words[k : k + H.LONG]), set()).add(n)
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i, (url, marked, blocks) in want.items():
        if marked:
            assert got[i] == "\n".join(blocks)
            continue
        words = " ".join(blocks).split()
        gone = {p for k in range(len(words) - H.LONG + 1) if len(count[(url, *words[k : k + H.LONG])]) > 1 for p in range(k, k + H.LONG)}
        kept, at = [], 0
        for b in blocks:
            kept.append(" ".join(w for k, w in enumerate(b.split(), at) if k not in gone))
            at += len(b.split())
        assert got[i] == "\n".join(k for k in kept if k)


def test_repeats_of_a_large_host(spark):
    chrome, both = "home news about contact imprint terms privacy help jobs", "a passage that only two pages of all have here"
    filler = lambda i: " ".join(f"t{i}x{k}" for k in range(2000))
    text = {i: filler(i) for i in range(300)}
    html = {i: f"<div>{chrome}</div><p>{text[i]}</p>" + (f"<p>{both}</p>" if i in (7, 250) else "") for i in text}
    rows = [(i, f"http://big.example.com/{i}", html[i]) for i in text] + [(1000 + k, f"http://big.example.com/copy{k}", html[3]) for k in range(50)]
    rows += [(2000 + k, f"http://other.example.com/{k}", f"<div>{chrome}</div>") for k in range(3)]
    got = {r.page_id: r.text for r in H.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert len(got) == len(rows) and all(got[i] == text[i] for i in text)
    assert all(got[1000 + k] == text[3] for k in range(50)) and all(got[2000 + k] == chrome for k in range(3))


def plain(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(n + p), v, n + p) for v, n, p in U.RULES if (host == n or host.endswith("." + n)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None


def test_urls(spark):
    urls = [
        "http://a.example.net/en/1", "http://A.Example.NET/de/1?x=/en/", "https://example.net/en", "http://notexample.net/en/1", "http://net", "http://x.example.com/de/a#b",
        "http://example.com/de", "http://x.org/fr/1", "http://x.org?/fr/", None, "", "no scheme", "http://", "x://y://z/a", "http://blog.casino-win.example.com/en/5",
        "http://m.cheappills.example.org/1", "http://example.com/freebets/1", "http://m.ththnd.example.com/en/9.html", "http://wiki.example.org/article", "http://É.example.com/é/",
    ]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(0, urls[0], "old")], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge(frame).collect()}
    assert U.judge(frame).count() == len(urls) + 1
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ("allow", "block") and verdict in (None, got[i].verdict)
    assert [got[i].verdict for i in (9, 10, 11, 14, 15, 16, 17, 18)] == ["allow"] * 3 + ["block"] * 3 + ["allow"] * 2
    assert U.judge(frame.limit(0)).count() == 0


def test_viterbi_is_the_best_split():
    import itertools

    s = U.Segmenter({"ab": 5, "a": 3, "b": 1, "abc": 2, "c": 4, "bc": 2})
    for run in map("".join, itertools.product("abcd", repeat=5)):
        cuts = [[run[i:j] for i, j in zip((0, *c), (*c, 5))] for k in range(5) for c in itertools.combinations(range(1, 5), k)]
        cost = lambda ws: sum(map(s._cost, ws))
        assert abs(cost(s(run)) - min(map(cost, cuts))) < 1e-9


def urls_of(spark, urls):
    return {r.url: r.verdict for r in U.judge(spark.createDataFrame([(u, "m", 1) for u in urls], "url string, method string, __blocked int")).collect()}


def test_clashing_columns_are_kept(spark):
    got = U.judge(spark.createDataFrame([(1, "http://casino-win.example.com/", "m", 7)], "page_id long, url string, method string, __blocked int")).first()
    assert (got.method, got["__blocked"], got.verdict) == ("m", 7, "block")


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_verdicts_do_not_depend_on_how_often_a_name_is_used(spark, monkeypatch, limit):
    monkeypatch.setattr(U, "BROADCAST_BYTES", limit)
    clean = [f"http://{w}.example.com/{p}" for w in ("roads", "essex", "sussex", "threads", "heads", "therly", "tionble") for p in ("en", "x")] + ["http://a.com/x"]
    spam = ["http://onlinecasino.example.com/", "http://m.cheappills.example.org/1", "http://freebets.example.com/", "http://mycasino.example.com/"]
    few = urls_of(spark, clean + spam)
    many = urls_of(spark, clean + spam + [f"http://{w}.h{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}.example.com/" for w in ("onlinecasino", "essex", "roads") for k in range(60)])
    assert {few[u] for u in clean} == {many[u] for u in clean} == {"allow"}
    assert {few[u] for u in spam} == {many[u] for u in spam} == {"block"}


def test_urls_against_plain_python(spark):
    """All statistics by plain loops over a small table with very long and repeated runs."""
    import math
    from collections import Counter

    rng = random.Random(2)
    words = [*U.labelled(U.BLOCK_NAMES), *U.labelled(U.ALLOW_NAMES), "ththon", "zz", "q"]
    urls = [f"http://{rng.choice('wm')}.{''.join(rng.choice(words) for _ in range(rng.randrange(1, 4)))}.com/{rng.choice(words)}/{k % 7}" for k in range(150)] + ["http://h.com/" + "casinox" * 400]
    parts = {u: plain(u)[:2] for u in urls}
    runs = {u: re.findall("[a-z]+", "/".join(p).lower()) for u, p in parts.items()}
    n = Counter(r for _, r in {(parts[u][0], r) for u in urls for r in runs[u]})
    total, beforehand, bayes = sum(n.values()), U.name_shares(), U.Bayes()
    b, a = U.labelled(U.BLOCK_NAMES), U.labelled(U.ALLOW_NAMES)
    vocabulary = {w for w in {*a, *b} if len(w) >= U.SHORTEST} - set(U.COMMON.split())
    for w in vocabulary:
        odds = [math.log((x[w] + 0.1) / (sum(x[v] for v in vocabulary) + 0.1 * len(vocabulary))) for x in (b, a)]
        assert abs(bayes.odds[w] - odds[0] + odds[1]) < 1e-9
    got = urls_of(spark, urls)
    for u in urls:
        score = bayes.prior
        for r in runs[u]:
            shares = {w: 0.8 * c / total for w, c in n.items() if w in r and U.SHORTEST <= len(w) <= U.LONGEST and w != r}
            for w, p in beforehand.items():
                if w in r:
                    shares[w] = shares.get(w, 0) + p
            score += bayes.of(U.evidence(r, shares))
        assert got[u] == ("block" if score > 0 else "allow"), u
