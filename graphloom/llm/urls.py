"""URL filter: rules on hosts and paths, then naive Bayes over segmented words.

A rule names a host and a path prefix; it fits that host and all its subdomains
if the url's path starts with the rule's, and the longest fitting rule decides.
Other urls are judged by their words: every run of letters in host and path is
split into words by a unigram Viterbi search (``cheappills`` is cheap + pills),
and a multinomial naive Bayes scores the words.

Unigrams are shares, so they mean the same at every size: a run of letters has
the share of all (host, run) pairs that are its own, and the words of the
training names below have a fixed part of the whole. Every run of the table is in the
dictionary, however many there are: the pieces of each distinct run are joined
with the counts, so no task holds the dictionary. A run that occurs whole is
still split where the search finds its parts (the whole is no candidate for
itself), so how often a name is used does not change its verdict. Words are not
to be found inside others by accident (``essex``, ``roads``): known pieces have at
least ``SHORTEST`` letters, and beside letters that are no known word only
those of ``ALONE`` or more count.

Naive Bayes is trained on the labelled names; words it has not seen, short words,
and words that both kinds of sites use, say nothing.

Defined results: a null url or one without ``://`` has an empty host and path and
no rule, and is allowed; repeated rows each get a row; an empty table gives none;
columns named host, path, rule or verdict are replaced, all others kept.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_BYTES, cut, release, small_batches, tidy

# The rules (verdict, host, path) of the filter.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

# Labelled names that train the model; two kinds, by topic.
BLOCK_NAMES = {
    "gambling": "casino casinos online casino best casino win casino slots poker poker bonus betting sports bets bets free bets odds jackpot roulette bingo lottery gambling",
    "pharmacy": "pills cheap pills diet pills online pills pharmacy discount pharmacy viagra cialis drugs without prescription",
    "adult": "adult adult videos adult cams porn sex cams escort nude hookup",
    "adverts": "ads ads server track ads click track tracker pixel banner ads popup ads adserver affiliate clicks",
    "spam": "spam spam links link farm farm links seo backlinks free followers traffic exchange",
    "fraud": "crack keygen warez torrent phishing malware replica watches payday loans fast cash money win free money prize",
}
ALLOW_NAMES = {
    "news": "news daily news press times herald weather report magazine journal",
    "learning": "university school library research science history museum education course lecture wiki encyclopedia",
    "public": "city council government health hospital police service community charity church",
    "leisure": "travel guide music review book review film festival garden kitchen recipes sports club photo gallery hiking farm holidays",
    "trade": "shop store market bakery furniture garden tools hotel restaurant bank insurance real estate",
    "technology": "docs developer manual open source software project code forum support download",
    "pages": "about contact article archive category page blog post search tag author help terms privacy",
}
# Words of urls of either kind.
COMMON = "http https www example com org net index html htm php page ref utm source feed top home"
#: Letters that a known word inside a run must have, at least.
SHORTEST = 3
#: Letters of a known word that counts beside unknown letters.
ALONE = 5
#: Letters of the longest word looked for: as many as a host's label may have.
LONGEST = 63
#: Part of all unigrams that the labelled names make up.
NAMES_PART = 0.2
#: Cost of an unknown piece: a constant and one a letter.
UNKNOWN, LETTER = 9.0, math.log(6)
SMOOTHING = 0.1
BLOCK_PRIOR = 0.2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled(names: dict[str, str]) -> Counter[str]:
    return Counter(w for topic in names.values() for w in topic.split())


def name_shares() -> dict[str, float]:
    """Shares of the words that the model knows beforehand."""
    counts = labelled(BLOCK_NAMES) + labelled(ALLOW_NAMES) + Counter(COMMON.split())
    total = sum(counts.values())
    return {w: NAMES_PART * n / total for w, n in counts.items()}


class Segmenter:
    """Splits runs of letters into the likeliest words of ``counts``, whose shares are of ``total``."""

    def __init__(self, counts: dict[str, float], total: float | None = None):
        total = sum(counts.values()) if total is None else total
        self.cost = {w: -math.log(c / total) for w, c in counts.items()}
        self.sizes = sorted({len(w) for w in counts})

    def _cost(self, word: str) -> float:
        """Minus log probability; an unknown stretch costs a constant and as much again for every letter."""
        return self.cost[word] if word in self.cost else UNKNOWN + LETTER * len(word)

    def __call__(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        start = 0  # where an unknown stretch up to here had best begin
        for end in range(1, len(run) + 1):
            cost, begin = best[start] + UNKNOWN + LETTER * (end - start), start
            for n in self.sizes:
                if n > end:
                    break
                known = self.cost.get(run[end - n : end])
                if known is not None and best[end - n] + known < cost:
                    cost, begin = best[end - n] + known, end - n
            best.append(cost)
            back.append(begin)
            if cost - LETTER * end < best[start] - LETTER * start:
                start = end
        words, at = [], len(run)
        while at:
            words.append(run[back[at] : at])
            at = back[at]
        return words[::-1]


def evidence(run: str, shares: dict[str, float]) -> list[str]:
    """The words of ``run`` that may be scored. ``shares`` has its pieces; short ones count only where the run is made of known words throughout."""
    known = {w: p for w, p in shares.items() if SHORTEST <= len(w) and w != run}
    words = Segmenter(known, 1.0)(run)
    if words == [run]:
        return words
    whole = all(w in known for w in words)
    return [w for w in words if w in known and (whole or len(w) >= ALONE)]


class Bayes:
    """Multinomial naive Bayes: the log odds of blocking."""

    def __init__(self, block: Counter[str] | None = None, allow: Counter[str] | None = None, prior: float = BLOCK_PRIOR):
        b, a = block or labelled(BLOCK_NAMES), allow or labelled(ALLOW_NAMES)
        words = {w for w in {*a, *b} if len(w) >= SHORTEST}.difference(COMMON.split())
        n_b, n_a = (sum(x[w] for w in words) + SMOOTHING * len(words) for x in (b, a))
        self.prior = math.log(prior / (1 - prior))
        self.odds = {w: math.log((b[w] + SMOOTHING) / n_b) - math.log((a[w] + SMOOTHING) / n_a) for w in words}

    def of(self, words: list[str]) -> float:
        return sum(self.odds.get(w, 0.0) for w in words)


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; null where none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def runs_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z]+"), 0)


def run_odds(urls: DataFrame) -> DataFrame:
    """(run, odds): what each distinct run of letters in ``urls(host, path)`` adds to the log odds; runs that add nothing are left out."""
    small_batches(urls.sparkSession)
    runs = urls.select("host", F.explode(F.array_distinct(runs_of(F.concat_ws("/", "host", "path")))).alias("run")).distinct()
    counts = cut(runs.groupBy("run").agg(F.count("*").alias("n")).withColumn("key", F.unhex(F.md5("run"))), "runs")
    total = counts.agg(F.sum("n")).first()[0] or 1

    def spell(batches):  # pieces go out as they are found, so a very long run takes no more memory than a short one
        for b in batches:
            for run, key in zip(b.column("run").to_pylist(), b.column("key").to_pylist()):
                for lo in range(0, len(run), 1000):
                    pieces = {run[i : i + n] for i in range(lo, min(lo + 1000, len(run))) for n in range(SHORTEST, min(LONGEST, len(run) - i) + 1)}
                    pieces.discard(run)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(pieces), pa.binary()), pa.array(list(pieces), pa.string())], ["key", "piece"])

    pieces = counts.select("run", "key").mapInArrow(tidy(spell), "key binary, piece string")
    found = pieces.join(counts.select(F.col("run").alias("piece"), "n"), "piece").groupBy("key").agg(F.collect_set(F.struct("piece", "n")).alias("pieces"))
    every = counts.select("run", "key").join(found, "key", "left")
    beforehand = name_shares()

    def judge_runs(batches):
        bayes = Bayes()
        for b in batches:
            out = []
            for run, pieces in zip(b.column("run").to_pylist(), b.column("pieces").to_pylist()):
                shares = {x["piece"]: (1 - NAMES_PART) * x["n"] / total for x in pieces or ()}
                for w, p in beforehand.items():
                    if w in run:
                        shares[w] = shares.get(w, 0.0) + p
                out.append(bayes.of(evidence(run, shares)))
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(out, pa.float64())], ["run", "odds"])

    odds = every.select("run", "pieces").mapInArrow(tidy(judge_runs), "run string, odds double").filter("odds <> 0")
    return cut(odds, "odds")


def blocked_addresses(urls: DataFrame) -> tuple[DataFrame, int]:
    """(host, path) that the words speak against, and their size in bytes."""
    distinct = urls.select("host", "path").distinct()
    odds = run_odds(distinct)
    size = odds.agg(F.sum(F.length("run") + 16)).first()[0] or 0
    scored = distinct.select("host", "path", F.explode(runs_of(F.concat_ws("/", "host", "path"))).alias("run")).join(_sized(odds, size), "run")
    sums = scored.groupBy("host", "path").agg(F.round(F.sum("odds"), 9).alias("odds"))
    blocked = cut(sums.filter(F.col("odds") + Bayes().prior > 0).select("host", "path"), "blocked")
    release(odds)
    return blocked, blocked.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0


def _sized(side: DataFrame, size: int) -> DataFrame:
    return F.broadcast(side) if size <= BROADCAST_BYTES else side.hint("merge")


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict in place of any columns so named."""
    rules = RULES if rules is None else rules
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    own = [F.col(f"`{c}`") for c in names]
    flag = "__blocked"
    while flag in names:
        flag += "_"
    parted = pages.select(*own, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    blocked, size = blocked_addresses(parted)
    marked = parted.join(_sized(blocked.withColumn(flag, F.lit(True)), size), ["host", "path"], "left")
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col(flag), F.lit("block")).otherwise(F.lit("allow"))
    return marked.select(*own, "host", "path", ruled["rule"].alias("rule"), F.coalesce(ruled["verdict"], method).alias("verdict"))
