import random
import re

from corpuscope.llm.queries_scan import URL_GLOBS, URL_RULES
from corpuscope.llm.url_filter import ShiftAnd, url_verdicts

SCHEMA = "page_id long, url string, host int, GLOB string"


def glob_regex(glob):
    host, slash, path = glob.partition("/")
    return re.compile("(?s)" + re.escape(host).replace(r"\*", "[^/]*") + (re.escape(slash + path).replace(r"\*", ".*")) + r"\Z")


def brute(page_id, url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.name), default=None)
    glob = next((g for g in URL_GLOBS if glob_regex(g).match(host + path)), None)
    return (page_id, host, path, rule and rule.name, rule.verdict if rule else "block" if glob else "allow", glob)


def test_against_regular_expressions(spark):
    rnd = random.Random(6)
    hosts = ["com", "example.com", "WWW.Example.com", "a.b.example.net", "net", "xnet", "casino.org", "my-ads-track.example.org",
             "", "user@example.com", "example.com:80", "É.com", "x.www.example.com", "adult-x.example.net"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/", "/x.com/", "/casino/", "?q=/en/", "#a/b", "/en/é?x#y", "/a://b.com/"]
    rows = [(i, rnd.choice(["http://", "https://", "://", "", "x"]) + rnd.choice(hosts) + rnd.choice(paths), 1, "x") for i in range(600)]
    rows += [(900, None, None, None), (901, "", 0, ""), (None, "http://example.com/en/", 0, ""), rows[5], (903, "http://a.net/es/" + "x" * 30_000, 0, ""),
             (904, "a\nb://c.com/\nd", 0, "")]
    got = url_verdicts(spark.createDataFrame(rows, SCHEMA).repartition(3), URL_RULES, URL_GLOBS).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(*r[:2]) for r in rows), key=str)


def test_automaton_over_many_words():
    rnd = random.Random(7)
    patterns = ["".join(rnd.choice("ab*./") for _ in range(rnd.randrange(1, 30))) for _ in range(40)]
    texts = ["".join(rnd.choice("ab./") for _ in range(rnd.randrange(0, 25))) for _ in range(500)]
    hit = ShiftAnd(patterns).match([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert [bool(x) for x in hit[i]] == [bool(glob_regex(p).match(t)) for p in patterns], t


def test_empty_table(spark):
    assert url_verdicts(spark.createDataFrame([], SCHEMA), URL_RULES, URL_GLOBS).collect() == []
