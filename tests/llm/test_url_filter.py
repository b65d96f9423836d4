import fnmatch
import random

from spark_trials.llm.queries import URL_RULES
from spark_trials.llm.url_filter import ShiftAnd, canonical, filter_urls

HARD = [
    (1, "https://www.Example.ORG/es/a?x#y"), (2, "http://example.org/es"), (3, "x://example.org/en/1"), (4, "https://notexample.org/en/12"), (5, "no scheme/en"),
    (6, None), (7, ""), (8, "a://b://example.com/fr/"), (9, "https://evil.net/a.org/"), (10, "https://example.org"), (11, "https://a.com/de/?q"),
    (12, "https://com/fr/x"), (13, "https://ünï.org/é"), (14, "https://example.org/es/" + "z" * 9000), (1, "https://www.Example.ORG/es/a?x#y"), (None, "https://a.org/"),
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, says in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, says)
    return host, path, best and best[0], best[1] if best else "allow"


def test_against_plain_rules(spark):
    df = spark.createDataFrame(HARD, "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    got = sorted((tuple(r) for r in filter_urls(df, URL_RULES).collect()), key=str)
    assert got == sorted(((i, *plain(u)) for i, u in HARD), key=str)


def test_empty_table(spark):
    out = filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES)
    assert out.count() == 0 and out.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert filter_urls(spark.createDataFrame(HARD, "page_id long, url string"), []).where("verdict = 'allow'").count() == len(HARD)


def test_many_wildcards_over_several_words():
    rng = random.Random(3)
    rules = [("".join(rng.choice("ab*.") for _ in range(rng.randint(1, 6))), "/" + "".join(rng.choice("ab*") for _ in range(rng.randint(0, 5))), rng.choice(["allow", "block"])) for _ in range(60)]
    machine = ShiftAnd(rules)
    assert machine.words > 4
    urls = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 7))), "/" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 7)))) for _ in range(300)]
    got = machine.best([canonical(*u) for u in urls])
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r[0] + r[1]))
    for (host, path), at in zip(urls, got.tolist(), strict=True):
        fits = [k for k, (h, p, _) in enumerate(ranked) if fnmatch.fnmatchcase("." + host, "*." + h) and fnmatch.fnmatchcase(path, p + "*")]
        assert at == (fits[0] if fits else -1)


def test_long_urls_stop_where_no_rule_can_move():
    rng = random.Random(5)
    rules = [("".join(rng.choice("ab*.") for _ in range(rng.randint(1, 4))), "/" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 5))), "block") for _ in range(40)]
    machine = ShiftAnd(rules)
    urls = [("".join(rng.choice("ab.") for _ in range(rng.randint(0, 5))), "/" + "".join(rng.choice("abé") for _ in range(rng.randint(0, 9)))) for _ in range(200)]
    urls += [(h, p + "a" * 2_000_000) for h, p in urls[:3]]
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    for (host, path), at in zip(urls, machine.best([canonical(*u) for u in urls]).tolist(), strict=True):
        fits = [k for k, (h, p, _) in enumerate(ranked) if fnmatch.fnmatchcase("." + host, "*." + h) and path.startswith(p)]
        assert at == (fits[0] if fits else -1)
