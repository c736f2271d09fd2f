"""Rule tries and agents' automata against plain rules, one by one."""

import random
import re
import time

import pytest

from webloom.kernel.robots import RobotsFile, RuleTrie, parse_robots
from webloom.operators import robots as R


def plain_best(rules, path):
    best = None
    for i, rule in enumerate(rules):
        pattern = rule["path"]
        anchored = pattern.endswith("$")
        regex = "".join(r"[^\n\r  ]*" if c == "*" else re.escape(c) for c in (pattern[:-1] if anchored else pattern)) + (r"\Z" if anchored else "")
        if pattern and re.match(regex, path):
            rank = (len(pattern), rule["allow"], -i)
            best = max(best, (rank, i)) if best else (rank, i)
    return rules[best[1]] if best else None


@pytest.mark.parametrize("seed", range(30))
def test_random_rules(seed):
    r = random.Random(seed)
    letters = "/ab*$" if seed % 2 else "/abcde.*$?\n"
    made = lambda n: "".join(r.choice(letters) for _ in range(r.randint(0, n)))
    for _ in range(40):
        rules = [{"path": r.choice(["", "/"]) + made(7), "allow": r.random() < 0.5} for _ in range(r.randint(0, 14))]
        trie = RuleTrie(rules)
        for _ in range(30):
            path = "/" + made(12)
            assert trie.best(path) is plain_best(rules, path), (rules, path)


@pytest.mark.parametrize("wild", [False, True])
def test_cost_does_not_grow_with_the_rules(wild):
    """10,000 rules of one file at under twice the cost of 10."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    rules = [{"path": f"/{word()}/*{word()}$" if wild else f"/{word()}/{word()}", "allow": i % 7 == 0} for i in range(10_000)]
    paths = [x["path"].replace("*", "xyz/").rstrip("$") + "/more" * (i % 2) for i, x in enumerate(rules[:10] * 100)] + [f"/{word()}/{word()}" for _ in range(2000)]
    few, many = RuleTrie(rules[:10]), RuleTrie(rules)

    def seconds(trie):
        best = []
        for _ in range(5):
            began = time.perf_counter()
            for p in paths:
                trie.best(p)
            best.append(time.perf_counter() - began)
        return min(best)

    assert [few.best(p) for p in paths[:1000]] == [many.best(p) for p in paths[:1000]]
    assert seconds(many) < 2 * seconds(few)


def test_shared_beginnings_longer_than_the_stack():
    rules = [{"path": "/" + "a" * 5000 + x, "allow": x == "c"} for x in "bcd"]
    assert RuleTrie(rules).best("/" + "a" * 5000 + "cx") is rules[1]
    assert RuleTrie([{"path": "/*" * 3000, "allow": False}]).best("/" * 3000)["allow"] is False


@pytest.mark.parametrize("seed", range(20))
def test_random_agents(seed):
    r = random.Random(seed)
    made = lambda n: "".join(r.choice("ab/") for _ in range(r.randint(1, n)))
    groups = [{"agents": [r.choice([made(4), "*", ""]) for _ in range(r.randint(1, 3))], "rules": [{"path": "/", "allow": bool(i % 2)}], "crawl_delay": float(i)} for i in range(r.randint(0, 9))]
    file = RobotsFile(groups)
    for _ in range(60):
        agent = made(9).upper()
        fits = [(len(t), -i) for i, g in enumerate(groups) for t in g["agents"] if t not in ("*", "") and t in agent.lower()]
        everyone = next((i for i, g in enumerate(groups) if "*" in g["agents"]), None)
        assert file.group_of(agent) == (-max(fits)[1] if fits else everyone)


def test_file():
    file = RobotsFile(parse_robots("user-agent: bot\nuser-agent: botmaster\ndisallow: /x\nallow: /x/y\ncrawl-delay: 2\n\nuser-agent: *\ndisallow:\ndisallow: /*.gif$\n")["groups"])
    assert file.verdict("My Bot", "/x/y?z") == {"allow": True, "path": "/x/y", "crawl_delay": 2.0}
    assert file.verdict("other", "/a.gif")["allow"] is False and file.verdict("other", "/a.gif?")["allow"] is None
    assert RobotsFile(None).verdict("a", "/") == {"allow": None, "path": None, "crawl_delay": None}


def test_verdicts_of_a_large_origin(spark):
    """An origin with more URLs than a task judges is dealt to several, each with its file; nulls and unknown origins are judged too."""
    files = R.files(spark.createDataFrame([("https://a.example", 200, "user-agent: *\ndisallow: /1\n\nuser-agent: b\ndisallow: /2"), ("https://n.example", 404, None), ("https://e.example", 500, "x"), (None, 200, "disallow: /")], "origin string, status int, body string"))
    rows = [(i, f"https://a.example/{i}", ["x", "B", None][i % 3]) for i in range(300)] + [(1000, "https://n.example/1", "x"), (1001, "https://e.example/1", "x"), (1002, "https://other.example/1", "x"), (1003, "no url", "x"), (1004, None, None), (1004, None, None)]
    urls = spark.createDataFrame(rows, "page_id long, url string, agent string")
    found = {}
    for r in R.verdicts(urls, files, urls.agent, urls_of_task=50).collect():
        found.setdefault(r.page_id, []).append((r.allowed, r.matched_rule, r.status, r.error))
    assert len(found) == 305 and len(found[1004]) == 2
    for i in range(300):
        first = "2" if i % 3 == 1 else "1"
        blocked = str(i).startswith(first)
        assert found[i] == [(not blocked, f"Disallow: /{first}" if blocked else None, 200, None)]
    assert found[1000] == [(True, None, 404, None)] and found[1001] == [(None, None, 500, "HTTP 500")] and found[1002] == [(True, None, None, None)] and found[1003][0][0] is True
    shares = R._by_tries(urls.selectExpr("page_id as key", "'https://a.example' as origin", "'/' as path", "agent"), files, 50)
    assert "hashpartitioning(origin" in shares._jdf.queryExecution().executedPlan().toString()
