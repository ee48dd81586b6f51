"""URL filters, revisits and preferences on small tables."""

import random

import pytest
from awardry.llm import preferences, url_filter, warc_revisits

URLS = [
    None, "", "no url", "http://", "https://EXAMPLE.com/en/x?y#z", "https://www.example.com/en/", "https://a.www.example.com/en/1", "http://example.com/en",
    "http://example.com:8080/en/", "http://x.net/es/a", "http://net/fr/", "http://notnet/fr/", "http://y.com", "http://y.com?q=/", "http://y.com/#a", "u://v.org/p://example.com/en/",
]


def brute(url, rules):
    rest = (url or "").partition("://")
    host = path = ""
    if rest[1]:
        cut = min([rest[2].find(c) for c in "/?#" if c in rest[2]] + [len(rest[2])])
        host = "".join(c.lower() if c.isascii() else c for c in rest[2][:cut])
        path = rest[2][cut:].split("?")[0].split("#")[0]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (r[1].count("."), len(r[2]), r[0]), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


@pytest.mark.parametrize("bound", [100, 0])
def test_urls_by_brute_force(spark, bound):
    rules = url_filter.RULES + [("allow", "example.com", "/e"), ("block", "example.com", "/en"), ("block", "com", "/"), ("allow", "v.org", "")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[:5])], "page_id long, url string, verdict string")
    table = spark.createDataFrame([*rules, ("block", None, "/"), rules[0]], "verdict string, host string, path string")
    got = url_filter.filter_urls(pages, table, broadcast_rules=bound).collect()
    assert len(got) == len(URLS) + 5
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.url
    assert url_filter.filter_urls(pages.limit(0), table, broadcast_rules=bound).count() == 0


def test_long_paths_and_missing_urls_in_the_joined_branch(spark):
    """A path has a key for each length of a rule's path, whatever its own length; a third of the rows without url are no burden."""
    import time

    rules = [("block", "a.com", "/" + "y" * 15_000), ("allow", "a.com", "/y"), ("block", "com", ""), ("block", "", "")]
    urls = ["http://a.com/" + "y" * 1_000_000, "http://b.a.com/" + "y" * 14_999, "http://a.com/" + "z" * 200_000, "http://q.com", "http://x.org/"] + [None] * 60 + ["http://q.com/1"] * 60
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    for r in url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), broadcast_rules=0).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules), r.page_id
    assert time.time() - began < 60


def test_very_long_paths_and_hosts(spark):
    """A rule of 5,000 segments compiles to flat tables, which can be sent to executors; long paths are judged whole."""
    import pickle

    path = "/a" * 5000
    rules = [("block", "x.org", path + "/"), ("allow", "x.org", path[:-2] + "/"), ("block", ".".join(["b"] * 3000) + ".org", "")]
    urls = [f"http://x.org{path}/c", f"http://x.org{path}", "http://x.org/" + "a" * 100_000, "http://" + "b." * 3000 + "org/q"]
    pickle.loads(pickle.dumps(url_filter.Trie(rules)))
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_filter.filter_urls(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).orderBy("page_id").collect()
    assert [r.verdict for r in got] == [brute(u, rules)[3] for u in urls] == ["block", "allow", "allow", "block"]


def test_canonical(spark):
    from pyspark.sql import functions as F

    rows = [("http://WWW.A.org:80/p/?b=2&utm_source=x&a=1#f", "a.org/p?a=1&b=2"), ("https://a.org/p", "a.org/p"), ("a.org", "a.org"), (None, None)]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r[0] == r[1] for r in df.select(warc_revisits.canonical(F.col("url")), "want").collect())


@pytest.mark.parametrize("slots", [1, 7, 64])
def test_revisits_by_brute_force(spark, slots):
    rng = random.Random(9)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot.org/a", "http://hot.org/a", f"http://b.org/{rng.randrange(20)}", None])
        kind = rng.choice([200, 200, 304, 304, 404])
        headers = rng.choice([None, {}, {"ETag": f'"{rng.randrange(2)}"', "X": str(i)}, {"Last-Modified": str(rng.randrange(2)), "Date": str(i)}])
        rows.append((i, url, rng.choice([rng.randrange(100), None]) if i % 9 == 0 else rng.randrange(100), kind, headers, str(i) if kind == 200 else None))
    schema = "record_id long, url string, date long, status int, headers map<string,string>, payload_digest string"
    got = {r.record_id: r for r in warc_revisits.resolve_revisits(spark.createDataFrame(rows, schema), slots).collect()}
    assert len(got) == sum(r[3] == 304 for r in rows)
    for i, url, date, status, headers, _ in rows:
        if status != 304:
            continue
        before = [r for r in rows if r[3] == 200 and None not in (url, date, r[1], r[2]) and r[1] == url and (r[2], r[0]) < (date, i)]
        best = max(before, key=lambda r: (r[2], r[0]), default=None)
        own, old = ({k.lower(): v for k, v in ((h or {}).items())} for h in (headers, best and best[4]))
        if best is None:
            want = "orphan"
        elif "etag" in own and "etag" in old:
            want = "resolved" if own["etag"] == old["etag"] else "changed"
        elif "last-modified" in own and "last-modified" in old:
            want = "resolved" if own["last-modified"] == old["last-modified"] else "changed"
        else:
            want = "unverified"
        assert got[i].outcome == want
        if want == "resolved":
            assert got[i].source_id == best[0] and got[i].payload_digest == best[5]
            assert got[i].headers == old | {k: v for k, v in own.items() if k in warc_revisits.PERMITTED}
        else:
            assert got[i].source_id is None and got[i].headers is None
    assert warc_revisits.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("slots", [None, 5])
def test_revisits_by_profile_ties_and_clustered_dates(spark, slots):
    """A date that a third of all captures have, one far off, repeated records, equal ids, profiles, extra columns."""
    schema = "record_id long, url string, date long, status int, headers map<string,string>, payload_digest string, profile string, outcome string, slot long"
    row = lambda i, date, status, digest, profile=None, tag="t": (i, "http://hot.org/", date, status, {"ETag": tag}, digest, profile, "clash", 3)
    modified = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    rows = [row(i, 7 if i < 40 else i, 200 if i % 2 else 304, str(i) if i % 2 else None) for i in range(90)]
    rows += [row(200, 10**12, 304, None), row(201, 10**12, 200, None, modified), row(202, 10**12, 200, None, modified), row(202, 10**12, 200, None, modified)]
    rows += [row(300, 500, 200, "a"), row(300, 500, 200, "b"), row(300, 500, 304, None), row(301, 500, 304, None), row(302, 600, 200, "c", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), row(303, 700, 304, None)]
    got = warc_revisits.resolve_revisits(spark.createDataFrame(rows, schema), slots).collect()
    want = []
    for r in rows:
        if r[6] == modified or (r[3] == 304 and r[6] is None):
            before = [x for x in rows if x[3] == 200 and x[5] and x[6] is None and (x[2], x[0]) < (r[2], r[0])]
            best = max(before, key=lambda x: (x[2], x[0], x[5]), default=None)
            want.append((r[0], "resolved" if best else "orphan", best and best[0], best and best[5]))
    assert sorted((r.record_id, r.outcome, r.source_id, r.payload_digest) for r in got) == sorted(want, key=lambda w: (w[0], w[2] or 0))
    assert got[0].asDict().keys() == {"record_id", "canonical_url", "outcome", "source_id", "payload_digest", "headers"}


def test_preferences(spark):
    schema = "conv_id long, turn long, role string, text string, prompt string"
    row = lambda c, t, r, x: (c, t, r, x, "clash")
    chosen = [row(1, 0, "user", "hé"), row(1, 1, "assistant", "good"), row(2, 0, "user", "a"), row(3, 1, None, None), row(None, 0, "user", "x"), row(5, 0, "user", "u"), row(5, 0, "user", "u")]
    rejected = [row(1, 0, "user", "hé"), row(1, 1, "assistant", "bad"), row(1, 2, "user", "why"), row(4, 0, "assistant", "z"), row(3, 7, None, None), row(5, 0, "user", "u")]
    got = {r.conv_id: r for r in preferences.preference_pairs(spark.createDataFrame(chosen, schema), spark.createDataFrame(rejected, schema)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].prompt == "<|user|>\nhé<|end|>\n" and got[1].n_prompt_turns == 1
    a, b = map(int, got[1].chosen_mask.split(":"))
    assert got[1].chosen[a:b] == "good<|end|>\n" and got[1].rejected.endswith("why<|end|>\n")
    a, b = map(int, got[1].rejected_mask.split(":"))
    assert got[1].rejected[a:b] == "bad<|end|>\n"
    assert got[2].prompt == "" and got[2].rejected == "" and got[2].chosen_mask == ""
    assert got[3].n_prompt_turns == 1 and got[3].chosen == got[3].rejected == ""
    assert got[4].chosen == "" and got[4].rejected_mask == "14:23"
    assert got[5].n_prompt_turns == 1 and got[5].rejected == "" and got[5].chosen
    empty = spark.createDataFrame([], schema)
    assert preferences.preference_pairs(empty, empty).count() == 0
    assert [got[k].paired for k in (1, 2, 3, 4, 5)] == [True, False, False, False, False]


def test_other_answers_are_answers_of_others(spark):
    long = "y" * 200_000
    answers = {1: "A", 2: "B", 3: "A", 4: long, 2000: "alone"}
    rows = [(c, t, r, x, "clash") for c, a in answers.items() for t, r, x in ((0, "user", "q"), (1, "assistant", "first"), (2, "user", "q2"), (3, "assistant", a), (4, "user", "thanks"))]
    rows += [(7, 0, "user", "no answer", "clash"), (None, 1, "assistant", "x", "clash"), (8, 0, None, None, "clash"), (9, None, "assistant", "z", "clash")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, last string")
    got = {r.conv_id: r for r in preferences.preference_pairs(*preferences.with_other_answers(table)).collect()}
    assert sorted(got) == [1, 2, 3, 4, 7, 8, 9, 2000]
    said = lambda x: f"<|assistant|>\n{x}<|end|>\n"
    assert {c: got[c].rejected for c in (1, 2, 3, 4)} == {1: said("B"), 2: said(long), 3: said("B"), 4: said("A")}
    assert all(got[c].chosen == said(answers[c]) and got[c].paired and got[c].n_prompt_turns == 3 for c in (1, 2, 3, 4))
    assert got[2000].chosen == said("alone") and got[2000].rejected == "" and not got[2000].paired
    assert not any(got[c].paired for c in (7, 8, 9))
    empty_pair = preferences.with_other_answers(table.limit(0))
    assert preferences.preference_pairs(*empty_pair).count() == 0
