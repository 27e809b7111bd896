"""URL filter: rules against a plain scan, collisions, shards, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from corpuscope.llm import url_filter as uf


def plain(rules, url):
    """Longest fitting rule by looking at every rule."""
    host, path = uf.split_url(url)
    best = None
    for rh, rp, verdict in rules:
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp):
            best = max(best, (len(rh) + len(rp), len(rh), rh, rp, verdict == "block")) if best else (len(rh) + len(rp), len(rh), rh, rp, verdict == "block")
    return best


def array(tmp_path, rules):
    path = tmp_path / "rules.bin"
    path.write_bytes(uf.compile_rules(rules))
    return uf.DigestArray(str(path))


def test_parts():
    assert uf.split_url("HTTP://WWW.Ex.COM/A?b#c") == ("www.ex.com", "/A")
    assert uf.split_url("x://h?q/") == ("h", "") and uf.split_url("x://h#/a") == ("h", "") and uf.split_url("no scheme/a") == ("", "")
    assert uf.split_url(None) == ("", "") and uf.split_url("a://b://c/d") == ("b:", "//c/d") and uf.split_url("://ÄÖ.De/") == ("ÄÖ.de", "/")


def test_longest_rule_equals_a_plain_scan(tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "b", "ab", "é"])
    rules = list({(".".join(word() for _ in range(rng.randint(1, 3))), "".join("/" + word() for _ in range(rng.randint(0, 3)))): rng.choice(["allow", "block"])
                  for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = ["x://" + ".".join(word() for _ in range(rng.randint(1, 4))) + "".join("/" + word() for _ in range(rng.randint(0, 4))) for _ in range(500)]
    got = array(tmp_path, rules).longest([uf.split_url(u) for u in urls])
    assert got == [plain(rules, u) for u in urls] and any(got)


def test_stored_strings_decide_on_collisions(tmp_path, monkeypatch):
    """With digests of four bits nearly all keys collide, and nothing changes."""
    rules = [(f"h{k}.com", f"/p{k}", "block") for k in range(60)]
    urls = [f"x://h{k}.com/p{k % 7}{k}/x" for k in range(80)] + [f"x://h{k}.com/p{k}" for k in range(80)]
    want = array(tmp_path, rules).longest([uf.split_url(u) for u in urls])
    full = xxhash.xxh64_intdigest
    monkeypatch.setattr(uf.xxhash, "xxh64_intdigest", lambda s: full(s) & 15)
    assert array(tmp_path, rules).longest([uf.split_url(u) for u in urls]) == want == [plain(rules, u) for u in urls]


@pytest.mark.parametrize("shard", [1_000_000, 2])
def test_rules_from_a_table_and_odd_rows(spark, shard):
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("Ex.com", "/a", "block"), ("ex.com", "/a", "allow"), ("net", "", "block"), (None, "/", "block"), ("org", None, "block")],
        "host string, path string, verdict string")
    files = uf.publish_rules(spark, rules, shard)
    assert len(files) == (1 if shard > 2 else 2)
    urls = [("x://a.ex.com/ab", "block"), ("x://ex.com/", "allow"), ("x://q.net", "block"), (None, "allow"), ("", "allow"), ("x://org/", "allow"),
            ("x://" + "a." * 2000 + "ex.com/a" + "b" * 5000, "block")]
    pages = spark.createDataFrame([(k, u, "mine") for k, (u, _) in enumerate(urls)], "page_id int, url string, host string")
    out = pages.withColumn("j", uf.judge(pages["url"], files)).collect()
    assert [r.j.verdict for r in sorted(out)] == [v for _, v in urls] and {r.host for r in out} == {"mine"}
    assert uf.filter_urls(pages.limit(0), [("com", "/", "allow")]).count() == 0
    assert [r.judged.rule for r in uf.filter_urls(pages, []).collect()] == [None] * len(urls)


def test_no_rules(tmp_path):
    assert array(tmp_path, []).longest([("a.com", "/")]) == [None] and np.memmap(tmp_path / "rules.bin", np.uint8, "r").size >= 96
