"""The matcher against the expression that it stands for, and its time on texts on which that expression would not end."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from linkweir.functions.url_matcher import Matcher, as_pattern, find_urls
from linkweir.operators import extract as X

KINDS = [(True, True), (False, False), (False, True), (True, False)]
BITS = ["http://", "https://", "www.", "www12.", "a.org/", "x.com", "x.co/", "10.0.0.1", "8.8.8.8", "192.168.1.1", "1.2.3.145", "223.255.1.254", ":80", ":8", ":123456", "/p?q=1", " ", "(", ")", "'", '"', ".", ",", "é", "ftp://u:p@", "\n", "#t", "%20", "@", "u@", "a:b@", "_", "-", "a", "1", "¡", "¿", "漢", "ſ", "İ", "K", "\u0301", "\x1f", "\xa0", "\u3000", "file", "data://", "🙂", "/", "?", "//", "..", "a-b.c_d.ee", "x" * 70 + ".com", "ab", "9"]


@pytest.mark.parametrize("kind", KINDS)
def test_matches_are_the_expressions(kind):
    rng, rx = random.Random(7), re.compile(as_pattern(*kind), re.IGNORECASE)
    for _ in range(20_000):
        text = "".join(rng.choices(BITS, k=rng.randint(1, 14)))
        assert list(Matcher(text, *kind).spans()) == [m.span() for m in rx.finditer(text)], text


def test_known_matches():
    text = "See (https://a.org/x_(y)), www.b.com. c.de/zz?q ftp://u:p@8.8.8.8:21/f http://10.0.0.1/ and x@y.com"
    assert find_urls(text, True, True) == ["c.de/zz?q", "ftp://u:p@8.8.8.8:21/f", "https://a.org/x_(y", "www.b.com"]
    assert find_urls(text, False, False) == ["ftp://u:p@8.8.8.8:21/f", "https://a.org/x_(y)),", "www.b.com."]
    assert find_urls("", True, True) == []


HOSTILE = {
    "letters": "a" * 10_000_000,
    "user infos": "http://" + "a@" * 500_000,
    "colons": "http://" + ":@a1" * 300_000,
    "labels": "www.1." * 300_000,
    "names": "a." * 5_000_000 + "com/",
    "schemes": "http://" * 300_000,
    "signs": "http://" + "!" * 5_000_000,
    "top": "http://" + "a" * 5_000_000 + "1",
    "punctuation": "http://" + "¡" * 2_000_000 + "1",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_texts_end(name):
    started = time.monotonic()
    for kind in KINDS[:2]:
        find_urls(HOSTILE[name], *kind)
    assert time.monotonic() - started < 30


def test_time_grows_with_the_length():
    def took(n):
        text = "http://" + "a1:@" * n
        started = time.process_time()
        find_urls(text, True, True)
        return time.process_time() - started

    took(20_000)
    small, large = min(took(40_000) for _ in range(3)), took(320_000)
    assert large < 8 * small * 4


def test_a_slow_document_is_its_own_failure(spark):
    hostile = "http://" + "a@" * 2_000_000
    rows = spark.createDataFrame([(1, hostile), (2, "see http://a.org/b."), (3, None), (4, "")], "i int, t string").coalesce(1)
    got = {r["i"]: (r["u"]["urls"], r["u"]["error"]) for r in rows.select("i", X.comprehensive_within(F.col("t"), 0.05).alias("u")).collect()}
    assert got == {1: ([], "timeout"), 2: (["http://a.org/b"], None), 3: ([], None), 4: ([], None)}
    layer = {r["i"]: r["u"]["urls"] for r in rows.select("i", X.text_layer_within(F.col("t")).alias("u")).collect()}
    assert layer == {1: [], 2: ["http://a.org/b."], 3: [], 4: []}


def test_pages_and_tei_have_a_limit_for_each_document(spark):
    page, tei = '<div class="ltx_page_content"><a href="/x&amp;y">t</a>%s<a href=/z></div><a href="/no">', '<TEI xmlns="n"><ref target="http://a.org/?a&amp;b"/>%s<p n:target="#b" xmlns:n="m"/></TEI>'
    rows = spark.createDataFrame([(1, page % "", tei % ""), (2, page % ("<b>" * 200_000), tei % ("<p/>" * 200_000)), (3, "<![x", "<TEI>"), (4, None, "")], "i int, h string, t string").coalesce(1)
    got = {r["i"]: (tuple(r["a"]), tuple(r["b"])) for r in rows.select("i", X.html_anchors_within(F.col("h")).alias("a"), X.tei_targets_within(F.col("t")).alias("b")).collect()}
    both = (["/x&y", "/z"], None), (["#b", "http://a.org/?a&b"], None)
    assert got == {1: both, 2: both, 3: (([], None), ([], None)), 4: (([], None), ([], None))}
    late = {r["i"]: (r["a"]["error"], r["b"]["error"]) for r in rows.select("i", X.html_anchors_within(F.col("h"), seconds=0.0).alias("a"), X.tei_targets_within(F.col("t"), seconds=-1.0).alias("b")).collect()}
    assert late[2] == ("timeout", "timeout") and late[4] == (None, None)
