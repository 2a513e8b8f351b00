"""Extractors: columns from text to sorted arrays of distinct URLs, and the long form (paper_id, format, url)."""

from __future__ import annotations

import re
import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from html.parser import HTMLParser
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from linkweir.functions import patterns as P
from linkweir.functions import scalars as S
from linkweir.functions.latex_text import readable
from linkweir.functions.url_matcher import find_urls


def _tidy(urls: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != ""))))


#: Seconds that a document's text and its LaTeX source may take.
TEXT_SECONDS, LATEX_SECONDS = 120.0, 60.0


def each_within(search: Callable[..., Iterable[str]], *columns: Column) -> Column:
    """What ``search`` finds in one document's columns, sorted and distinct, or why nothing: a struct of urls and error.

    A document whose search takes too long gives no URLs and the error "timeout", any other failure its name, and the
    documents beside it go on. A null or empty first column gives no URLs and no error."""

    @F.pandas_udf("urls array<string>, error string")
    def run(*series: pd.Series) -> pd.DataFrame:
        def one(first, *rest):
            try:
                return sorted(set(search(first, *rest))) if first else [], None
            except TimeoutError:
                return [], "timeout"
            except Exception as e:  # one document's failure is its result
                return [], type(e).__name__

        return pd.DataFrame([one(*row) for row in zip(*series)], columns=["urls", "error"])

    return run(*columns)


def comprehensive_within(text: Column, seconds: float = TEXT_SECONDS) -> Column:
    """URLs by scheme, by "www" or by a domain before a slash, as a struct of urls and error."""
    return each_within(lambda t: find_urls(t, slash=True, edge=True, seconds=seconds), text)


def text_layer_within(text: Column, seconds: float = TEXT_SECONDS) -> Column:
    """The variant for text layers: neither a domain before a slash nor a word boundary at the end."""
    return each_within(lambda t: find_urls(t, slash=False, edge=False, seconds=seconds), text)


def comprehensive(text: Column) -> Column:
    return comprehensive_within(text)["urls"]


def find_within(text: Column, pattern: str, group: int = 0, seconds: float = TEXT_SECONDS) -> Column:
    """Matches of any pattern under a time limit, as a struct of urls and error. The search runs in Python, as Java's has
    no limit; ``scalars.find_all`` is the faster form for patterns that cannot backtrack far."""
    rx = regex.compile(pattern.replace("(?iU)", "(?i)"))
    return each_within(lambda t: (m[group] for m in rx.finditer(t, timeout=seconds)), text)


def text_layer(text: Column, links: Column, raw: Column, doc_id: Column) -> Column:
    """Links of annotations, URLs of the text and of the file's bytes, cleaned, without noise and self references."""
    found = F.concat(F.filter(links, S.keeps_link_uri), text_layer_within(text)["urls"], text_layer_within(S.sanitize(raw))["urls"])
    cleaned = F.transform(found, S.clean_url)
    return _tidy(F.filter(cleaned, lambda u: ~S.is_noise(u) & ~S.is_self_reference_text(u, doc_id)))


def latex_commands(source: Column) -> Column:
    return _tidy(F.concat(S.find_all(source, P.LATEX_URL, 1), S.find_all(source, P.LATEX_URLADDR, 1)))


def latex_within(source: Column, is_bibliography: Column, sanitize: bool = False, seconds: float = LATEX_SECONDS) -> Column:
    """Command targets of the raw source and URLs of its text, as a struct of urls and error.

    Bibliographies, and sources that no reader could follow, are searched as they stand; the latter have no error."""
    commands = [re.compile(p) for p in (P.LATEX_URL, P.LATEX_URLADDR)]

    def search(content, bibliography):
        plain = content if bibliography else readable(content)[0]
        plain = re.sub(r"[^\x20-\x7E\t\n\r]", " ", plain) if sanitize else plain
        targets = (u for p in commands for u in p.findall(content))
        return [u for u in chain(targets, find_urls(plain, slash=True, edge=True, seconds=seconds)) if u]

    return each_within(search, source, is_bibliography)


def latex(source: Column, is_bibliography: Column, sanitize: bool = False) -> Column:
    return latex_within(source, is_bibliography, sanitize)["urls"]


def latex_papers(files: DataFrame, sanitize: bool = False, seconds: float = LATEX_SECONDS) -> DataFrame:
    """(paper_id, path, content) of .tex and .bbl files to the union of each paper's URLs, their number and its failed files.

    Files are read apart, so that a failed one costs the paper only its own URLs and a paper of many files is many tasks'."""
    found = files.select("paper_id", latex_within(F.coalesce("content", F.lit("")), F.col("path").endswith(".bbl"), sanitize, seconds).alias("r"))
    long = found.select("paper_id", F.col("r.error").alias("error"), F.posexplode_outer("r.urls").alias("i", "url"))
    failed = F.count_if(F.col("error").isNotNull() & (F.coalesce("i", F.lit(0)) == 0))
    out = long.groupBy("paper_id").agg(F.array_sort(F.collect_set("url")).alias("urls"), failed.alias("failed_files"))
    return out.select("paper_id", "urls", F.size("urls").alias("url_count"), "failed_files")


class _Anchors(HTMLParser):
    """Targets of <a href> inside the first element of a tag whose class has a name; all of the page without one."""

    def __init__(self, tag: str | None, name: str | None):
        super().__init__(convert_charrefs=True)
        self.tag, self.name, self.depth, self.done, self.found = tag, name, 0 if tag else 1, False, []

    def handle_starttag(self, tag, attrs):
        got = dict(attrs)
        if self.tag and not self.done and tag == self.tag:
            if self.depth:
                self.depth += 1
            elif self.name is None or self.name in (got.get("class") or "").split():
                self.depth = 1
        if self.depth and not self.done and tag == "a" and "href" in got:
            self.found.append(got["href"] or "")

    def handle_endtag(self, tag):
        if self.tag and self.depth and tag == self.tag:
            self.depth -= 1
            self.done = not self.depth


#: Characters that a parser is fed between two looks at the clock.
FED = 1 << 16


def _in_time(text: str, seconds: float) -> Iterator[str]:
    """The text in parts; TimeoutError once they have taken longer."""
    until = time.monotonic() + seconds
    for i in range(0, len(text), FED):
        if time.monotonic() > until:
            raise TimeoutError
        yield text[i : i + FED]


def html_anchors_within(html: Column, tag: str | None = "div", name: str | None = "ltx_page_content", seconds: float = TEXT_SECONDS) -> Column:
    """Targets of a page's anchors as a struct of urls and error."""

    def search(page):
        p = _Anchors(tag, name)
        try:
            for part in _in_time(page, seconds):
                p.feed(part)
        except AssertionError:  # the parser's answer to broken declarations
            return []
        return p.found

    return each_within(search, html)


def html_anchors(html: Column, tag: str | None = "div", name: str | None = "ltx_page_content") -> Column:
    return html_anchors_within(html, tag, name)["urls"]


def html_links(html: Column, doc_id: Column) -> Column:
    """Targets inside the page's content, without fragments and links to the document itself."""
    return F.filter(html_anchors(html), lambda u: ~S.is_self_reference_html(u, doc_id))


def tei_targets_within(xml: Column, seconds: float = LATEX_SECONDS) -> Column:
    """@target attributes of a document as a struct of urls and error; one that does not parse has none, and no error."""

    def search(doc):
        parser, found = ET.XMLPullParser(events=("start",)), []
        try:
            for part in _in_time(doc, seconds):
                parser.feed(part)
                found += (v for _, e in parser.read_events() for k, v in e.attrib.items() if k.rpartition("}")[2] == "target")
            parser.close()
        except ET.ParseError:
            return []
        return found

    return each_within(search, xml)


def tei_targets(xml: Column, corpus: bool = False) -> Column:
    """@target attributes that are links; none of a document that does not parse."""
    return F.filter(tei_targets_within(xml)["urls"], lambda u: S.keeps_tei_target(u, corpus))


def markdown_links(text: Column) -> Column:
    return S.find_all(text, P.MARKDOWN_LINK, 1)


def html_attributes(text: Column) -> Column:
    return S.find_all(text, P.HTML_ATTRIBUTE, 1)


def bare(text: Column) -> Column:
    return S.find_all(text, P.BARE)


def markdown(text: Column) -> Column:
    return _tidy(F.transform(F.concat(markdown_links(text), html_attributes(text), bare(text), comprehensive(text)), S.strip_trailing))


def raw_bytes(content: Column) -> Column:
    """URLs in a file's bytes: found in Latin-1, given back as UTF-8."""
    return _tidy(F.transform(S.find_all(F.decode(content, "ISO-8859-1"), P.RAW_BYTES, 1), lambda u: F.decode(F.encode(u, "ISO-8859-1"), "UTF-8")))


def _answer(text: Column) -> Column:
    out = text
    for mark in ("<|assistant|>", "assistant", "assistant:", "Assistant:"):  # the last that applies is asked first
        out = F.when(text.contains(mark), F.substring_index(text, mark, -1)).otherwise(out)
    return out


def response_lines(text: Column) -> Column:
    """Trimmed lines after the last assistant mark, blank ones dropped, without a test for URLs."""
    return F.filter(F.transform(F.split(_answer(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def response_first_matches(text: Column) -> Column:
    """The first URL of each line, after its edges are stripped and its spaces removed."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.replace(S.strip_edges(x), F.lit(" "), F.lit("")))
    return _tidy(F.transform(lines, lambda x: S.strip_right(F.regexp_extract(x, P.STRICT, 0))))


def response_all_matches(text: Column) -> Column:
    """All URLs, right-stripped, without ordinals."""
    found = F.transform(S.find_all(text, P.STRICT), lambda u: S.strip_right(F.replace(F.trim(u), F.lit(" "), F.lit(""))))
    return _tidy(F.filter(found, lambda u: ~u.rlike(r"^\d+\.")))


def _unfenced(text: Column) -> Column:
    t = F.trim(text)
    inner = F.when(t.startswith("```"), F.get(F.split(t, "```"), F.lit(1))).otherwise(t)
    return F.trim(F.regexp_replace(inner, r"^json", ""))


def response_json(text: Column) -> Column:
    """A JSON list of URLs, in a code fence or not; empty if it does not parse."""
    return F.coalesce(F.from_json(_unfenced(text), "array<string>"), F.array().cast("array<string>"))


def response_record(text: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """What is kept of a model's answer: urls, url_count, tokens, cost_usd, failed and error.

    An answer that is no JSON has failed and counts no tokens; JSON that is no list has no URLs and has not failed."""
    value = F.try_parse_json(_unfenced(text))
    error = F.when(value.isNull(), F.lit("JSON parse error"))
    urls = F.when(F.startswith(F.schema_of_variant(value), F.lit("ARRAY")), response_json(text)).otherwise(F.array().cast("array<string>"))
    tokens = [F.when(error.isNull(), F.coalesce(t, F.lit(0))).otherwise(0) for t in (input_tokens, output_tokens)]
    return F.struct(urls.alias("urls"), F.size(urls).alias("url_count"), tokens[0].alias("input_tokens"), tokens[1].alias("output_tokens"), S.token_cost(*tokens).alias("cost_usd"), error.isNotNull().alias("failed"), error.alias("error"))


def number_pages(pages: DataFrame) -> DataFrame:
    """Adds ``page``, from 1 in the order of the names of a paper's files."""
    return pages.withColumn("page", F.row_number().over(W.partitionBy("paper_id").orderBy("name")))


def page_rollup(pages: DataFrame) -> DataFrame:
    """(paper_id, page, urls) to the distinct URLs of each paper and their number."""
    long = pages.select("paper_id", F.explode_outer("urls").alias("url"))
    out = long.groupBy("paper_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return out.withColumn("url_count", F.size("urls"))


def explode_urls(docs: DataFrame, urls: Column, fmt: str) -> DataFrame:
    return docs.select("paper_id", F.lit(fmt).alias("format"), F.explode(urls).alias("url"))
