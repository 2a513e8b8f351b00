"""The LaTeX reader, and the union of a paper's files."""

import pytest
from pyspark.sql import functions as F

from linkweir.functions.latex_text import Broken, readable, to_text
from linkweir.operators import extract as X
from linkweir.sources import blobs, files


@pytest.mark.parametrize(
    "source,text",
    [
        (r"a {b {c \emph{d {e}}}} f", "a b c d e f"),
        (r"\href{http://a.org/x\%20y}{the {\bf text}}.", "the text <http://a.org/x%20y>."),
        (r"\href[pdfnewwindow]{http://a.org}{t}", "t <http://a.org>"),
        (r"\url{http://a.org/50%25#s_t&u~v} on", "<http://a.org/50%25#s_t&u~v> on"),
        (r"\url|http://a.org/{%|", "<http://a.org/{%>"),
        (r"\url{http://a.org/{b}c}", "<http://a.org/{b}c>"),
        ("a % gone \\url{x}\n  b", "a b"),
        (r"100\% \& \#1 \_ \$5 \{x\}", "100% & #1 _ $5 {x}"),
        ("\\% kept % gone", "% kept "),
        (r"Erd\H{o}s, na\"ive, \c{c}a, caf\'e, \~n, \'{\i}", "Erdős, naïve, ça, café, ñ, í"),
        (r"\cite[see][p. 3]{knuth} \label{eq:1}x", "   x"),
        ("\\newcommand{\\x}[2][d]{#1 \\url{http://no.org} #2}y", " y"),
        ("\\def\\x#1{\\url{http://no.org}}y", "y"),
        ("\\begin{verbatim}\n{ % \\x\n\\end{verbatim}z", "\n{ % \\x\nz"),
        ("\\begin{comment} http://no.org { \\end{comment}z", "z"),
        (r"\verb|http://a.org/%{| b", "http://a.org/%{ b"),
        (r"$a_{1}$ \(b\) \[c\] $$d$$", "a_1 b c d"),
        (r"a\\[2pt]b\,c~d", "a\nb c d"),
        ("\\begin{tabular}{l|l}a & b\\end{tabular}", "\na   b\n"),
        (r"x\footnote{http://a.org}", "x http://a.org"),
        ("\\unknown{kept} \\other", "kept "),
        ("", ""),
    ],
)
def test_reading(source, text):
    assert to_text(source) == text


@pytest.mark.parametrize("source", ["{ a", "a }", r"\begin{a} x", r"\begin{a} \end{b}", r"x \end{a}", "$a", r"\(a", r"\url{x", r"{\begin{a}}\end{a}", r"\begin{verbatim} x", r"\verb|x"])
def test_broken_sources_stand_for_themselves(source):
    with pytest.raises(Broken):
        to_text(source)
    assert readable(source) == (source, False)


def test_depth_and_length_need_no_recursion_and_linear_time():
    assert to_text("{" * 100_000 + "x" + "}" * 100_000) == "x"
    assert len(to_text("\\emph{a} % b\n" * 100_000)) == 200_000
    assert readable("{" * 1_000_000)[1] is False


def test_a_papers_files_are_united(spark, tmp_path):
    content = {
        "p1/main.tex": "\\begin{document}\\href{http://a.org/h}{t} % http://a.org/comment\n\\url{http://a.org/50%25}\\end{document}",
        "p1/sub/refs.bbl": "% http://a.org/kept \\urladdr{http://a.org/home}",
        "p1/broken.tex": "{ % http://a.org/raw",
        "p1/picture.png": "http://a.org/no",
        "p2/main.tex": "nothing",
        "p2/again.tex": "http://b.org/1 http://b.org/1",
    }
    blobs.write_files(spark.createDataFrame(list(content.items()), "path string, content string"), f"file://{tmp_path}/src")
    got = {r["paper_id"]: r for r in X.latex_papers(files.latex_sources(spark, f"file://{tmp_path}/src")).collect()}
    assert got["p1"]["urls"] == ["http://a.org/50%25", "http://a.org/h", "http://a.org/home", "http://a.org/kept", "http://a.org/raw"]
    assert got["p2"]["urls"] == ["http://b.org/1"] and got["p2"]["url_count"] == 1
    rows = spark.createDataFrame([("p3", "x.tex", "www.a1@" * 400_000), ("p3", "y.tex", "http://c.org/"), ("p4", "z.tex", None)], "paper_id string, path string, content string")
    late = {r["paper_id"]: (r["urls"], r["failed_files"]) for r in X.latex_papers(rows, seconds=0.0).collect()}
    assert late["p3"] == ([], 2) and late["p4"] == ([], 0)
    assert spark.range(1).select(X.latex(F.lit("\\url{http://a.org/x} é http://b.org/ü"), F.lit(False), sanitize=True).alias("u")).first()["u"] == ["http://a.org/x", "http://b.org"]
