import json
import random
import re

import numpy as np
from pyspark.sql import functions as F

from linkweir.functions import patterns as P
from linkweir.functions import scalars as S
from linkweir.operators import evaluation as E
from linkweir.operators import extract as X
from linkweir.operators import resample as R
from linkweir.operators import stats as T
from linkweir.sources import files


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


def python_pattern(java):
    return re.compile(java.replace("(?iU)", "(?i)").replace("\\z", "\\Z"))


def test_java_patterns_match_as_pythons_do(spark):
    random.seed(5)
    bits = ["http://", "https://", "www.", "a.org/", "x.com", "10.0.0.1", "8.8.8.8", ":80", "/p?q=1", " ", "(", ")", "[", "]", "'", '"', ".", ",", "é", "ftp://u:p@", "\n", "#t", "%20"]
    texts = ["".join(random.choices(bits, k=random.randint(1, 9))) for _ in range(800)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for p in (P.BARE, P.STRICT):
        got = {r["i"]: r["u"] for r in rows.select("i", S.find_all(F.col("t"), p).alias("u")).collect()}
        rx = python_pattern(p)
        for i, t in enumerate(texts):
            assert got[i] == sorted({m[0] for m in rx.finditer(t)}), (p, t)


def test_scalars(spark):
    u = F.col("u")
    assert one(spark, S.clean_url(u), u="http://a.b/c).\"><x>") == "http://a.b/c"
    assert one(spark, S.strip_trailing(u), u="http://a.b/c!?]") == "http://a.b/c"
    assert one(spark, S.netloc(u), u="http://me:pw@A.org:80/x?y") == "me:pw@A.org:80"
    assert one(spark, S.netloc(u), u="www.a.org/x") == ""
    assert one(spark, S.scheme(u), u="MAILTO:a@b") == "mailto"
    assert one(spark, S.id_from_stem(u), u="hep-ph9311368") == "hep-ph/9311368"
    assert one(spark, S.from_safe_name(u), u="hep-ph_93_1") == "hep-ph/93_1"
    assert [one(spark, f(u), u="hep-ph/9311368") for f in (S.year_or_unknown, S.year_of_html_id)] == ["1993", "1993"]
    assert one(spark, S.year_of_tei_id(u), u="5001.00001") == 2050
    assert one(spark, S.year_of_html_id(u), u="x") == "unknown_year"
    assert one(spark, S.split_quoted(u), u='"a, b",c') == ["a, b", "c"]
    assert one(spark, S.split_plain(u), u='"a, b",c') == ['"a', 'b"', "c"]
    assert one(spark, S.token_cost(F.col("a"), F.col("b")), a=1000, b=200) == 0.002
    assert one(spark, S.missing_styles(u), u="! LaTeX Error: File `foo.sty' not found.") == ["foo.sty"]
    assert one(spark, S.is_self_reference_text(u, F.col("i")), u="http://arxiv.org/pdf/2103.1v2", i="2103.1v1")
    assert one(spark, S.elapsed(F.col("s")), s=90061) == "1d 1h 1m"
    assert one(spark, S.stars(F.col("s")), s=0.004) == "**"


def test_responses(spark):
    t = F.col("t")
    assert one(spark, X.response_lines(t), t="x assistant\n http://a \n\nfoo") == ["http://a", "foo"]
    assert one(spark, X.response_lines(t), t="assistant: y Assistant: z") == ["z"]
    assert one(spark, X.response_first_matches(t), t="1) http://a.b /c).\nno") == ["http://a.b/c"]
    assert one(spark, X.response_json(t), t='```json\n["http://a"]\n```') == ["http://a"]
    assert one(spark, X.response_json(t), t="oops") == []


def test_html_tei_latex(spark):
    page = '<a href="/out">x</a><div class="ltx_page_content z"><div><a href="http://a?x=1&amp;y=2">.</a></div><a href="#f">.</a></div><div class="ltx_page_content"><a href="late">.</a></div>'
    assert one(spark, X.html_anchors(F.col("t")), t=page) == ["#f", "http://a?x=1&y=2"]
    assert one(spark, X.html_anchors(F.col("t")), t="<p>none") == []
    assert one(spark, X.tei_targets(F.col("t")), t='<T><a target="http://x"/><b target="#y"/><c target="http://einstein.org"/></T>') == ["http://x"]
    assert one(spark, X.tei_targets(F.col("t")), t="<T><broken") == []
    got = one(spark, X.latex(F.col("t"), F.lit(False)), t="% http://c.org/no\n\\url{http://a.org/x} see http://b.org/y.")
    assert got == ["http://a.org/x", "http://b.org/y"]


def test_null_label_counts(spark):
    gt = spark.createDataFrame([(1, 1, None), (1, 2, "GenURL"), (1, 3, "TPD")], "paper_id int, url int, label string")
    assert sorted(r["url"] for r in E.labelled(gt).collect()) == [1, 3]


def test_coverage_is_monotone_and_point_inside_interval(spark, sf):
    from linkweir.plans import catalog

    c, v = catalog._combo_vectors(spark, sf)
    got = {r["combo"]: r for r in E.prf(v, c).collect()}
    for a in got:
        for b in got:
            if a & b == a:
                assert got[a]["tp"] <= got[b]["tp"] and got[a]["ext"] <= got[b]["ext"]
    ci = {r["combo"]: r for r in R.intervals(R.bootstrap_by_blocks(v, 500)).collect()}
    assert all(ci[k]["r_low"] - 1e-9 <= got[k]["recall"] <= ci[k]["r_high"] + 1e-9 for k in got)


def test_bootstrap_by_join_draws_with_replacement(spark, sf):
    from pyspark.sql import functions as F

    from linkweir.plans import catalog

    m = R.hashed_draws(spark, 40, 1000, 1000).groupBy("rep", "place").count().toPandas()
    assert (m.groupby("rep")["count"].sum() == 1000).all() and (m.groupby("rep")["count"].max() > 2).all()
    assert abs(len(m) / 40_000 - 0.632) < 0.01
    c, v = catalog._combo_vectors(spark, sf)
    ci = R.intervals(R.bootstrap_by_join(v, 40)).where(F.col("r_low") < F.col("r_high"))
    assert ci.count() == R.intervals(R.bootstrap_by_blocks(v, 500)).where(F.col("r_low") < F.col("r_high")).count() > 0


def test_bootstrap_by_blocks_draws_as_many_papers_as_there_are(spark):
    v = spark.range(100).crossJoin(spark.createDataFrame([(1,), (2,)], "combo int")).select(F.concat(F.lit("p"), "id").alias("paper_id"), "combo", F.lit(1).alias("gt"), (F.col("id") % 2).alias("tp"), F.col("id").alias("ext"))
    got = R.bootstrap_by_blocks(v, 300, papers=9).toPandas()
    assert len(got) == 600 and (got["gt"] == 100).all()
    assert abs(got["tp"].mean() - 50) < 1 and 4 < got["tp"].std() < 6 and abs(got["ext"].mean() - 4950) < 60
    assert got.groupby("rep")["tp"].nunique().max() == 1  # combinations of a replicate share its draws
    more = spark.range(200).select(F.concat(F.lit("p"), "id").alias("paper_id"))
    wide = R.bootstrap_by_blocks(v, 300, papers=9, population=more).toPandas()
    assert abs(wide["gt"].mean() - 100) < 2 and 6 < wide["gt"].std() < 8.5
    assert R.bootstrap_by_blocks(v.limit(0), 5).count() == 0


def test_incremental_extraction_remembers_papers_of_any_id_and_without_urls(spark, tmp_path):
    from linkweir.streaming import incremental as I

    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: I.extract_incrementally(spark, source, "paper_id string, text string", X.markdown_links(F.col("text")), target, state, files_per_batch=1)
    put = lambda rows: spark.createDataFrame(rows, "paper_id string, text string").coalesce(1).write.mode("append").parquet(source)
    put([("a", "[x](http://a)"), ("b", "none"), ("b", "none"), ("c", None), (None, "[x](http://n)")])
    assert sorted((r["paper_id"] or "", r["urls"]) for r in run().collect()) == [("", ["http://n"]), ("a", ["http://a"]), ("b", []), ("c", [])]
    put([("a", "[x](http://late)"), (None, "[x](http://late)")])
    put([("d", "[x](http://d)")])
    got = run()
    assert sorted((r["paper_id"] or "", r["urls"]) for r in got.collect()) == [("", ["http://n"]), ("a", ["http://a"]), ("b", []), ("c", []), ("d", ["http://d"])]
    todo = spark.createDataFrame([("b",), ("e",)], "paper_id string")
    assert [r["paper_id"] for r in I.not_done(todo, got).collect()] == ["e"]


def test_a_document_that_takes_too_long_leaves_the_others_alone(spark):
    rows = spark.createDataFrame([(1, "a" * 40 + "!"), (2, "aab"), (3, None), (4, "")], "i int, t string").coalesce(1)
    slow = {r["i"]: (r["u"]["urls"], r["u"]["error"]) for r in rows.select("i", X.find_within(F.col("t"), r"(?:(?:a|aa)+)+b", 0, 0.5).alias("u")).collect()}
    assert slow == {1: ([], "timeout"), 2: (["aab"], None), 3: ([], None), 4: ([], None)}
    texts = spark.createDataFrame([("see http://a.org/x, www.b.com/y) and [t](https://c.de/z)",)], "t string")
    for p, g in ((P.BARE, 0), (P.STRICT, 0), (P.MARKDOWN_LINK, 1)):
        r = texts.select(X.find_within(F.col("t"), p, g)["urls"].alias("a"), S.find_all(F.col("t"), p, g).alias("b")).first()
        assert r["a"] == r["b"] != []


def test_yearly_bootstrap_draws_with_replacement(spark):
    from linkweir.operators import longitudinal as L

    pool = spark.range(1000).selectExpr("1993 AS year", "id AS paper_id", "1 AS format", "id AS num_urls")
    got = [r["urls"] for r in L.yearly_bootstrap(pool, 100, 1000).collect()]
    assert len(got) == 100 and len(set(got)) > 90
    assert abs(np.mean(got) - 499_500) < 4 * 9_129 / 10 and 6_500 < np.std(got) < 12_000


def test_wilcoxon_without_differences_is_null(spark):
    s = spark.createDataFrame([(p, c, 0.5 + (0.1 * p if c == 4 else 0)) for p in range(1, 6) for c in (1, 2, 4)], "paper_id int, combo int, recall double")
    got = {r["combo"]: r for r in T.wilcoxon(s, 1).collect()}
    assert got[2]["z"] is None and got[2]["effect"] == 0 and got[4]["effect"] == 1
    holm = {r["combo"]: r for r in T.holm(T.wilcoxon(s, 1).withColumn("p", T.normal_two_sided(F.col("z")))).collect()}
    assert holm[2]["holm_p"] is None and not holm[2]["significant"]
    z = (0 - 5 * 6 / 4) / np.sqrt(5 * 6 * 11 / 24)
    assert abs(got[4]["z"] - z) < 1e-5


def test_column_layout(spark):
    kind = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
    data = [[(50.0, 0.0, 200.0, 90.0), (300.0, 0.0, 450.0, 90.0)], [(50.0, 0.0, 200.0, 90.0), (60.0, 0.0, 200.0, 90.0)], [(50.0, 0.0, 52.0, 90.0), (300.0, 0.0, 450.0, 90.0)], []]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, b {kind}")
    got = [r["l"] for r in rows.orderBy("i").select(R.column_layout(F.col("b")).alias("l")).collect()]
    assert got == ["double", "single", "single", "single"]


def test_file_sources(spark, tmp_path):
    root = tmp_path / "src"
    for name, text in {"p1/a.tex": "\\documentclass{x} long enough", "p1/b.tex": "short", "p1/r.bbl": "ref", "p2/m.tex": "no start here", "p2/n.tex": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    src = files.latex_sources(spark, f"file://{root}")
    assert src.count() == 5
    assert {r["paper_id"]: r["path"].rsplit("/", 1)[-1] for r in files.main_file(src).collect()} == {"p1": "a.tex", "p2": "m.tex"}
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a_meta.json").write_text(json.dumps({"arxiv_id": "1", "status": "ok", "timestamp": "2024-01-02 03:04:05"}))
    (tmp_path / "s/b_meta.json").write_text("{broken")
    got = {r["paper_id"]: r["status"] for r in files.read_status_files(spark, f"file://{tmp_path}/s").collect()}
    assert got == {"1": "ok", "b_meta.json": "corrupted_json"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l/1993_task_1.log").write_text("a\nb\n\n")
    (tmp_path / "l/1993_task_2.log").write_text("b\nrunning on A100\n")
    assert files.read_tracker_logs(spark, f"file://{tmp_path}/l").count() == 3
    assert files.hardware_tally(spark, f"file://{tmp_path}/l").first()["kind"] == "A100"
    m = spark.createDataFrame([(1993, "hep/1", "x|y")], "year int, paper_id string, path string")
    files.write_manifest(m, f"file://{tmp_path}/man")
    assert files.read_manifest(spark, f"file://{tmp_path}/man").collect() == m.collect()
    (tmp_path / "g.csv").write_text('arxiv_id,URL\n2103.10,"a\nb"\n1,NA\n')
    got = {r["arxiv_id"]: r["URL"] for r in files.read_csv(spark, f"file://{tmp_path}/g.csv", "arxiv_id string, URL string").collect()}
    assert got == {"2103.10": "a\nb", "1": None}
    assert {r["paper_id"] for r in files.list_files(spark, f"file://{root}", "bbl").collect()} == {"r"}
    t = files.with_content(spark.createDataFrame([("r",), ("zz",)], "paper_id string"), files.whole_texts(spark, f"file://{root}", "bbl"))
    assert {r["paper_id"]: r["content"] for r in t.collect()} == {"r": "ref", "zz": ""}
