"""Relations over the test tables that stand for papers, formats, URLs and ground truth. One SQL for Spark and DuckDB.

Papers are l_suppkey, URLs l_partkey % 200, formats l_linenumber 1 to 6, ground truth the rows with l_linenumber 7; the
corpus by year is orders with their lines; documents in several markups are templates around pages.url.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "ext": "SELECT DISTINCT l_suppkey AS paper_id, l_linenumber AS format, l_partkey % 200 AS url FROM {lineitem} WHERE l_linenumber BETWEEN 1 AND 6",
    "gt_raw": """SELECT l_orderkey AS row_idx, l_suppkey AS paper_id, l_partkey % 200 AS url,
  CASE l_partkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'GenURL' WHEN 2 THEN 'TPD' WHEN 3 THEN 'TPS' WHEN 4 THEN 'APD' WHEN 5 THEN 'APS' ELSE 'Project' END AS label,
  CASE l_orderkey % 4 WHEN 0 THEN 'Abstract; Body' WHEN 1 THEN 'Footnote' WHEN 2 THEN 'References;Body' ELSE NULL END AS location,
  CASE l_partkey % 3 WHEN 0 THEN 'Split Across Lines, Wrapped' WHEN 1 THEN '"Two, Columns",Inline' ELSE NULL END AS spatial,
  CASE l_suppkey % 2 WHEN 0 THEN 'Long,Has Query' ELSE 'Short' END AS lexical,
  CASE l_orderkey % 3 WHEN 0 THEN 'Hidden in Annotation Layers' ELSE 'Plain' END AS representational FROM {lineitem} WHERE l_linenumber = 7""",
    "corpus": "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, o_orderkey AS paper_id, l_linenumber AS format, CAST(floor(l_quantity) AS BIGINT) AS num_urls FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE l_linenumber BETWEEN 1 AND 5",
    "papers": "SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, o_orderkey AS paper_id, o_orderstatus AS status FROM {orders}",
    "layout": "SELECT p_partkey AS paper_id, CAST(1992 + p_partkey % 5 AS INT) AS year, p_size AS n_pages, CAST(length(p_name) * 4 AS INT) AS n_chars, CAST(p_partkey % 2 AS INT) AS n_images, CASE WHEN p_partkey % 3 = 0 THEN 'double' ELSE 'single' END AS layout FROM {part}",
    "urls": "SELECT page_id AS paper_id, url FROM {pages}",
    "markdown": "SELECT page_id AS paper_id, concat('See [x](', url, ') and ![i](', url, '.png), <a href=\"', url, '/a\">here</a> <img src=''', url, '.gif''> or ', url, '.') AS text FROM {pages}",
    "latex": "SELECT page_id AS paper_id, concat('\\\\documentclass{{article}} % ', url, chr(10), ' \\\\url{{', url, '}} text \\\\urladdr{{', url, '/home}} \\\\emph{{x}} ', url) AS text FROM {pages}",
    "tei": "SELECT page_id AS paper_id, concat('<TEI><text><ref target=\"', replace(url, '&', '&amp;'), '\">x</ref><ref target=\"#b', page_id, '\"/><ptr target=\"', replace(url, '&', '&amp;'), '/2\"/></text></TEI>') AS text FROM {pages}",
    "vlm": "SELECT page_id AS paper_id, concat('user: list URLs', chr(10), 'Assistant: ', url, chr(10), '  ', chr(10), ' 1. ', url, '/b). ', chr(10), 'none here', chr(10), 'www.x', page_id, '.org/a, and www.y.org') AS text FROM {pages}",
    "llm": "SELECT page_id AS paper_id, CASE page_id % 4 WHEN 0 THEN concat('```json', chr(10), '[\"', url, '\", \"', url, '/2\"]', chr(10), '```') WHEN 1 THEN concat('[\"', url, '\"]') WHEN 2 THEN concat('Sorry, ', url) ELSE '[]' END AS text FROM {pages}",
    "raw": "SELECT page_id AS paper_id, concat('%PDF (', url, ') /URI(', url, '/é) <', url, '>') AS text FROM {pages}",
}
#: The rows of "ext" as they come, for aggregates that copies don't change.
SQL["ext_rows"] = SQL["ext"].replace("SELECT DISTINCT", "SELECT", 1)

TABLES = ("lineitem", "orders", "pages", "part")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = SQL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **frames)


def duck(name: str) -> str:
    """The relation as a DuckDB subquery."""
    sql = SQL[name].replace("\\\\", "\\") if name == "latex" else SQL[name]
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    sql = sql.replace("{{", "{").replace("}}", "}")
    return f"({sql})"
