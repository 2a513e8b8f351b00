"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

The base measures (words, symbols, repeated lines and five-word windows) and the ratios of the table are DataFrame
expressions over one row, so there is no shuffle and no Python. A null text counts as empty, a null id stays null,
repeated rows are each judged alone, further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, words_column

#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the corpus languages (en, fr, de, es).
STOP_WORDS = (
    "the of and to in is it that a for on with as was be by this are or from an at "
    "de la le et les des en un une du que qui dans pour par sur au avec "
    "der die und das den von zu mit auf für ist ein eine dem nicht im als auch "
    "el los las del y con una por para se su es"
).split()
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """A document fails if its metric is under ``low`` or over ``high``; it is exempt below ``from_words`` words."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: Metrics are the columns of ``ratios``. All are integers scaled by 1000, so that any engine gets equal verdicts.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("word_length", "permille_word_chars", low=1500, high=25000),
    Rule("symbols", "permille_symbols", high=100),
    Rule("shouting", "permille_upper", high=400, from_words=5),
    Rule("exclamations", "permille_exclaim", high=200),
    Rule("stop_words", "permille_stop_words", low=20, from_words=50),
    Rule("repeated_lines", "permille_dup_lines", high=500, from_words=10),
    Rule("bullets", "permille_bullets", high=900, from_words=10),
    Rule("ellipses", "permille_ellipsis", high=500, from_words=10),
)


def _length_without(text: Column, chars: str) -> Column:
    return F.char_length(F.translate(text, chars, ""))


def base_measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` plus the text ``t``, its words and the base measures. Windows that a text repeats are compared as
    strings, and only in texts where the windows' hashes show a repetition."""
    t, words = F.col("t"), F.col("words")
    step = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    step = step.withColumn("words", words_column(t)).withColumn("n_words", F.size("words").cast("long"))

    def window(make):
        tail = F.slice(words, WINDOW, F.greatest(F.size(words), F.lit(1)))
        return F.when(F.size(words) >= WINDOW, F.transform(tail, lambda x, i: make(*[words[i + k] for k in range(WINDOW - 1)], x)))

    step = step.withColumn("hashes", window(F.xxhash64))
    step = step.withColumn("repeats", F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False)))
    strings = window(lambda *w: F.concat_ws(" ", *w))
    step = step.withColumn("windows", F.when(F.col("repeats"), strings)).withColumn("windows", F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("p")))))
    s = F.col("windows")
    again = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["w"] == x["w"])) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(again, lambda x: F.sequence(x["p"], x["p"] + (WINDOW - 1))))))
    step = step.withColumn("n_repeat_words", F.when(s.isNotNull(), covered).otherwise(F.lit(0)).cast("long"))
    step = step.withColumn("lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WORD_SPACE)) != ""))
    return step.select(
        *keep, "t", "words", "lines", "n_words",
        _length_without(t, WORD_SPACE).cast("long").alias("word_chars"),
        (F.char_length(t) - _length_without(t, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
    )


def ratios(measures: DataFrame) -> DataFrame:
    """Adds the metrics that the rule table speaks of; divisions by nothing count as 0."""
    t, n = F.col("t"), F.col("n_words")

    def permille(x: Column, of: Column) -> Column:
        return F.when(of > 0, F.expr("1000L") * x / of).otherwise(F.lit(0)).cast("long")

    lines = F.size("lines")
    count = lambda cond: F.size(F.filter("lines", cond))
    return measures.withColumns({
        "permille_word_chars": permille(F.col("word_chars"), n),
        "permille_symbols": permille(F.col("n_symbols"), n),
        "permille_upper": permille(F.char_length(t) - _length_without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.col("word_chars")),
        "permille_exclaim": permille(F.char_length(t) - _length_without(t, "!"), n),
        "permille_stop_words": permille(F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))), n),
        "permille_dup_lines": permille(F.col("n_dup_lines"), lines),
        "permille_bullets": permille(count(lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("•")), lines),
        "permille_ellipsis": permille(count(lambda x: x.endswith("...") | x.endswith("…")), lines),
    })


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table as one boolean expression: true if no rule fails."""
    ok = F.lit(True)
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (F.col(r.metric) < r.low)
        if r.high is not None:
            bad = bad | (F.col(r.metric) > r.high)
        ok = ok & ~(bad & (F.col("n_words") >= r.from_words))
    return ok


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def score_rules(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep``, the base measures, ``base_failed``, ``kept`` and the ratios of every document."""
    scored = ratios(base_measures(docs, text, keep))
    # Always true, but not deterministic: without it the optimizer would move a later filter on ``kept`` below the
    # projections and evaluate the whole tree of expressions once for each mention.
    whole = F.monotonically_increasing_id() >= 0
    return scored.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & verdict(rules) & whole).alias("kept"),
        *[c for c in scored.columns if c.startswith("permille_")],
    )


def sql(table: str = "documents") -> str:
    """The same rules as DuckDB SQL."""
    conds = []
    for r in RULES:
        parts = [f"{r.metric} < {r.low}"] * (r.low is not None) + [f"{r.metric} > {r.high}"] * (r.high is not None)
        conds.append(f"NOT (({' OR '.join(parts)}) AND n_words >= {r.from_words})")
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    gone = lambda chars: f"length(translate(t, {chars}, ''))"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    per = lambda x, of: f"CASE WHEN {of} > 0 THEN (1000 * ({x})) // ({of}) ELSE 0 END"
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM {table}),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(t, chr(10)), lambda x: trim(x, {ws}) <> '') AS lines FROM a),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(words[i:i+{WINDOW - 1}], ' ')) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, t, words, lines, len(words)::BIGINT AS n_words, {gone(ws)}::BIGINT AS word_chars,
  (length(t) - {gone(f"'{SYMBOLS}'")})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
f AS (SELECT *, {per('word_chars', 'n_words')} AS permille_word_chars, {per('n_symbols', 'n_words')} AS permille_symbols,
  {per("length(t) - " + gone("'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"), 'word_chars')} AS permille_upper,
  {per("length(t) - " + gone("'!'"), 'n_words')} AS permille_exclaim,
  {per(f"len(list_filter(words, lambda x: lower(x) IN ({stops})))", 'n_words')} AS permille_stop_words,
  {per('n_dup_lines', 'len(lines)')} AS permille_dup_lines,
  {per("len(list_filter(lines, lambda x: starts_with(x, '- ') OR starts_with(x, '* ') OR starts_with(x, '•')))", 'len(lines)')} AS permille_bullets,
  {per("len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…')))", 'len(lines)')} AS permille_ellipsis FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {' AND '.join(conds)} AS kept,
  permille_word_chars, permille_symbols, permille_upper, permille_exclaim, permille_stop_words, permille_dup_lines, permille_bullets, permille_ellipsis
FROM f"""
