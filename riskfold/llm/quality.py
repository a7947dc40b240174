"""Quality rules: a threshold table compiled into one projection.

Every statistic is a built-in expression over the whole text, the verdict is
the conjunction of the rows of ``RULES``; no user function runs.

Null text counts as no words.  Rows are judged one by one: repeated rows, null
ids and ties get the same verdict each time, an empty table gives an empty
result.  Statistics columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.common import BLANKS, documents, unused, words

#: Frequent function words of the corpus languages, compared in lower case as written
#: (a text all in capitals has none).
STOP_WORDS = (
    "a al an and are as at au auf avec be by con das dans de del dem den der des die du ein el elle en es est et "
    "for from für il im in is it la las le les los mit nicht no of on or ou para pas por pour que qui se sich su "
    "sur than that the this to un una une und von was with y zu"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high`` must hold; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None

    def holds(self) -> Column:
        v, ok = F.expr(self.measure), F.lit(True)
        if self.low is not None:
            ok = ok & (v >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (v <= F.lit(self.high))
        return F.coalesce(ok, F.lit(False))


#: The threshold table.  Measures are SQL over the statistics columns.
RULES: tuple[Rule, ...] = (
    Rule("mean_word_length", "word_chars / greatest(n_words, 1)", 2.0, 15.0),
    Rule("symbol_ratio", "n_symbols / greatest(n_words, 1)", None, 0.1),
    Rule("duplicate_line_ratio", "n_dup_lines / greatest(n_lines, 1)", None, 0.3),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_word_ratio", "n_stop_words / greatest(n_words, 1)", 0.02, None),
)

#: Base verdict: too short, or more than half of the words repeat.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _stages(docs: DataFrame, text: str) -> DataFrame:
    """Statistics in a chain of projections.  An array that a later projection
    uses twice stays a column of its own, so it is computed once a row; the
    names of these columns are chosen so that none of the input's can clash."""
    u = unused(docs.columns)
    w, lines, h, s, p = (f"{u}{x}" for x in ("words", "lines", "hashes", "sorted", "places"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    out = docs.withColumn(w, words(t)).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0))
    n = F.size(w)
    # a 3-word window is known by its hash and place; sorted, equal windows are neighbours
    hashed = F.transform(F.arrays_zip(F.col(w).alias("a"), F.expr(f"slice({w}, 2, greatest(size({w}) - 2, 0))").alias("b"),
                                      F.expr(f"slice({w}, 3, greatest(size({w}) - 2, 0))").alias("c")),
                         lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i")))
    out = out.withColumn(h, F.when(n >= 3, F.slice(hashed, 1, n - 2)))
    # most texts repeat few windows: sort only where some hash occurs twice
    out = out.withColumn(s, F.when(F.size(F.array_distinct(F.col(f"{h}.h"))) < F.size(h), F.sort_array(h)))
    out = out.withColumn(p, F.filter(
        F.zip_with(F.zip_with(s, F.expr(f"concat(array(cast(null as struct<h:bigint,i:int>)), slice({s}, 1, size({s}) - 1))"),
                              lambda x, y: F.struct(x["h"].alias("h"), x["i"].alias("i"), y["h"].alias("p"))),
                   F.expr(f"slice({s}, 2, size({s}) - 1)"),
                   lambda x, y: F.when(x["h"].eqNullSafe(x["p"]) | x["h"].eqNullSafe(y["h"]), x["i"])),
        lambda i: i.isNotNull()))
    covered = F.size(F.array_distinct(F.flatten(F.transform(p, lambda i: F.array(i, i + 1, i + 2)))))
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.size(F.regexp_extract_all(t, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.when(F.col(p).isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, base_failed: str = BASE_FAILED) -> DataFrame:
    """``docs`` plus the statistics, ``failed_rules`` (names, table order),
    ``base_failed`` and ``kept``."""
    made = {*STATISTICS, "failed_rules", "base_failed", "kept"}
    if text.lower() in made:
        raise ValueError(f"the text column may not be called {text!r}")
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    stats = _stages(own, text)
    failed = F.filter(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")
    out = stats.withColumn("failed_rules", failed).withColumn("base_failed", F.expr(base_failed))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = " AND ".join(f"({r.measure}) {op} {v}" for r in RULES for op, v in ((">=", r.low), ("<=", r.high)) if v is not None)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
g AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
h AS (SELECT k, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS x FROM g),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM h),
p AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY k),
s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words
      FROM d LEFT JOIN p USING (k)),
f AS (SELECT *, ({BASE_FAILED}) AS base_failed, ({rules}) AS good FROM s)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND good) AS kept FROM f
"""


SQL = _sql()
