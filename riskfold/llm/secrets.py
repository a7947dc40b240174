"""Secret scans: candidate strings judged by a random forest, all in built-in
expressions.

A candidate is a run of 16 or more characters of keys and tokens with a digit,
a vendor's format with or without one, or the value after a secret's name: any
6 or more non-blank characters after ``=`` or ``:`` (up to the quote that ends
it), after a mere blank such with a digit or 16 characters of keys, as prose
goes on after those names, too.
Its features: length, shares of character classes, transitions between classes
and letter pairs, coverage by words of the corpus, path and host marks, and
the neighbouring words.  A word of the corpus stands outside the candidates in
``LEAST_TEXTS`` distinct texts or the share ``TEXT_SHARE`` of them, whichever
is more, so that neither a secret's copies nor the table's size make its pieces
words.  ``weak_labels`` marks findings whose form or context
is beyond doubt (vendor formats, assignments to a secret's name; against them
card numbers, hosts, paths, ids, dictionary text); the forest is trained on a
bounded sample of them (``SAMPLE`` of each class, smallest hash) and decides on
every candidate but the certain vendor formats, which need no vote.  With one
class only, the weak label itself decides.

Null or empty text has no candidate.  Spans are code points, end exclusive.
Repeated rows are judged each by itself; null ids stay; an empty table gives
an empty result.  No column of the input is needed but text and id.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskfold.llm.common import documents, exchanged, stash

SAMPLE, TREES, DEPTH, SEED, THRESHOLD = 5000, 20, 6, 11, 0.5
#: Pieces of candidates are broadcast as a filter up to this count, joined by exchange beyond it.
BROADCAST_PIECES = 500_000
#: A corpus word is in so many distinct texts at least, and in that share of them.
LEAST_TEXTS, TEXT_SHARE = 5, 0.001
MASK = "[SECRET]"

#: Names that secrets are assigned to, and public formats of keys.
NAMED = r"""(?i)(password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)["']?\s*[=: ]\s*["']?$"""
VENDOR = r"^(AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[baprs]-[A-Za-z0-9-]{10,}$|^sk[-_](live|test|proj)?[-_]?[A-Za-z0-9]{20,}$|^AIza[0-9A-Za-z_-]{35}$|^eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+$|^glpat-[A-Za-z0-9_-]{20}$"
_KEY = r"[A-Za-z0-9_+/.~-]"
_NAME = r"""(?=[pPsStTaAbBcC])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)["']?"""
_ASSIGNED, _BESIDE = r"""\s{0,8}[=:]\s{0,8}["']?""", r"""\s{1,4}["']?"""
#: Marks that end a sentence or a bracket are no part of an unquoted value's end.
_VALUE = r"""(?![=:>])[^\s"'`]{5,}[^\s"'`.,;:)\]}>]"""
_BESIDE_VALUE = rf"""(?=[^\s"'`0-9]*+[0-9]|{_KEY}{{16}}){_VALUE}"""
#: A run that ends in a name and an assignment is the name, not a value.
_RUN = rf"(?<!{_KEY})(?=[A-Za-z_+/.~-]*+[0-9])(?={_KEY}{{16}})(?!{_KEY}*{_NAME}{_ASSIGNED}[^\s\"'`=:>]){_KEY}{{16,}}+={{0,2}}"
_FORM = rf"(?<!{_KEY})(?:{VENDOR.replace('^', '').replace('$', '').replace('(', '(?:')})(?![A-Za-z0-9_+/~-]|\.[A-Za-z0-9])"
_BEFORE = rf"(?:{_NAME}(?:{_ASSIGNED}(?={_VALUE})|{_BESIDE}(?={_BESIDE_VALUE})))"
CANDIDATE = rf"{_BEFORE}|{_FORM}|{_RUN}"
#: Text up to a candidate (a secret's name included), then the candidate.
_CUT = rf"(?s)(.*?(?:{_BEFORE}|(?={_FORM}|{_RUN})|\z))((?<={_NAME}{_ASSIGNED}){_VALUE}|(?<={_NAME}{_BESIDE}){_BESIDE_VALUE}|{_FORM}|{_RUN}|)"
HOST = r"(?i)\.(com|org|net|io|edu|gov|info|html?|php|png|jpe?g|gif|pdf|py|js|css|json|xml|txt|zip|gz)\.?$"
PLAIN = r"^[0-9./_-]+$|^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^(v|V)?[0-9]+(\.[0-9]+)+|^/|//|^\d{4}-\d{2}-\d{2}"

FEATURES = ("length", "digits", "upper", "lower", "transitions", "pairs", "distinct", "dots", "slashes", "dashes", "hex", "coverage",
            "named", "vendor", "host", "plain", "after_at", "assigned", "quoted", "left_word", "right_at")


def suspects(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows with a candidate, numbered (``_k``), in the shared folder."""
    found = docs.where(F.col(text).rlike(CANDIDATE))
    return stash(found.withColumn("_k", F.monotonically_increasing_id()), "secret-rows")


def candidates(held: DataFrame, text: str = "text") -> DataFrame:
    """(_k, n, start, end, value, left, right) of every candidate, n from 0."""
    gaps = F.regexp_extract_all(F.col(text), F.lit(_CUT), F.lit(1))
    values = F.regexp_extract_all(F.col(text), F.lit(_CUT), F.lit(2))
    cut = held.select("_k", gaps.alias("g"), values.alias("v"))
    cut = cut.select("_k", F.arrays_zip("g", "v", F.expr("concat(slice(g, 2, size(g)), array(''))").alias("r")).alias("z"))
    each = cut.select("_k", F.posexplode("z").alias("n", "z"))
    each = each.select("_k", "n", F.length("z.g").alias("gap"), F.length("z.v").alias("size"), F.col("z.v").alias("value"),
                       F.expr("right(z.g, 40)").alias("left"), F.expr("left(z.r, 24)").alias("right"))
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("_k").orderBy("n"))
    return each.withColumn("end", end).where("size > 0").select("_k", "n", (F.col("end") - F.col("size")).alias("start"), "end", "value", "left", "right")


def coverage(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(value, covered): letters of each distinct value in words of the corpus:
    counted once per distinct text, outside all candidates."""
    values = found.select("value").distinct()
    pieces = values.select("value", F.explode(F.split(F.lower("value"), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    named = stash(pieces.select("w").distinct(), "secret-pieces")
    few = named.count() <= BROADCAST_PIECES
    whole = F.xxhash64(F.col(text))
    least = max(LEAST_TEXTS, TEXT_SHARE * docs.where(F.col(text).isNotNull()).select(whole).distinct().count())
    prose = F.when(F.col(text).rlike(CANDIDATE), F.array_join(F.regexp_extract_all(F.col(text), F.lit(_CUT), F.lit(1)), " ")).otherwise(F.col(text))
    spoken = docs.select(whole.alias("h"), F.explode(F.array_distinct(F.split(F.lower(prose), "[^a-z]+"))).alias("w"))
    spoken = spoken.join(F.broadcast(named) if few else named, "w", "left_semi")
    common = spoken.groupBy("w").agg(F.count_distinct("h").alias("c")).where(F.col("c") >= least).select("w")
    return pieces.join(F.broadcast(common) if few else exchanged(common), "w").groupBy("value").agg(F.sum(F.length("w")).alias("covered"))


def _count(of: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(of, F.lit(pattern), F.lit(0)))


def features(found: DataFrame, covered: DataFrame) -> DataFrame:
    """Candidates plus one double column per feature."""
    v, left, right = F.col("value"), F.col("left"), F.col("right")
    n = F.length(v)
    letters = _count(v, "[A-Za-z]")
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"))
    exprs = {
        "length": n,
        "digits": _count(v, "[0-9]") / n,
        "upper": _count(v, "[A-Z]") / n,
        "lower": _count(v, "[a-z]") / n,
        "transitions": (runs - 1) / n,
        "pairs": _count(F.lower(v), "[bcdfghjklmnpqrstvwxz][aeiouy]") * 2 / F.greatest(letters, F.lit(1)),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "dots": _count(v, r"\."),
        "slashes": _count(v, "/"),
        "dashes": _count(v, "[_-]"),
        "hex": v.rlike("^[0-9a-fA-F]+$"),
        "coverage": F.coalesce("covered", F.lit(0)) / F.greatest(letters, F.lit(1)),
        "named": left.rlike(NAMED),
        "vendor": v.rlike(VENDOR),
        "host": v.rlike(HOST),
        "plain": v.rlike(PLAIN),
        "after_at": left.endswith("@"),
        "assigned": left.rlike(r"""[=:]\s*["']?$"""),
        "quoted": left.rlike("[\"'`]$") & right.rlike("^[\"'`]"),
        "left_word": F.length(F.regexp_extract(left, r"(\p{L}*)[^\p{L}]*$", 1)),
        "right_at": right.startswith("@"),
    }
    joined = found.join(covered, "value", "left")
    return joined.select("_k", "n", "start", "end", "value", *[exprs[f].cast("double").alias(f) for f in FEATURES])


def weak_labels(featured: DataFrame) -> DataFrame:
    """Adds ``label``: 1.0, 0.0, or null where nothing is certain.  Words of the
    corpus speak against a value only if neither its form nor its name does for it."""
    spoken = F.col("coverage") >= 0.5
    sure = (F.col("vendor") > 0) | ((F.col("named") > 0) & (~spoken | (F.col("digits") > 0)))  # words alone after a name are left to the forest
    wrong = (F.col("host") + F.col("plain") + F.col("after_at") + F.col("right_at") > 0) | (spoken & (F.col("named") + F.col("vendor") == 0))
    return featured.withColumn("label", F.when(sure & ~wrong, 1.0).when(wrong & ~sure, 0.0))


def _vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="_x", handleInvalid="keep").transform(rows)


def train(labelled: DataFrame, sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """Forest from labelled findings (features, label); None without both
    classes.  The sample is sorted in one partition (it is bounded), so the
    forest does not depend on the cluster's layout."""
    rows = labelled.where("label is not null").select("value", "label", *FEATURES).dropDuplicates(["value", "label"])
    order = ["_h", "value"]
    sides = [rows.where(F.col("label") == c).withColumn("_h", F.xxhash64("value")).orderBy(*order).limit(sample) for c in (0.0, 1.0)]
    chosen = stash(sides[0].unionByName(sides[1]).coalesce(1).sortWithinPartitions(*order), "secret-sample")
    if chosen.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(_vectors(chosen).select("_x", "label"))


def judge(featured: DataFrame, model: RandomForestClassificationModel | None) -> DataFrame:
    """Adds ``score`` (share of the forest's votes; 1 for a certain vendor format) and ``secret``."""
    if model is None:
        return featured.withColumn("score", F.coalesce("label", F.lit(0.0))).withColumn("secret", F.col("score") >= THRESHOLD)
    out = model.transform(_vectors(featured))
    certain = (F.col("vendor") > 0) & F.coalesce(F.col("label") == 1.0, F.lit(False))
    out = out.withColumn("score", F.when(certain, 1.0).otherwise(F.round(vector_to_array("probability")[1], 6)))
    return out.withColumn("secret", F.col("score") >= THRESHOLD).drop("_x", "rawPrediction", "probability", "prediction")


def judged(held: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Every candidate of the suspect rows with features, score and verdict."""
    found = stash(candidates(held, text), "secret-candidates")
    featured = stash(weak_labels(features(found, coverage(found, docs, text))), "secret-features")
    return judge(featured, train(featured))


def kind() -> Column:
    v = F.col("value")
    return (F.when(v.rlike("^(AKIA|ASIA)"), "access_key").when(F.col("vendor") > 0, "vendor_token").when(F.col("hex") > 0, "hex_secret").otherwise("secret"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, kind, value_sha256, score) of every secret."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    held = suspects(own)
    found = judged(held, own).where("secret")
    rows = found.select("_k", "start", "end", kind().alias("kind"), F.sha2("value", 256).alias("value_sha256"), "score")
    return rows.join(held.select("_k", "doc_id"), "_k").select("doc_id", "start", "end", "kind", "value_sha256", "score")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by ``MASK``.  The input
    row travels as one column, so that no name can clash."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    held = suspects(own)
    hits = judged(held, own).where("secret").groupBy("_k").agg(F.collect_list("n").alias("hits"))
    parts = F.arrays_zip(F.regexp_extract_all(F.col("text"), F.lit(_CUT), F.lit(1)).alias("g"), F.regexp_extract_all(F.col("text"), F.lit(_CUT), F.lit(2)).alias("v"))
    cut = held.join(hits, "_k", "left").withColumn("parts", F.when(F.col("hits").isNotNull(), parts))
    masked = F.array_join(F.transform("parts", lambda p, i: F.concat(p["g"], F.when(F.array_contains("hits", i), F.lit(MASK)).otherwise(p["v"]))), "")
    shown = cut.select("row", F.coalesce(masked, F.col("text")).alias("text"))
    rest = own.where(~F.coalesce(F.col("text").rlike(CANDIDATE), F.lit(False)))
    both = rest.unionByName(shown)
    return both.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
