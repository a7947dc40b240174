"""Toxicity: class-conditional Kneser-Ney models over characters.

Words (lower case, letter runs) give character ``ORDER``-grams, padded at the
word's edges.  Pooled counts of both classes form a Kneser-Ney model: absolute
discount, continuation counts at the lower orders of ``LEVELS``.  Each class
then has its own counts at the highest order, discounted by the amounts that
its own counts of counts give for one, two and more occurrences (modified
Kneser-Ney), with the freed mass on the pooled model of the same history: an
expression that a class has hardly seen is smoothed by the shared counts.  A
gram that no learning row has, after a history that some has, leaves each class
only its freed mass, and the shared probability cancels: its ratio belongs to
the history.  After an unknown history both classes follow the shared model
and the ratio is zero.

A text is compared by length-normalised log-likelihood ratios: over the whole
text, over what its words exceed ``MARGIN`` by (so that chance does not add
up), and over its ``STRONGEST`` words, so that a few words in a long text still
show.  A logistic link, fitted on learning rows that the counts left out (at
most ``CALIBRATION_ROWS``, and a fifth of all), turns these and the length into
a score between 0 and 1.

All counts are gathered over every other learning row, and no ratio is left
out.  The model is broadcast while it has at most ``BROADCAST_GRAMS`` rows, as
64-bit hashes with their ratios (12 bytes a row); beyond that words are scored
by joins (``word_ratios``) and the same formulas run on the joined ratios.  A
very long text is one row of the exchange in either case, as it was in the
input.

Null or empty text has ratios zero and gets the score of the link there.
Labels other than 0 and 1, null ids and ids without a document teach nothing;
with one class only every score is that class's share (0.0 without labels).
Repeated rows are scored alike; output columns replace clashing ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField

from riskfold.llm.common import add_columns, documents, exchanged, held_out, stash
from riskfold.session import ship_package

ORDER, DISCOUNT = 9, 0.75
MARGIN, STRONGEST = 3.0, 5
#: Orders of the backoff chain.
LEVELS = (2, 4, 6, ORDER)
CALIBRATION_ROWS, BROADCAST_GRAMS = 20_000, 12_000_000
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]{1,24}")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str) -> list[str]:
    padded = "^" * (ORDER - 1) + word + "$"
    return [padded[i:i + ORDER] for i in range(len(word) + 1)]


def _grams_of(word: Column) -> Column:
    padded = F.concat(F.lit("^" * (ORDER - 1)), word, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))


def count_grams(labelled: DataFrame) -> DataFrame:
    """(g, t, o): counts of each gram in toxic and ordinary rows (text, toxic);
    words are summed per task before they are exchanged."""
    ship_package(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            every = list(held[0] | held[1])
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([h[w] for w in every], pa.int64()) for h in held]], ["w", "t", "o"])
            held[0].clear(), held[1].clear()
            return out

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held[0 if toxic else 1].update(tokens(text))
                if len(held[0]) + len(held[1]) > 150_000:
                    yield flush()
        yield flush()

    words = labelled.select("text", "toxic").mapInArrow(run, "w string, t long, o long").groupBy("w").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    return words.select(F.explode(_grams_of(F.col("w"))).alias("g"), "t", "o").groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def _by_history(table: DataFrame, order: int, **sums: Column) -> DataFrame:
    """``table`` plus sums over the grams of the same history: one exchange,
    and no more rows a history than there are characters."""
    alike = Window.partitionBy("h")
    table = table.withColumn("h", F.expr(f"substring(g, 1, {order - 1})"))
    return table.select("*", *[c.over(alike).alias(name) for name, c in sums.items()]).drop("h")


def _smoothed(table: DataFrame, order: int, below: DataFrame | None, last: int) -> DataFrame:
    """``table`` (g, a, all, kinds) plus ``p``, backed off to ``below`` (g, p) of order ``last``."""
    if below is None:
        lower = F.lit(1.0) / F.col("kinds")
    else:
        table = table.withColumn("s", F.expr(f"substring(g, {order - last + 1})")).join(exchanged(below.select(F.col("g").alias("s"), F.col("p").alias("q"))), "s").drop("s")
        lower = F.col("q")
    return table.withColumn("p", (F.greatest(F.col("a") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * lower) / F.col("all"))


def _below(counts: DataFrame) -> DataFrame:
    """(g, p) of the order below the highest, from continuation counts of all grams."""
    levels, above = {}, counts.select("g")
    for k, longer in zip(LEVELS[-2::-1], LEVELS[:0:-1]):
        above = levels[k] = above.groupBy(F.expr(f"substring(g, {longer - k + 1})").alias("g")).agg(F.count("*").cast("double").alias("a"))
    below, last = None, 0
    for k in LEVELS[:-1]:
        table = _by_history(levels[k], k, all=F.sum("a"), kinds=F.count("*"))
        below, last = _smoothed(table, k, below, last).select("g", "p"), k
    return below


def pooled_model(counts: DataFrame) -> DataFrame:
    """(g, p): interpolated Kneser-Ney probability of each seen gram's last
    character after the others; ``counts`` has (g, n)."""
    table = _by_history(counts.select("g", F.col("n").cast("double").alias("a")), ORDER, all=F.sum("a"), kinds=F.count("*"))
    return _smoothed(table, ORDER, _below(counts), LEVELS[-2]).select("g", "p")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Discounts of counts of one, two, and three or more, from the numbers of
    grams that occur so often; within (0, 1), (0, 2) and (0, 3)."""
    if not (n1 and n2):
        return (DISCOUNT,) * 3
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))


def class_discounts(counts: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Discounts of the classes t and o from all grams."""
    row = counts.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in "to" for k in (1, 2, 3, 4)]).first()
    return {c: discounts(*[row[f"{c}{k}"] for k in (1, 2, 3, 4)]) for c in "to"}


def ratio_table(counts: DataFrame) -> DataFrame:
    """(g, r): log ratio of the class models for each seen gram, and for each
    seen history (one character shorter) the ratio of any other gram after it.
    Totals and freed mass of the pooled and both class models come from all
    grams, in one exchange by history."""
    cut = class_discounts(counts)

    def discount(c: str) -> Column:
        return F.when(F.col(c) >= 3, cut[c][2]).when(F.col(c) == 2, cut[c][1]).when(F.col(c) == 1, cut[c][0]).otherwise(0.0)

    own = {f"{c}_{n}": e for c in "to" for n, e in (("all", F.sum(F.col(c).cast("double"))), ("free", F.sum(discount(c))))}
    table = _by_history(counts, ORDER, kinds=F.count("*"), top=F.max("g"), **own).withColumn("a", (F.col("t") + F.col("o")).cast("double")).withColumn("all", F.col("t_all") + F.col("o_all"))
    seen = _smoothed(table, ORDER, _below(counts), LEVELS[-2])

    def probability(c: str) -> Column:
        own = (F.col(c) - discount(c) + F.col(f"{c}_free") * F.col("p")) / F.col(f"{c}_all")
        return F.when(F.col(f"{c}_all") > 0, own).otherwise(F.col("p"))

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, F.log(F.col(f"{c}_free") / F.col(f"{c}_all"))).otherwise(0.0)

    # one gram of each history also speaks for the history
    both = seen.select("g", (F.log(probability("t")) - F.log(probability("o"))).alias("r"), (left("t") - left("o")).alias("rest"), (F.col("g") == F.col("top")).alias("last"))
    rows = F.array(F.struct("g", "r"), F.when(F.col("last"), F.struct(F.expr(f"substring(g, 1, {ORDER - 1})").alias("g"), F.col("rest").alias("r"))))
    return both.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("x.g", "x.r")


class Ratios:
    """Ratios of words from the broadcast table (hashes in ascending order and
    ratios); words seen lately are kept."""

    def __init__(self, keys: np.ndarray, ratios: np.ndarray) -> None:
        self.keys, self.ratios, self.known = keys, ratios, {}

    def _find(self, hashed: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one = xxhash.xxh64_intdigest
        at = np.fromiter((one(g.encode(), 42) for g in hashed), np.uint64, len(hashed)).view(np.int64)
        place = np.minimum(np.searchsorted(self.keys, at), len(self.keys) - 1)
        return (self.keys[place] == at, self.ratios[place]) if len(self.keys) else (np.zeros(len(at), bool), np.zeros(len(at)))

    def learn(self, words: list[str]) -> None:
        each = [grams(w) for w in words]
        flat = [g for x in each for g in x]
        found, r = self._find(flat)
        r = np.where(found, r, 0.0).astype(np.float64)
        rest = np.flatnonzero(~found)
        if len(rest):
            known, other = self._find([flat[i][:-1] for i in rest])
            r[rest] = np.where(known, other, 0.0)
        starts = np.cumsum([0, *map(len, each[:-1])])
        self.known.update(zip(words, np.add.reduceat(r, starts).tolist()))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Ratios of the words of each text."""
        if len(self.known) > 300_000:
            self.known.clear()
        new = list(dict.fromkeys(w for words in texts for w in words if w not in self.known))
        for lo in range(0, len(new), 20_000):
            self.learn(new[lo:lo + 20_000])
        find = self.known.__getitem__
        return [np.fromiter(map(find, words), float, len(words)) for words in texts]


def features(ratios: np.ndarray) -> tuple[float, float, float, float]:
    """Mean over the text, log of what exceeds the margin in all, mean of the
    strongest words, log length."""
    n = len(ratios)
    if not n:
        return 0.0, 0.0, 0.0, 0.0
    top = np.partition(ratios, n - STRONGEST)[-STRONGEST:] if n > STRONGEST else ratios
    return float(ratios.mean()), math.log1p(float(np.maximum(ratios - MARGIN, 0.0).sum())), float(np.maximum(top, 0.0).sum() / STRONGEST), math.log1p(n)


@dataclass
class Model:
    """Broadcast table (or the shared table of a large model) and the link."""

    table: DataFrame
    small: bool
    link: np.ndarray
    packed: object = None


_OPEN: dict[str, Ratios] = {}


def _opened(packed) -> Ratios:
    """One table per Python worker, however many tasks it runs."""
    key, keys, ratios = packed.value
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Ratios(np.frombuffer(keys, np.int64), np.frombuffer(ratios, np.float32))
    return _OPEN[key]


def _pack(table: DataFrame):
    import uuid
    found = table.select(F.xxhash64("g").alias("g"), F.col("r").cast("float")).toArrow()
    keys, ratios = found.column("g").to_numpy(), found.column("r").to_numpy()
    order = np.argsort(keys)
    return table.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, keys[order].tobytes(), ratios[order].tobytes()))


FEATURES = [StructField("tox_mean", DoubleType()), StructField("tox_peak", DoubleType()), StructField("tox_top", DoubleType()), StructField("tox_length", DoubleType())]


def with_features(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    if model.small:
        packed = model.packed

        def make():
            ratios = _opened(packed)
            return lambda texts: [list(x) for x in zip(*[features(r) for r in ratios.rows([tokens(t) for t in texts])])] or [[], [], [], []]

        return add_columns(docs, [text], FEATURES, make, rows=256)
    return _joined_features(docs, model.table, text)


def word_ratios(words: DataFrame, table: DataFrame) -> DataFrame:
    """(w, r) for distinct words (w), by joins with the ratio table."""
    each = words.select("w", F.explode(_grams_of(F.col("w"))).alias("g"))
    known = each.join(table, "g", "left").select("w", "r", F.when(F.col("r").isNull(), F.expr(f"substring(g, 1, {ORDER - 1})")).alias("g"))
    rest = known.where("r is null").join(table.withColumnRenamed("r", "other"), "g", "left").select("w", "other")
    return known.where("r is not null").select("w", "r").unionByName(rest.select("w", F.coalesce("other", F.lit(0.0)).alias("r"))).groupBy("w").agg(F.sum("r").alias("r"))


def _joined_features(docs: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """The features where the table is too large to broadcast: ratios of the
    distinct words by joins, then back to the places of each text.  The input
    row travels as one column, so that no name can clash."""

    def cut():
        return lambda texts: [[tokens(t) for t in texts]]

    made = {f.name for f in FEATURES}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    own = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("k"))
    keyed = stash(add_columns(own, ["text"], [StructField("words", ArrayType(StringType()))], cut).drop("text"), "tox")
    places = keyed.select("k", F.posexplode("words").alias("n", "w"))
    ratios = word_ratios(places.select("w").distinct(), table)
    back = places.join(exchanged(ratios), "w").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "r"))).alias("rs"))

    def finish():
        return lambda rows: [list(x) for x in zip(*[features(np.array([p["r"] for p in r or []])) for r in rows])] or [[], [], [], []]

    return add_columns(keyed.drop("words").join(back, "k", "left"), ["rs"], FEATURES, finish).select("row.*", *[f.name for f in FEATURES])


def fit_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights on standardised features by Newton steps; returns
    mean, scale and weights as rows."""
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        at = np.clip(share, 1e-9, 1 - 1e-9)
        return np.array([[0.0] * 5, [1.0] * 5, [0.0] * 4 + [math.log(at / (1 - at))]])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
    w = np.zeros(5)
    ridge = np.diag([1.0] * 4 + [1e-6])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
    return np.array([[*mean, 0.0], [*scale, 1.0], w])


def scored(featured: DataFrame, link: np.ndarray) -> DataFrame:
    z = F.lit(float(link[2][4]))
    for i, f in enumerate(FEATURES):
        z = z + (F.col(f.name) - float(link[0][i])) / float(link[1][i]) * float(link[2][i])
    return featured.withColumn("score", 1 / (1 + F.exp(-z))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def set_aside(learn: DataFrame, most: int) -> Column:
    """Whether a learning row fits the link and not the counts: a fifth of the
    rows by id hash, of these no more than ``most``, smallest hash first.  Ids
    with more than a hundredth of ``most`` rows are always counted."""
    own = F.xxhash64("doc_id")
    fifth = F.pmod(own, F.lit(5)) == 0
    n = learn.count()
    # hashes spread evenly: this range holds slightly more than is needed, whatever n
    reach = min(int(-2**63 + 2**64 * min(1.0, (5.5 * most + 500) / max(n, 1))), 2**63 - 1)
    seen = learn.where(fifth & (own <= F.lit(reach))).groupBy(own.alias("h")).agg(F.count("*").alias("n")).collect()
    large = [r["h"] for r in seen if r["n"] > max(most // 100, 1)]
    taken, last = 0, -2**63
    for h, n in sorted((r["h"], r["n"]) for r in seen if r["n"] <= max(most // 100, 1)):
        if taken + n > most:
            break
        taken, last = taken + n, h
    return fifth & (own <= F.lit(last)) & ~own.isin(large) if taken else F.lit(False)


def train(learn: DataFrame, broadcast_grams: int = BROADCAST_GRAMS, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Model from learning rows (doc_id, text, toxic); those ``set_aside``
    fit the link, all others are counted."""
    learn = learn.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    aside = set_aside(learn, calibration_rows)
    table = stash(ratio_table(stash(count_grams(learn.where(~aside)), "tox-counts")), "tox-ratios")
    model = Model(table, table.count() <= broadcast_grams, np.zeros((3, 5)))
    if model.small:
        model.packed = _pack(table)
    rows = with_features(learn.where(aside).select("doc_id", "text", "toxic"), model).drop("text").toArrow()
    rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "toxic", *[f.name for f in FEATURES])])
    x = np.column_stack([rows.column(f.name).to_numpy() for f in FEATURES]) if rows.num_rows else np.zeros((0, 4))
    model.link = fit_link(x, rows.column("toxic").to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` plus the features, ``score`` and ``predicted``."""
    made = {"score", "predicted"}
    own = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    return scored(with_features(own, model, text), model.link)


def learning_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learnt from: crc32(doc_id) mod 3 is not 1."""
    named = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out("doc_id", 3, 1))
    return docs.select("doc_id", "text").join(named, "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(learning_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    out = score(docs, model).withColumn("held_out", held_out("doc_id", 3, 1))
    return out.select("doc_id", F.col("held_out").cast(BooleanType()), "score", F.col("predicted").cast(IntegerType()))
