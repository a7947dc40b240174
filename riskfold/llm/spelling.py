"""Spelling variants by permuterm rotations.

Every frequent word is marked with a terminator and rotated through all of its
places.  Two words that differ by one replaced code point have rotations that
agree in all but the last code point; a word with one more code point has a
rotation that is the other word's whole rotation and one code point.  So each
word enters, for every place, the rotation that skips the code point there
(kind ``SKIPPED``) and, for every gap, its whole rotation (kind ``WHOLE``).
Sorted by rotation, a run of equal prefixes holds exactly the words that are
near through that place, and a scan of the runs gives each member its number
of neighbours and the best one.  A run holds one word for each letter at most
and is never expanded into pairs: the best of the others is the first or the
second of the run.

A deletion inside a row of equal letters would appear in several runs; it is
counted in the one of the row's first letter.  Rotations of words over
``LONG`` code points are entered by two 61-bit polynomial hashes, so that a
word of a million letters costs a million rows and not their square.

Words carry a number that ascends with (count descending, word), so that the
best neighbour is the least number.  Form chains are followed by pointer
jumping: a form has at least ``RATIO`` times the count, so a chain has at most
log(largest count) links.

Null text has no words, a null id counts as the empty text before the colon.
Ties in the count go to the smallest word in code-point order.  Repeated rows
count again.  An empty table gives an empty result; extra columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfold.llm.common import documents, stash
from riskfold.session import ship_package

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP = 6, 5, 5, 199
END, LONG = "$", 64
WHOLE, SKIPPED = 0, 1
_PRIME, _BASES = (1 << 61) - 1, (911382323, 972663749)
#: Distinct words held by a task before they are handed on, and letters in them.
_HELD, _HELD_CHARS = 200_000, 8_000_000
_NONE = np.iinfo(np.int64).max


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST_LENGTH, drop: int = DROP) -> DataFrame:
    """(word, n): runs of letters of at least ``least`` code points, A-Z in
    lower case; where ``drop`` divides the crc32 h of ``<doc_id>:<run>``, the
    run's code point h % length is deleted first.  Tasks sum their own words."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile("[a-zÀ-ÿ]{%d,}" % least)
        held: Counter = Counter()
        chars = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                for name, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if not whole:
                        continue
                    seen = Counter(runs.findall(whole.encode().lower().decode()))  # bytes: A-Z only
                    start = zlib.crc32(b":", zlib.crc32(("" if name is None else str(name)).encode()))
                    for word in [w for w in seen if zlib.crc32(w.encode(), start) % drop == 0]:
                        at = zlib.crc32(word.encode(), start) % len(word)
                        n, short = seen.pop(word), word[:at] + word[at + 1:]
                        if len(short) >= least:
                            held[short] += n
                            chars += len(short)
                    chars += sum([len(w) for w in seen if len(w) > 200])
                    held.update(seen)
                if len(held) > _HELD or chars > _HELD_CHARS:
                    chars = 0
                    yield flush()
        yield flush()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame) -> DataFrame:
    """(id, word, n); ids ascend with (n descending, word) and are distinct."""
    ranged = words.select("word", "n").repartitionByRange(F.col("n").desc(), "word").sortWithinPartitions(F.col("n").desc(), "word")
    return stash(ranged.withColumn("id", F.monotonically_increasing_id()), "spelling-words")


def _hashed(word: str) -> tuple[list[str], list[str]]:
    """Keys of a long word's skipping and whole rotations, in one pass a base."""
    n, parts = len(word), []
    marked = [ord(c) for c in word] + [ord(END)]
    for base in _BASES:
        power, prefix = [1], [0]
        for x in marked + marked:
            prefix.append((prefix[-1] * base + x) % _PRIME)
            power.append(power[-1] * base % _PRIME)
        # rotation of `size` code points from place i of the doubled word
        parts.append(lambda i, size, f=prefix, p=power: (f[i + size] - f[i] * p[size]) % _PRIME)
    skipped = [f"{n}:{parts[0](i + 1, n):x}:{parts[1](i + 1, n):x}" for i in range(n)]
    whole = [f"{n + 1}:{parts[0](i, n + 1):x}:{parts[1](i, n + 1):x}" for i in range(n + 1)]
    return skipped, whole


def word_rotations(word: str, long: int = LONG) -> tuple[list[str], list[str], list[bool]]:
    """Skipping rotations by place, whole rotations by gap, and by place
    whether it is the first of its row of equal letters.  Words of ``long``
    code points and one more enter both ways where they meet."""
    n = len(word)
    first = [i == 0 or word[i - 1] != word[i] for i in range(n)]
    if n > long:
        skipped, whole = _hashed(word)
        return skipped, whole, first
    twice = word + END + word + END
    return [twice[i + 1:i + 1 + n] for i in range(n)], [twice[i:i + n + 1] for i in range(n + 1)], first


def rotations(words: DataFrame, long: int = LONG) -> DataFrame:
    """(key, kind, id, first) for all rotations of (id, word)."""
    ship_package(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kinds, ids, firsts, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int8()), pa.array(ids, pa.int64()), pa.array(firsts, pa.bool_())],
                                              ["key", "kind", "id", "first"])

        for b in batches:
            for at, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                skipped, whole, first = word_rotations(word, long)
                if len(word) == long:  # its longer neighbours are hashed
                    whole = _hashed(word)[1]
                keys += skipped + whole
                kinds += [SKIPPED] * len(skipped) + [WHOLE] * len(whole)
                firsts += first + [False] * len(whole)
                ids += [at] * (len(skipped) + len(whole))
                if len(keys) > 50_000:
                    yield flush()
                    keys, kinds, ids, firsts = [], [], [], []
        if keys:
            yield flush()

    return words.select("id", "word").mapInArrow(run, "key string, kind byte, id long, first boolean")


def scan(key: pa.Array, kind: np.ndarray, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, near, best) of the members of whole runs of equal keys; the rows
    are sorted by (key, kind, id)."""
    n = len(ids)
    change = np.ones(n, bool)
    if n > 1:
        change[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(change)
    run = np.cumsum(change) - 1
    size = np.diff(np.append(starts, n))
    host = kind[starts] == WHOLE  # at most one word has this whole rotation
    lead = starts + host
    members = size - host
    second = np.where(members > 1, ids[np.minimum(lead + 1, n - 1)], _NONE)
    leader = np.where(members > 0, ids[np.minimum(lead, n - 1)], _NONE)
    longer = np.add.reduceat(first.astype(np.int64), starts) if n else np.zeros(0, np.int64)
    best_longer = np.minimum.reduceat(np.where(first, ids, _NONE), starts) if n else np.zeros(0, np.int64)
    skip = np.flatnonzero(kind == SKIPPED)
    r = run[skip]
    joins = first[skip] & host[r]
    near = members[r] - 1 + joins
    best = np.where(ids[skip] == leader[r], second[r], leader[r])
    best = np.where(joins, np.minimum(best, ids[starts[r]]), best)
    some = near > 0
    hosts = np.flatnonzero(host & (longer > 0))
    return (np.concatenate([ids[skip][some], ids[starts[hosts]]]), np.concatenate([near[some], longer[hosts]]), np.concatenate([best[some], best_longer[hosts]]))


def neighbours(words: DataFrame, long: int = LONG) -> DataFrame:
    """(id, n_near, best) for the words (id, word) that have a near word;
    ``best`` is the least id among them."""
    rows = rotations(words, long).repartition("key").sortWithinPartitions("key", "kind", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            rows = pa.Table.from_batches([b])
            rows = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            key = rows.column("key").combine_chunks()
            # the last run may go on in the next batch
            last = pc.index(pc.equal(key, key[-1]), True).as_py()
            held, ready = rows.slice(last), rows.slice(0, last)
            if ready.num_rows:
                yield found(ready)
        if held is not None and held.num_rows:
            yield found(held)

    def found(rows: pa.Table) -> pa.RecordBatch:
        column = lambda c: rows.column(c).to_numpy()
        made = scan(rows.column("key").combine_chunks(), column("kind"), column("id"), column("first"))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in made], ["id", "near", "best"])

    each = rows.mapInArrow(run, "id long, near long, best long")
    return each.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(edges: DataFrame) -> DataFrame:
    """(id, root) for every edge (id, form): the end of its chain.  Each round
    doubles the distance followed."""
    now = stash(edges.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = stash(now.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = jumped.select("id", "root")
        if jumped.where("moved").limit(1).count() == 0:
            return now


def variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, long: int = LONG) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n) that
    occur ``least_count`` times: near-word count, the form each stands for and
    the end of its chain of forms."""
    words = numbered(counts.where(F.col("n") >= least_count))
    near = words.join(neighbours(words, long), "id", "left")
    best = words.select(F.col("id").alias("best"), F.col("n").alias("best_n"))
    judged = near.join(best, "best", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best")).alias("form"), F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best_n")).alias("form_n"))
    judged = stash(judged, "spelling-forms")
    ends = roots(judged.where("form is not null").select("id", "form"))
    name = lambda c, out: words.select(F.col("id").alias(c), F.col("word").alias(out))
    out = judged.join(ends, "id", "left").select("word", "n", "n_near", "form_n", F.col("form").alias("form_id"), F.col("root").alias("root_id"))
    out = out.join(name("form_id", "form"), "form_id", "left").join(name("root_id", "root"), "root_id", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(documents(spark, sf_dir)))


#: crc32 by its table, words from whole texts, near words by what is left after one deletion.
SQL = """
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce([i] || range(8)::BIGINT[], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
  FROM (SELECT unnest(range(256))::BIGINT AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, w, count(*) AS k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r WHERE length(w) >= 6 GROUP BY doc_id, w),
h AS (SELECT w, k, xor(list_reduce([4294967295] || list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT),
        lambda a, b: xor(a >> 8, t.tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM c, t),
d AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, k FROM h),
s AS (SELECT word, sum(k)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM s),
cut AS (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM p),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT a.word, a.n, s.word, s.n FROM cut a JOIN s ON a.rest = s.word
   UNION SELECT s.word, s.n, a.word, a.n FROM cut a JOIN s ON a.rest = s.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM near GROUP BY word),
pick AS (SELECT b.word, b.n_near, b.top, min(n.other) AS other FROM best b JOIN near n ON n.word = b.word AND n.other_n = b.top GROUP BY ALL),
f AS (SELECT s.word, s.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 5 * s.n THEN other END AS form, CASE WHEN top >= 5 * s.n THEN top END AS form_n
      FROM s LEFT JOIN pick ON pick.word = s.word),
chain AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, ends.root, f.n, f.n_near, f.form_n FROM f JOIN ends ON ends.word = f.word
"""
