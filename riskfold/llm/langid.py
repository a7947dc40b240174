"""Language ID: script ranges, per-word scores, Viterbi over the words.

Each word (letter run, lower case) has a script by the code-point ranges of
its letters; only languages whose learning texts use that script (at least
``SCRIPT_SHARE`` of their letters) are candidates.  A candidate's score is the
sum of log probabilities of the word's character trigrams (edges included), as
differences from the best candidate, no lower than ``-FLOOR``; a language that
the script rules out can't label the word at all.  Viterbi with a
penalty ``SWITCH`` per change of language labels every word, so a text of
several languages comes out as spans; the language with most letters wins.

Which language fits best says nothing of whether any fits.  ``lang_evidence``
is absolute: the mean over the text's trigrams of the log probability under
the language that labels them, in standard deviations from that language's own
mean (both follow from the learning counts); trigrams of a script that no
learning language uses count ``-FOREIGN``.  A text of a learned language lies
near zero, one of another language or script or of random letters far below
``LEAST_EVIDENCE``.  A language learnt from fewer than ``LEAST_KNOWN`` distinct
trigrams is too little known to speak against a text: words in its own script
count zero.

Trigram counts cover all learning texts.  They are kept by hash in ``SLOTS``
places, so the table's size is bounded by SLOTS x languages.

Null text or a text without letters: no spans, ``und``, score 0, evidence null.  Without any
learning language every text is ``und``.  Ties go to the first language in
alphabetical order.  Null languages and null texts teach nothing.  Rows are
independent; very long texts are read whole, their words ``BLOCK_WORDS`` and
those of one text at a time; output columns replace input columns of the same
name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from riskfold.llm.common import add_columns, documents, held_out
from riskfold.session import ship_package

SLOTS, FLOOR, SWITCH, SMOOTH, SCRIPT_SHARE = 1 << 17, 6.0, 12.0, 0.5, 0.01
FOREIGN, LEAST_EVIDENCE, LEAST_KNOWN = 10.0, -2.5, 1000
#: Words scored and decoded together.
BLOCK_WORDS = 400_000

#: First and last code point of the blocks of each script.
SCRIPTS: tuple[tuple[str, int, int], ...] = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("arabic", 0xFB50, 0xFEFF), ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("han", 0x20000, 0x323AF),
)
_NAMES = list(dict.fromkeys(s for s, _, _ in SCRIPTS))
OTHER = len(_NAMES)
_WORD = re.compile(r"[^\W\d_]{1,40}")
#: The same for lower-case texts up to U+024F, which need no test for other numerals.
_PLAIN_WORD = re.compile("[a-zªµºß-öø-ɏ]{1,40}")
_BEYOND = re.compile("[\u0250-\U0010ffff]")


def script(word: str) -> int:
    """Place of the script of the word's first letter in a known range."""
    for c in word:
        o = ord(c)
        for name, a, b in SCRIPTS:
            if a <= o <= b:
                return _NAMES.index(name)
    return OTHER


class _Places(dict):
    """Slot of each trigram; the hash is taken once per trigram in use."""

    def __missing__(self, gram: str) -> int:
        if len(self) > 200_000:
            self.clear()
        at = self[gram] = xxhash.xxh64_intdigest(gram.encode(), 42) % SLOTS
        return at


_PLACES = _Places()


def slots(word: str) -> list[int]:
    w, place = f"^{word}$", _PLACES
    return [place[w[i:i + 3]] for i in range(len(w) - 2)]


def count_trigrams(learn: DataFrame) -> DataFrame:
    """(lang, slot, n) over all rows of (text, lang); slots from SLOTS on count
    the letters of each script.  Words are summed per task first."""
    ship_package(learn.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        sums: dict[str, np.ndarray] = {}

        def settle() -> None:
            for lang, seen in held.items():
                into = sums.setdefault(lang, np.zeros(SLOTS + OTHER + 1, np.int64))
                for w, n in seen.items():
                    for s in slots(w):
                        into[s] += n
                    into[SLOTS + script(w)] += n * len(w)
            held.clear()

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.setdefault(lang, Counter()).update(_WORD.findall(text.lower()))
                if sum(map(len, held.values())) > 200_000:
                    settle()
        settle()
        for lang, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at])], ["lang", "slot", "n"])

    rows = learn.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, slot int, n long")
    return rows.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages in alphabetical order, log probabilities (slot, language) and
    allowed (script, language); mean and standard deviation of the log
    probability of each language's own trigrams (infinite: too few known)."""

    langs: list[str]
    logs: np.ndarray
    allowed: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def train(learn: DataFrame) -> Model:
    found = count_trigrams(learn).toArrow()  # at most languages x (SLOTS + scripts) rows
    langs = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((SLOTS + OTHER + 1, len(langs)))
    if langs:
        place = {k: i for i, k in enumerate(langs)}
        counts[found.column("slot").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] = found.column("n").to_numpy()
    grams, scripts = counts[:SLOTS], counts[SLOTS:]
    shared = (grams.sum(1, keepdims=True) + SMOOTH) / max(grams.sum() + SMOOTH * SLOTS, 1.0)
    total = grams.sum(0, keepdims=True)
    # each language leans on the shared distribution with the weight of SMOOTH x 1000 trigrams
    logs = np.log((grams + 1000 * SMOOTH * shared) / (total + 1000 * SMOOTH))
    share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1.0)
    own = grams / np.maximum(total, 1.0)
    mean = (own * logs).sum(0)
    spread = np.sqrt(np.maximum((own * (logs - mean) ** 2).sum(0), 0.25))
    spread = np.where((grams > 0).sum(0) >= LEAST_KNOWN, spread, np.inf)
    return Model(langs, logs.astype(np.float32), share >= SCRIPT_SHARE, mean, spread)


class Scores:
    """Score rows of words, kept for the words seen lately."""

    def __init__(self, model: Model) -> None:
        self.model, self.place = model, {}
        self.rows = np.zeros((0, len(model.langs)), np.float32)
        self.evidence = np.zeros((0, len(model.langs) + 1), np.float32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Score rows and evidence rows (last column: trigrams) of the words."""
        if len(self.place) > 200_000:
            self.place, self.rows, self.evidence = {}, self.rows[:0], self.evidence[:0]
        place = self.place
        new = sorted(set(words).difference(place))
        if new:
            every = [slots(w) for w in new]
            starts = np.cumsum([0, *map(len, every[:-1])])
            at = np.fromiter((s for x in every for s in x), np.int64, sum(map(len, every)))
            raw = np.add.reduceat(self.model.logs[at], starts, axis=0)
            allowed = self.model.allowed[[script(w) for w in new]]
            foreign = ~allowed.any(1, keepdims=True)
            allowed = allowed | foreign  # a script that nobody uses rules nobody out, but speaks for nobody
            many = np.array([[len(x)] for x in every], np.float32)
            fits = np.where(foreign, -FOREIGN * many, (raw - many * self.model.mean) / self.model.spread)
            self.evidence = np.vstack([self.evidence, np.hstack([fits, many]).astype(np.float32)])
            raw = np.where(allowed, raw, -np.inf)
            place.update(zip(new, range(len(place), len(place) + len(new))))
            self.rows = np.vstack([self.rows, np.where(allowed, np.maximum(raw - raw.max(1, keepdims=True), -FLOOR), -np.inf)])
        at = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        return self.rows[at], self.evidence[at]


def viterbi(scores: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; ``scores`` holds the words of all texts one
    after another.  Texts advance side by side, the longest first."""
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], starts[order]
    k = scores.shape[1]
    out = np.zeros(len(scores), np.int16)
    if not len(scores):
        return out
    came = np.zeros((len(scores), k), np.int16)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts with more than t words
    own = np.arange(k, dtype=np.int16)
    best = scores[starts[:active[0]]].copy()
    final = np.zeros((len(lengths), k), np.float32)
    final[:active[0]] = best
    for t in range(1, longest):
        a = active[t]
        best = best[:a]
        top = best.argmax(1)
        moved = best[np.arange(a), top] - switch
        stay = best >= moved[:, None]
        at = starts[:a] + t
        came[at] = np.where(stay, own, top[:, None])
        best = np.where(stay, best, moved[:, None]) + scores[at]
        best -= best.max(1, keepdims=True)
        final[:a] = best
    state = final.argmax(1)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        out[at] = state[:a]
        state[:a] = came[at, state[:a]] if t else state[:a]
    return out


def _cut(text: str) -> list[tuple[int, int]]:
    """Places of the words of a text in lower case."""
    found = [m.span() for m in _WORD.finditer(text)]
    if not text.isascii():  # other numerals are word characters, too
        found = [(s, e) for s, e in found if text[s].isalpha() or any(map(str.isalpha, text[s:e]))]
    return found


def label(texts: list[str | None], known: Scores) -> Iterator[tuple[list[tuple[int, int, int, int]], float]]:
    """Spans (start, end, language place, letters) and evidence of each text, whole texts."""
    lows: list[str] = []
    lengths: list[int] = []
    words: list[str] = []
    for text in texts:
        low = (text or "").lower()
        if len(low) != len(text or ""):  # the few letters whose lower case is longer stay, so that places hold
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        if _BEYOND.search(low):
            found = [w for w in _WORD.findall(low) if w[0].isalpha() or any(map(str.isalpha, w))]  # other numerals are word characters, too
        else:
            found = _PLAIN_WORD.findall(low)
        lows.append(low)
        lengths.append(len(found))
        words += found
        if len(words) >= BLOCK_WORDS:
            yield from _flush(lows, lengths, words, known)
            lows, lengths, words = [], [], []
    yield from _flush(lows, lengths, words, known)


def _flush(lows: list[str], lengths: list[int], words: list[str], known: Scores) -> Iterator[tuple[list[tuple[int, int, int, int]], float]]:
    best, fits = np.zeros(0, np.int16), np.zeros((0, 2))
    if words:
        scores, evidence = known.of(words)
        best = viterbi(scores, np.array(lengths, np.int64))
        fits = np.column_stack([evidence[np.arange(len(best)), best], evidence[:, -1]])
    sums = np.concatenate([[[0.0, 0.0]], np.cumsum(fits, axis=0, dtype=np.float64)])
    before = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    at = 0
    for low, n in zip(lows, lengths):
        lang = best[at:at + n]
        turns = np.flatnonzero(lang[1:] != lang[:-1]) + 1
        if not n:
            yield [], 0.0
            continue
        of_text = sums[at + n] - sums[at]
        fit = float(of_text[0] / max(of_text[1], 1.0))
        if not len(turns):  # one language: from the first word to the end of the last
            last = words[at + n - 1]
            yield [(low.find(words[at]), low.rfind(last) + len(last), int(lang[0]), int(before[at + n] - before[at]))], fit
        else:
            places, cuts = _cut(low), [0, *turns.tolist(), n]
            yield [(places[a][0], places[b - 1][1], int(lang[a]), int(before[at + b] - before[at + a])) for a, b in zip(cuts, cuts[1:])], fit
        at += n


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())]))
FIELDS = [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_evidence", DoubleType()), StructField("lang_spans", SPANS)]


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``lang_score`` (share of the letters in that
    language), ``lang_evidence`` and, if asked for, ``lang_spans`` (start, end,
    lang)."""
    packed = docs.sparkSession.sparkContext.broadcast(model)
    fields = FIELDS if spans else FIELDS[:3]

    def make():
        known = Scores(packed.value)
        langs = known.model.langs

        def work(texts: list) -> list:
            if not langs:
                return [["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [[] for _ in texts]][:len(fields)]
            pred, share, fits, out = [], [], [], []
            for found, fit in label(texts, known):
                letters = np.zeros(len(langs))
                for _, _, k, n in found:
                    letters[k] += n
                k = int(letters.argmax())
                pred.append(langs[k] if found else "und")
                share.append(float(letters[k] / letters.sum()) if found else 0.0)
                fits.append(fit if found else None)
                out.append([{"start": s, "end": e, "lang": langs[k]} for s, e, k, _ in found])
            return [pred, share, fits, out][:len(fields)]
        return work

    return add_columns(docs, [text], fields, make, rows=4096)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.select("doc_id", "text", "lang").where(~held_out("doc_id", 5, 0) & F.col("doc_id").isNotNull()))
    out = identify(docs.select("doc_id", "text"), model, spans=False).drop("text")
    # the share of the letters, as far as the language fits them at all
    fit = 1 / (1 + F.exp(-2 * (F.coalesce("lang_evidence", F.lit(0.0)) - LEAST_EVIDENCE)))
    return out.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", (F.col("lang_score") * fit).alias("score"), "lang_evidence")
