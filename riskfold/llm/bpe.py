"""BPE encoding and decoding with tree concatenation.

A text is normalised and cut to pieces as the tokenizer file says (NFC, white
space, lower case; contractions, letter runs, single digits, mark runs), each
piece becomes byte symbols of which the last carries the word end, and the
lowest-ranked pair merges first, leftmost on ties.

Long unsplit text is encoded as a tree: halves on their own, then at each join
a window that grows on both sides is encoded again until its first and last
token are the tokens that stood there before.  Tokens whose neighbours merge
to themselves form the one valid encoding, so an agreeing window makes the
whole exact.  Inside a task the leaves have ``LEAF`` symbols; a text of more
than ``PART`` characters is also spread over tasks: its pieces are dealt out
in parts (a piece longer than a part is cut in halves until it fits), encoded
in parallel and joined per text.

Null text encodes like the empty text: no ids.  Every row is encoded by
itself: repeated rows, null ids and ties need no rule; an empty table gives an
empty result.  Output columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from riskfold.llm.common import add_columns, documents, without

LEAF, PART = 64, 1 << 20
NEVER = 1 << 60
CACHED = 100_000
_LATE = re.compile("[\u0558-\U0010ffff]")
_MARKS = re.compile("[\u0300-\U0010ffff]")

#: The library's tables are those of Unicode 16.  (first, count) of the letters and numbers that later
#: versions assigned; they count as marks.
LATER = (
    (0x558, 1), (0x58b, 2), (0x88f, 1), (0xc5c, 1), (0xcdc, 1), (0x208f, 1), (0x209d, 3), (0xa7ce, 2), (0xa7d2, 1), (0xa7d4, 1),
    (0xa7dd, 1), (0xa7e2, 1), (0xa7f1, 1), (0xab6c, 2), (0x107bb, 5), (0x10940, 26), (0x10ec5, 3), (0x10ed9, 22), (0x11b0a, 1),
    (0x11db0, 44), (0x11df1, 1), (0x16ea0, 25), (0x16ebb, 25), (0x16ff2, 2), (0x187f8, 8), (0x18cd6, 5), (0x18d09, 24),
    (0x18d80, 115), (0x18e00, 914), (0x191a0, 51), (0x1b123, 6), (0x1b168, 1), (0x1d6a6, 1), (0x1df1f, 6), (0x1df2b, 87),
    (0x1df90, 7), (0x1dfcd, 51), (0x1e6c0, 31), (0x1e6e0, 3), (0x1e6e4, 2), (0x1e6e7, 7), (0x1e6f0, 5), (0x1e6fe, 2),
    (0x2b73a, 6), (0x2b81e, 1), (0x2cea2, 12), (0x323b0, 4298), (0x3d000, 11328),
    (0x11de0, 10), (0x1246f, 1), (0x12475, 11), (0x12550, 311), (0x16ff4, 3),
)
#: Lower-case letters that the library knows and Python's tables lack.
LOWER = {
    0x1c89: 0x1c8a, 0xa7cb: 0x264, 0xa7cc: 0xa7cd, 0xa7ce: 0xa7cf, 0xa7d2: 0xa7d3, 0xa7d4: 0xa7d5, 0xa7da: 0xa7db, 0xa7dc: 0x19b,
} | {0x10d50 + i: 0x10d70 + i for i in range(22)} | {0x16ea0 + i: 0x16ebb + i for i in range(25)}


def byte_letters() -> list[str]:
    """The letter of each byte in byte-level vocabularies: printable bytes are
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class WordBpe:
    """Vocabulary, merges and piece cache of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["normalizer"]["normalizers"]
        if model["type"] != "BPE" or [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: a word-end BPE file with NFC, white space and lower case steps is needed")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        self.pairs: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.names = {i: t for t, i in (vocab | special).items()}
        self.decimal = {i: str(i) for i in self.names}
        self.length = {i: len(t.removesuffix(end)) for t, i in vocab.items()}  # symbols of a token
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.cache = Pieces(self)
        from tokenizers import normalizers
        self.compose = normalizers.NFC().normalize_str

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Lists of pieces between special tokens, and the ids of those."""
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                yield self.special[part]
            elif part:
                if _MARKS.search(part):  # letters before U+0300 are composed already; the library knows its own marks
                    part = self.compose(part).replace("Σ", "σ")  # no final-letter rule
                yield self._cut(part.lower())

    def _cut(self, text: str) -> list[str]:
        """Pieces by the file's pattern, with the letters of Unicode 16."""
        if _LATE.search(text):
            text = text.translate(LOWER)
            new = {c for c in set(text) if any(a <= ord(c) < a + n for a, n in LATER)}
            if new:
                known = text.translate({ord(c): "\xa4" for c in new})
                return [text[m.start():m.end()] for m in self.cut.finditer(known)]
        return self.cut.findall(text)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.pieces(text):
            if isinstance(part, int):
                out.append(part)
            else:
                out += chain.from_iterable([self.cache[p] for p in part])
        self.cache.turn()
        return out

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode()
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def merge(self, symbols: list[int]) -> list[int]:
        """Lowest rank first, leftmost on ties."""
        out, find = list(symbols), self.pairs.get
        ranks = [find(a << 20 | b, NEVER) for a, b in zip(out, out[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            out[i] = low & 0xFFFFF
            del out[i + 1], ranks[i]
            if i:
                ranks[i - 1] = find(out[i - 1] << 20 | out[i], NEVER)
            if i < len(ranks):
                ranks[i] = find(out[i] << 20 | out[i + 1], NEVER)
        return out

    def tree(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF:
            return self.merge(symbols)
        half = len(symbols) // 2
        left, right = symbols[:half], symbols[half:]
        return self.join(left, self.tree(left), right, self.tree(right))

    def join(self, left: list[int], a: list[int], right: list[int], b: list[int]) -> list[int]:
        """Encoding of left + right (symbols) from the encodings a and b."""
        k = 2
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            n, m = sum(map(self.length.__getitem__, a[i:])), sum(map(self.length.__getitem__, b[:j]))
            window = left[len(left) - n:] + right[:m]
            new = self.merge(window) if len(window) <= 4 * LEAF or (i == 0 and j == len(b)) else self._wide(window)
            if (i == 0 or new[0] == a[i]) and (j == len(b) or new[-1] == b[j - 1]):
                return a[:i] + new + b[j:]
            k *= 2

    def _wide(self, window: list[int]) -> list[int]:
        """A window too long for one merge pass is a tree of its own."""
        return self.tree(window)

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file names no decoder."""
        return " ".join(map(self.names.__getitem__, ids))

    def digest(self, ids: list[int]) -> tuple[int, str, str]:
        text = " ".join(map(self.decimal.__getitem__, ids))
        return len(ids), hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()


class Pieces(dict):
    """Ids of the pieces seen lately; two generations bound the memory."""

    def __init__(self, bpe: WordBpe) -> None:
        super().__init__()
        self.bpe, self.old = bpe, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            symbols = self.bpe.symbols(piece)
            ids = tuple(self.bpe.tree(symbols))
        if len(piece) <= LEAF:
            self[piece] = ids
        return ids

    def turn(self) -> None:
        if len(self) > CACHED:
            self.old = dict(self)
            self.clear()


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def _parts(bpe: WordBpe, text: str, part: int) -> Iterator[tuple[list[str] | None, list[int] | None]]:
    """A long text as rows to encode in parallel: (pieces, None) for whole
    pieces, (None, symbols) for one part of a piece that is cut, an empty
    part closing it, and ([], [id]) for a special token."""
    for found in bpe.pieces(text):
        if isinstance(found, int):
            yield [], [found]
            continue
        held, size = [], 0
        for piece in found:
            if len(piece) > part:
                if held:
                    yield held, None
                held, size = [], 0
                symbols = bpe.symbols(piece)
                todo = [symbols]
                while todo:
                    x = todo.pop()
                    if len(x) <= part:
                        yield None, x
                    else:
                        todo += [x[len(x) // 2:], x[:len(x) // 2]]
                yield None, []
                continue
            held.append(piece)
            size += len(piece)
            if size >= part:
                yield held, None
                held, size = [], 0
        if held:
            yield held, None


def _encode_long(docs: DataFrame, path: str, text: str, part: int) -> DataFrame:
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.monotonically_increasing_id().alias("_k"), rest.alias("_row"), F.col(text).alias("_t"))

    def cut():
        bpe = loaded(path)

        def work(texts: list) -> list:
            return [[[{"pieces": p, "symbols": s} for p, s in _parts(bpe, t, part)] for t in texts]]
        return work

    def encode():
        bpe = loaded(path)

        def work(pieces: list, symbols: list) -> list:
            out = []
            for p, s in zip(pieces, symbols):
                if p is None:
                    out.append(bpe.tree(s) if s else [])
                else:
                    out.append([*(s or []), *chain.from_iterable([bpe.cache[x] for x in p])])
                bpe.cache.turn()
            return [out]
        return work

    def meet():
        bpe = loaded(path)

        def work(all_parts: list) -> list:
            out = []
            for parts in all_parts:
                ids: list[int] = []
                open_: list[tuple[list[int], list[int]]] = []  # symbols and ids of the piece that is still open
                for p in parts:
                    if p["pieces"] is not None:
                        ids += p["ids"]
                    elif p["symbols"]:
                        open_.append((p["symbols"], p["ids"]))
                    else:
                        while len(open_) > 1:  # join neighbours, level by level
                            open_ = [(x[0][0] + x[1][0], bpe.join(*x[0], *x[1])) if len(x) == 2 else x[0]
                                     for x in (open_[i:i + 2] for i in range(0, len(open_), 2))]
                        ids += open_[0][1]
                        open_ = []
                out.append(ids)
            return [out]
        return work

    part_type = "struct<pieces:array<string>,symbols:array<int>>"
    cut_rows = add_columns(keyed, ["_t"], [StructField("_parts", _type(docs.sparkSession, f"array<{part_type}>"))], cut, rows=1)
    dealt = cut_rows.select("_k", "_row", F.posexplode_outer("_parts").alias("_n", "_part"))
    dealt = dealt.select("_k", F.when(F.coalesce("_n", F.lit(0)) == 0, F.col("_row")).alias("_row"), "_n", "_part.pieces", "_part.symbols")
    dealt = dealt.repartition("_k", "_n")
    coded = add_columns(dealt, ["pieces", "symbols"], [StructField("ids", ArrayType(IntegerType()))], encode, rows=8)
    whole = coded.groupBy("_k").agg(F.first("_row", ignorenulls=True).alias("_row"),
                                    F.array_sort(F.collect_list(F.when(F.col("_n").isNotNull(), F.struct("_n", "pieces", "symbols", "ids")))).alias("_parts"))
    whole = add_columns(whole, ["_parts"], [StructField("ids", ArrayType(IntegerType()))], meet, rows=1)
    return whole.select("_row.*", "ids")


def _type(spark: SparkSession, ddl: str):
    from pyspark.sql.types import _parse_datatype_string
    return _parse_datatype_string(ddl)


def encode(docs: DataFrame, path: str, text: str = "text", part: int = PART) -> DataFrame:
    """``docs`` plus ``ids``, the token ids of the whole text."""
    own = docs if text == "ids" else without(docs, ["ids"])

    def make():
        bpe = loaded(path)
        return lambda texts: [[bpe.encode(t or "") for t in texts]]

    short = add_columns(own.where(F.coalesce(F.length(text), F.lit(0)) <= part), [text], [StructField("ids", ArrayType(IntegerType()))], make, rows=128)
    return short.unionByName(_encode_long(own.where(F.length(text) > part), path, text, part))


def decode(coded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``coded`` plus ``decoded``, the text of its ids (null ids: empty)."""

    def make():
        bpe = loaded(path)
        return lambda rows: [[bpe.decode(r or []) for r in rows]]

    return add_columns(coded, [ids], [StructField("decoded", StringType())], make, rows=128)


DIGEST = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]


def digests(docs: DataFrame, path: str, text: str = "text", part: int = PART) -> DataFrame:
    """``docs`` less the text plus the digests of ``encode`` and ``decode``;
    usual texts are encoded, decoded and digested in one pass."""

    def direct():
        bpe = loaded(path)
        return lambda texts: [list(x) for x in zip(*[bpe.digest(bpe.encode(t or "")) for t in texts])] or [[], [], []]

    def later():
        bpe = loaded(path)
        return lambda rows: [list(x) for x in zip(*[bpe.digest(r) for r in rows])] or [[], [], []]

    short = add_columns(docs.where(F.coalesce(F.length(text), F.lit(0)) <= part), [text], DIGEST, direct).drop(text)
    long = add_columns(_encode_long(docs.where(F.length(text) > part), path, text, part), ["ids"], DIGEST, later, rows=1).drop(text, "ids")
    return short.unionByName(long)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = os.environ.get("WORD_BPE_FILE") or public_tokenizers.path("word_bpe_49k.json")
    return digests(documents(spark, sf_dir).select("doc_id", "text"), path)
