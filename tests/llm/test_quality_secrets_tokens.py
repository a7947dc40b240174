import random
import hashlib
import heapq
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from riskfold.llm import quality, secrets, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def slow_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    again = {j for places in at.values() if len(places) > 1 for i in places for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), len(w) < 50 or 100 * len(again) > 50 * len(w)


def test_quality_edges(spark, clashing, nothing):
    extra = spark.createDataFrame([(50, "a b a b a b a b"), (51, "x\n x\nx\n\n"), (52, " # a*b $ %&|<>"), (53, "one two three " * 40)], "doc_id long, text string")
    out = quality.judge(clashing.unionByName(extra, allowMissingColumns=True)).collect()
    assert len(out) == clashing.count() + 4
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == slow_quality(r.text), r.text
        assert r.kept == (not r.base_failed and not r.failed_rules) and r.score in ("mine", None)
    assert quality.judge(nothing).count() == 0


def test_quality_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(quality.SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = quality.op9_quality_rules(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert all((got[c] == want[c]).all() for c in want.columns) and len(got) == len(want)


def test_secrets_against_a_plain_search(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").toPandas()
    got = secrets.op6_secrets(spark, sf.replace("0.001", "0.01")).toPandas()
    text = dict(zip(docs.doc_id, docs.text))
    for r in got.itertuples():
        assert hashlib.sha256(text[r.doc_id][r.start:r.end].encode()).hexdigest() == r.value_sha256
    plain = re.compile(r'(AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{18}|(?<=token = ")[0-9a-f]{40}|(?<=TOKEN = ")[0-9A-F]{40})')
    want = {(i, *m.span(1)) for i, t in text.items() for m in plain.finditer(t)}
    assert {(r.doc_id, r.start, r.end) for r in got.itertuples()} == want


def test_secrets_edges(spark, clashing, nothing):
    clean = clashing.drop("kept")
    out = secrets.redact(clean).collect()
    assert len(out) == clean.count()
    seven = next(r for r in out if r.doc_id == 7)
    assert seven.text.count(secrets.MASK) == 3 and seven.score == "mine"
    assert sorted(r.text or "" for r in out if r.doc_id != 7) == sorted(r.text or "" for r in clean.collect() if r.doc_id != 7)
    assert secrets.scan(nothing).count() == 0 and secrets.redact(nothing).count() == 0
    many = spark.createDataFrame([(1, "é " * 50 + 'key = "A1b2C3d4E5f6G7h8I9" ' * 300), (1, None)], "doc_id long, text string")
    spans = secrets.scan(many).collect()
    assert len({(r.start, r.end) for r in spans}) == len(spans)


def huffman_bits(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_code_is_optimal_and_limited():
    rnd = np.random.default_rng(2)
    for n in (2, 3, 10, 700):
        counts = rnd.zipf(1.5, n).clip(0, 5000)
        lengths = tokens.code_lengths(counts)
        assert (lengths * counts).sum() == huffman_bits(counts) and lengths.max() <= tokens.LIMIT
        short = tokens.code_lengths(counts, limit=10)
        assert short.max() <= 10 and abs(sum(2.0 ** -short.astype(float)) - 1) < 1e-9
        assert (short * counts).sum() >= huffman_bits(counts)
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144])
    best = min((sum(c * n for c, n in zip(sorted(fib)[::-1], ls)) for ls in _kraft(12, 4)), default=None)
    assert (tokens.code_lengths(fib, limit=4) * fib).sum() == best


def _kraft(n, limit):
    """Ascending length tuples that use up the code space."""
    def more(k, at, left):
        if k == 0:
            if left == 0:
                yield ()
            return
        for m in range(at, limit + 1):
            if 2 ** (limit - m) <= left:
                for rest in more(k - 1, m, left - 2 ** (limit - m)):
                    yield (m, *rest)
    return more(n, 1, 2 ** limit)


def test_shards_round_trip():
    rnd = np.random.default_rng(3)
    for n, docs in ((1, 1), (511, 3), (512, 1), (513, 2), (5000, 40)):
        ids = rnd.integers(0, 300, n)
        sizes = np.diff(np.sort(np.concatenate([[0, n], rnd.integers(0, n + 1, docs - 1)]))).tolist()
        code = tokens.Code(tokens.code_lengths(np.bincount(ids)))
        names, got, out = tokens.read_shard(code, tokens.write_shard(code, [None, *range(1, docs)], sizes, ids))
        assert names == [None, *range(1, docs)] and got.tolist() == sizes and (out == ids).all()


def test_pieces_equal_the_library():
    enc, lib = tokens.Encoder(BYTES), Tokenizer.from_file(BYTES)
    texts = ["it's  two\n\n spaces ", "a\x1cb \x85 ½ ², x_y __ 12ab", "ÀÉß ñandú", "<|endoftext|>a<|endoftext|>", "東京 ok", "", "  ", "\xa0x 　y"]
    for t, raw in zip(texts, enc.encode(texts, 2)):
        assert np.frombuffer(raw, enc.width).tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2], t


def test_pieces_equal_the_library_on_any_white_space():
    enc, lib, rnd = tokens.Encoder(BYTES), Tokenizer.from_file(BYTES), random.Random(8)
    letters = [" ", " ", " ", "\n", "\t", "\r", "\xa0", "\u2003", "\x1c", "\x85", "a", "Bc", "'s", "'", "é", "１", "12", "_", "-", "東", "\u0301", "😀", "<|endoftext|>"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 14))) for _ in range(4000)]
    for t, raw in zip(texts, enc.encode(texts, 2)):
        assert np.frombuffer(raw, enc.width).tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2], repr(t)


def test_long_pieces_are_not_held():
    enc = tokens.Encoder(BYTES)
    enc.encode(["x" * 5000 + " " + "é" * 5000, "short words"], 2)
    assert max(map(len, enc.pieces)) <= tokens.KEPT_CHARS


def test_the_smallest_id_is_no_null(spark):
    df = spark.createDataFrame([(-(1 << 63), "a"), (None, "b"), (5, None)], "doc_id long, text string")
    assert [r.doc_id for r in sorted(tokens.round_trip(df, BYTES, 2).collect(), key=lambda r: r.start)] == [None, -(1 << 63), 5]


def test_round_trip_edges(spark, clashing, nothing, monkeypatch):
    monkeypatch.setattr(tokens, "SHARD_IDS", 50)
    monkeypatch.setattr(tokens, "PART_IDS", 5000)
    out = tokens.round_trip(clashing, BYTES, 2).collect()
    lib = Tokenizer.from_file(BYTES)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0), [*lib.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in clashing.collect())
    at, want = 0, []
    for (known, i), ids in rows:
        want.append((i if known else None, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert tokens.round_trip(nothing, BYTES, 2).count() == 0
