import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from riskfold.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.WordBpe(PATH), Tokenizer.from_file(PATH)


def ids(lib, text):
    return lib.encode(text, add_special_tokens=False).ids


def test_same_ids_as_the_library(both):
    own, lib = both
    rnd = random.Random(5)
    for n in range(1500):
        t = [lambda: "".join(chr(rnd.choice([rnd.randrange(1, 0x250), rnd.randrange(0x300, 0x700), rnd.randrange(0x3000, 0x3100), rnd.randrange(0x1F300, 0x1F700)])) for _ in range(30)),
             lambda: "".join(rnd.choice("abcdeirnstlo") for _ in range(rnd.randint(1, 900))),
             lambda: "".join(rnd.choice(["er", "in", "the", "ing", "tion", "s", "t"]) for _ in range(rnd.randint(50, 600))),
             lambda: rnd.choice(["a", "ab", "aab", "!?", "é"]) * rnd.randint(1, 400),
             lambda: "".join(rnd.choice("it's they're <|endoftext|> 've I'LL 1234 ΣΑΣ İi \x1c\x85 ") for _ in range(60)),
             lambda: " ".join(rnd.choice(["<|startoftext|>", "<|endoftext|>", "don't", "WE'VE", "½²", "Ⅷ", "१२"]) for _ in range(10))][n % 6]()
        assert own.encode(t) == ids(lib, t), t
        assert own.decode(ids(lib, t)) == lib.decode(ids(lib, t), skip_special_tokens=False)


def test_joins_equal_one_pass(both):
    own, _ = both
    rnd = random.Random(9)
    for _ in range(200):
        s = own.symbols("".join(rnd.choice("aabeinrst") for _ in range(rnd.randint(2, 400))))
        k = rnd.randrange(1, len(s))
        assert own.join(s[:k], own.merge(s[:k]), s[k:], own.merge(s[k:])) == own.merge(s) == own.tree(s)


def test_long_texts_in_parts_equal_whole_texts(spark, both):
    own, lib = both
    rnd = random.Random(2)
    rows = [(1, "x".join(rnd.choice(["the", "er", "on"]) for _ in range(400)) + " it's <|endoftext|> " + "word " * 50), (2, "short one"), (2, None), (None, ""), (3, "a" * 3000), (3, "a" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bpe.digests(df, PATH, part=100).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.digests(df, PATH).collect()))
    want = sorted(len(ids(lib, t or "")) for _, t in rows)
    assert sorted(r.n_tokens for r in got) == want
    coded = bpe.decode(bpe.encode(df, PATH, part=100), PATH).collect()
    assert all(r.decoded == lib.decode(ids(lib, r.text or ""), skip_special_tokens=False) for r in coded)


def test_edges(clashing, nothing, both):
    _, lib = both
    out = bpe.encode(clashing, PATH).collect()
    assert len(out) == clashing.count() and all(r.ids == ids(lib, r.text or "") and r.score == "mine" for r in out)
    assert bpe.digests(nothing.select("doc_id", "text"), PATH).count() == 0


def test_every_code_point_equals_the_library():
    """All code points up to U+33480 between letters, after a blank and after a
    letter that marks combine with."""
    ours, lib = bpe.WordBpe(PATH), Tokenizer.from_file(PATH)
    points = [chr(i) for i in range(1, 0x33480) if not 0xD800 <= i < 0xE000]
    for form in ("a{0}b", " {0}", "é{0}̣x"):
        for lo in range(0, len(points), 512):
            block = points[lo:lo + 512]
            texts = [form.format(c) for c in block]
            want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
            assert [ours.encode(t) for t in texts] == want, form
