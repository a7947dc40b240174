import random

import xxhash

from riskfold.llm import simhash
from riskfold.llm.components import connected_components


def slow(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_equals_the_definition():
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(rnd.choice("ab ÀÉ\tXy\n c ") for _ in range(rnd.randint(0, 60)))
        assert simhash.fingerprint(t) == slow(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_links_and_components_equal_brute_force(spark):
    rnd = random.Random(3)
    prints = []
    for _ in range(40):
        p = rnd.getrandbits(64)
        prints.append(p)
        for _ in range(rnd.randint(0, 5)):
            for _ in range(rnd.randint(0, 4)):
                p ^= 1 << rnd.randrange(64)
            prints.append(p)
    prints = list(dict.fromkeys([*prints, 0, 1, (1 << 64) - 1]))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).distinct().collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if 0 < (prints[i] ^ prints[j]).bit_count() <= 3}
    assert found == want


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(200 + i, 200 + (i + 1) % 20) for i in range(20)] + [(5, 5), (300, 299), (300, 299)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {200 + i: 200 for i in range(20)} | {299: 299, 300: 299}
    assert {k: v for k, v in want.items() if k != v} == {k: v for k, v in roots.items() if k != v}


def test_edges(clashing, nothing):
    found = simhash.near_duplicates(clashing).collect()
    assert len(found) == clashing.count()
    by = {r.doc_id: r.component_id for r in found}
    assert by[8] == by[1] == 1 and by[3] == by[4] == by[2] == 2
    kept = simhash.keep_first(clashing)
    assert kept.columns == clashing.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 8 not in ids and ids.count(11) == 1 and ids.count(1) == 1 and ids.count(2) == 1 and None in ids
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_nothing_that_grows_with_the_texts_is_broadcast(spark, tmp_path):
    """Spark sizes the 66 probes of a fingerprint as one row: under its default
    threshold they used to be collected and broadcast."""
    path = str(tmp_path / "prints")
    spark.range(2000).selectExpr("id * 1000003 as fp").write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        found = simhash.links(spark.read.parquet(path))
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
