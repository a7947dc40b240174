import random
import re

from riskfold.llm import pii


def plain(text):
    """The base patterns as written, without shortcuts."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(3)
    for _ in range(5000):
        t = "".join(rnd.choice("0123456789..--@@ ab+()A\n") for _ in range(rnd.randint(1, 60)))
        assert pii.base_spans(t) == plain(t)


def test_long_runs_stay_linear():
    for t in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" + " " * 200_000, "a" * 200_000 + "@"):
        pii.base_spans(t)


def texts():
    rnd = random.Random(1)
    for n in range(60):
        card = "45320151128303" + f"{n:02d}"
        card = next(card[:-1] + str(d) for d in range(10) if pii.luhn(card[:-1] + str(d)))
        yield f"words an{n} b{rnd.choice('xyz')}{n}.{n}@mail{n % 9}.example.com then +1 ({200 + n}) 555-{1000 + n} and 10.{n}.3.{n} with {card} end"


def test_field_adds_spelled_and_respaced_values_only():
    weights = pii.fit([t[a:b] for t in texts() for a, b in pii.islands(t)][:40], epochs=3)
    base, added = pii.all_spans("call 269-555-3296 now", weights, 2.0)
    assert base == [] and [k for k, _, _ in added] == ["phone"]
    assert pii.all_spans("on 2024-01-15 at 10:30 version 1.2.3 cost 45", weights, 2.0) == ([], [])
    t = "mail bob.smith (at) mail7.example.com please"
    assert [(k, t[s:e]) for k, s, e in pii.all_spans(t, weights, 2.0)[1]] == [("email", "bob.smith (at) mail7.example.com")]


def test_decode_is_the_best_segmentation():
    weights = pii.fit([t[a:b] for t in texts() for a, b in pii.islands(t)][:20], epochs=1)
    island = pii.Island("x 10.1.2.3 y")
    scored = island.scored(weights)

    def best(j, last):
        """Brute force over all segmentations from atom j on."""
        if j == island.n:
            return 0.0
        top = best(j + 1, "")
        for e in range(j + 1, island.n + 1):
            for i, kind, s in scored[e]:
                if i == j:
                    top = max(top, s + weights.get(f"{last}>{kind}", 0.0) + best(e, kind))
        return top

    got, last, end = 0.0, "", 0
    for kind, s, e, score in pii.decode(island, weights):
        got += score + weights.get(f"{last if end == s else ''}>{kind}", 0.0)
        last, end = kind, e
    assert abs(got - best(0, "")) < 1e-9


def test_edges(spark, clashing, nothing):
    out = pii.digests(pii.find(clashing.select("doc_id", "text", "base_spans"), {})).collect()
    assert len(out) == clashing.count()
    six = next(r for r in out if r.doc_id == 6)
    assert (six.n_email, six.n_ip, six.n_card, six.n_phone, six.n_added) == (1, 1, 1, 1, 0)
    assert sorted(r.base_sha256 for r in out) == sorted(pii.base_digest(r.text or "") for r in clashing.collect())
    assert pii.train(nothing) == {}
    assert pii.digests(pii.find(nothing, {})).count() == 0


def _whole_table(island, weights):
    """The same dynamic program over a full table of segments and states."""
    import math
    none = len(pii.KINDS)
    trans = [[weights.get(f"{a}>{b}", 0.0) for b in pii.KINDS] for a in (*pii.KINDS, "")]
    best = [[(-math.inf, None)] * (none + 1) for _ in range(island.n + 1)]
    best[0][none] = (0.0, [])
    for j, at in enumerate(island.scored(weights)):
        if j:
            best[j][none] = max(best[j - 1], key=lambda x: x[0])
        for i, kind, s in at:
            k = pii.KINDS.index(kind)
            for q in range(none + 1):
                if best[i][q][0] + s + trans[q][k] > best[j][k][0]:
                    best[j][k] = (best[i][q][0] + s + trans[q][k], best[i][q][1] + [(kind, island.cuts[i], island.cuts[j], s)])
    return max(best[-1], key=lambda x: x[0])[1]


def test_horizon_decode_equals_the_whole_table():
    rnd = random.Random(6)
    parts = ["1", "22", "333", "4444", ".", "-", " ", "  ", "+", "(", ")", "@", "at", "dot", "a", "bob", "é", "½", "٣", "_", ",", "com", "4532015112830366", "10.2.3.4"]
    for n in range(400):
        island = pii.Island("".join(rnd.choices(parts, k=rnd.randint(1, 60))))
        weights = {}
        for at in island.by_end:
            for _, kind, f in at:
                for x in f:
                    weights.setdefault(x, rnd.uniform(-1, 1))
        weights |= {f"{a}>{b}": rnd.uniform(-1, 1) for a in (*pii.KINDS, "") for b in pii.KINDS}
        assert pii.decode(pii.Atoms(island.text), weights) == _whole_table(island, weights), n


def test_a_long_text_of_numbers_is_bounded_in_memory_and_linear_in_time():
    import time
    import tracemalloc
    weights, spent = {"phone|b": 0.1}, []
    for size in (100_000, 400_000):
        text = "1,2,3,4.5 " * (size // 10)
        began = time.process_time()
        pii.decode(pii.Atoms(text), weights)
        spent.append(time.process_time() - began)
    assert spent[1] < 7 * spent[0]
    text = "1,2,3,4.5 " * 100_000     # a million characters
    tracemalloc.start()
    pii.Atoms(text)
    base = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert base < 20_000_000 and 5 * len(text) * 2 < 100_000_000
