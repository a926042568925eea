import io
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from leafmill.llm import ctw


def brute(rows, depth):
    """Sequential context-tree weighting by dictionaries."""
    out = {i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2 for i, _ in rows}
    words = Counter()
    ends, counts = 0, defaultdict(lambda: [0, 0])
    seqs = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = bytes(depth) + b" ".join(w) + b"\0"
        seqs.append((i, w, s))
        if not out[i]:
            words.update(w)
            ends += 1
            for at in range(depth, len(s)):
                for k in range(8):
                    prefix, bit = (s[at] >> (8 - k), k), s[at] >> (7 - k) & 1
                    for d in range(depth + 1):
                        counts[s[at - d : at], prefix][bit] += 1
    children = defaultdict(list)
    for c, p in counts:
        if c:
            children[c[1:], p].append((c, p))

    def kt(node):
        a, b = counts[node]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    memo = {}

    def pw(node):
        if node not in memo:
            if len(node[0]) == depth:
                memo[node] = kt(node)
            else:
                x, y = kt(node), sum(pw(c) for c in children[node])
                memo[node] = max(x, y) + math.log1p(math.exp(-abs(x - y))) - math.log(2)
        return memo[node]

    def prob(context, prefix, bit, d=0):
        node = (context[len(context) - d :], prefix)
        if node not in counts:
            return 0.5
        a, b = counts[node]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == depth:
            return own
        w = math.exp(kt(node) - math.log(2) - pw(node))
        return w * own + (1 - w) * prob(context, prefix, bit, d + 1)

    n, v = sum(words.values()) + ends, len(words) + (ends > 0)
    result = []
    for i, w, s in seqs:
        score = sum(math.log10(prob(s[at - depth : at], (s[at] >> (8 - k), k), s[at] >> (7 - k) & 1)) for at in range(depth, len(s)) for k in range(8))
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        result.append((i, out[i], len(w) + 1, sum(words[x] > 0 for x in w) + (ends > 0), n, base, score))
    return result


@pytest.mark.parametrize("block, hot", [(10**6, 0), (60, 20), (10**6, 10**6)])
def test_scores_match_brute_force(docs, monkeypatch, block, hot):
    monkeypatch.setattr(ctw, "HOT", hot)  # no context, some, all are dealt by a third byte
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "Cat", "cät", "runs", "of", "x"]) for _ in range(rng.randrange(12))) + "\n" * (i % 2)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, " \t"), (7, rows[7][1]), (None, "the cat")]
    got = ctw.score(docs(rows), 3, block).collect()
    want = brute(rows, 3)
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], abs=2e-4)


def test_no_rows_and_no_training_rows(docs):
    assert ctw.score(docs([(1, "a")]).where("false")).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = ctw.score(docs([(held, "ab cd")])).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == 0
    assert r["score"] == pytest.approx(-8 * 6 * math.log10(2))


def test_table():
    import numpy as np

    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**60, 5000, dtype=np.uint64))
    out = io.BytesIO()
    ctw.Table(keys, np.arange(1, len(keys) + 1, dtype=np.float32)).write(out)
    t, rest = ctw.Table.read(np.frombuffer(out.getvalue() + bytes(8), np.uint64))
    assert len(rest) == 1
    assert (t.get(keys) == np.arange(1, len(keys) + 1)).all()
    assert not t.get(np.setdiff1d(rng.integers(0, 2**60, 5000, dtype=np.uint64), keys)).any()
    assert not ctw.Table(keys[:0], np.zeros(0, np.float32)).get(keys).any()
