import random

import numpy as np
import xxhash

from leafmill.llm import simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, codes, radius=2):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    return {(ids[i], min(ids[j] for j in range(len(ids)) if label[j] == label[i])) for i in range(len(ids))}


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = " ".join(rng.choice(["The", "a", "Éa", "x1", "of"]) + str(rng.randrange(9)) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def planted(rng, groups=30, spread=12):
    codes = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        codes.append(base)
        for _ in range(spread):
            x = rng.choice(codes[-4:])
            for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                x ^= 1 << b
            codes.append(x)
    return codes


def test_gray_ranks_follow_the_gray_sequence():
    i = np.arange(1 << 12, dtype=np.uint64)
    assert (simhash.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


def test_index_finds_all_links(spark):
    rng = random.Random(3)
    codes = list(dict.fromkeys([0, *planted(rng)]))
    frame = spark.createDataFrame([(int(np.uint64(c).astype(np.int64)),) for c in codes], "code long")
    want = brute_components(list(range(len(codes))), codes)
    for crowded in (20_000, 3):  # the second deals every bucket again
        edges = [(int(np.int64(r["a"]).astype(np.uint64)), int(np.int64(r["b"]).astype(np.uint64))) for r in simhash.near_links(frame, 2, crowded).collect()]
        assert all(bin(a ^ b).count("1") <= 2 * len(codes) for a, b in edges)
        label = {c: c for c in codes}

        def root(x):
            while label[x] != x:
                x = label[x]
            return x

        for a, b in edges:
            label[root(a)] = root(b)
        groups = {}
        for i, c in enumerate(codes):
            groups.setdefault(root(c), []).append(i)
        assert {(i, min(g)) for g in groups.values() for i in g} == want


def test_components_match_brute_force(docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(1000, ""), (1001, None), (1002, " \n")]
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([1, 2, 5, 200]))]
        for c in range(4):
            own = list(base)
            if c > 1:
                own[rng.randrange(len(own))] = "changed"
            rows.append((g * 10 + c, " ".join(own)))
    rows.append(rows[-1])
    out = simhash.components(docs(rows))
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out.collect()]
    codes = [brute_fingerprint(t or "") for _, t in rows]
    assert sorted(x[:2] for x in got) == sorted((i, f"{c:016x}") for (i, _), c in zip(rows, codes))
    assert {(a, b) for a, _, b in got} == brute_components([i for i, _ in rows], codes)
    kept = simhash.dedup(docs([*rows, (None, "a b c"), (None, "a b c")]))
    roots = {b for _, _, b in got}
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(roots)
    assert kept.where("doc_id is null").count() == 2 and kept.columns == docs([(1, "")]).columns


def test_star_rounds_on_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {(r["node"], r["root"]) for r in simhash.connected(chain).collect()}
    assert got == {(i, 0) for i in range(1, 61)} | {(101, 100)}


def test_a_unique_text_of_a_repeated_id_stays(docs, untouched):
    a, b = "one two three four five six seven", "other words that are not alike at all here"
    kept = simhash.dedup(docs([(3, a), (5, a), (5, b), (5, b)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, a), (5, b)]
    untouched(kept)


def test_ranks_of_wide_codes():
    rng = random.Random(2)
    codes = [rng.getrandbits(128) for _ in range(500)]

    def rank(x):
        for s in (1, 2, 4, 8, 16, 32, 64):
            x ^= x >> s
        return x

    got = simhash.gray_rank(np.array([[c >> 64, c & (1 << 64) - 1] for c in codes], np.uint64))
    assert [(int(a) << 64) | int(b) for a, b in got] == [rank(c) for c in codes]


def test_forest_of_a_dense_bucket(monkeypatch):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, (600, 2), np.uint64)
    codes[100:500] = codes[100] ^ (np.uint64(1) << rng.integers(0, 60, (400, 2)).astype(np.uint64))
    bucket = np.repeat([4, 9], 300)
    label = {k: k for k in range(600)}
    for i in range(600):
        for j in range(i):
            if bucket[i] == bucket[j] and label[i] != label[j] and np.bitwise_count(codes[i] ^ codes[j]).sum() <= 3:
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    for reach in (simhash.REACH, 50):
        monkeypatch.setattr(simhash, "REACH", reach)
        a, b = simhash.forest(codes, bucket, 3)
        root = {k: k for k in range(600)} | dict(zip(a.tolist(), b.tolist()))
        groups = {}
        for k in range(600):
            groups.setdefault(root[k], set()).add(k)
        want = {}
        for k, v in label.items():
            want.setdefault(v, set()).add(k)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_empty_table(docs):
    none = docs([(1, "a")]).where("false")
    assert simhash.components(none).count() == 0 and simhash.dedup(none).count() == 0
