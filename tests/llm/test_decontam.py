import random

from leafmill.llm import decontam


def brute(text, item, run=20, identity=0.8, least=8):
    a, b = decontam.tokens((item or "").encode()).tolist(), decontam.tokens((text or "").encode()).tolist()
    if not a:
        return False
    need = min(run, len(a))
    for d in range(-len(a), len(b)):
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        same = [a[i] == b[i + d] for i in range(lo, hi)]
        if any(sum(same[i : i + need]) >= (need if len(a) < least else identity * need) for i in range(len(same) - need + 1)):
            return True
    return False


def test_substitutions_are_tolerated(docs, spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((60, 25, 12, 8, 9, 5, 40))]
    items += [(7, None), (8, ""), (9, items[0][1])]
    rows, must = [], set()
    for d in range(60):
        own = [rng.choice(words) for _ in range(rng.choice([3, 40, 400]))]
        i = rng.randrange(7)
        part = items[i][1].split()
        changes = d % 4
        if changes < 3:
            # up to what the rule accepts
            for at in rng.sample(range(len(part)), changes * decontam.allowed(len(part), 0.8) // 2):
                part[at] = "Changed!"
            at = rng.randrange(len(own) + 1)
            own[at:at] = [p.upper() + "," if d % 2 else p for p in part]
        rows.append((d, " ".join(own)))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, t in rows for i, x in items if brute(t, x)}
    assert len(want) > 25
    for shard in (10**6, 40):
        got = [(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(rows), bench, shard_tokens=shard).collect()]
        assert set(got) == want
        assert got.count((102, 0)) == 2 and got.count((102, 9)) == 2
        kept = decontam.decontaminate(docs(rows), bench, shard_tokens=shard)
        bad = {d for d, _ in want}
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _ in rows if d not in bad)
        assert kept.columns == docs(rows).columns


def test_every_accepted_substitution_is_found():
    rng = random.Random(6)
    for n in [*range(1, 24), 30, 40]:
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        shard = decontam.Shard([" ".join(words).encode()])
        window = min(n, 20)
        for _ in range(150):
            own = list(words)
            at = rng.randrange(n - window + 1)
            for i in rng.sample(range(window), decontam.allowed(window, 0.8) if n >= 8 else 0):
                own[at + i] = "x"
            # beyond the window nothing agrees
            own = [w if at <= i < at + window else "y" for i, w in enumerate(own)]
            h = decontam.tokens(" ".join(["a", "b", *own, "c"]).encode())
            assert [m[0] for m in shard.matches(h)] == [0], (n, own)


def test_repeated_words_and_ties():
    shard = decontam.Shard([b"same " * 30])
    h = decontam.tokens(b"same " * 20_000)
    assert shard.matches(h) == [(0, 0, 30, 30)]
    # equal alignments at two places: the first counts
    item = " ".join(f"w{i}" for i in range(12))
    shard = decontam.Shard([item.encode()])
    assert shard.matches(decontam.tokens(f"a {item} b {item}".encode())) == [(0, 1, 12, 12)]


def test_empty_tables(docs, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    own = docs([(1, "a b c d e f g h i j k l m")])
    assert decontam.contaminated(own.where("false"), bench).count() == 0
    assert decontam.decontaminate(own, bench.where("false")).count() == 1
    assert decontam.contaminated(own, bench.where("false")).count() == 0
