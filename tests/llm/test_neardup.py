import random
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from leafmill.llm import neardup


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def brute_groups(rows):
    label = {i: i for i, _ in rows}
    for i, a in rows:
        for j, b in rows:
            if j < i and label[i] != label[j] and (a.split() == b.split() or a and b and jaccard(a, b) >= 0.8):
                x, y = sorted((label[i], label[j]))
                label = {k: x if v == y else v for k, v in label.items()}
    return label


def test_stage_keeps_one_of_each_group_at_similarity_08(spark, docs):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 100, 300]))]
        for c in range(4):
            own = list(base)
            for _ in range(c * max(1, len(base) // 100)):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((g * 10 + c, " ".join(own)))
    # a chain: neighbours are near, the ends aren't
    link = [rng.choice(words) for _ in range(200)]
    for c in range(6):
        rows.append((900 + c, " ".join(link)))
        link[c * 30 : c * 30 + 10] = [rng.choice(words) for _ in range(10)]
    rows += [(990, ""), (991, " ")]
    label = brute_groups(rows)
    assert len({label[900 + c] for c in range(6)}) == 1 and jaccard(rows[-3][1], rows[-8][1]) < 0.8
    kept = corpus_pipeline.near_dedup(spark, docs([*rows, rows[5], (None, rows[0][1])]), "")
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted(set(label.values()))
    assert kept.where("doc_id is null").count() == 1
    none = docs([(1, "a")]).where("false")
    assert corpus_pipeline.near_dedup(spark, none, "").count() == 0


def test_tables_and_radius_find_pairs_at_the_threshold():
    rng = np.random.default_rng(2)
    met = 0
    masks = np.array(neardup.tables(200_000), np.uint64)
    for _ in range(1000):
        h = rng.integers(0, 1 << 63, 180, np.uint64)
        x = neardup.fingerprint(h[:162]) ^ neardup.fingerprint(h[18:])
        met += bool(((x & masks) == 0).all(1).any() and np.bitwise_count(x).sum() <= neardup.RADIUS)
    assert met >= 930  # similarity 144 / 180 = 0.8


def test_large_groups_in_rounds(docs):
    """The rounds over the cluster give the groups that one task gives, also where blocks hold a few texts only."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for d in range(40):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append((d, " ".join(own)))
    label = brute_groups(rows)
    assert 3 < len(set(label.values())) < 35
    own = docs([*rows, rows[0]])
    for options in ({"hot": 400, "block": 300}, {"crowded": 2}):
        kept = neardup.dedup(own, **options)
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label.values())), options


def test_rows_of_one_id(docs, untouched):
    a, b = "one two three four five six seven", "other words that are not alike at all here"
    kept = neardup.dedup(docs([(3, a), (5, a), (5, b), (5, b)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, a), (5, b)]
    untouched(kept)


def test_a_worker_holds_the_words_of_one_text():
    text = " ".join(f"word{i}" for i in range(500))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(range(4000)), pa.array([text] * 4000)], names=["doc_id", "hash", "text"])
    tracemalloc.start()
    n = sum(b.num_rows for b in neardup.printed(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the batch has 15 MB of text, and its words would take 100
    assert n == 4000 and peak < 20e6
