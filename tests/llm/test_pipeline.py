import random

import corpus_pipeline
from leafmill.llm import linededup, spiece
from tests.llm.test_decontam import brute as overlaps
from tests.llm.test_quality import brute as counts
from tests.llm.test_neardup import brute_groups


def line_ok(line):
    """The line rules again, in plain Python, for lines without boilerplate phrases."""
    bare = "".join(line.split())
    words = line.split()
    if not bare:
        return True
    symbols = sum(c in "#*$%&|<>{}\\^~=_" for c in line)
    separators = sum(set(w) <= set("|>/»›•·") for w in words)
    return not (symbols * 100 > len(bare) * 10 or separators >= 3 and separators * 100 >= len(words) * 25 or len(words) >= 12 and not any(c in ".!?;:,…" for c in line))


def test_stages_match_brute_force(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(900)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    bench = [(i, line(30)) for i in range(4)]
    rows = []
    for d in range(80):
        lines = [line(rng.randint(5, 25)) for _ in range(rng.choice([0, 1, 3, 8]))]
        if d % 5 == 0:
            lines.append("The same line on every page.")
        if d % 7 == 0:
            lines += ["a | b | c | d | e"] * rng.choice([1, 60])
        if d % 11 == 0:
            lines.append(bench[d % 4][1])
        rows.append([d, "\n".join(lines), "en", f"s{d % 2}", 0])
    for d in range(80, 100):
        rows.append([d, rows[d - 60][1], "en", rows[d - 60][3], 0])
    rows.append([100, None, None, None, None])
    for r in rows:
        r[4] = None if r[1] is None else len(r[1])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = {r[0]: (r[1] or "", r[3]) for r in rows}
    kept = {}
    for d, (text, source) in docs.items():
        n, chars, _, _, repeats = counts(text)
        clean = "\n".join(x for x in text.split("\n") if line_ok(x))
        if n >= 20 and 100 * repeats <= 30 * n and 100 * len("".join(clean.split())) >= 50 * chars:
            kept[d] = (clean, source)
    pages = {s: {kept[d][0] for d in kept if kept[d][1] == s} for s in ("s0", "s1")}
    share = {}
    for s, own in pages.items():
        for t in own:
            for x in {x.strip() for x in t.split("\n") if x.strip()}:
                share[s, x] = share.get((s, x), 0) + 1
    drop = {k for k, n in share.items() if n > 1 and n > linededup.MAX_RATIO * len(pages[k[0]])}
    assert drop
    kept = {d: "\n".join(x for x in t.split("\n") if (s, x.strip()) not in drop) for d, (t, s) in kept.items()}
    label = brute_groups(sorted(kept.items()))
    assert len(set(label.values())) < len(kept)
    kept = {d: t for d, t in kept.items() if label[d] == d}
    left = {d: t for d, t in kept.items() if not any(overlaps(t, x) for _, x in bench)}
    assert 0 < len(left) < len(kept)

    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = frame.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        frame = spark.read.parquet(f"{tmp_path}/{k}")
        assert frame.columns == columns
    assert {r["doc_id"]: r["text"] for r in frame.collect()} == left
    assert all(r["n_chars"] == len(r["text"]) for r in frame.collect())
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(left) and all(r["round_trip"] for r in last)
    v = spiece.Vocabulary(corpus_pipeline.vocabulary("piece_bpe_32k.model"))
    import numpy as np

    assert all(spiece.decode(v, np.array(r["ids"])) == left[r["doc_id"]].encode() for r in last if r["n_pieces"])
