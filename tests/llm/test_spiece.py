import itertools
import math
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import spiece

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tables():
    return spiece.Lattices(spiece.Vocabulary(MODEL))


def brute(text, alpha=1.0):
    """Probability of each segmentation (tuple of ids) of a short text."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=MODEL)
    n = m.get_piece_size()
    own = {m.id_to_piece(i): i for i in range(3, n) if not m.is_byte(i)}
    byte = {int(m.id_to_piece(i)[3:5], 16): i for i in range(n) if m.is_byte(i)}
    s = "▁" + text.replace(" ", "▁")

    def paths(at):
        if at == len(s):
            yield (), 0.0
            return
        options = [(end, (own[s[at:end]],), -alpha * math.log(min(-m.get_score(own[s[at:end]]), n) + spiece.RANK_SHIFT)) for end in range(at + 1, len(s) + 1) if s[at:end] in own]
        if s[at] not in own:
            raw = s[at].encode()
            options.append((at + 1, tuple(byte[b] for b in raw), -alpha * len(raw) * math.log(n + spiece.RANK_SHIFT)))
        for end, ids, w in options:
            for rest, v in paths(end):
                yield ids + rest, w + v

    all_paths = dict(paths(0))
    z = sum(math.exp(v) for v in all_paths.values())
    return {k: math.exp(v) / z for k, v in all_paths.items()}


@pytest.mark.parametrize("text", ["abc", "in at", "é\n中x", "the  cat"])
def test_probabilities_and_order(tables, text):
    want = brute(text)
    seen, n = Counter(), 4000
    keys = spiece.mix(np.arange(n, dtype=np.uint64))
    for paths in spiece.sample(tables, [text] * n, keys, 3):
        ids = [tuple(spiece.piece_ids(tables, p.edges).tolist()) for p in paths]
        assert len(set(ids)) == len(ids) == min(3, len(want))
        for i, p in zip(ids, paths):
            assert p.logp == pytest.approx(math.log(want[i]), abs=1e-9)
            assert spiece.decode(tables.v, np.array(i)) == text.encode()
        scores = [p.gumbel for p in paths]
        assert scores == sorted(scores, reverse=True)
        seen[ids[0]] += 1
    for i, p in want.items():
        assert abs(seen[i] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 2e-3


def test_pairs_are_drawn_without_replacement(tables):
    """The first two of a text follow the law of successive draws."""
    want = brute("abc")
    n, seen = 6000, Counter()
    for paths in spiece.sample(tables, ["abc"] * n, spiece.mix(np.arange(n, dtype=np.uint64) + np.uint64(10**6)), 2):
        seen[tuple(tuple(spiece.piece_ids(tables, p.edges).tolist()) for p in paths)] += 1
    for a, b in itertools.permutations(want, 2):
        p = want[a] * want[b] / (1 - want[a])
        assert abs(seen[a, b] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 3e-3


def test_all_segmentations_in_the_end(tables):
    want = brute("abc")
    (paths,) = spiece.sample(tables, ["abc"], np.array([7], np.uint64), len(want) + 3)
    assert {tuple(spiece.piece_ids(tables, p.edges).tolist()) for p in paths} == set(want)


def test_rows_and_seeds(docs):
    rows = [(1, None), (2, ""), (3, "Hello wörld\n\n  again\t中文 🙂 a▁▁b ▁ " + "x" * 300), (4, "the cat sat " * 400), (5, " "), (4, "the cat sat " * 400)]
    got = spiece.segmentations(docs(rows), MODEL, 3, with_ids=True).collect()
    assert all(r["round_trip"] for r in got)
    assert [r["n_pieces"] for r in got if r["doc_id"] in (1, 2)] == [0, 0]
    assert len({r["ids_crc32"] for r in got if r["doc_id"] == 3}) == 3
    again = spiece.segmentations(docs(rows[::-1]).coalesce(1), MODEL, 3).collect()
    assert sorted((r["doc_id"], r["sample"], r["ids_crc32"]) for r in got) == sorted((r["doc_id"], r["sample"], r["ids_crc32"]) for r in again)
    other = spiece.segmentations(docs(rows), MODEL, 1, seed=1).where("doc_id = 4").first()
    assert other["ids_crc32"] not in {r["ids_crc32"] for r in got if r["doc_id"] == 4}
    assert all(0 < r["inclusion"] <= 1 for r in got)
    assert spiece.segmentations(docs(rows).where("false"), MODEL).count() == 0


def test_library_encoding_decodes(tables):
    for text in ("Hello wörld", "a  b\n\tc 中文 🙂"):
        assert spiece.decode(tables.v, np.array(spiece.encode(MODEL, [text])[0])) == text.encode()


def test_suffixes_of_known_units_are_not_learned_again(monkeypatch):
    t, learned, learn = spiece.Lattices(spiece.Vocabulary(MODEL)), [], spiece.Lattices.learn
    monkeypatch.setattr(spiece.Lattices, "learn", lambda self, *units: (learned.append(units), learn(self, *units)))
    key = np.array([7], np.uint64)
    spiece.sample(t, ["donation\n"], key, 2)
    assert len(learned) == 1
    spiece.sample(t, [" "], key, 2)
    learned.clear()
    (paths,) = spiece.sample(t, ["\nnation"], key, 2)
    assert not learned
    assert {spiece.decode(t.v, spiece.piece_ids(t, p.edges)) for p in paths} == {b"\nnation"}


def test_numbers_of_keys():
    rng, numbers, known = np.random.default_rng(1), spiece.Numbers(), {}
    for _ in range(40):
        keys = rng.integers(1, 2**63, 500, dtype=np.uint64) >> np.uint64(rng.integers(0, 60))
        assert numbers.find(keys).tolist() == [known.get(k, 0) for k in keys.tolist()]
        new = keys[numbers.find(keys) == 0]
        got, fresh = numbers.add(new)
        assert got[fresh].tolist() == list(range(len(known) + 1, len(known) + 1 + len(set(new.tolist()))))
        known |= dict(zip(new.tolist(), got.tolist()))
        assert numbers.find(keys).tolist() == [known[k] for k in keys.tolist()]


def test_units_cut_no_piece_and_go_in_parts(tables, monkeypatch):
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=MODEL)
    own = {m.id_to_piece(i).replace("▁", " ") for i in range(3, m.get_piece_size()) if not m.is_byte(i)}
    rng = np.random.default_rng(2)
    docs = ["", *("".join(rng.choice(list("aabbN  \n\t_.,'-€™—²é中🙂▁½"), n)) for n in (1, 2, 30, 200, 2000)), "", "x" * 300 + " the cat, sat."]
    chars, starts, n = tables.v.split(docs)
    text = "".join(map(chr, chars.tolist()))
    assert text == "".join(" " + d for d in docs if d)
    firsts = set(np.cumsum([0, *(len(d) + 1 for d in docs if d)]).tolist())
    for at in set(starts.tolist()) - firsts:
        assert not any(text[at - a : at + b] in own for a in range(1, min(at, 12) + 1) for b in range(1, 13))
    assert n.tolist() == [sum(a <= x < a + len(d) + 1 for x in starts.tolist()) if d else 0 for d, a in zip(docs, np.cumsum([0, *(len(d) + 1 if d else 0 for d in docs)]).tolist())]
    keys = spiece.mix(np.arange(len(docs), dtype=np.uint64))
    want = [[(spiece.piece_ids(tables, p.edges).tolist(), p.logp, p.gumbel) for p in x] for x in spiece.sample(tables, docs, keys, 3)]
    monkeypatch.setattr(spiece, "PART", 40)
    monkeypatch.setattr(spiece, "LEARN", 3)
    t = spiece.Lattices(tables.v)
    assert [[(spiece.piece_ids(t, p.edges).tolist(), p.logp, p.gumbel) for p in x] for x in spiece.sample(t, docs, keys, 3)] == want
