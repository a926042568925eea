import random
import zlib

import numpy as np
import pytest

from leafmill.llm import tokenbin

P = pytest.importorskip("public_tokenizers")
MODEL = P.path("word_bpe_49k.json")


def test_files_hold_the_library_ids(docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(MODEL)
    rows = [(5, "Hello, wörld! it's 42."), (1, None), (2, ""), (9, "<|endoftext|> a\ue000b \ue000 c"), (3, "e\u0301 \u0301 x\u00a0y\u2003z"), (7, "same"), (7, "same"), (4, "word " * 5000),
            (10, "don't DON'T it's' 'tis we'll, İstanbul ΣΑΣ ΟΔΟΣ. ß. é. e\u0301. ñ, a1,2 x*** &&& <|ENDOFTEXT|> --- foo-bar's. dž DŽ. ﬁ."), (11, "<|startoftext|>A<|endoftext|>. B")]
    rows += [(100 + i, f"Doc {i} with some wordé{i} and more\n\tlines") for i in range(50)]
    out = tokenbin.round_trip(docs(rows), MODEL, 2, f"file://{tmp_path}/tokens")
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in out.collect())
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_null_ids_come_first_and_empty_tables(docs, tmp_path):
    out = tokenbin.round_trip(docs([(1, "a b"), (None, "c")]), MODEL, 2, f"file://{tmp_path}/x").collect()
    assert {(r["doc_id"], r["start"]) for r in out} == {(None, 0), (1, 2)}
    assert tokenbin.round_trip(docs([(1, "a")]).where("false"), MODEL, 2, f"file://{tmp_path}/y").count() == 0


def test_every_two_byte_letter_before_punctuation():
    encoder = tokenbin.WordEncoder(MODEL)
    words = [f"{head}{chr(c)}{tail}" for c in range(0xC0, 0x280) for head in ("", "10", "ab") for tail in (".", ",", ")", "(", "...", '".', "-")]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([w.encode() for w in words])]
    assert [w for w, ids in zip(words, got) if ids != encoder.ids(w)] == []


def test_random_texts_of_all_scripts():
    rng, encoder = random.Random(9), tokenbin.WordEncoder(MODEL)
    signs = "abcXYZ019 .,;:!?\"'()[]{}<>|*&-_/\\@#$%^~`\n\t\r\x0b\x85\u00a0\u2003İıſßẞΣσςАяёжЖאבعلى中文日本カ゛ㄱ가힣\u0301\u0307\u200b\u200dﬁ\ufeff😀👍🏽ǅǈͅᾳᾼK" + "".join(map(chr, range(0xA1, 0x250)))
    texts = ["".join(rng.choice(signs) if rng.random() < 0.7 else rng.choice("abcde .,'") for _ in range(rng.choice([1, 2, 3, 5, 20]))) for _ in range(20_000)]
    got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode([t.encode() for t in texts])]
    assert [t for t, ids in zip(texts, got) if ids != encoder.ids(t)] == []


def test_many_rows_without_an_id_are_several_shards(docs, tmp_path):
    rows = [(None, f"text {i}") for i in range(200)] + [(5, "a b")]
    manifest = tokenbin.write(docs(rows), MODEL, 2, f"file://{tmp_path}/n", shards=4).collect()
    assert len(manifest) >= 3 and sum(r["n_docs"] for r in manifest) == 201
