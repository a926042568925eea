import re
from collections import Counter

from leafmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


CLEAN = " ".join(f"Word{i} goes here, and more." for i in range(8))
TEXTS = [
    None, "", " \n\t ", CLEAN, "a b c d e f g h " * 3, "x " * 30, "the cat sat on the mat by me " * 2 + "end", CLEAN + "\n" + CLEAN + "\n\n" + CLEAN,
    "a | b | c | d | e | f | g | h\n" * 5, "&&& %%% ### $$$ " * 10, "é ü 中文 " * 9, "w" * 50_000, "one two three " * 20_000, CLEAN + "\nAll rights reserved.",
]


def test_counts_match_brute_force(docs):
    rows = quality.measure(docs(list(enumerate(TEXTS)))).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute(TEXTS[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_lines_go_and_documents_follow(docs, untouched):
    junk = "\n".join("nav | bar | with | many | links | here | and | more" for _ in range(30))
    own = docs([(1, CLEAN + "\nAll rights reserved."), (2, CLEAN + "\n" + junk), (3, CLEAN), (4, None), (5, CLEAN), (5, CLEAN)])
    out = quality.clean(own)
    assert out.columns == own.columns
    untouched(out)
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    assert got == [(1, CLEAN, len(CLEAN)), (3, CLEAN, len(CLEAN)), (5, CLEAN, len(CLEAN)), (5, CLEAN, len(CLEAN))]


def test_empty_table(docs, spark):
    own = docs([(1, "x")]).where("false")
    assert quality.clean(own).count() == 0 and quality.measure(own).count() == 0


def test_phrases_of_four_languages(docs):
    lines = ["Alle Rechte vorbehalten.", "Impressum", "Tous droits réservés.", "Politique de confidentialité", "Todos los derechos reservados.", "Política de privacidad", "Please click here."]
    own = docs([(i, f"{CLEAN}\n{x}") for i, x in enumerate(lines)] + [(50, f"{CLEAN}\nDas Impressum der Zeitung fehlt."), (51, f"{CLEAN}\nShe will share this on Monday.")])
    got = {r["doc_id"]: r["text"] for r in quality.clean(own).collect()}
    assert all(got[i] == CLEAN for i in range(len(lines))) and got[50] != CLEAN and got[51] != CLEAN


def test_each_text_is_cleaned_once(docs):
    """A filter pushed below the cleaned text would clean it twice."""
    plan = quality.clean(docs([(1, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(quality.SENTENCE) == 1
