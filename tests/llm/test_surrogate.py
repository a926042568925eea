import random
import re

from leafmill.llm import surrogate as s
from tests.llm.conftest import CLASHES

TEXT = (
    "Write to Anna.Berg+x@mail3.example.com or anna.berg+x@MAIL3.example.com, call +1 (689) 555-4072. Card 4111 1111 1111 1111, again 4111111111111111. "
    'From 152.143.123.13: token = "5bbf0274eef70e05c644ebfa24bebaa8d5fe62a0". SSN 123-45-6789, IBAN DE89 3704 0044 0532 0130 00. '
    "Mr Smith met Anna Smith and Dr. Peter Müller-Lang; господин Иванов и Анна Петрова."
)


def test_every_mention_changes_and_keeps_its_format():
    new, found = s.rewrite(TEXT)
    kinds = [k.split(":")[0] for k, _ in found]
    assert kinds.count("email") == 2 and kinds.count("card") == 2 and {"phone", "ip", "secret", "ssn", "iban", "given", "surname"} <= set(kinds)
    for old in ("Anna", "Smith", "Müller", "4111", "152.143.123.13", "5bbf02", "123-45-6789", "3704 0044", "555-4072", "Иванов", "Петрова"):
        assert old not in new
    again = [(k.split(":")[0]) for k, _ in s.rewrite(new)[1]]
    assert [k for k in again if k not in ("given", "surname")] == [k for k in kinds if k not in ("given", "surname")]
    mails = re.findall(r"[\w.+]+@[\w.]+", new)
    assert mails[0].lower() == mails[1].lower().strip(".") and mails[0].endswith(".example.com")
    # capitals stay where they were
    assert [c.isupper() for c in mails[0]] == [c.isupper() for c in "Anna.Berg+x@mail3.example.com"] and mails[1].split("@")[1].startswith(mails[0].split("@")[1].split(".")[0].upper())
    cards = re.findall(r"Card ([\d ]+), again (\d+)", new)[0]
    assert cards[0].replace(" ", "") == cards[1] and s.luhn(cards[1][:-1]) == int(cards[1][-1]) and cards[0].count(" ") == 3
    iban = re.search(r"IBAN (DE[\d ]+)\.", new)[1].replace(" ", "")
    assert s.mod97(iban) == 1
    smith = re.search(r"Mr (\w+) met (\w+) (\w+) and", new)
    assert smith[1] == smith[3] and smith[2] in s.GIVEN[("latin", "f")]
    assert re.search(r"господин ([А-Я][а-я]+ов) и ([А-Я][а-я]+) [А-Я][а-я]+ова", new)


def test_neighbours_are_told_apart():
    text = "+1 (826) 555-4081 190.137.223.204 and +49 30 1234567 10.1.2.3, +44 20 7946 0958 123 4567 8901"
    kinds = [k for k, _ in s.rewrite(text)[1]]
    assert kinds[:4] == ["phone", "ip", "phone", "ip"] and kinds[4] == "phone"
    assert not any(x in s.rewrite(text)[0] for x in ("190.137", "10.1.2.3", "555-4081", "1234567"))


def test_permutations_are_bijections():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(s.permute(i, size, "k", "t") for i in range(size)) == list(range(size))
    assert len({s.reformat(f"{i:03d}", "k", "t") for i in range(1000)}) == 1000


def test_clean_text_stays():
    for text in ("", "No data here, 12 apples; 3.14.", "Version 1.2.3 of 2024-01-02 costs 1,000.", "Mary had a lamb.", "1234567890123456"):
        assert s.rewrite(text) == (text, [])


def test_corpus_is_consistent_and_distinct(docs, untouched):
    rows = [(i, f"Mr Berg{chr(97 + i % 26)}{chr(97 + i // 26)} wrote to user{i}@mail.example.com from 10.0.0.{i % 250}.") for i in range(300)]
    rows += [(1000, rows[3][1]), (1001, None), (1002, ""), (1002, "")]
    own = docs(rows)
    out = s.pseudonymize(own)
    assert out.columns == [c for c in own.columns if c != "_kinds"] + ["_kinds"] and out.count() == len(rows)
    untouched(out, [c for c in CLASHES if c != "_kinds"])
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[1000] == text[3] and text[1001] is None and text[1002] == ""
    assert len({re.search(r"Mr (\w+)", text[i])[1] for i in range(300)}) == 300
    assert len({re.search(r"to (\S+)", text[i])[1] for i in range(300)}) == 300
    originals = {re.search(r"Mr (\w+)", t)[1] for _, t in rows[:300]}
    assert not originals & {re.search(r"Mr (\w+)", text[i])[1] for i in range(300)}
    assert s.pseudonymize(own.where("false")).count() == 0


def test_collisions_take_another_attempt(docs, spark, monkeypatch):
    few = spark.createDataFrame([(i, "given:latin:m", n) for i, n in enumerate(s.GIVEN[("latin", "m")])] + [(99, "ssn", "000000000")], "doc_id long, kind string, norm string")
    odd = {(r["kind"], r["norm"]): r["attempt"] for r in s.exceptions(few).collect()}
    new = [s.surrogate("given:latin:m", n, attempt=odd.get(("given:latin:m", n), 0)) for n in s.GIVEN[("latin", "m")]]
    assert len(set(new)) == len(new) and all(a != b for a, b in zip(new, s.GIVEN[("latin", "m")]))


def test_names_beside_punctuation_are_found():
    texts = ["He (Dr. Meyer) left.", '"Anna Berg" said so.', "Author:Anna Berg", "[Mr Berg]", "—Frau Weber", "(г-н Иванов)", "x/M. Petit", "see«Анна Петрова»"]
    for text in texts:
        found = [(text[a:b], kind.split(":")[0]) for a, b, kind, _ in s.detect(text)]
        assert ("surname" in {k for _, k in found}), text
        # an unrelated lead word elsewhere changes nothing
        assert [(text[a:b], kind.split(":")[0]) for a, b, kind, _ in s.detect(f"{text}\nAnna")] == found
    for lead in [*s._GENDER, *s._TITLE]:
        for before in ("", "(", '"', ":", " ", "-", "́"):
            text = f"{before}{lead} Zander{'ов' if lead[0] > 'я' else ''}"
            assert any(kind.startswith("surname") for _, _, kind, _ in s.detect(text)) == any(m["rest"] or m["surname"] for m in s._PERSON.finditer(text))


def test_names_outside_the_lists_are_found_by_context():
    """Names spelled here, in sentences of a generator of the test's own."""
    rng = random.Random(3)
    make = lambda: "".join(rng.choice("ptkbdgmnrszlvchw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))).capitalize()
    frames = (
        "{0} met {1} and {2}.", "Yesterday {0} wrote that all is well.", "Author: {0}", "Dear {0}, thank you.", "We told {0} about it.", "Contact: {0}, {1}", "Gestern traf {0} den Chef.",
        "{0} vive en Lima con {1}.", "the report that {0} signed, and {1} too",
    )
    hits = total = 0
    for k in range(900):
        names = [f"{make()} {make()}" for _ in range(3)]
        text = frames[k % len(frames)].format(*names)
        new, _ = s.rewrite(text)
        for n in names:
            if n in text:
                total += 1
                hits += n not in new and not any(x in new for x in n.split())
    assert hits / total > 0.85
    for text in ("The New York office opened.", "In Paris it rained. Said no one.", "Great Britain and Ireland are islands.", "See Chapter Two and Table Three."):
        assert s.rewrite(text) == (text, [])


def test_coreference_of_a_bare_surname():
    new, _ = s.rewrite("Wei Zhang met Olumide Adeyemi and Priya Sharma. Later Zhang left, and Sharma stayed.")
    assert not re.search("Zhang|Wei|Olumide|Adeyemi|Priya|Sharma", new)
    a = re.match(r"(\w+) (\w+) met (\w+) (\w+) and (\w+) (\w+)\. Later (\w+) left, and (\w+) stayed", new).groups()
    assert a[6] == a[1] and a[7] == a[5] and len(set(a[:6])) == 6
