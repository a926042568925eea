import pytest

#: Names that operators use inside, or give to their own results.
CLASHES = (
    "_clean _words _host _salt _drop _kept _n_lines _n_dropped _odd _doc _new _kinds _scored _rule_verdict _text _page _n_main _n_blocks _keep _code _key _row _heavy "
    "_copy _hot page drop rule host path words"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, code string, key string, h long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="session")
def docs(spark):
    """Rows to documents, with more columns whose names clash with those inside the operators."""

    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), "c", "k", 7, *CLASHES) for i, t, s in ((*r, "a")[:3] for r in rows)]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def untouched():
    """Check that the clashing columns still have their values."""

    def check(frame, names=CLASHES):
        rows = frame.select(*names).distinct().collect()
        assert all(tuple(r) == tuple(names) for r in rows)

    return check
