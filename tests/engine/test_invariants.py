"""Properties that hold whatever the rows."""

from pyspark.sql import functions as F

from leafmill.operators import chunks, diff, policy, search

SCHEMA = "doc_id long, node_id string, partition_order int, ord int, kind string, layer string, parent_id string, heading_level int, text string, editability string, part_uri string"


def nodes(spark, n=200):
    kinds = ["Heading", "Paragraph", "ListItem", "Comment"]
    rows = [(i // 40, f"n{i}", i % 40 // 15, i % 40, kinds[i * 7 % 4], "Hidden" if i % 17 == 0 else "Body", f"n{i - 1}" if i % 9 == 4 else None, 1 + i % 3, "w " * (i * 31 % 90), "EditableInPlace", "p") for i in range(n)]
    return spark.createDataFrame([*rows, (99, None, 0, 0, None, None, None, None, None, None, None)], SCHEMA)


def test_chunks_hold_every_node_in_order(spark):
    own = nodes(spark)
    out = chunks.chunk(own, 300).collect()
    held = own.where("layer = 'Body' and coalesce(text, '') <> ''").orderBy("doc_id", "ord").collect()
    by_doc = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["chunk_id"].split("_")[-1])):
        by_doc.setdefault(r["doc_id"], []).extend(r["node_ids"].split(","))
    assert by_doc == {d: [r["node_id"] for r in held if r["doc_id"] == d] for d in by_doc}
    assert all(len(r["text"]) <= 300 or "," not in r["node_ids"] for r in out)


def test_policies_nest(spark):
    own = nodes(spark).where("node_id is not null")
    n = {p: {r["node_id"] for r in policy.apply_policy(own, p).collect()} for p in policy.POLICIES}
    assert n["sanitized"] <= n["visible"] <= n["complete"]


def test_sections_never_split_right_after_a_heading(spark):
    own = nodes(spark).where("node_id is not null")
    rows = chunks.sections(own, 100).join(own.select("node_id", "kind"), "node_id").orderBy("doc_id", "position").collect()
    for a, b in zip(rows, rows[1:]):
        if a["doc_id"] == b["doc_id"] and a["section"] != b["section"]:
            assert a["kind"] != "Heading" and b["section"] == a["section"] + 1


def test_diff_of_equal_tables_is_empty_and_deletes_are_explicit(spark):
    own = nodes(spark).where("node_id is not null")
    assert diff.diff(own, own).count() == 0
    less = own.where("ord <> 5")
    kinds = {r["op"] for r in diff.diff(own, less).collect()}
    assert kinds == {"MissingNode"}
    listed = own.where("ord = 5").select("node_id")
    assert {r["op"] for r in diff.diff(own, less, listed).collect()} == {"ExplicitDelete"}


def test_search_finds_more_as_the_query_shrinks(spark):
    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["# Title", "one two", "**tw**o &amp; three", "見", "直し", "ＡＢＣ"])], "doc_id long, line int, raw string")
    hits = lambda q: {r["line"] for r in search.search(lines, q).collect()}
    assert hits("two & three") == {3} and hits("two") >= hits("two & three")
    assert hits("見直し") == {4} and hits("abc") == {6}
    heads = {r["line"]: r["heading"] for r in search.search(lines, "two").collect()}
    assert heads[2] is None


def test_duplicate_ids_become_unique(spark):
    rows = [(1, f"r{i}", "x" if i % 2 else " ", 0, i) for i in range(9)]
    out = diff.deduplicate_ids(spark.createDataFrame(rows, "doc_id long, row_id string, node_id string, partition_order int, ord int"))
    assert out.select("node_id").distinct().count() == 9 and out.where(F.col("node_id") == "x").count() == 1
