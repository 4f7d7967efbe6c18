import hashlib
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from reelmill.llm import exact_dedup as E
from tests.llm import edge


def expected(data):
    groups = defaultdict(list)
    for doc, text, *_ in data:
        groups[(text or "").encode().translate(None, E.IGNORED)].append((-len(text or ""), doc is None, doc))
    return sorted(((d, min(g)[2], len(g), min(g)[2] == d, hashlib.sha256(k).hexdigest()) for k, g in groups.items() for *_, d in g), key=repr)


def test_groups_against_brute_force(spark):
    for budget in (E.TRIE_BYTES, 2000):  # the second spills all the time
        got = sorted(map(tuple, E.exact_groups(edge.table(spark), trie_bytes=budget).collect()), key=repr)
        assert got == expected(edge.rows())
    data = [(None, "a b", *[None] * 9), (None, "ab", *[None] * 9), (4, "ab", *[None] * 9), (None, "c", *[None] * 9)]
    assert sorted(map(tuple, E.exact_groups(edge.table(spark, data)).collect()), key=repr) == expected(data)


def test_query_equals_its_sql(spark, sf_dir, tmp_path):
    import duckdb

    from reelmill.llm import queries as Q

    data = edge.table(spark)
    data.write.parquet(f"{tmp_path}/sf/documents.parquet")
    for sf, at in ((sf_dir, f"{sf_dir}/documents.parquet"), (f"{tmp_path}/sf", f"{tmp_path}/sf/documents.parquet/*.parquet")):
        con = duckdb.connect()
        con.execute(f"create view documents as select * from '{at}'")
        got = Q.op2_exact_dedup(spark, sf)
        want = con.execute(Q.ORACLE_SQL["op2_exact_dedup"])
        names = [c[0] for c in want.description]
        assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_drop_copies_keeps_all_columns_and_one_row_a_text(spark):
    kept = E.drop_copies(edge.table(spark))
    assert kept.columns == edge.table(spark).columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({k for _, k, *_ in expected([r for r in edge.rows() if r[0] is not None])})
    assert kept.filter("doc_id is null").count() == 1


def test_empty_table(spark):
    assert E.exact_groups(edge.table(spark, [])).collect() == []
    assert E.drop_copies(edge.table(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=6) | st.sampled_from([b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaac"]), st.integers(0, 5), st.integers(0, 9)), max_size=30), st.sampled_from([0, 500, 1 << 20]))
def test_trie_owners(rows, budget):
    got = defaultdict(lambda: [[], 0])
    for key, (a, b, n) in E._owners([(k, [-c, d, 1]) for k, c, d in rows], budget):
        got[key][0].append([a, b])
        got[key][1] += n
    want = defaultdict(list)
    for k, c, d in rows:
        want[k].append([-c, d])
    assert {k: (min(v), n) for k, (v, n) in got.items()} == {k: (min(v), len(v)) for k, v in want.items()}
