import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelmill.llm import fim
from reelmill.llm import queries as Q
from tests.llm import edge


def plain(doc, text, seed=7):
    """The contract, with prefix sums in place of the skip list."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = [int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


EXTRA = [(900 + i, t, None, None, None, "", "", "", 1, "", "") for i, t in enumerate(["\n", "a\n\n\nb", "x\r\ny z\n", "with <S> inside\nb", "<", "<P", "P>\n<", "é😀\n" * 500])]


def test_edges(spark):
    data = edge.rows() + EXTRA
    found = fim.fill_in_middle(edge.table(spark, data), seed=7).withColumn("back", fim.restored()).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found), key=key) == sorted(((d, *plain(d, t)) for d, t, *_ in data), key=key)
    assert sorted(r.back for r in found) == sorted(t or "" for _, t, *_ in data)
    assert fim.fill_in_middle(edge.table(spark, [])).collect() == []


def test_the_registered_query(spark, sf_dir):
    found = {r.doc_id: r for r in Q.op12_fill_in_middle(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        n, form, p, m, out = plain(d.doc_id, d.text)
        r = found[d.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, p, m)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def test_rates_patterns_and_sentinels(spark):
    docs = edge.table(spark, [(i, edge.words(__import__("random").Random(i), 30), None, None, None, "", "", "", 1, "", "") for i in range(400)])
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = fim.fill_in_middle(docs, pattern=r"\S+\s*", fim=50, spm=0, sentinels=marks).withColumn("back", fim.restored(sentinels=marks))
    n = {r.form: r["count"] for r in made.groupBy("form").count().collect()}
    assert set(n) == {"plain", "psm"} and 140 < n["psm"] < 260
    assert made.join(docs, "doc_id").filter(F.col("back") != F.col("text")).count() == 0
    assert made.filter("n <> 30").count() == 0
    for bad in (("<P>", "<P>x", "<M>"), ("aa", "<S>", "<M>"), ("", "<S>", "<M>"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(docs, sentinels=bad)


@given(st.lists(st.integers(0, 50), max_size=300))
@settings(max_examples=60, deadline=None)
def test_skip_list_against_prefix_sums(widths):
    units = fim.SkipList(widths)
    total = 0
    assert (units.n, units.n_chars) == (len(widths), sum(widths))
    for rank in range(len(widths) + 1):
        assert units.seek(rank) == total
        total += widths[rank] if rank < len(widths) else 0
    with pytest.raises(IndexError):
        units.seek(len(widths) + 1)


def test_a_descent_is_short():
    units = fim.SkipList([3] * 100_000)
    assert len(units.units) > 6 and len(units.units[-1]) < 60
    assert units.seek(77_777) == 3 * 77_777 and sum(units.units[2]) <= 100_000
