from collections import Counter

import corpus_pipeline as C
from reelmill.llm import exact_dedup
from tests.llm import edge
from tests.llm.test_minhash import classes, grams


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    out = C.identify_language(spark, docs, sf_dir)
    known = {r.doc_id: r.text for r in out.collect()}
    assert set(known) == {d for d, t in rows.items() if any(c.isalpha() for c in t or "")}
    best = {}
    for d, t in known.items():
        k = t.encode().translate(None, exact_dedup.IGNORED)
        best[k] = min(best.get(k, (0, d)), (-len(t), d))
    distinct = C.drop_exact_copies(spark, out, sf_dir)
    assert sorted(r.doc_id for r in distinct.collect()) == sorted(d for _, d in best.values())
    near = C.drop_near_copies(spark, distinct, sf_dir)
    ids = sorted(d for _, d in best.values())
    want = sorted(set(classes([(d, grams(known[d])) for d in ids]).values()))
    assert sorted(r.doc_id for r in near.collect()) == want
    mixed = C.mix_sources(spark, near, sf_dir)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == set(want)
    drawn = Counter(r.doc_id for r in mixed.collect())
    pieces = Counter(r.doc_id for r in C.pack_sequences(spark, mixed, sf_dir).filter("piece = 0").collect())
    assert pieces == drawn


def test_run_equals_its_stages_and_edges(spark, tmp_path):
    edge.table(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert C.run(spark, f"{tmp_path}/a").count() > 0
    edge.table(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert C.run(spark, f"{tmp_path}/b").count() == 0
    assert [n for n, _ in C.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack_sequences"]


def test_no_text_vanishes_where_ids_repeat(spark):
    long, b = "A long text of quite other words than these", "B is short and plain text"
    docs = spark.createDataFrame([(5, long), (5, b), (7, b)], "doc_id long, text string")
    for stage in (C.drop_exact_copies, C.drop_near_copies):
        assert sorted((r.doc_id, r.text) for r in stage(spark, docs, "").collect()) == [(5, long), (5, b)]
    # 3 is near to one text of 5; the other one has no copy anywhere
    near = spark.createDataFrame([(3, long), (5, long.lower()), (5, b), (5, None), (9, " "), (None, b)], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.text or "") for r in C.drop_near_copies(spark, near, "").collect()) == [(0, b), (3, long), (5, ""), (5, b)]
