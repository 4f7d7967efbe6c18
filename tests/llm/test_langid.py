import numpy as np

from reelmill.llm import langid as L
from reelmill.llm.queries import op7_language_id
from tests.llm import edge


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = op7_language_id(spark, sf_dir).filter("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 40 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark, sf_dir):
    model = L.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    got = L.predict(edge.table(spark), model).collect()
    assert len(got) == len(edge.rows())
    texts = {d: t for d, t, *_ in edge.rows()}
    for r in got:
        no_letter = not any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und") == no_letter and (not no_letter or r.score == 0)
    kept = L.keep_known(edge.table(spark), model)
    assert kept.columns == edge.table(spark).columns
    assert {r.doc_id for r in kept.collect()} <= {r.doc_id for r in got if r.lang_pred != "und"}
    assert L.train(edge.table(spark, [])) is None
    assert {r.lang_pred for r in L.predict(edge.table(spark), None).collect()} == {"und"}
    assert L.predict(edge.table(spark, []), model).collect() == []


def test_copies_leave_every_language_in_the_sample(spark):
    made = [(r.t, r.h) for r in spark.range(3000).selectExpr("'text number ' || id as t").selectExpr("t", "xxhash64(t) as h").orderBy("h").collect()]
    first = next(t for t, h in made if h % (1 << 20) < 1000)
    high = [t for t, h in made if h % (1 << 20) > 900_000][-1]
    rows = [(i, first, "aa") for i in range(100)] + [(i, t, "bb") for i, (t, _) in enumerate(made[-5:])] + [(i, high, "cc") for i in range(1000)]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_rows=5)
    assert model.langs == ["aa", "bb", "cc"]


def made_texts(rng, lang, n, words=40):
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = np.random.default_rng(lang).permutation(list(letters))[:9]
    return [" ".join("".join(rng.choice(own, 4)) for _ in range(words)) for _ in range(n)]


def test_seven_languages_and_copies(spark):
    rng = np.random.default_rng(1)
    texts = {f"l{k}": made_texts(rng, k, 60) for k in range(7)}
    rows = [(i, t, lang) for lang, some in texts.items() for i, t in enumerate(some[:40])]
    held = [(t, lang) for lang, some in texts.items() for t in some[40:]]
    for copies in (0, 20_000):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        docs = docs.unionByName(spark.range(copies).selectExpr("id as doc_id", f"'{texts['l0'][0]}' as text", "'l0' as lang"))
        model = L.train(docs, sample_rows=30)
        assert model.langs == sorted(texts)
        data, offsets = np.frombuffer("".join(t for t, _ in held).encode(), np.uint8), np.cumsum([0] + [len(t) for t, _ in held])
        best = model.decode(model.margins(data, offsets))[0]
        assert np.mean([model.langs[b] == lang for b, (_, lang) in zip(best, held, strict=True)]) > 0.97


def test_features_of_whole_texts(monkeypatch):
    text = "abc déf ".encode() * 9_000
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = L.features(data, offsets)
    monkeypatch.setattr(L, "STEP", 1000)
    assert (L.features(data, offsets) == whole).all()
    batch = next(L._counted(iter([__import__("pyarrow").RecordBatch.from_pydict({"lang": ["x"], "h": [1], "text": [text.decode()]})])))
    back = np.frombuffer(__import__("pyarrow").decompress(batch.column(2)[0].as_py(), 4 * L.BUCKETS, "zstd", asbytes=True), np.float32)
    assert (back == whole[0]).all()


def test_one_language_and_many():
    assert L.codewords(1).shape == (1, 1)
    for k in range(1, 65):
        code = L.codewords(k)
        assert len({tuple(r) for r in code.tolist()}) == k == len(code)
        columns = {tuple(c) for c in code.T.tolist()}
        assert len(columns) == code.shape[1] and (k == 1 or not any(tuple(-x for x in c) in columns for c in columns))
    model = L.fit([b"the cat and the dog"] * 3, ["en"] * 3)
    assert model.decode(model.margins(np.frombuffer(b"a dog", np.uint8), np.array([0, 5])))[0].tolist() == [0]


def test_whole_text_counts_and_steps(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [b"", b"a", "été à la mer".encode() * 50, b"der Hund " * 80]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    model = L.Model(["a", "b"], L.codewords(2), rng.normal(size=(L.BUCKETS, 1)).astype(np.float32), np.zeros(1), np.ones(1))
    want = []
    for t in texts:
        f = L.folded(np.frombuffer(t, np.uint8))
        grams = np.concatenate([L.buckets_of(f, n) for n in L.ORDERS if len(f) >= n] or [np.zeros(0, int)])
        want.append(model.weight[grams].sum(dtype=np.float64) / max(1, len(grams)))
    for step in (1 << 20, 64):
        monkeypatch.setattr(L, "STEP", step)
        assert np.allclose(model.margins(data, offsets)[:, 0], want, atol=1e-5)


def test_ambiguity_is_flagged():
    model = L.Model(["a", "b"], L.codewords(2), np.zeros((L.BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    assert model.decode(np.array([[0.0], [5.0]]))[2].tolist() == [True, False]
