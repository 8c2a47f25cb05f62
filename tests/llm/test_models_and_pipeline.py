"""Language identification, the quality network and the corpus pipeline."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ctxweave.llm import language_id, quality, queries

SF = "/root/testdata/sf0.01"


def plain_bits(samples, text):
    """PPM by walking counts of contexts."""
    fold = lambda b: bytes(x + 32 if 65 <= x <= 90 else x for x in b)
    data = fold(b"".join(b"\n\n\n" + t for t in samples))
    seen = Counter(data[i - k : i + 1] for i in range(len(data)) for k in range(4) if i >= k)
    after = {}
    for s, n in seen.items():
        after.setdefault(s[:-1], {})[s[-1]] = n
    t, bits = fold(b"\n\n\n" + text), 0.0
    for i in range(3, len(t)):
        for k in (3, 2, 1, 0):
            c = after.get(t[i - k : i])
            if c is None:
                continue
            n, d = sum(c.values()), len(c)
            if t[i] in c:
                bits += math.log2((n + d) / c[t[i]])
                break
            bits += math.log2((n + d) / d)
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_tree():
    samples = {"a": [b"the cat sat on the mat", b"The end."], "b": ["le été là-bas".encode(), b"la fin"]}
    model = language_id.Ppm(samples)
    texts = [b"the cat", b"THE fin xyz \xff\x00", "été".encode(), b"", b"q", b"the cat sat on the mat " * 40]
    got = model.bits(texts, block=64)
    for row, t in zip(got, texts, strict=True):
        assert row == pytest.approx([plain_bits(samples[x], t) for x in "ab"], rel=1e-5)


@pytest.mark.parametrize("max_pairs", [1, 3, 10])
def test_contexts_of_rare_pairs_count(max_pairs):
    samples = {"a": [b"the cat sat on the mat", b"The end."], "b": ["le été là-bas".encode(), b"la fin"]}
    model = language_id.Ppm(samples, max_pairs)
    texts = [b"the cat", b"THE fin xyz \xff\x00", "été".encode(), b"q", b"the cat sat on the mat " * 40]
    for row, t in zip(model.bits(texts, block=64), texts, strict=True):
        assert row == pytest.approx([plain_bits(samples[x], t) for x in "ab"], rel=1e-5)


def test_more_byte_pairs_than_the_table_has():
    """A language of thousands of signs has more than 2,000 adjacent pairs; every context still counts."""
    r = np.random.default_rng(13)
    signs = [chr(int(c)) for c in r.integers(0x4E00, 0x9000, 3000)]
    samples = {"a": ["".join(r.choice(signs, 3000)).encode()], "b": [b"plain words of another language " * 30]}
    model = language_id.Ppm(samples)
    assert model.pairs == 2001 and len(model.rare[0][0]) > 0
    texts = ["".join(r.choice(signs, 50)).encode(), samples["a"][0][300:600], b"plain words"]
    for row, t in zip(model.bits(texts), texts, strict=True):
        assert row == pytest.approx([plain_bits(samples[x], t) for x in "ab"], rel=1e-4)


def test_training_rows(spark):
    """At most so many documents of a label, one text an id, long texts by stretches from start to end, nothing without a text."""
    rows = [(i, f"text {i}", "many") for i in range(400)] + [(1000, "start " + "middle " * 50_000 + "end", "long"), (2000, None, "none"), (2001, "", "none"), (None, "x", "many"), (3000, "x", None)]
    rows += [(4000, "twice", "a"), (4000, "twice", "a"), (4000, "other", "b"), (4001, "z", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.training_rows(docs, docs, "lang", F.lit(True), 50, 1 << 10)
    by = Counter(r[1] for r in got)
    one = docs.coalesce(1)
    assert by == {"many": 50, "long": 1, "a": 2, "b": 1} and got == language_id.training_rows(one, one, "lang", F.lit(True), 50, 1 << 10)
    long = next(r[2] for r in got if r[1] == "long")
    assert long.startswith("start") and long.endswith("end") and "middle" in long and len(long.encode()) <= 1 << 10
    assert {r for r in got if r[1] in "ab"} == {(4000, "a", "twice"), (4000, "b", "other"), (4001, "a", "z")}
    labels = spark.createDataFrame([(i, i % 2) for i in range(500)] + [(7, 0)], "doc_id long, quality int")
    both = language_id.training_rows(docs.select("doc_id", "text"), labels, "quality", F.lit(True), 300, 1 << 10)
    assert Counter(r[1] for r in both) == {"0": 201, "1": 200} and {r[1] for r in both if r[0] == 7} == {"0", "1"}


def test_language_id_on_held_out_documents(spark):
    got = queries.op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and len(held) > 200 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_id_odd_rows(spark):
    model = language_id.Ppm({"en": [b"hello there"], "fr": ["bonjour là".encode()]})
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "hello"), (None, "bonjour"), (4, "hello"), (5, "là " * 300_000)]
    df = spark.createDataFrame([(i, t, "x", "y", True) for i, t in rows], "doc_id long, text string, score string, lang string, held_out boolean")
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(df, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "en"), (None, "fr"), (4, "en"), (5, "fr")], key=str)
    assert language_id.identify(df.where("false").withColumn("lang_pred", F.lit("x")), model).count() == 0
    clash = language_id.identify(df.withColumns({"lang_pred": F.lit("x"), "label": F.lit("y")}), model)
    assert clash.columns == ["doc_id", "held_out", "lang_pred", "score"] and "x" not in {r.lang_pred for r in clash.collect()}
    even = language_id.Ppm({"b": [b"same text"], "a": [b"same text"]}).predict(["some text"])
    assert even == (["a"], [0.5])  # of equal ones the first by name
    untaught = language_id.train(df.where("false"), F.lit(True))
    assert [r.lang_pred for r in language_id.identify(df, untaught).collect()] == ["und"] * 7


def test_quality_on_held_out_documents(spark):
    got = queries.op10_quality(spark, SF)
    rows = got.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert got.count() == 1000 and sum(r.predicted == r.quality for r in held) / len(held) > 0.9
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.93


def test_network_gradients():
    net = quality.ByteCnn.new(3)
    for k in vars(net):
        setattr(net, k, getattr(net, k).astype(np.float64))
    texts, y = [b"some text " * 90, b"other%%% words### here" * 40, b"x"], np.array([1.0, 0.0, 1.0])

    def loss():
        p = net._score(texts, 1 << 19)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    grads = net._gradients(texts, y)
    r = np.random.default_rng(0)
    for k, g in grads.items():
        w = getattr(net, k)
        for i in r.choice(np.flatnonzero(np.abs(g).reshape(-1) > 1e-4), 3):
            keep = w.reshape(-1)[i]
            w.reshape(-1)[i] = keep + 1e-5
            up = loss()
            w.reshape(-1)[i] = keep - 1e-5
            down = loss()
            w.reshape(-1)[i] = keep
            assert (up - down) / 2e-5 == pytest.approx(g.reshape(-1)[i], rel=0.02, abs=1e-5)


def plain_score(net, text):
    """The network window by window: filters, their maximum over chunks of 128 windows that start every 64, mean and maximum of these."""
    n = max(1, -(-max(0, len(text) - quality.WIDTH) // quality.STRIDE) + 1)
    text = text.ljust((n - 1) * quality.STRIDE + quality.WIDTH, b"\0")
    windows = []
    for w in range(n):
        seen = [x for b in text[w * quality.STRIDE : w * quality.STRIDE + quality.WIDTH] for x in net.embed[b].tolist()]
        windows.append([sum(x * y for x, y in zip(seen, net.filters[:, f].tolist(), strict=True)) + float(net.bias[f]) for f in range(quality.FILTERS)])
    chunks = []
    for at in range(0, max(1, n - quality.HALF), quality.HALF):
        part = windows[at : at + 2 * quality.HALF]
        chunks.append([max(0.0, *(w[f] for w in part)) for f in range(quality.FILTERS)])
    x = [sum(c[f] for c in chunks) / len(chunks) for f in range(quality.FILTERS)] + [max(c[f] for c in chunks) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, net.weight.tolist(), strict=True)) + float(net.offset[0]))))


def test_op10_query_against_a_plain_network(spark):
    """Scores as returned by the query, for short and long documents, by plain Python."""
    sf = "/root/testdata/sf0.001"
    net = queries.quality_model(spark, sf)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op10_quality(spark, sf).collect()}
    assert set(got) == set(texts) and all(r.predicted == (r.score >= 0.3) for r in got.values())
    by_size = sorted(texts, key=lambda i: len(texts[i]))
    for i in [*by_size[:6], *by_size[60:140:8], by_size[-1]]:
        assert got[i].score == pytest.approx(plain_score(net, texts[i].encode()), abs=1e-4)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())


def test_quality_of_very_long_texts(spark):
    net = quality.ByteCnn.new(4)
    df = spark.createDataFrame([(1, "some words " * 200_000), (2, "some words " * 200_000 + "%%%")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score_quality(df, net, ["doc_id"]).collect()}
    assert got[1] == pytest.approx(float(net.score(["some words " * 200_000], 1 << 14)[0]), abs=1e-5) and len(got) == 2


def test_network_scores_do_not_depend_on_blocks():
    net = quality.ByteCnn.new()
    texts = ["", "a", "word " * 5, "w%%% " * 700, "text " * 3000, "é" * 999]
    assert net.score(texts) == pytest.approx(net.score(texts, 300), abs=1e-5)
    assert net.score(texts) == pytest.approx(np.concatenate([net.score([t]) for t in texts]), abs=1e-5)


def test_quality_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "text", "s"), (2, "", "s")], "doc_id long, text string, score string")
    got = quality.score_quality(df, quality.ByteCnn.new(), ["doc_id", "score"]).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id != None}) == 1  # noqa: E711
    labels = spark.createDataFrame([(1, "a", 1)], "doc_id long, text string, quality int")
    assert quality.train(labels, labels, F.lit(True)).score(["x"])[0] > 0.9 and quality.train(labels, labels.where("false"), F.lit(True)).score(["x"])[0] == 0.5


def brute_pipeline(spark, docs, sf_dir):
    """Each stage by plain means over the whole input of the stage."""
    from ctxweave.llm.decontaminate import FOLD

    from .test_first_four import brute_lines
    from .test_search_and_dedup import brute_components

    rows = {r.doc_id: r.text for r in docs.collect()}
    model = queries.quality_model(spark, sf_dir)
    rows = {i: t for i, t in rows.items() if model.score([t])[0] >= 0.3}
    rows = {i: t for i, t, _, _ in brute_lines(list(rows.items()), 10)}
    near = brute_components(list(rows.items()), 5, 80)
    rows = {i: t for i, t in rows.items() if near[i][1] == i}
    items = [r.text.encode().translate(FOLD) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    exact = {i for i, t in rows.items() if any(x in t.encode().translate(FOLD) for x in items)}
    return rows, exact


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, leaked = brute_pipeline(spark, docs, sf)
    got = corpus_pipeline.run(spark, sf)
    kept = {r.doc_id: r.doc_tokens for r in got.select("doc_id", "doc_tokens").distinct().collect()}
    assert set(kept) == set(rows) - leaked
    assert got.agg(F.sum("length")).first()[0] == sum(kept.values())
    for _, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, sf)
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]


def test_stages_with_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    names = ["row", "before", "predicted", "score", "gone", "n_lines", "n_dropped", "__t", "cls", "keys"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    plain = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 1").first().text
    rows = [(1, None), (2, ""), (None, plain), (3, plain), (3, plain), (4, plain), (5, "word " * 40000)]
    docs = spark.createDataFrame([(i, t, None, None, None, *names) for i, t in rows], schema)
    for name, f in corpus_pipeline.STAGES:
        for df in (docs, docs.where("false")):
            out = f(spark, df, sf)
            n = out.count()
            if name != "packing":
                assert out.columns == docs.columns and n <= df.count()
                if n and name != "quality classifier":  # the row without an id is a copy of one with an id, and holds no benchmark item
                    assert out.where("doc_id is null").count() == (name != "n-gram Jaccard join")
    near = corpus_pipeline.near_copy_stage(spark, docs, sf)
    assert sorted(r.doc_id for r in near.collect()) == [1, 2, 3, 5]


def test_near_copies_are_judged_by_row(spark):
    """Repeated rows leave one, a different text under a repeated id stays, rows without an id yield."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (2, text), (2, "a text that no other row has at all"), (None, text), (None, "words of a row without an id"), (None, "words of a row without an id"), (3, None), (3, None), (4, ""), (5, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(map(tuple, corpus_pipeline.near_copy_stage(spark, docs, "/root/testdata/sf0.001").collect()))
    assert got == Counter([(1, text), (2, "a text that no other row has at all"), (None, "words of a row without an id"), (3, None), (3, None), (4, ""), (5, " ")])


def test_rows_without_an_id_are_decontaminated(spark):
    sf = "/root/testdata/sf0.001"
    item = max((r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").collect()), key=len)
    docs = spark.createDataFrame([(None, f"before {item} after"), (None, "clean"), (None, None), (1, "clean"), (2, item), (7, "clean"), (7, item)], "doc_id long, text string")
    got = corpus_pipeline.decontamination_stage(spark, docs, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in docs.collect() if not (r.text and item in r.text)]))
