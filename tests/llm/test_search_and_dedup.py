"""Cover-tree search, suffix dedup, n-gram join, decontamination against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxweave.llm import components, cover_tree, decontaminate, ngram_join, queries, shared_keys, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, cuts string, keys string, n string, component_id string"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "c", "k", "n", "x") for i, t in rows], SCHEMA)


def brute_top(points, queries_, k):
    out = []
    for q, v in queries_:
        s = sorted(((-int(np.dot(np.array(v, object), np.array(w, object))), p) for p, w in points if p != q and len(w) == len(v)))
        out += [(q, r + 1, p, -x) for r, (x, p) in enumerate(s[:k])]
    return sorted(out)


def vectors(n, dim, seed, spread=6):
    r = np.random.default_rng(seed)
    centers = r.integers(-40, 40, (5, dim))
    return [(int(i), (centers[i % 5] + r.integers(-spread, spread + 1, dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("n", "k", "scale"), [(1500, 20, 1), (300, 400, 1), (200, 3, 10**5), (200, 3, 10**7)])
def test_top_k(spark, n, k, scale):
    points = [(i, [x * scale for x in v]) for i, v in vectors(n, 8, n)]
    points += [(10_000 + i, points[0][1]) for i in range(30)]  # ties
    df = spark.createDataFrame(points, "vec_id long, v array<long>")
    asked = [p for p in points if p[0] % 20 == 0]
    got = cover_tree.top_k(df, df.where("vec_id % 20 = 0"), k, block_rows=400, query_bytes=1000 if n == 300 else 1 << 20)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(points, asked, k)


def test_top_k_odd_rows(spark):
    v = [[1.0, 2.0], None, [], [float("nan"), 1.0], [1.0, None], [float("inf"), 0.0], [1.0, 2.0, 3.0], [0.5, -0.25], [1.0, 2.0]]
    df = spark.createDataFrame([*enumerate(v), (None, [9.0, 9.0]), (0, [1.0, 2.0])], "vec_id long, embedding array<float>").select("vec_id", cover_tree.quantized("embedding").alias("v"))
    got = cover_tree.top_k(df, df, 5).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in got) == [(0, 7, 32 * 64 - 16 * 128), (0, 8, 64 * 64 * 5), (7, 0, 0), (7, 8, 0), (8, 0, 64 * 64 * 5), (8, 7, 0)]
    assert cover_tree.top_k(df.where("false"), df.where("false")).count() == 0


def test_top_k_with_rows_repeated_in_other_blocks(spark):
    points = vectors(300, 8, 5)
    rows = spark.createDataFrame(spark.sparkContext.parallelize(points * 3, 1), "vec_id long, v array<long>")
    asked = [p for p in points if p[0] % 20 == 0]
    got = cover_tree.top_k(rows, rows.where("vec_id % 20 = 0"), 20, block_rows=300)
    assert sorted(map(tuple, got.collect())) == brute_top(points, asked, 20)


def test_an_id_takes_one_place_for_equal_scores():
    top = cover_tree.TopK(np.array([100]), 3)
    for _ in range(2):
        top.add(np.array([0]), np.array([[9.0, 9.0, 9.0, 9.0, 8.0, 7.0, 6.0]]), np.array([1, 1, 1, 1, 2, 3, 4]))
    assert [x.tolist() for x in top.best[0]] == [[9, 8, 7], [1, 2, 3]]


def checked_tree(pts, leaf):
    tree = cover_tree.CoverTree(pts, leaf)
    assert sorted(tree.order.tolist()) == list(range(len(pts)))
    for i in range(len(tree.low)):
        rows = tree.order[tree.low[i] : tree.high[i]]
        assert np.sqrt(((pts[rows] - tree.center[i]) ** 2).sum(1)).max() == pytest.approx(tree.radius[i])
        assert np.sqrt((pts[rows] ** 2).sum(1)).max() == pytest.approx(tree.top[i])
        if tree.kids[i]:
            c = tree.children(np.array([i]))
            assert tree.low[c[0]] == tree.low[i] and tree.high[c[-1]] == tree.high[i] and (tree.high[c[:-1]] == tree.low[c[1:]]).all()
        else:
            assert len(rows) <= leaf or tree.radius[i] == 0
    return tree


def test_tree_prunes_and_covers():
    pts = np.array([v for _, v in vectors(4000, 4, 1, 2)], np.int64)
    checked_tree(pts, 64)
    search = cover_tree.Search(pts[:64], np.arange(64), 5)
    search.add(pts, np.arange(4000))
    assert search.pruned > 0


def test_trees_of_64_dimensions_have_levels_and_prune_copies():
    """Vectors like those of the table, all of one length, with a group of near copies that is large enough to fill every k."""
    r = np.random.default_rng(8)
    unit = lambda x: np.floor(64 * x / np.sqrt((x**2).sum(1, keepdims=True))).astype(np.int64)
    pts = np.concatenate([unit(r.normal(size=(3000, 64))), unit(r.normal(size=(1, 64)) + r.normal(0, 0.02, (300, 64)))])
    tree, asked = checked_tree(pts, cover_tree.LEAF), np.arange(0, 3300, 20)
    assert tree.kids[0] and tree.kids[1:].any()
    want = brute_top([*enumerate(pts.tolist())], [(int(a), pts[a].tolist()) for a in asked], 20)
    for leaf, query_leaf, least in ((cover_tree.LEAF, cover_tree.QUERY_LEAF, 1), (64, 32, 15 * 500)):  # smaller leaves prune more, and take longer
        search = cover_tree.Search(pts[asked], asked, 20, cover_tree.CoverTree(pts[asked], query_leaf))
        assert search.tree.kids[0]
        search.add(pts, np.arange(3300), cover_tree.CoverTree(pts, leaf))
        assert search.pruned > 0 and search.points_pruned >= least
        assert sorted((int(q), r + 1, int(i), int(x)) for q, (s, d) in zip(asked, search.top.best, strict=True) for r, (x, i) in enumerate(zip(s, d, strict=True))) == want


def test_rounds_share_what_they_know(spark):
    points = vectors(2000, 8, 3)
    rows = spark.createDataFrame(points, "vec_id long, v array<long>")
    got = cover_tree.top_k(rows, rows.where("vec_id % 20 = 0"), 20, block_rows=100, query_bytes=4000, first_blocks=3, growth=2)
    assert sorted(map(tuple, got.collect())) == brute_top(points, [p for p in points if p[0] % 20 == 0], 20)


def test_op5_table_is_indexed_in_levels(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", cover_tree.quantized("embedding").alias("v")).where("v is not null").collect()
    pts, ids = np.array([r.v for r in rows], np.int64), np.array([r.vec_id for r in rows])
    search = cover_tree.Search(pts[ids % 20 == 0], ids[ids % 20 == 0], 20)
    assert search.tree.kids[0] and checked_tree(pts, cover_tree.LEAF).kids[1:].any()


PASSAGE = "a passage of well over fifty bytes that several documents share with each other"
DUPES = [(1, PASSAGE + " one"), (2, "two " + PASSAGE), (3, "x" * 200), (4, "y" + "x" * 90), (5, ""), (6, None), (7, "short"), (8, "short"), (9, PASSAGE + " one"), (9, PASSAGE + " one"), (10, "é" * 60 + PASSAGE[:49]), (11, "é" * 60), (12, PASSAGE * 3), (0, "né" + PASSAGE[5:60]), (13, "z" * 49), (14, "z" * 49)]


def test_suffix_dedup_small(spark):
    got = suffix_dedup.remove_repeats(rows_of(spark, [*DUPES, (None, PASSAGE)]).repartition(3), 50)
    want = suffix_dedup.brute_force([r for k, r in enumerate(DUPES) if k != 9])
    by = defaultdict(list)
    for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256)).collect():
        by[r[0]].append(tuple(r)[1:])
    assert by.pop(None)[0][:2] == (len(PASSAGE), 0)
    assert {i: set(v) for i, v in by.items()} == {i: {v} for i, v in want.items()} and len(by[9]) == 2
    assert suffix_dedup.remove_repeats(rows_of(spark, [])).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(rows_of(spark, []), 20)


def test_pairs_and_tables_find_the_same_stretches():
    r = np.random.default_rng(17)
    some = 0
    for _ in range(300):
        gram, group = bytes(r.integers(97, 99, 20).tolist()), {}
        for _ in range(r.integers(2, 9)):
            right, left = (bytes(r.integers(97, 99, n).tolist()) for n in (r.integers(0, 31), r.integers(0, 31)))
            if r.random() < 0.7:
                right, left = (b"a" * 30)[: len(right)] if r.random() < 0.7 else right, (b"a" * 30)[: len(left)] if r.random() < 0.7 else left
            group.setdefault(gram + right + suffix_dedup.END + left, {})[int(r.integers(0, 5))] = [100, 300]
        group = [(k, [(d, t, [at[t]]) for d, at in v.items() for t in (0, 1)]) for k, v in sorted(group.items())]

        def covered(limit):
            out = defaultdict(set)
            for doc, a, b in suffix_dedup.group_cuts(group, 50, 20, limit):
                out[doc].update(range(a, b))
            return out

        assert covered(48) == covered(0)
        some += bool(covered(0))
    assert some > 20


def test_suffix_dedup_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in queries.op6_suffix_dedup(spark, SF).collect()}
    assert got == suffix_dedup.brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_suffix_dedup_of_very_long_texts(spark):
    r = np.random.default_rng(18)
    long = "".join(r.choice(list("abcdefghij "), 300_000))
    rows = [(1, long), (2, "new start " + long[1000:250_000] + " new end"), (3, "z" * 100_000), (4, "y" + "z" * 60_000)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in suffix_dedup.remove_repeats(rows_of(spark, rows), 50).collect()}
    assert got == {i: v[:3] for i, v in suffix_dedup.brute_force(rows).items()}


def test_loser_tree_merges_without_looking_twice():
    r = np.random.default_rng(5)
    runs = [sorted({bytes(r.integers(97, 99, r.integers(0, 12)).tolist()) for _ in range(r.integers(0, 40))}) for _ in range(7)]
    coded = []
    for run in runs:
        entries = suffix_dedup.front_coded({k: [1, 2, [3]] for k in run})
        assert [k for _, k, _ in suffix_dedup.decoded(entries)] == run
        coded.append(suffix_dedup.decoded(entries))
    out = list(suffix_dedup.LoserTree(coded))
    assert [k for _, k, _ in out] == sorted(k for run in runs for k in run)
    for (_, a, _), (p, b, _) in zip(out, out[1:], strict=False):
        assert a[:p] == b[:p] and (p == min(len(a), len(b)) or a[p : p + 1] != b[p : p + 1])


def test_equal_stretches_have_equal_anchors():
    r = np.random.default_rng(1)
    shared = bytes(r.integers(97, 105, 60).tolist())
    texts = [bytes(r.integers(97, 105, 40).tolist()) + shared + bytes(r.integers(97, 105, 30).tolist()), shared, b"ab", b"", b"a" * 70]
    at, keys, n = suffix_dedup.anchors(texts, 50, 20)
    assert n[2] == n[3] == 0 and n[4] == 51
    first, second = set(at[: n[0]].tolist()), set(at[n[0] : n[0] + n[1]].tolist())
    for s in range(11):
        own = {p for p in second if s <= p <= s + 30}
        assert own and any(p + 40 in first for p in own)


def brute_components(rows, words, percent):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    common = Counter()
    held = defaultdict(list)
    for i in sorted(sets):
        for x in sets[i]:
            common.update((j, i) for j in held[x])
            held[x].append(i)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(s), root(i)) for i, s in sets.items()}


def edited(base, r, n):
    w = list(base)
    for _ in range(n):
        w[r.integers(len(w))] = f"w{r.integers(10**6)}"
    return " ".join(w)


def near_rows():
    r = np.random.default_rng(2)
    rows = []
    for f in range(12):
        base = [f"b{r.integers(400)}" for _ in range(r.integers(20, 120))]
        rows += [(len(rows) + k, edited(base, r, r.integers(0, 6))) for k in range(r.integers(2, 12))]
    n = len(rows)
    odd = ["one two", "ONE  two", "one two three", "", None, "  \n", rows[0][1], rows[0][1].upper(), "é É", "x y z w v"]
    return rows + [(n + k, t) for k, t in enumerate(odd)]


@pytest.mark.parametrize(("words", "percent", "block"), [(4, 85, 1 << 20), (5, 80, 1500), (2, 50, 3000), (1, 60, 1 << 20)])
def test_near_duplicates(spark, words, percent, block):
    rows = near_rows()
    got = ngram_join.near_duplicates(rows_of(spark, [*rows, (None, rows[0][1]), rows[3]]).repartition(3), words, percent, block)
    found = got.collect()
    assert len(found) == len(rows) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, words, percent)
    assert ngram_join.near_duplicates(rows_of(spark, []), words, percent).count() == 0


def test_documents_with_a_common_phrase_are_no_family(spark):
    """Unrelated sets that share a prefix token aren't joined by it; sets that may link always are."""
    r = np.random.default_rng(14)
    base = [r.integers(0, 1 << 42, 300, dtype=np.uint64) for _ in range(40)]
    near = []
    for x in base[:20]:
        y = x.copy()
        y[: r.integers(0, 40)] = r.integers(0, 1 << 42, dtype=np.uint64)
        near.append(np.unique(y))
    sets = base + near
    n = np.array([len(x) for x in sets])
    bits = np.array([ngram_join.sketch(x) for x in sets])
    u, v = ngram_join.plausible(np.zeros(len(sets), int), np.arange(len(sets)), n, n, bits, 85)
    groups = ngram_join.Groups(len(sets))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        groups.join(a, b)
    assert all(groups.root(i) == i for i in range(40))
    for i in range(20):
        both = len(np.intersect1d(sets[i], sets[40 + i]))
        assert 100 * both < 85 * (n[i] + n[40 + i] - both) or groups.root(40 + i) == i


@pytest.mark.parametrize(("compared", "block"), [(0, 3), (3, 512)])
def test_near_duplicates_of_frequent_tokens(spark, monkeypatch, compared, block):
    monkeypatch.setattr(ngram_join, "COMPARED", compared)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    rows = near_rows()
    got = ngram_join.near_duplicates(rows_of(spark, rows).repartition(3), 4, 85, 4000).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)


def test_a_large_family_of_chains(spark, monkeypatch):
    """Copies of copies: neighbours link, ends don't, so hubs alone join few of them."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(ngram_join, "COMPARED", 0)
    r = np.random.default_rng(16)
    words, rows = [f"a{k}" for k in range(120)], []
    for i in range(90):
        rows.append((int(r.permutation(90)[0]) * 1000 + i, " ".join(words)))
        step = 4 if i % 13 else 40  # a wide step parts the chain
        for at in range(i * 4, i * 4 + step):
            words[at % 120] = f"b{i}x{at}"
    got = ngram_join.near_duplicates(rows_of(spark, rows), 2, 80).collect()
    want = brute_components(rows, 2, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and 3 < len({c for _, c in want.values()}) < 30


def test_near_duplicates_of_very_long_texts(spark):
    r = np.random.default_rng(15)
    words = [f"w{k}" for k in r.integers(0, 10**7, 120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:118_000])), (3, " ".join(words[:60_000])), (4, "short text of few words"), (5, " ".join(words[::-1]))]
    got = ngram_join.near_duplicates(rows_of(spark, rows), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 4, 85)


def test_near_duplicates_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, SF).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], 4, 85)


def test_shared_keys_with_heavy_ones(spark, monkeypatch):
    monkeypatch.setattr(shared_keys, "CHUNK_KEYS", 500)
    docs = rows_of(spark, [(i, f"hot k{i % 50} own{i}") for i in range(400)])

    def extract(texts):
        words = [t.split() for t in texts]
        return np.array([int.from_bytes(w.encode().ljust(8, b"."), "little") * 0x9E3779B97F4A7C15 % (1 << 64) for ws in words for w in ws], np.uint64), np.array([len(w) for w in words])

    got = shared_keys.shared_keys(docs.coalesce(1), extract).collect()
    assert len(got) == 400 and all(r.n == 3 and len(r["keys"]) == 16 for r in got)
    assert {r.classes[-1] for r in got} | {r.classes[0] for r in got} == {3, shared_keys.HEAVY_CLASS}
    assert all(r["keys"] is None for r in shared_keys.shared_keys(docs.coalesce(1), extract, 0.9).collect())


def test_keys_are_counted_before_they_are_cut(spark):
    docs = rows_of(spark, [(i, "x") for i in range(3)])
    keys = np.array([5 << 40, (5 << 40) + 1, (5 << 40) + 2, 9 << 50, 9 << 50], np.uint64)  # three that are cut alike, and one twice
    got = shared_keys.shared_keys(docs.coalesce(1), lambda texts: (np.tile(keys, len(texts)), np.full(len(texts), 5))).collect()
    assert [r.n for r in got] == [4, 4, 4] and len({(r.h1, r.h2) for r in got}) == 1
    assert all(len(set(np.frombuffer(r["keys"], np.uint64).tolist())) == 4 and r["keys"] == got[0]["keys"] for r in got)


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(i, i) == root(i) for i in up)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_decontamination(spark):
    r = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz     "))
    noise = lambda n: "".join(r.choice(letters, n))
    items = [(i, noise(120 + 20 * i)) for i in range(8)] + [(90, None), (91, ""), (92, "?tiny?"), (None, noise(150))]
    docs, want = [], {}
    for k in range(60):
        t = noise(400)
        if k % 2 == 0:
            i, x = items[k % 8]
            x = list(x.upper() if k % 3 == 0 else x)
            e = k % 9
            for _ in range(e):
                x[r.integers(len(x))] = "#"
            t = t[:200] + "".join(x) + t[200:]
            want[k, i] = e
        docs.append((k, t))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (103, "é" + items[-1][1]), (None, items[1][1]), (104, "very long " * 20000 + items[2][1]), (105, "a ?TINY? one")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.find_passages(rows_of(spark, docs), bench, item_bytes=400).collect()
    got = {(x.doc_id, x.item_id): x for x in found}
    assert all(got[k].edits <= e for k, e in want.items())
    rest = set(got) - set(want)
    assert rest == {(102, 0), (103, None), (None, 1), (104, 2), (105, 92)} and len(found) == len(want) + 6
    assert (got[104, 2].start, got[104, 2].stop) == (200_000, 200_000 + 160)
    assert decontaminate.find_passages(rows_of(spark, []), bench).count() == 0
    assert decontaminate.find_passages(rows_of(spark, docs), bench.where("false")).count() == 0


def test_alignment_against_plain_edit_distance():
    r = np.random.default_rng(6)
    for _ in range(200):
        a, t = (bytes(r.integers(97, 100, r.integers(lo, hi)).tolist()) for lo, hi in ((3, 15), (0, 22)))
        d = [[0] * (len(t) + 1)]
        for i in range(len(a)):
            row = [i + 1]
            for j in range(len(t)):
                row.append(min(d[-1][j] + (a[i] != t[j]), d[-1][j + 1] + 1, row[j] + 1))
            d.append(row)
        best, got = min(d[-1]), decontaminate.alignment(a, t, 4)
        assert (got[0] if got else 9) == (best if best <= 4 else 9)


def nearest(item, text):
    """Edits, start and stop of the stretch of text nearest to item; the first of equally near ones."""
    d = [(0, j) for j in range(len(text) + 1)]
    for a in item:
        row = [(d[0][0] + 1, d[0][1])]
        for j, b in enumerate(text):
            row.append(min((d[j][0] + (a != b), d[j][1]), (d[j + 1][0] + 1, d[j + 1][1]), (row[j][0] + 1, row[j][1])))
        d = row
    stop = min(range(len(d)), key=lambda j: (d[j], j))
    return (*d[stop], stop)


def brute_passages(docs, items, rate=0.08):
    fold = lambda t: (t or "").encode().translate(decontaminate.FOLD)
    out = []
    for i, t in docs:
        for k, x in items:
            e, start, stop = nearest(fold(x), fold(t))
            if x and t and e <= int(rate * len(fold(x))):
                out.append((i, k, start, stop, e))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "expand"), [(1 << 18, 1 << 22), (300, 500)])
def test_passages_against_brute_force(spark, monkeypatch, window, expand):
    """Items of all lengths, with repeated grams, changed by up to and beyond their budget, in short and long texts."""
    monkeypatch.setattr(decontaminate, "WINDOW", window)
    monkeypatch.setattr(decontaminate, "EXPAND", expand)
    r = np.random.default_rng(9)
    noise = lambda n: "".join(r.choice(list("abcde fgh"), n))
    items = [noise(n) for n in (1, 5, 9, 12, 13, 20, 26, 40, 75, 110)] + ["-" * 60, "ab" * 40, "-" * 30 + noise(30), "é" * 20]
    docs = [noise(n) for n in (0, 3, 12, 40)]
    for k in range(40):
        x = list(items[k % len(items)])
        for _ in range(r.integers(0, 2 + len(x) // 10)):
            at = r.integers(len(x))
            x[at : at + r.integers(0, 2)] = "#" * r.integers(0, 2)
        docs.append(noise(r.integers(0, 200)) + "".join(x) + noise(r.integers(0, 200)))
    docs += ["-" * 400, "ab" * 150 + "-" * 61 + "ba" * 50, "x" + "-" * 29 + "#" + "-" * 40]
    docs, items = list(enumerate(docs)), list(enumerate(items))
    want = brute_passages(docs, items)
    found = decontaminate.Items([i for i, _ in items], [t.encode().translate(decontaminate.FOLD) for _, t in items], 10, 0.08).find([t.encode() for _, t in docs])
    assert {(d, i, e, a) for d, i, a, _, e in found} == {(d, i, e, a) for d, i, a, _, e in want} and len(found) == len(want)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_passages(df, bench, item_bytes=200).collect()
    assert sorted(((x.doc_id, x.item_id, x.start, x.stop, x.edits) for x in got), key=str) == want
    clean = decontaminate.without_passages(df, bench.where("length(text) > 10"), item_bytes=200).collect()
    assert [x.doc_id for x in clean] == [d for d, _ in docs if not any(w[0] == d and len(items[w[1]][1]) > 10 for w in want)]


def test_passages_in_a_text_of_one_byte_take_bounded_memory():
    import tracemalloc

    items = decontaminate.Items([1, 2, 3], [b"-" * 300, b"-" * 200 + b"!" + b"-" * 99, b"=" * 50], 10, 0.08)
    tracemalloc.start()
    got = items.find([b"-" * 80_000, b"-" * (1 << 20), b"x"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [(0, 1, 0, 300, 0), (0, 2, 0, 299, 1), (1, 1, 0, 300, 0), (1, 2, 0, 299, 1)]
    assert peak < 300 << 20


def test_op8_query_against_brute_force(spark):
    """Every document of the smallest table against some items, by plain edit distance; and exact copies of all items."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.start, r.stop, r.edits) for r in queries.op8_decontamination(spark, SF).collect()}
    fold = lambda t: (t or "").encode().translate(decontaminate.FOLD)
    exact = {(d, i): (a, a + len(fold(x)), 0) for d, t in docs for i, x in items if fold(x) and (a := fold(t).find(fold(x))) >= 0}
    assert exact and {k: v for k, v in got.items() if not v[2]} == exact
    hit, texts = {i for _, i in got}, {d for d, _ in got}
    some = [(i, x) for i, x in items if i in sorted(hit)[:3]]
    short = [(d, t) for d, t in docs if d in texts and len(t or "") < 3000][:6]
    want = brute_passages(short, some)
    assert [x for x in want] == sorted(((d, i, *got[d, i]) for d, i in got if d in dict(short) and i in dict(some)), key=str)
