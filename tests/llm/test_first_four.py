"""Packing, sharding, token counts and line dedup against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ctxweave.llm import common, line_dedup, packing, queries, sharding, token_counts

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, "a  b\n\n c\t"), (4, "word " * 3000), (5, "x"), (5, "x"), (None, "no id"), (6, "<|endoftext|> in text <|startoftext|>"), (7, "ÀÉ́ don't I'LL 12345  tab\x85é\x1cx"), (8, "!!"), (9, "a\nb\nA \n\n")]
BYTE_BPE = common.tokenizer_path("byte_bpe_50k.json"), common.tokenizer_path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, n_bytes string, shard string, ids string, pos string"


def odd(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "n", "s", "i", "p") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(common.tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def checked_pieces(pieces, docs, tokenizer, limits):
    want = Counter()
    for i, t in docs:
        want[i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])] += 1
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        by_doc[p["doc_id"], p["doc_tokens"]].append((p["start"], p["length"], tuple(int(x) for x in ids)))
        by_seq[p["sequence_id"]].append(p)
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= limits.tokens and len(s) <= limits.segments and sum(p["loss_tokens"] for p in s) <= limits.loss
    for (i, ids), n in want.items():
        got = sorted(by_doc[i, len(ids)])
        if n == 1:
            assert sum((x[2] for x in got), ()) == ids
        assert sum(x[1] for x in got) == n * len(ids)
    return by_seq


def test_packing_round_trip(spark, tokenizer):
    t = tokenizer["byte_bpe_50k.json"]
    for limits in (packing.Limits(), packing.Limits(tokens=64, segments=2, loss=40, window=3)):
        got = packing.pack_documents(odd(spark).coalesce(1), limits).collect()
        checked_pieces(got, ODD, t, limits)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = packing.pack_documents(docs).collect()
    seqs = checked_pieces(got, rows, t, packing.Limits())
    used = sum(p["length"] for p in got)
    assert used / (2048 * len(seqs)) > 0.98
    assert packing.pack_documents(docs.where("doc_id < 0")).count() == 0


def test_packing_prompt_bears_no_loss(spark):
    docs = spark.createDataFrame([(i, "one two three four five six seven eight", "one two three") for i in range(30)], "doc_id long, text string, q string")
    limits = packing.Limits(tokens=32, segments=4, loss=12, window=8)
    got = packing.pack_documents(docs.coalesce(1), limits, prompt="q").collect()
    assert sum(p["loss_tokens"] for p in got) == 30 * 6
    by = defaultdict(list)
    for p in got:
        by[p["sequence_id"]].append(p)
    assert all(sum(p["loss_tokens"] for p in s) <= 12 and len(s) <= 4 and sum(p["length"] for p in s) <= 32 for s in by.values())


def test_token_counts(spark, tokenizer):
    t = tokenizer["word_bpe_49k.json"]
    for df in (odd(spark), spark.read.parquet(f"{SF}/documents.parquet"), odd(spark, [])):
        rows = [(r.doc_id, r.text or "") for r in df.collect()]
        got = Counter(map(tuple, token_counts.count_tokens(df, entries=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()))
        want = Counter((i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 2048) for i, x in rows)
        assert got == want


def test_ring_is_filled_evenly_with_limited_movement(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "id % 7 as size", "'x' as shard", "'y' as slot")
    def place(n, slack=0.0):
        return {r.doc_id: r for r in sharding.shard_rows(rows, rows.doc_id, n, [rows.doc_id, rows.size], slack=slack).collect()}
    a, b = place(40), place(41)
    for got, n in ((a, 40), (b, 41)):
        counts = Counter(r.shard for r in got.values())
        assert len(got) == 4000 and len(counts) == n and max(counts.values()) - min(counts.values()) <= 1
        for s, c in counts.items():
            assert sorted(r.slot for r in got.values() if r.shard == s) == list(range(c))
    loose_a, loose_b = place(40, 0.25), place(41, 0.25)
    assert max(Counter(r.shard for r in loose_a.values()).values()) <= 126
    assert sum(loose_a[i].shard != loose_b[i].shard for i in loose_a) < 4000 * 0.25


def test_ring_hot_null_and_empty(spark):
    rows = spark.createDataFrame([(1, i) for i in range(900)] + [(None, i) for i in range(100)], "doc_id long, size long")
    got = sharding.shard_rows(rows, rows.doc_id, 7, [rows.size]).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [142, 143, 143, 143, 143, 143, 143]
    assert len({(r.shard, r.slot) for r in got}) == 1000
    assert sharding.shard_rows(rows.where("size < 0"), rows.doc_id, 7, [rows.size]).count() == 0
    with pytest.raises(ValueError):
        sharding.ring(10, 1, places=4)


def brute_lines(rows, least):
    space = " \t\n\x0b\f\r"
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(space).translate(low)
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or seen[key(x)] < least]
        out.append((i, "\n".join(kept), len(ls), len(ls) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("side", [0, 1000])
def test_line_dedup(spark, side):
    rows = [*ODD, *[(100 + i, f"Shared Line \n own {i}\n\tshared line\n É") for i in range(5)], (200, "\n".join(["SHARED line"] * 3))]
    for least in (2, 5, 6, 99):
        got = line_dedup.drop_shared_lines(odd(spark, rows), least, broadcast_rows=side)
        assert {"n_bytes", "shard", "ids", "pos"} <= set(got.columns)
        assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()) == brute_lines(rows, least)
    assert line_dedup.drop_shared_lines(odd(spark, []), 2).count() == 0


def test_lines_of_a_repeated_document_count_once(spark):
    rows = [(1, "twice held\nonly here")] * 3 + [(2, "twice held\nown")] + [(None, "own")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.drop_shared_lines(df, 2, doc="doc_id")
    assert Counter(tuple(r) for r in got.select("doc_id", "text", "n_dropped").collect()) == {(1, "only here", 1): 3, (2, "own", 1): 1, (None, "own", 0): 3}


def test_a_text_of_very_many_lines(spark):
    """Work grows with the lines, not with their square: 100,000 lines, half of them shared."""
    lines = [f"line {k // 2}" if k % 2 else f"own %d {k}" for k in range(100_000)]
    rows = [(i, "\n".join(x % i if "%" in x else x for x in lines)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_dedup.drop_shared_lines(df, 3).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == brute_lines(rows, 3)


def test_very_long_texts_and_other_columns(spark):
    """A text of some megabytes beside short ones, and columns that are called like those that operators make."""
    long = "some words of a line\n" * 200_000
    df = spark.createDataFrame([(1, long, "a", 1), (2, "x", "b", 2), (None, long, "c", 3)], "doc_id long, text string, n_lines string, n_dropped long")
    got = line_dedup.drop_shared_lines(df, 2)
    assert sorted((r.n_lines, r.n_dropped, r.text) for r in got.collect()) == [(1, 0, "x"), (200_001, 200_000, ""), (200_001, 200_000, "")]
    pieces = packing.pack_documents(df.where("doc_id = 1")).collect()
    assert sum(p.length for p in pieces) == pieces[0].doc_tokens and {p.length for p in pieces if p.length < 2048} in (set(), {pieces[0].doc_tokens % 2048})
    placed = sharding.shard_rows(df, df.doc_id, 2, [df.n_dropped]).collect()
    assert sorted(r.shard for r in placed) in ([0, 0, 1], [0, 1, 1]) and all(len(r.text) in (1, len(long)) for r in placed)


def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_query(spark, tokenizer):
    docs, got = documents(spark), defaultdict(list)
    rows = queries.op1_packing(spark, SF).collect()
    for r in rows:
        got[r.doc_id].append(r)
    assert set(got) == set(docs)
    for i, pieces in got.items():
        ids = np.array([*tokenizer["byte_bpe_50k.json"].encode(docs[i], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for s in by_seq.values():
        ends = [a + n for a, n in sorted(s)]
        assert [a for a, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_op2_query(spark):
    docs, by_shard = documents(spark), defaultdict(list)
    rows = queries.op2_sharding(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None) and 0 <= r.shard < 40
        by_shard[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    counts = [len(by_shard[s]) for s in range(40)]
    assert max(counts) - min(counts) <= 1


def test_ring_against_a_walk_of_single_keys():
    """Runs by place against placing key after key, first each at its own node, then the overflow clockwise."""
    r = np.random.default_rng(12)
    counts = {int(p): int(n) for p, n in zip(r.choice(256, 60, False), r.integers(1, 40, 60), strict=True)}
    nodes, room = sharding.ring(7, 4, 256), sharding.capacities(sum(counts.values()), 7, 0.0)
    used, at, waiting = [0] * 7, {}, []
    for place in sorted(counts):
        home = next((k for k, (p, _) in enumerate(nodes) if p >= place), 0)
        for key in range(counts[place]):
            shard = nodes[home][1]
            if used[shard] < room[shard]:
                at[place, key], used[shard] = (shard, used[shard]), used[shard] + 1
            else:
                waiting.append((place, key, home))
    for place, key, step in waiting:
        while used[shard := nodes[step][1]] >= room[shard]:
            step = (step + 1) % len(nodes)
        at[place, key], used[shard] = (shard, used[shard]), used[shard] + 1
    got = {(p, k): (s, slot + k - low) for p, low, high, s, slot in sharding.place_counts(counts, 7, 4, 0.0, 256) for k in range(low, high)}
    assert got == at


def test_op3_query(spark, tokenizer):
    docs = documents(spark)
    rows = queries.op3_token_counts(spark, SF).collect()
    want = {i: len(tokenizer["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(docs)
    assert all(r.n_bytes == len(docs[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows)


def test_long_units_are_not_kept(tokenizer):
    path, long = common.tokenizer_path("word_bpe_49k.json"), "x" * 5000
    lengths, words = token_counts.Lengths(path, token_counts.pack_table({})), tokenizer["word_bpe_49k.json"]
    assert sum(lengths.many([f"a {long} a"])) == len(words.encode(f"a {long} a", add_special_tokens=False).ids) and set(lengths.known) == {"a"}
    bpe = packing.ByteBpe(*BYTE_BPE)
    assert np.frombuffer(bpe(f"a {long} b"), "<u4").tolist() == tokenizer["byte_bpe_50k.json"].encode(f"a {long} b", add_special_tokens=False).ids and set(bpe.units) == {"\n", "a", " b"}


def test_every_unit_of_a_table_is_encoded_as_by_the_library(spark, tokenizer):
    """All different units of the documents at a larger scale, and a rank file of another vocabulary."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").collect()]
    bpe, t = packing.ByteBpe(*BYTE_BPE), tokenizer["byte_bpe_50k.json"]
    for _ in bpe.many(texts):
        pass
    units = sorted(bpe.units)
    assert len(units) > 20_000
    assert [np.frombuffer(bpe.units[u], "<u4").tolist() for u in units] == [e.ids for e in t.encode_batch(units, add_special_tokens=False)]
    other = packing.ByteBpe(BYTE_BPE[0], common.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    with pytest.raises(ValueError, match="rank file|line ends"):
        list(other.many(texts))


def test_full_caches_change_nothing(spark, tokenizer):
    """Odd words of many scripts, with caches that are full at once or in the middle of a text."""
    texts = [*documents(spark).values()][:60] + ["naïve don't ſtraße İstanbul ΑΣ 12,5% ½ x\u0301 日本語 🙂🙂 ﬁn e\u200bz \u00a0 ok", "we'll we'LL a'b '' ... !!?", "\ufeffstart", "a\u2028b\x0bc"]
    for cached in (0, 3, 10**6):
        bpe = packing.ByteBpe(*BYTE_BPE, cached)
        lengths = token_counts.Lengths(common.tokenizer_path("word_bpe_49k.json"), token_counts.pack_table({"the": 1}), cached)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in bpe.many(texts, 5000)] == [tokenizer["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids for t in texts]
            assert list(lengths.many(texts, 5000)) == [len(tokenizer["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids) for t in texts]


def test_texts_with_other_white_space_go_whole(tokenizer):
    """Also where it stands beside a space, which the number of words doesn't show; new units are learned with long ones among them."""
    from ctxweave.llm.pretokens import spaced_units

    encode = packing.ByteBpe(*BYTE_BPE)
    for c in (chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) not in " \n"):
        assert spaced_units(f"a {c}b c") is None and spaced_units(f"a{c}b") is None
    rows = [f"a {c}b\nc{c}d" for c in "\t\xa0 "] + ["one two\nthree " + "x" * 200 + " four", "four " + "x" * 200]
    assert spaced_units(rows[-1]) == ["four", " " + "x" * 200]
    for t, ids in zip(rows, encode.many(rows), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids
