"""The context engine's behaviour on small contexts, against plain models and known cases."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ctxweave import staging
from ctxweave.functions import pricing, text
from ctxweave.operators import bookend, budget, chunks, compaction, dedup, diff, duplication, health, metrics, prune, structural, summarize, tfidf
from ctxweave.plans import commands, pipeline
from ctxweave.sources import config, formats, providers, state, transcript
from ctxweave.streaming import jobs

ROLES = ["system", "user", "assistant"]
WORDS = "alpha beta gamma delta the and sure budget é $3,000 done ok".split()


def contexts(spark, n=12, seed=3):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for p in range(r.randrange(0, 16)):
            lines = [" ".join(r.choice(WORDS) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(1, 4))]
            rows.append((c, p, "system" if p == 0 and r.random() < 0.5 else r.choice(ROLES[1:]), "\n".join(lines)))
    return chunks.build_chunks(spark.createDataFrame(rows, "ctx_id long, pos long, role string, content string"))


def by_ctx(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.ctx_id, []).append(r.asDict())
    return {c: sorted(rows, key=lambda r: r["pos"]) for c, rows in out.items()}


def chat(spark, *messages, ctx=1):
    return chunks.build_chunks(spark.createDataFrame([(ctx, i, r, t) for i, (r, t) in enumerate(messages)], "ctx_id long, pos long, role string, content string"))


def test_budget_against_a_loop(spark):
    df = contexts(spark)
    before = by_ctx(df)
    for limit in (5, 20, 60):
        after = by_ctx(budget.truncate_to_budget(df, limit))
        for c, rows in before.items():
            users = [r["pos"] for r in rows if r["role"] == "user"][-2:]
            left, gone = sum(r["token_count"] for r in rows), set()
            for r in rows:
                if left <= limit:
                    break
                if r["role"] != "system" and r["pos"] not in users:
                    gone.add(r["pos"])
                    left -= r["token_count"]
            want = [r["content"] for r in rows if r["pos"] not in gone]
            assert [r["content"] for r in after.get(c, [])] == want
            assert [r["pos"] for r in after.get(c, [])] == list(range(len(want)))
    with pytest.raises(ValueError):
        budget.truncate_to_budget(df, 0)


def test_bookend_keeps_messages_and_puts_best_at_the_ends(spark):
    df = contexts(spark)
    a, b = by_ctx(df), by_ctx(bookend.bookend(df))
    for c in a:
        assert sorted(r["content"] for r in a[c]) == sorted(r["content"] for r in b[c])
        score = [r["relevance_score"] for r in b[c]]
        if score:
            assert score[0] == max(score) and (len(score) < 2 or score[-1] == sorted(score)[-2])
    asked = by_ctx(bookend.bookend(chat(spark, ("user", "alpha beta"), ("user", "gamma"), ("user", "delta words")), "gamma?"))[1]
    assert asked[0]["content"] == "gamma" and asked[0]["relevance_score"] == 1.0
    assert by_ctx(bookend.bookend(df, "?!")) == b


def test_duplicates_against_all_pairs(spark):
    df = contexts(spark, 6)
    sets = {(r.ctx_id, r.pos): set(r.w) for r in df.select("ctx_id", "pos", text.duplicate_words("content").alias("w")).collect()}
    for threshold in (0.15, 0.5, 1.0, 0.0):
        want = {(c, i, j): len(a & b) / len(a | b) if a | b else 0.0 for (c, i), a in sets.items() for (d, j), b in sets.items() if c == d and i < j}
        want = {k: v for k, v in want.items() if v >= threshold}
        for pairwise in (2000, 5, 0):
            got = {(r.ctx_id, r.pos_a, r.pos_b): r.similarity for r in duplication.duplicate_pairs(df, threshold, pairwise).collect()}
            assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_pairs_of_large_contexts_meet_block_by_block(spark, monkeypatch):
    """Several blocks of several contexts, copies, empty texts; and no join that pairs words with words."""
    rows = [(c, i, "user", " ".join(f"w{(i * k * 7 + c) % 23}x{k}" for k in range(i % 9))) for c in (1, 2) for i in range(60)]
    df = chunks.build_chunks(spark.createDataFrame(rows, "ctx_id long, pos long, role string, content string"))
    want = sorted(map(tuple, duplication.duplicate_pairs(df).collect()))
    assert want
    monkeypatch.setattr(duplication, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(duplication, "STEP", 7)
    monkeypatch.setattr(duplication, "MEETINGS", 300)
    got = duplication.duplicate_pairs(df, small=0)
    assert sorted(map(tuple, got.collect())) == want
    assert not any(x in got._jdf.queryExecution().toString() for x in ("SortMergeJoin", "BroadcastHashJoin", "Exchange hashpartitioning(w"))


def test_copies_in_a_block_are_compared_once():
    """A block holds each set once, whatever the order of its words, and its pairs are those of all chunks."""
    sets = [[5, 6, 7], [7, 6, 5], [], [8], [5, 6, 7], [6, 7]] * 3
    rows = pa.table({"ctx_id": pa.array([4] * 18), "pos": pa.array(range(18)), "chunk_index": pa.array(range(18)), "token_count": pa.array([1] * 18), "n": pa.array([len(x) for x in sets], pa.int32()), "ws": pa.array(sets, pa.list_(pa.int64()))})
    (block,) = duplication._blocks(rows, 4)
    assert block.n.tolist() == [3, 1, 2] and len(block.pos) == 15 and duplication._blocks(rows, 5) == []
    owner, h = duplication._flat(rows)
    found = {(int(block.pos[x]), int(y), round(float(z), 6)) for a, b, s in block.pairs(np.arange(18), np.array([len(x) for x in sets]), owner, *np.unique(h, return_inverse=True), 0.5) for x, y, z in zip(a, b, s, strict=True)}
    share = lambda x, y: round(len(x & y) / max(1, len(x | y)), 6)
    assert found == {(i, j, share(set(sets[i]), set(sets[j]))) for j in range(18) for i in range(j) if share(set(sets[i]), set(sets[j])) >= 0.5}


def test_words_of_a_large_context_are_found_by_many_tasks(spark, monkeypatch):
    """They were found by the one task to which the context's windows had brought its texts; the top pairs stay the same."""
    df = chunks.build_chunks(spark.createDataFrame([(1, i, "user", f"alpha beta w{i % 5} x{i}") for i in range(60)], "ctx_id long, pos long, role string, content string"))
    want = sorted(map(tuple, duplication.top_pairs(duplication.duplicate_pairs(df)).collect()))
    staged = []
    monkeypatch.setattr(duplication, "STEP", 10)
    monkeypatch.setattr(duplication, "stage", lambda *a, **b: staged.append(staging.stage(*a, **b)) or staged[-1])
    with duplication.confs(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        assert sorted(map(tuple, duplication.top_pairs(duplication.duplicate_pairs(df, small=0)).collect())) == want and len(want) == 3
    assert staged[0].select(F.input_file_name()).distinct().count() > 1


def test_health_of_large_contexts_reads_texts_once(spark, monkeypatch):
    rows = [(c, i, "user", f"alpha beta w{i % 3} x{i} " * 9) for c in (1, None) for i in range(20)]
    df = chunks.build_chunks(spark.createDataFrame(rows, "ctx_id long, pos long, role string, content string"))
    want = sorted(map(str, health.analyze(df).collect()))
    monkeypatch.setattr(duplication, "is_small", lambda df: False)
    got = health.analyze(df)
    assert sorted(map(str, got.collect())) == want and len(want) == 2
    for plan in (got, got.select("recommendations")):
        assert "Window" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_health_of_empty_single_and_identical(spark):
    assert health.analyze(chat(spark, ("user", "x")).where("false")).count() == 0
    one = health.analyze(chat(spark, ("user", "hello"))).first()
    assert one.dead_zone_score == 100 and one.budget_score == 100 and one.health_score == 100 and one.status == "GOOD"
    many = health.analyze(chat(spark, *[("user", "alpha beta gamma " * 20)] * 6)).first()
    assert many.duplicate_pairs == 15 and many.duplicate_ratio == 1.0 and many.duplication_score == 0
    assert json.loads(health.to_json(health.analyze(chat(spark, ("user", "hello")))).first().json)["health_score"] == 100


def test_prune_rules(spark):
    df = chat(spark, ("system", "ok"), ("user", "Great question!"), ("assistant", "Sure, I can help\n```\nok\n```\n\n# Plan\nThe database migration runs nightly against seventeen production clusters"), ("user", "thanks"), ("user", "ok"))
    out = by_ctx(prune.prune(df, 0.3))[1]
    assert [r["content"] for r in out] == ["ok", prune.PLACEHOLDER, "```\nok\n```\n\n# Plan\nThe database migration runs nightly against seventeen production clusters", "thanks", "ok"]
    assert out[1]["token_count"] == 7
    assert len(by_ctx(prune.prune(contexts(spark), 0.9))) == len(by_ctx(contexts(spark)))


def test_exact_dedup_keeps_the_first(spark):
    out = by_ctx(dedup.dedup_exact(chat(spark, ("user", "a"), ("assistant", "b"), ("user", "a"))))[1]
    assert [(r["pos"], r["chunk_index"], r["content"]) for r in out] == [(0, 0, "a"), (1, 1, "b")]


def test_semantic_dedup(spark):
    class Fixed:
        """Vectors by first word."""

        def embed(self, texts):
            return [[1.0, 0.0] if t.startswith("alpha") else [0.0, 1.0] for t in texts]

    df = chat(spark, ("user", "alpha one two three. other sentence here"), ("user", "alpha one two three and more and more words"), ("user", "zeta"))
    out = by_ctx(dedup.dedup_semantic(df, Fixed()))[1]
    assert len(out) == 2 and out[0]["content"].endswith("[merged from duplicate]: other sentence here")
    assert by_ctx(dedup.dedup_semantic(chat(spark, ("user", "same words"), ("user", "same words"))))[1][1]["content"] == "same words"  # no word tells two apart
    five = chat(spark, *[("user", "identical content words")] * 2, ("user", "other thing"), ("user", "third matter"), ("user", "fourth topic"))
    assert len(by_ctx(dedup.dedup_semantic(five))[1]) == 4
    assert len(by_ctx(dedup.dedup_semantic(chat(spark, ("user", "single"))))[1]) == 1


def test_semantic_dedup_without_a_matrix_of_words(monkeypatch):
    """As by dense vectors of all chunks, with copies, near copies, empty and wordless texts; and those are never made."""
    class Dense:
        def embed(self, texts):
            return tfidf.TfIdf().embed(texts)

    rng = random.Random(5)
    base = [" ".join(f"w{rng.randrange(90)}" for _ in range(rng.randrange(3, 30))) for _ in range(25)]
    texts = [*base, *base[:6], "", "", "the", *(f"{t}. {rng.choice(base)}\nand w{rng.randrange(90)} new" if rng.random() < 0.4 else t + f" w{k}" for k, t in enumerate(base))]
    rng.shuffle(texts)
    tokens = [len(t.encode()) // 4 for t in texts]
    want = {(t, s): dedup.resolve(texts, tokens, Dense(), t, s) for t in (0.3, 0.6, 0.85) for s in (False, True)}
    assert any(added for _, added in want.values())
    monkeypatch.setattr(tfidf.TfIdf, "embed", None)
    assert {k: dedup.resolve(texts, tokens, tfidf.TfIdf(), *k) for k in want} == want


def test_cosines_at_a_threshold_are_as_in_sql():
    """A cosine of just 0.7 isn't below 0.7, as single precision has it."""
    a, b = (np.array(x, np.float32) for x in ([2, 4, 1, 2, 2, 4, 0, 0], [2, 5, 0, 1, 0, 4, 3, 5]))
    assert dedup.cosine(a, b) == 0.7 and [x[1 - i] for i, x in enumerate(dedup.cosine_rows([a, b]))] == [0.7, 0.7]


def test_summarize(spark):
    class Echo:
        def complete(self, system, prompt):
            return "short\nnote"

    turns = [("system", "rules"), *[("user" if i % 2 else "assistant", f"turn {i} " + "word " * 30) for i in range(15)]]
    plain = by_ctx(summarize.summarize(chat(spark, *turns)))[1]
    assert [r["content"][:7] for r in plain] == ["rules", *(f"turn {i} "[:7] for i in range(3, 15))]
    told = by_ctx(summarize.summarize(chat(spark, *turns), Echo()))[1]
    assert told[1]["content"] == "[Conversation summary]\nshort\nnote" and told[2]["content"] == "- short\n- note" and told[-1]["content"].startswith("turn 14")
    few = chat(spark, ("user", "a"), ("system", "b"), ("user", "c"))
    assert [r["content"] for r in by_ctx(summarize.summarize(few))[1]] == ["a", "b", "c"]
    only = chat(spark, ("system", "b"))
    assert [r["content"] for r in by_ctx(summarize.summarize(only))[1]] == ["b"]


@pytest.mark.parametrize(("given", "want"), [
    ('{"a":1,"created_at":"x","meta":{},"data":{"v":2}}', '```json\n{\n  "a": 1,\n  "data": {\n    "v": 2\n  }\n}\n```'),
    ('{"result":{"b":1},"id":"12345678-1234-1234-1234-123456789abc"}', '```json\n{\n  "b": 1\n}\n```'),
    ('[[[[[1,2]]]]]', '```json\n[\n  [\n    [\n      [\n        "[...2 items]"\n      ]\n    ]\n  ]\n]\n```'),
    ('{"a":{"b":{"c":{"d":{"e":1,"f":2}}}}}', '```json\n{\n  "a": {\n    "b": {\n      "c": {\n        "d": "{...2 fields}"\n      }\n    }\n  }\n}\n```'),
    ("{not json}", "{not json}"),
    ('{"a":NaN}', '{"a":NaN}'),
    ("```json\n{bad\n```", "```json\n{bad\n```"),
    ("plain\r\ntext\n", "plain\ntext"),
    ("a\n```py\nopen", "a\n\n```py\nopen"),
    ("```\nx\n```", "```\nx\n```"),
    ("", ""),
])
def test_structural_cases(given, want):
    assert structural.compress_text(given) == want


def test_structural_code():
    body = "\n".join(f"    x{i} = 1" for i in range(20))
    assert structural.compress_text(f"```python\nimport os\ndef f(a):\n    \"\"\"Doc.\"\"\"\n{body}\n\ny = 2\n```") == '```python\nimport os\ndef f(a):\n    """Doc."""\n    # ... (21 lines)\ny = 2\n```'
    assert structural.compress_text(f"```py\nclass A:\n    '''More\n    lines'''\n    def m(self):\n{body}\n```") == "```python\nclass A:\n    '''More\n    lines'''\n    # ... (21 lines)\n```"
    js = "\n".join(f"  call({i});" for i in range(20))
    assert structural.compress_text(f"```js\nexport function go(\n  a,\n) {{\n{js}\n}}\nconst k = 1;\n```") == "```js\nexport function go(\n  a,\n) {\n    /* ... (20 lines) */\n}\nconst k = 1;\n```"
    rs = "\n".join(f"    let x{i} = 1;" for i in range(20))
    assert structural.compress_text(f"```rs\nfn one() {{}}\na\nb\nc\nd\ne\npub(crate) fn f() {{\n{rs}\n}}\n```") == "```rust\nfn one() {}\na\nb\nc\nd\ne\npub(crate) fn f() {\n    /* ... (20 lines) */\n}\n```"
    md = "intro\n# Keep Budget\ntext\n# Drop\none two\n\nthree\n# Bare\n"
    assert structural.compress_text(md, "budget") == "intro\n# Keep Budget\ntext\n# Drop [collapsed: 2 paragraphs, ~4 tokens]\n# Bare"
    assert structural.compress_text(md) == md.rstrip("\n")


def test_structural_column_keeps_plain_rows(spark):
    got = structural.structural(chat(spark, ("user", "plain text"), ("user", '{"a": 1}'), ("user", "tail\n")))
    assert [r["content"] for r in by_ctx(got)[1]] == ["plain text", '```json\n{\n  "a": 1\n}\n```', "tail"]


def test_pipeline_names_and_order(spark):
    df = contexts(spark, 4)
    assert pipeline.resolve(None, "balanced") == ["bookend", "structural"] and pipeline.resolve() == ["bookend"]
    for bad in ({"strategies": ["nope"]}, {"preset": "nope"}, {"budget": 0}):
        with pytest.raises(ValueError):
            pipeline.optimize(df, **bad)
    steps = pipeline.explain_steps(df, ["bookend", "dedup"]).collect()
    assert [s.strategy for s in steps] == ["bookend", "dedup"] and steps[0].before_tokens == steps[0].after_tokens
    pipeline.register("shout", lambda d, c: d.withColumn("content", F.upper("content")))
    try:
        assert pipeline.optimize(df, ["shout"]).count() == df.count()
        with pytest.raises(ValueError):
            pipeline.register("shout", pipeline.STRATEGIES["shout"])
    finally:
        del pipeline.STRATEGIES["shout"]


def test_each_context_is_independent(spark):
    df = contexts(spark, 5)
    config_ = pipeline.PipelineConfig(prune_threshold=0.6)
    together = by_ctx(pipeline.optimize(df, ["bookend", "dedup", "prune"], config=config_))
    alone = {}
    for c in range(5):
        alone |= by_ctx(pipeline.optimize(df.where(f"ctx_id = {c}"), ["bookend", "dedup", "prune"], config=config_))
    assert together == alone


def test_diff_passes(spark):
    long = "x" * 100
    before = chat(spark, ("user", "a"), ("user", long + " tail"), ("assistant", "gone for good"), ("user", "b"))
    after = chat(spark, ("user", "b"), ("user", long), ("user", "a"))
    out = commands.diff(before, after)
    assert sorted((r.pos_before, r.pos_after) for r in out["moved"].collect()) == [(0, 2), (3, 0)]
    assert [(r.pos_before, r.before_tokens, r.after_tokens) for r in out["compressed"].collect()] == [(1, 27, 25)]
    assert [r.pos_before for r in out["removed"].collect()] == [2]
    s = out["summary"].first()
    assert s.before_messages == 4 and s.after_messages == 3 and s.token_change_pct < 0


RAW = {
    "openai": '[{"role":"user","content":"a","relevance_score":3,"name":"n"},{"role":"assistant","content":"b"}]',
    "anthropic": '[{"role":"user","content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]},{"role":"assistant","content":"c"}]',
    "rag_chunks": '[{"content":"a","score":0.25,"metadata":{"x":1}},{"content":"b"}]',
    "raw": '{"role":"user"}',
}


def test_formats(spark):
    df = spark.createDataFrame(list(enumerate([*RAW.values(), "[]", "no json", '[{"role":"user"}]', '[{"x":1}]', ""])), "ctx_id long, raw string")
    kinds = [r[0] for r in df.select(formats.detect_format("raw"), "ctx_id").orderBy("ctx_id").collect()]
    assert kinds == ["openai", "anthropic", "rag_chunks", "raw", "openai", "raw", "openai", "raw", "raw"]
    rows = formats.parse_messages(df)
    got = {}
    for r in rows.orderBy("ctx_id", "pos").collect():
        got.setdefault(r.ctx_id, []).append((r.role, r.content, r.relevance_score, r.error))
    assert got[0] == [("user", "a", 3.0, None), ("assistant", "b", None, None)]
    assert got[1] == [("user", "a\n\nb", None, None), ("assistant", "c", None, None)]
    assert got[2] == [("document", "a", 0.25, None), ("document", "b", None, None)]
    assert got[3] == [("document", '{"role":"user"}', None, None)] and 4 not in got and got[6][0][3]
    built = {(r.ctx_id, r.pos): r.relevance_score for r in commands.load(df).collect()}
    assert built[0, 0] == 1.0 and built[2, 0] == 0.25 and built[2, 1] == 0.9
    assert formats.parse_messages(df.where("ctx_id = 2"), "raw").first().content == RAW["rag_chunks"]
    with pytest.raises(ValueError):
        formats.parse_messages(df, "xml")
    with pytest.raises(Exception, match="not valid as openai"):
        formats.parse_messages(df.where("ctx_id = 6"), failfast=True).collect()


def test_files_that_are_not_utf8(spark, tmp_path):
    (tmp_path / "a.json").write_text(RAW["openai"])
    (tmp_path / "b.bin").write_bytes(b"\xff\xfe\x00")
    rows = {r.path.rpartition("/")[2]: r for r in formats.read_texts(spark, str(tmp_path)).collect()}
    assert rows["a.json"].error is None and rows["b.bin"].raw is None and rows["b.bin"].error


TRANSCRIPT = [
    '{"type":"user","message":{"role":"user","content":"hello"}}',
    "",
    "not json",
    '{"message":{"role":"user","content":"no type"}}',
    '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"look"},{"type":"tool_use","id":"t1","name":"Bash","input":{"b":1,"a":"x"}},{"type":"tool_use","id":"t2","name":"Read","input":{}},{"type":"thinking"}]}}',
    '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t1","content":"first"},{"type":"tool_result","tool_use_id":"t1","content":"last"},{"type":"tool_result","tool_use_id":"zz","content":"orphan"},{"type":"tool_result","tool_use_id":"t2"}]}}',
    '{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t2","content":["array"]}]}}',
    '{"type":"system","message":{"role":"system","content":""}}',
    '{"type":"summary"}',
    '{"type":"user","message":{"role":"user","content":""}}',
]


def test_transcript(spark):
    df = spark.createDataFrame([(1, "\n".join(TRANSCRIPT), "s.jsonl")], "ctx_id long, raw string, path string")
    out = by_ctx(commands.load(df, transcripts=True))[1]
    assert [(r["role"], r["content"]) for r in out] == [("system", ""), ("user", "hello"), ("assistant", "look"), ("tool_interaction", '[Tool: Bash] Input: {"a":"x","b":1} Output: last'), ("tool_interaction", "[Tool: Read] Input: {} Output: (no result)")]
    parsed = transcript.parse_transcript(transcript.transcript_lines(df))
    assert parsed.where("not valid").count() == 3 and parsed.count() == 9


def test_long_tool_output(spark):
    rows = spark.createDataFrame([("a" * 5000,), ("é" * 3000,), ("short",), (None,)], "t string")
    got = [r[0] for r in rows.select(transcript.shortened(F.col("t"))).collect()]
    assert got[0] == "a" * 2048 + " … [output truncated, 1250 tokens]" and got[1] == "é" * 1024 + " … [output truncated, 1500 tokens]" and got[2] == "short"


def test_loss_and_injection(spark):
    df = chat(spark, ("user", "The budget must stay below $50K. The budget must stay below $50K."), ("assistant", "We chose REST because of the team."), ("user", "nothing here"))
    items = compaction.extract_items(df)
    kinds = {r.content: (r.category, r.occurrence_count) for r in items.collect()}
    assert kinds["The budget must stay below $50K."] == ("Constraint", 2) and kinds["We chose REST because of the team."][0] == "Decision"
    said = spark.createDataFrame([(1, "budget must stay below $50k the")], "ctx_id long, summary string")
    states = {r.category: r.state for r in compaction.loss_classify(items, said).collect()}
    assert states == {"Constraint": "preserved", "Decision": "lost"}
    report = compaction.loss_report(compaction.loss_classify(items, said)).first()
    assert (report.total_fingerprinted, report.preserved_count, report.lost_count) == (2, 1, 1)
    chosen = compaction.injection_select(items, 4)
    assert chosen.first().truncated and chosen.first().tokens == 4 and len(chosen.first().content) == 16
    assert "recovered from pre-compaction analysis (2 items" in compaction.injection_text(compaction.injection_select(items, 100)).first().text


def test_state_store(spark, tmp_path):
    s = state.StateStore(spark, f"{tmp_path}/state")
    assert s.init() and not s.init() and s.settings()["injection_budget_tokens"] == 4096
    row = lambda sid, text: spark.createDataFrame([(sid, text)], "session_id string, text string")
    assert s.take_injection("a") is None
    s.append("pending_injections", row("a", "one"), 1)
    s.append("pending_injections", row("a", "two"), 2)
    s.append("pending_injections", row("a_1", "other"), 3)
    assert s.latest("pending_injections", "a").first().text == "two"
    assert s.take_injection("a") == "two" and s.take_injection("a") is None and s.take_injection("a_1") == "other"
    event = spark.createDataFrame([("a", "t1", 10, 7)], "session_id string, timestamp string, total_items long, preserved long")
    s.append("compaction_log", event, 1)
    assert s.history("a").count() == 1 and state.history_ratios(s.history()).first().preserved_ratio == 0.7
    with pytest.raises(ValueError):
        s.path("nope")


def test_config_and_providers(tmp_path):
    project = tmp_path / "p.toml"
    user = tmp_path / "u.toml"
    user.write_text("[prune]\nthreshold = 0.4\n")
    assert config.load(project, user).prune_threshold == 0.4
    project.write_text('[optimize]\nstrategies = ["prune"]\nbudget = 0\n[proxy]\nbudget = 0\n')
    c = config.load(project, user)
    assert c.strategies == ["prune"] and c.budget is None and c.prune_threshold is None and c.requests == {"budget": None}
    assert config.load(tmp_path / "x", tmp_path / "y").source == "defaults" and config.chosen(None, 2, 3) == 2
    assert providers.embedding_provider(None) is None and providers.embedding_provider("tfidf").embed([]) == []
    for f in (providers.embedding_provider, providers.llm_provider):
        with pytest.raises(ValueError):
            f("nope")
    assert pricing.model_budget("default") == 128_000


def test_watch_reads_new_versions(spark, tmp_path):
    src, ck = f"{tmp_path}/in", f"{tmp_path}/ck"
    seen, alerts = [], []
    put = lambda v, raw: spark.createDataFrame([(7, v, raw)], jobs.RAW_SCHEMA).coalesce(1).write.mode("append").parquet(src)
    put(1, RAW["openai"])
    go = lambda: jobs.watch(spark, src, lambda df, e: seen.extend(df.collect()), ck, lambda df, e: alerts.extend(df.collect()), 101, True, f"{tmp_path}/out", interval=None).awaitTermination()
    go()
    put(2, json.dumps([{"role": "user", "content": "new words"}]))
    go()
    assert [r.n_chunks for r in seen] == [2, 1] and len(alerts) == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    for bad in ((src, True, None), (src, False, "o"), (src, True, src)):
        with pytest.raises(ValueError):
            jobs.validate_watch(*bad)


def test_requests(spark, tmp_path):
    body = lambda **k: json.dumps({"model": "gpt-4o", "temperature": 0.5, **k})
    good = body(messages=[{"role": "user", "content": "a b c"}, {"role": "user", "content": "same"}, {"role": "user", "content": "same", "name": "n"}], stream=True)
    rows = [(1, jobs.CHAT_PATH, good), (2, jobs.CHAT_PATH, body(messages=[{"role": "user", "content": ["x"]}])), (3, "/v1/models", "{}"), (4, jobs.CHAT_PATH, "not json"), (5, jobs.CHAT_PATH, body(messages=[]))]
    df = spark.createDataFrame(rows, jobs.REQUEST_SCHEMA)
    got = {r.request_id: r for r in jobs.optimize_requests(df, ["dedup"]).collect()}
    assert json.loads(got[1].body) == {"model": "gpt-4o", "temperature": 0.5, "stream": True, "messages": [{"role": "user", "content": "a b c"}, {"role": "user", "content": "same"}]}
    assert got[1].was_optimized and got[1].is_streaming and (got[1].original_tokens, got[1].optimized_tokens) == (4, 3)
    assert got[2].was_fallback and not got[2].was_optimized and all(got[i].body == rows[i - 1][2] for i in (2, 3, 4, 5))
    assert not any(got[i].was_fallback or got[i].was_optimized for i in (3, 4, 5))
    dry = {r.request_id: r for r in jobs.optimize_requests(df, ["dedup"], dry_run=True).collect()}
    assert dry[1].body == good and dry[1].was_optimized
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    jobs.serve(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck", ["bookend"], interval=None).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/log").count() == 5


def test_running_metrics(spark, tmp_path):
    rows = spark.createDataFrame([("gpt-4o", 100, 60), ("gpt-4o", 0, 0), ("x", 10, 20)], "model string, original_tokens long, optimized_tokens long")
    rows.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")
    q = jobs.running_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    q.stop()
    assert {r.model: (r.requests, r.tokens_saved) for r in spark.table("running").collect()} == {"gpt-4o": (1, 40), "x": (1, 0)}


def test_report_and_message_output(spark, tmp_path):
    report = health.analyze(chat(spark, ("user", "hello"))).first().asDict()
    assert commands.show_report(report).startswith("Context health: 100/100  GOOD")
    commands.write_messages(chat(spark, ("user", "hello")), f"{tmp_path}/m")
    assert json.loads(spark.read.text(f"{tmp_path}/m").first()[0]) == {"ctx_id": 1, "messages": [{"role": "user", "content": "hello"}]}
    with pytest.raises(ValueError):
        commands.analyze(chat(spark, ("user", "a")), output="xml")


def test_byte_cut(spark):
    texts = ["", "abc", "aé", "日本語", "🙂🙂", "é" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (0, 1, 2, 3, 4, 5, 7):
        want = [t.encode()[:most].decode(errors="ignore") for t in texts]
        assert [r[0] for r in df.select(text.cut_bytes("t", most)).collect()] == want


def test_long_outputs_are_cut_where_a_character_ends(spark):
    def cut(t):
        size = 0
        for i, ch in enumerate(t):
            size += len(ch.encode())
            if size % 64 == 0 and -(-size // 4) >= 500:
                return t[: i + 1].rstrip()
        return t.rstrip()

    texts = ["a" * 2000, "a" * 2001, "a" * 5000, "é" * 3000, "a" + "é" * 3000, "日" * 1500, "ab" + "🙂" * 900, "x" * 2040 + " " * 300, "x" * 2047 + "é" + "y" * 20, ("a" + "🙂" * 15 + "日") * 200]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, (got,) in zip(texts, df.select(transcript.shortened(F.col("t"))).collect(), strict=True):
        n = -(-len(t.encode()) // 4)
        assert got == (t if n <= 500 else f"{cut(t)} … [output truncated, {n} tokens]")


def test_dropping_many_lines_takes_proportional_time(spark):
    lines = [f"line {k}" for k in range(60_000)]
    df = spark.createDataFrame([("\n".join(lines), list(range(0, 60_000, 2))), ("a\nb", []), ("a\nb", [1, 0])], "t string, gone array<int>")
    got = [r[0] for r in df.select(text.without_positions(F.split("t", "\n"), F.col("gone"))).collect()]
    assert got == ["\n".join(lines[1::2]), "a\nb", ""]


def test_errors_of_messages(spark):
    raw = spark.createDataFrame([(1, '[{"role":"user","content":"a"},{"role":"user"}]'), (2, '[{"role":"user","content":"b"}]'), (3, "[]"), (4, "plain")], "ctx_id long, raw string")
    got = sorted(map(tuple, formats.parse_messages(raw).select("ctx_id", "pos", "role", "content", "error").collect()))
    assert got == [(1, None, None, None, "not valid as openai"), (2, 0, "user", "b", None), (4, 0, "document", "plain", None)]
    assert formats.parse_messages(raw).where("error is null").count() == 2
    with pytest.raises(Exception, match="not valid as openai"):
        formats.parse_messages(raw, failfast=True).collect()


def test_injections_are_taken_by_one(spark, tmp_path):
    s = state.StateStore(spark, f"file://{tmp_path}/state")
    s.append("pending_injections", spark.createDataFrame([("a/b", "text")], "session_id string, text string"), 7)
    assert s._claim(f"{s.folder}/claims/{state.safe_name('a/b')}-7")  # another taker was here first and has not recorded it yet
    assert s.take_injection("a/b") is None
    assert not s._claim(f"{s.folder}/claims/{state.safe_name('a/b')}-7") and state.safe_name("a/b") != state.safe_name("a_b")


def test_vectors_in_blocks_are_those_of_pairs():
    import numpy as np

    r = np.random.default_rng(1)
    vectors = [x.astype(np.float32) for x in r.normal(size=(40, 9))] + [np.zeros(9, np.float32)]
    rows = list(dedup.cosine_rows(vectors, 7))
    assert np.allclose(rows, [[dedup.cosine(a, b) for b in vectors] for a in vectors], atol=1e-6)
    odd = [np.ones(3, np.float32), np.ones(5, np.float32)]
    assert np.allclose(list(dedup.cosine_rows(odd)), [[dedup.cosine(a, b) for b in odd] for a in odd])


def test_metrics_after_a_reset_and_a_dashboard(spark):
    log = spark.createDataFrame([(i, "gpt-4o", ["bookend"], 100 * i, 60 * i, True, False, False, 3) for i in range(1, 6)], "request_id long, model string, strategies array<string>, original_tokens long, optimized_tokens long, was_optimized boolean, was_fallback boolean, is_streaming boolean, latency_ms long")
    resets = spark.createDataFrame([(2,), (3,)], "request_id long")
    assert metrics.request_totals(metrics.after_reset(log, resets)).first().input_original == 900
    assert metrics.request_totals(metrics.after_reset(log, resets.where("false"))).first().total == 5
    shown = commands.show_dashboard(metrics.snapshot(log).first().asDict(recursive=True), 3 * 3600 + 62)
    assert shown.split("\n") == ["Uptime: 03h 01m 02s    Requests: 5", "Tokens saved: 600 (40.0%)", "Est. cost saved: $0.00", "Avg optimization latency: 3.0ms", "Last: gpt-4o | 500->300  (-40.0%)"]


def test_tables_for_a_terminal(spark, tmp_path):
    before = chat(spark, ("system", "rules"), ("user", "one two three"), ("assistant", "four five six seven"), ("user", "eight"))
    shown = commands.show_chunks([r.asDict() for r in before.collect()]).split("\n")
    assert shown[0].split() == ["idx", "role", "tokens", "zone", "relevance"] and len(shown) == 6 and shown[2].split() == ["0", "system", "2", "STRONG", "1.00"]
    after = bookend.bookend(before).where("role <> 'assistant'")
    found = commands.diff(before, after)
    told = commands.show_diff(found["summary"].first().asDict(), *([r.asDict() for r in found[k].collect()] for k in ("moved", "compressed", "removed")), most=1)
    assert "Total tokens" in told and "Removed: 1" in told and "message 2 (assistant): 5 tokens" in told
    commands.write_pretty(before, f"file://{tmp_path}/pretty")
    files = [p.read_text() for p in (tmp_path / "pretty").rglob("*.txt")]
    assert len(files) == 1 and json.loads(files[0]) == [{"role": r, "content": t} for r, t in (("system", "rules"), ("user", "one two three"), ("assistant", "four five six seven"), ("user", "eight"))]


def test_settings_reach_the_pipeline(spark):
    c = config.parse('[optimize]\nstrategies = ["prune"]\nbudget = 30\n[prune]\nthreshold = 0.99\n[summarize]\nrecent_turns = 2\n', "here")
    set_ = pipeline.configured(c)
    assert (set_.prune_threshold, set_.recent_turns, set_.dedup_threshold) == (0.99, 2, 0.85)
    df = contexts(spark)
    want = pipeline.optimize(df, ["prune"], budget=30, config=set_)
    assert by_ctx(pipeline.optimize_configured(df, c)) == by_ctx(want)


def test_exact_counts(spark):
    from ctxweave.functions import tokens

    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "plain words, and 123 figures!", "  odd   space\n\n", "日本語 é 🙂", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert [r[0] for r in df.select(tokens.public_bpe()(F.col("t"))).collect()] == [len(t.encode(x or "").ids) for x in texts]


def test_requests_that_are_answered_here(spark):
    df = spark.createDataFrame([(1, "/health", ""), (2, "/v1/models", ""), (3, None, "")], "request_id long, path string, body string")
    assert [r.answer for r in jobs.answered(df).orderBy("request_id").collect()] == ['{"status":"ok"}', None, None]


def test_a_bad_context_does_not_take_others_with_it(spark, tmp_path):
    rows = [(1, 1, '[{"role":"user","content":"fine"}]'), (2, 1, '[{"role":"user","content":"bad"}]')]
    spark.createDataFrame(rows, jobs.RAW_SCHEMA).write.parquet(f"{tmp_path}/in")
    seen, failed = [], []

    def report(df, epoch):
        ids = [r.ctx_id for r in df.select("ctx_id").collect()]
        if 2 in ids:
            raise ValueError("cannot be shown")
        seen.extend(ids)

    q = jobs.watch(spark, f"{tmp_path}/in", report, f"{tmp_path}/c", interval=None, errors=lambda df, epoch: failed.extend(r.ctx_id for r in df.collect()))
    q.awaitTermination(120)
    assert seen == [1] and failed == [2]
    with pytest.raises(ValueError, match="no such folder"):
        jobs.watch(spark, f"{tmp_path}/absent", report, f"{tmp_path}/c2")


def test_large_contexts_are_pruned_alike(spark, monkeypatch):
    """The join of large contexts, and groups that count few meetings at once, give the same scores."""
    df = contexts(spark, 6, 5)
    want = sorted(map(tuple, prune.line_scores(df).collect()))
    monkeypatch.setattr(prune, "SMALL", 0)
    assert sorted(map(tuple, prune.line_scores(df).collect())) == want and len(want) > 20
    monkeypatch.setattr(prune, "MEETINGS", 5)
    import numpy as np

    r = np.random.default_rng(2)
    of_line = np.sort(r.integers(0, 9, 30))
    words = [np.unique(r.integers(0, 12, r.integers(0, 6))) for _ in of_line]
    line, word = np.repeat(np.arange(30), [len(w) for w in words]), np.concatenate(words)
    held = [set(np.concatenate([words[k] for k in np.nonzero(of_line == c)[0]] or [[]]).tolist()) for c in range(9)]
    assert prune._most_shared(of_line, line, word, 9).tolist() == [max([len(held[c] & set(w.tolist())) for c in range(of_line[k])], default=0) for k, w in enumerate(words)]


def test_large_contexts_meet_block_by_block(spark, monkeypatch):
    """Several blocks and hubs of a context, mixed with small contexts and one without an id, give the same scores, by broadcast and by join; words meet in no join, and no line is shuffled."""
    from ctxweave.operators import overlap

    df = contexts(spark, 7, 9).withColumn("ctx_id", F.when(F.col("ctx_id") != 3, F.col("ctx_id")))
    rows = lambda f: sorted(repr(tuple(r)) for r in f.collect())
    want, pruned = rows(prune.line_scores(df)), rows(prune.prune(df, 0.6))
    sizes = [r["count"] for r in df.groupBy("ctx_id").count().collect()]
    for k, v in {"BLOCK_BYTES": 1500, "WAVE_BYTES": 4000, "STEP": 2, "HUBS": 1, "CELLS": 20, "WORDS": 40}.items():
        monkeypatch.setattr(overlap, k, v)
    monkeypatch.setattr(prune, "is_small", lambda df: False)
    for small, told in ((0, 1 << 20), (sorted(sizes)[2], 1 << 20), (0, -1), (max(sizes), 0)):
        monkeypatch.setattr(prune, "SMALL", small)
        monkeypatch.setattr(prune, "TOLD_BYTES", told)
        scores = prune.line_scores(df)
        assert rows(scores) == want and len(want) > 20
        assert rows(prune.prune(df, 0.6)) == pruned
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate") == 1 and plan.count("Join") == (small < max(sizes))


def test_lines_are_scored_within_their_row(spark):
    """Fences pair up without a window over a context's lines."""
    plan = prune.line_scores(contexts(spark))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [x for x in plan if x.lstrip(" +-:").startswith("Window")]
    assert windows and not [x for x in windows if "line" in x]


def test_lines_are_scored_once_and_without_what_scores_do_not_need(spark):
    """No filter scores all lines again before they are listed, and no text goes through windows of tokens."""
    plan = prune.line_scores(contexts(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("great question") == prune.prune(contexts(spark))._jdf.queryExecution().optimizedPlan().toString().count("great question") > 0
    assert "sum(token_count" not in plan and "relevance_score" not in plan


def test_contexts_of_several_blocks_meet_together(monkeypatch):
    """Waves hold blocks of as many contexts as fit; each context's blocks come in order, one in a wave, and are as few as need be."""
    from types import SimpleNamespace

    from ctxweave.operators import overlap

    monkeypatch.setattr(overlap, "BLOCK_BYTES", 100)
    monkeypatch.setattr(overlap, "WAVE_BYTES", 200)
    sizes = {0: [10] * 45, 1: [10] * 12, 2: [10] * 3, 3: [10] * 12, 4: [30], 5: [10] * 12, 6: [250, 10]}
    groups = overlap._groups([SimpleNamespace(c=c, step=i, bytes=b) for c, own in sizes.items() for i, b in enumerate(own)])
    for c, own in sizes.items():
        (mine,) = [g for g in groups if c in g[0]]
        assert [i for wave in mine for i in range(*wave[c])] == list(range(len(own)))
    assert all(sum(sum(sizes[c][low:high]) for c, (low, high) in wave.items()) <= 200 for g in groups for wave in g if 6 not in wave)
    assert [sorted(g[0]) for g in groups] == [[2, 4], [1, 3], [5], [6], [0]]


def test_texts_are_not_sorted_for_what_is_known_of_their_lines(spark, monkeypatch):
    """Too large to be sent to all tasks, it is joined by hash; one number a line holds it, and rows stay the same."""
    def rows(df):
        return sorted(map(tuple, df.collect()))

    df = contexts(spark)
    expected, pruned = rows(prune.line_scores(df)), rows(prune.prune(df, 0.6))
    monkeypatch.setattr(prune, "SMALL", 0)
    monkeypatch.setattr(prune, "TOLD_BYTES", -1)
    scores = prune.line_scores(df)
    assert rows(scores) == expected and rows(prune.prune(df, 0.6)) == pruned
    plan = scores._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    assert "__told" in plan and "__met" not in plan


def test_shuffles_go_once_texts_are_staged(spark, monkeypatch):
    """Before words are staged, files of the shuffle that brought the texts may go."""
    from ctxweave.operators import overlap

    seen = []
    staged, drop = prune.stage, prune.drop_shuffles
    monkeypatch.setattr(prune, "stage", lambda df, label, *a, **k: (staged(df, label, *a, **k), seen.append(label))[0])
    monkeypatch.setattr(prune, "drop_shuffles", lambda s: (drop(s), seen.append("drop"))[0])
    words = overlap.stage
    monkeypatch.setattr(overlap, "stage", lambda df, label, *a, **k: (words(df, label, *a, **k), seen.append(label))[0])
    monkeypatch.setattr(prune, "SMALL", 0)
    prune.line_scores(contexts(spark))
    assert seen[:3] == ["prune-chunks", "drop", "prune-words"]
