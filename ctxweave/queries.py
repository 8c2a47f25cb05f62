"""Every query over the synthetic tables, with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, tokens
from .functions.pricing import PRICES
from .operators import bookend, budget, chunks, compaction, dedup, diff, duplication, health, metrics, prune, structural, summarize, tfidf
from .plans import pipeline
from .sources import formats, state, transcript
from .sources.tables import conversations, documents, request_log, table
from .streaming.jobs import optimize_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its name."""
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Sums of floats differ by their order; so both sides are rounded."""
    return df.withColumns({n: F.round(n, digits) for n in names})


# SQL building blocks: each is a list of CTEs, the last of which is named.
def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


CONV = "m AS (SELECT conv_id AS ctx_id, turn AS pos0, role, coalesce(text, '') AS content, NULL::DOUBLE AS given FROM conversations)"
DOCS = "m AS (SELECT try_cast(substr(source, 4) AS BIGINT) AS ctx_id, doc_id AS pos0, 'document' AS role, coalesce(text, '') AS content, NULL::DOUBLE AS given FROM documents)"
RAG = "m AS (SELECT try_cast(substr(source, 4) AS BIGINT) AS ctx_id, d.doc_id AS pos0, 'document' AS role, coalesce(text, '') AS content, quality::DOUBLE AS given FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
BUILD = """p AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY pos0, content, role) - 1 AS pos, count(*) OVER (PARTITION BY ctx_id) AS n, ceil(strlen(content) / 4.0)::BIGINT AS token_count FROM m),
r AS (SELECT *, CASE WHEN given IS NOT NULL THEN greatest(0.0, least(1.0, given)) WHEN role = 'system' THEN 1.0 WHEN n <= 1 THEN 0.5 ELSE 0.1 + 0.8 * (pos::DOUBLE / greatest(n - 1, 1)) END AS relevance_score FROM p)"""


def zoned(source: str, out: str) -> str:
    return f"""{out}0 AS (SELECT *, coalesce(sum(token_count) OVER (PARTITION BY ctx_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin_tokens, sum(token_count) OVER (PARTITION BY ctx_id) AS all_tokens FROM {source}),
{out} AS (SELECT * EXCLUDE (begin_tokens, all_tokens), CASE WHEN all_tokens > 0 AND begin_tokens / all_tokens::DOUBLE >= 0.25 AND begin_tokens / all_tokens::DOUBLE < 0.75 THEN 'dead_zone' ELSE 'strong' END AS attention_zone FROM {out}0)"""


COLS = "ctx_id, pos::BIGINT AS pos, chunk_index::BIGINT AS chunk_index, role, content, token_count::BIGINT AS token_count, round(relevance_score, 6) AS relevance_score, attention_zone"
CHUNKS = f"{BUILD}, {zoned('(SELECT *, pos AS chunk_index FROM r)', 'chunks')}"


def from_chunks(source: str, select: str, more: str = "") -> str:
    return f"WITH {source}, {CHUNKS}{', ' + more if more else ''} {select}"


def words_sql(column: str, keep: str, least: int, stop: list[str]) -> str:
    edge = f"[^\\p{{L}}\\p{{N}}{keep}]+"
    bare = f"list_transform(string_split_regex({column}, '\\s+'), lambda w: regexp_replace(regexp_replace(lower(w), '^{edge}', ''), '{edge}$', ''))"
    return f"list_filter({bare}, lambda w: strlen(w) >= {least}" + (f" AND NOT list_contains({_list(stop)}, w))" if stop else ")")


def shown(df: DataFrame) -> DataFrame:
    return rounded(df.select("ctx_id", "pos", "chunk_index", "role", "content", "token_count", "relevance_score", "attention_zone"), "relevance_score")


@query(from_chunks(CONV, f"SELECT {COLS} FROM chunks"))
def build_chunks(spark, d):
    return shown(conversations(spark, d))


@query(from_chunks(RAG, f"SELECT {COLS} FROM chunks"))
def build_rag_chunks(spark, d):
    return shown(documents(spark, d, scored=True))


@query(from_chunks(CONV, f"SELECT {COLS} FROM chunks WHERE attention_zone = 'dead_zone'"))
def dead_zone_chunks(spark, d):
    return shown(chunks.dead_zone_chunks(conversations(spark, d)))


@query(from_chunks(CONV, "SELECT ctx_id, count(*)::BIGINT AS n_chunks, sum(token_count)::BIGINT AS total_tokens FROM chunks GROUP BY ctx_id"))
def count_tokens(spark, d):
    return chunks.count_tokens(conversations(spark, d))


DEAD = """dz AS (SELECT ctx_id, sum(token_count)::BIGINT AS total_tokens, count(*)::BIGINT AS n_chunks, sum(CASE WHEN attention_zone = 'dead_zone' THEN token_count ELSE 0 END)::BIGINT AS dead_zone_tokens,
count(*) FILTER (WHERE attention_zone = 'dead_zone')::BIGINT AS dead_zone_chunks FROM chunks GROUP BY ctx_id),
dz2 AS (SELECT *, CASE WHEN total_tokens > 0 THEN dead_zone_tokens / total_tokens::DOUBLE ELSE 0.0 END AS dead_zone_ratio FROM dz),
dead AS (SELECT *, round((1 - dead_zone_ratio) * 100)::BIGINT AS dead_zone_score FROM dz2)"""


@query(from_chunks(CONV, "SELECT * REPLACE (round(dead_zone_ratio, 6) AS dead_zone_ratio) FROM dead", DEAD))
def dead_zone_metric(spark, d):
    return rounded(health.dead_zone_metric(conversations(spark, d)), "dead_zone_ratio")


BUDGET = """bud AS (SELECT *, 128000::BIGINT AS budget, total_tokens / 128000.0::DOUBLE AS utilization FROM dead),
budgeted AS (SELECT *, CASE WHEN utilization > 1 THEN 0 ELSE round((1 - utilization) * 100)::BIGINT END::BIGINT AS budget_score FROM bud)"""


@query(from_chunks(DOCS, "SELECT ctx_id, total_tokens, budget, round(utilization, 6) AS utilization, budget_score FROM budgeted", f"{DEAD}, {BUDGET}"))
def budget_metric(spark, d):
    return rounded(health.budget_metric(health.dead_zone_metric(documents(spark, d)), 128_000), "utilization").select("ctx_id", "total_tokens", "budget", "utilization", "budget_score")


PAIRS = f"""ws AS (SELECT ctx_id, pos, chunk_index, token_count, list_distinct({words_sql('content', '$', 2, text.STOP_DUPLICATE)}) AS w FROM chunks),
wx AS (SELECT ctx_id, pos, unnest(w) AS w FROM ws),
shared AS (SELECT a.ctx_id, a.pos AS pos_a, b.pos AS pos_b, count(*) AS c FROM wx a JOIN wx b ON a.ctx_id = b.ctx_id AND a.w = b.w AND a.pos < b.pos GROUP BY ALL),
sims AS (SELECT s.ctx_id, a.chunk_index AS chunk_a, b.chunk_index AS chunk_b, s.pos_a, s.pos_b, c / (len(a.w) + len(b.w) - c)::DOUBLE AS similarity, least(a.token_count, b.token_count) AS smaller
FROM shared s JOIN ws a ON a.ctx_id = s.ctx_id AND a.pos = s.pos_a JOIN ws b ON b.ctx_id = s.ctx_id AND b.pos = s.pos_b),
pairs AS (SELECT ctx_id, chunk_a, chunk_b, pos_a, pos_b, similarity, similarity * smaller AS duplicate_tokens FROM sims WHERE similarity >= 0.15)"""


@query(from_chunks(DOCS, "SELECT ctx_id, chunk_a::BIGINT AS chunk_a, chunk_b::BIGINT AS chunk_b, round(similarity, 6) AS similarity, round(duplicate_tokens, 6) AS duplicate_tokens FROM pairs", PAIRS))
def duplicate_pairs(spark, d):
    return rounded(duplication.duplicate_pairs(documents(spark, d)).drop("pos_a", "pos_b"), "similarity", "duplicate_tokens")


@query(from_chunks(DOCS, "SELECT ctx_id, chunk_a::BIGINT AS chunk_a, chunk_b::BIGINT AS chunk_b, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY similarity DESC, pos_a, pos_b) AS rank FROM pairs) WHERE rank <= 3", PAIRS))
def top_duplicate_pairs(spark, d):
    return duplication.top_pairs(duplication.duplicate_pairs(documents(spark, d))).select("ctx_id", "chunk_a", "chunk_b", "rank")


HEALTH = f"""{DEAD}, {BUDGET}, {PAIRS},
dup AS (SELECT ctx_id, count(*)::BIGINT AS duplicate_pairs, round(sum(duplicate_tokens))::BIGINT AS duplicate_tokens FROM pairs GROUP BY ctx_id),
h0 AS (SELECT b.*, coalesce(duplicate_pairs, 0)::BIGINT AS duplicate_pairs, coalesce(duplicate_tokens, 0)::BIGINT AS duplicate_tokens FROM budgeted b LEFT JOIN dup USING (ctx_id)),
h1 AS (SELECT *, least(1.0::DOUBLE, CASE WHEN total_tokens > 0 THEN duplicate_tokens / total_tokens::DOUBLE ELSE 0.0 END) AS duplicate_ratio FROM h0),
h2 AS (SELECT *, round((1 - duplicate_ratio) * 100)::BIGINT AS duplication_score FROM h1),
h3 AS (SELECT *, round(dead_zone_score * (0.30::DOUBLE / 0.75::DOUBLE) + duplication_score * (0.25::DOUBLE / 0.75::DOUBLE) + budget_score * (0.20::DOUBLE / 0.75::DOUBLE))::BIGINT AS health_score FROM h2),
health AS (SELECT *, CASE WHEN health_score >= 80 THEN 'GOOD' WHEN health_score >= 60 THEN 'NEEDS WORK' ELSE 'POOR' END AS status,
array_to_string(list_filter([CASE WHEN dead_zone_score < 80 THEN 'Run `optimize --strategy bookend` to fix dead zone placement' END,
CASE WHEN duplication_score < 90 AND duplicate_tokens > 0 THEN 'Run `optimize --strategy dedup` to remove ~' || format('{{:,}}', duplicate_tokens) || ' duplicate tokens' END,
CASE WHEN budget_score < 20 THEN 'Context is near capacity — consider `compress --budget=64k`' END], lambda x: x IS NOT NULL), '; ') AS advice FROM h3)"""
HEALTH_COLUMNS = ["ctx_id", "total_tokens", "n_chunks", "dead_zone_tokens", "dead_zone_chunks", "dead_zone_score", "duplicate_pairs", "duplicate_tokens", "duplication_score", "budget", "budget_score", "health_score", "status"]


@query(from_chunks(DOCS, f"SELECT {', '.join(HEALTH_COLUMNS)} FROM health", HEALTH))
def health_report(spark, d):
    return health.analyze(documents(spark, d)).select(*HEALTH_COLUMNS)


@query(from_chunks(DOCS, "SELECT ctx_id, advice FROM health", HEALTH))
def recommendations(spark, d):
    return health.analyze(documents(spark, d)).select("ctx_id", F.array_join("recommendations", "; ").alias("advice"))


_REPORT = """total_tokens long, chunk_count long, dead_zone struct<tokens:long,chunks:long,ratio:double,score:long>, duplication struct<duplicate_tokens:long,pairs:long,ratio:double,score:long>,
budget struct<budget:long,utilization:double,score:long>, health_score long, recommendations array<string>"""


@query(from_chunks(CONV, """SELECT ctx_id, total_tokens, n_chunks AS chunk_count, dead_zone_tokens, dead_zone_chunks, round(dead_zone_ratio, 6) AS dead_zone_ratio, dead_zone_score, duplicate_tokens, duplicate_pairs,
round(duplicate_ratio, 6) AS duplicate_ratio, duplication_score, budget, round(utilization, 6) AS utilization, budget_score, health_score, advice FROM health""", HEALTH))
def health_json(spark, d):
    """The report as JSON, read back field by field."""
    r = health.to_json(health.analyze(conversations(spark, d))).select("ctx_id", F.from_json("json", _REPORT).alias("r")).select("ctx_id", "r.*")
    out = r.select(
        "ctx_id", "total_tokens", "chunk_count", F.col("dead_zone.tokens").alias("dead_zone_tokens"), F.col("dead_zone.chunks").alias("dead_zone_chunks"), F.col("dead_zone.ratio").alias("dead_zone_ratio"), F.col("dead_zone.score").alias("dead_zone_score"),
        F.col("duplication.duplicate_tokens").alias("duplicate_tokens"), F.col("duplication.pairs").alias("duplicate_pairs"), F.col("duplication.ratio").alias("duplicate_ratio"), F.col("duplication.score").alias("duplication_score"),
        F.col("budget.budget").alias("budget"), F.col("budget.utilization").alias("utilization"), F.col("budget.score").alias("budget_score"), "health_score", F.array_join("recommendations", "; ").alias("advice"),
    )
    return rounded(out, "dead_zone_ratio", "duplicate_ratio", "utilization")


CONVERSATION = "bool_and(role IN ('system', 'user', 'assistant')) OVER (PARTITION BY ctx_id)"


def scored_sql(source: str, out: str) -> str:
    back = "row_number() OVER (PARTITION BY ctx_id, role ORDER BY pos DESC)"
    return f"""{out} AS (SELECT * REPLACE (CASE WHEN NOT {CONVERSATION} THEN relevance_score WHEN role = 'system' THEN 1.0 WHEN role = 'user' AND {back} <= 3 THEN 0.9 WHEN n <= 1 THEN 0.5
ELSE 0.1 + 0.6 * (pos::DOUBLE / greatest(n - 1, 1)) END AS relevance_score) FROM {source})"""


def placed_sql(source: str, out: str) -> str:
    return f"""{out}r AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY relevance_score DESC, pos) - 1 AS rk FROM {source}),
{out} AS (SELECT * EXCLUDE (rk) REPLACE (CASE WHEN rk % 2 = 0 THEN rk // 2 ELSE n - 1 - (rk - 1) // 2 END AS pos) FROM {out}r)"""


BOOKEND = f"{scored_sql('chunks', 's')}, {placed_sql('s', 'placed')}"


@query(from_chunks(CONV, f"SELECT {COLS} FROM placed", BOOKEND))
def bookend_heuristic(spark, d):
    return shown(bookend.bookend(conversations(spark, d)))


@query(from_chunks(RAG, f"SELECT {COLS} FROM placed", BOOKEND))
def bookend_rag_scores(spark, d):
    return shown(bookend.bookend(documents(spark, d, scored=True)))


ASKED = "The and ARE with the $3,000?"
ASKED_WORDS = ["the", "and", "are", "with", "the", "$3,000"]
_TFS = ", ".join(f"len(list_filter(w, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(ASKED_WORDS))
_TERMS = " + ".join(f"(CASE WHEN len(w) > 0 THEN tf{i} / len(w)::DOUBLE ELSE 0.0 END) * greatest(ln(n / (1 + sum((tf{i} > 0)::INTEGER) OVER (PARTITION BY ctx_id))::DOUBLE), 0.0)" for i in range(len(ASKED_WORDS)))
BY_QUERY = f"""q0 AS (SELECT *, {words_sql('content', '$', 1, [])} AS w FROM chunks), q1 AS (SELECT *, {_TFS} FROM q0), q2 AS (SELECT *, {_TERMS} AS sc FROM q1),
q3 AS (SELECT *, max(sc) OVER (PARTITION BY ctx_id) AS best FROM q2),
s AS (SELECT * REPLACE (round(CASE WHEN role = 'system' THEN 1.0 WHEN best > 0 THEN sc / best ELSE sc END, 6) AS relevance_score) FROM q3), {placed_sql('s', 'placed')}"""


@query(from_chunks(CONV, f"SELECT {COLS} FROM placed", BY_QUERY))
def bookend_query(spark, d):
    return shown(bookend.place(rounded(bookend.score_by_query(conversations(spark, d), ASKED), "relevance_score")))


@query(from_chunks(DOCS, f"SELECT {COLS.replace('pos::BIGINT AS pos', '(row_number() OVER (PARTITION BY ctx_id ORDER BY pos) - 1)::BIGINT AS pos')} FROM (SELECT *, row_number() OVER (PARTITION BY ctx_id, content ORDER BY pos) AS k FROM chunks) WHERE k = 1"))
def dedup_exact(spark, d):
    return shown(dedup.dedup_exact(documents(spark, d)))


def protected_sql(source: str, out: str, k: int = 2) -> str:
    return f"{out} AS (SELECT *, role = 'system' OR (role = 'user' AND row_number() OVER (PARTITION BY ctx_id, role ORDER BY pos DESC) <= {k}) AS protected FROM {source})"


@query(from_chunks(CONV, "SELECT ctx_id, pos::BIGINT AS pos, role FROM prot WHERE protected", protected_sql("chunks", "prot")))
def protected_chunks(spark, d):
    return conversations(spark, d).withColumn("p", chunks.is_protected()).where("p").select("ctx_id", "pos", "role")


LIMIT = 150
CUT = f"""{protected_sql('chunks', 'prot')},
b0 AS (SELECT *, sum(token_count) OVER (PARTITION BY ctx_id) AS total, coalesce(sum(CASE WHEN protected THEN 0 ELSE token_count END) OVER (PARTITION BY ctx_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM prot),
b1 AS (SELECT *, NOT protected AND total - gone > {LIMIT} AS dropped FROM b0),
cut AS (SELECT * REPLACE (row_number() OVER (PARTITION BY ctx_id ORDER BY pos) - 1 AS pos) FROM b1 WHERE NOT dropped)"""


@query(from_chunks(CONV, f"SELECT {COLS} FROM cut", CUT))
def budget_truncate(spark, d):
    return shown(budget.truncate_to_budget(conversations(spark, d), LIMIT))


@query(from_chunks(CONV, f"""SELECT ctx_id, pos::BIGINT AS seq, 'Dropped chunk ' || chunk_index || ' (' || role || ', ' || token_count || ' tokens)' AS warning FROM b1 WHERE dropped UNION ALL
SELECT ctx_id, count(*)::BIGINT, 'Warning: protected chunks alone use ' || sum(CASE WHEN dropped THEN 0 ELSE token_count END)::BIGINT || ' tokens (budget {LIMIT})' FROM b1 GROUP BY ctx_id HAVING sum(CASE WHEN dropped THEN 0 ELSE token_count END) > {LIMIT}""", CUT))
def budget_warnings(spark, d):
    return budget.budget_warnings(conversations(spark, d), LIMIT)


def prune_sql(source: str, out: str, threshold: float) -> str:
    filler = " OR ".join("contains(lower(line), '" + p.replace("'", "''") + "')" for p in text.FILLER)
    return f"""{protected_sql(source, f'{out}p')}, {out}n AS (SELECT *, count(*) OVER (PARTITION BY ctx_id) AS nn, list_distinct({words_sql('content', '', 2, text.STOP_PRUNE)}) AS fp FROM {out}p),
{out}l AS (SELECT ctx_id, pos, role, nn, protected, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM {out}n),
{out}f AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare, sum(CASE WHEN starts_with(trim(line, ' ' || chr(9)), '```') THEN 1 ELSE 0 END) OVER (PARTITION BY ctx_id, pos ORDER BY line_no) AS fences FROM {out}l),
{out}w AS (SELECT *, {words_sql('line', '', 2, text.STOP_PRUNE)} AS ws, len(list_filter(string_split_regex(line, '\\s+'), lambda w: w <> '')) AS n_words, ({filler}) AS filler FROM {out}f
WHERE NOT protected AND fences % 2 = 0 AND NOT starts_with(bare, '```') AND bare <> ''),
{out}x AS (SELECT DISTINCT ctx_id, pos, line_no, unnest(ws) AS w FROM {out}w),
{out}e AS (SELECT ctx_id, pos, unnest(fp) AS w FROM {out}n),
{out}o AS (SELECT ctx_id, pos, line_no, max(c) AS c FROM (SELECT x.ctx_id, x.pos, x.line_no, e.pos AS p, count(*) AS c FROM {out}x x JOIN {out}e e ON x.ctx_id = e.ctx_id AND x.w = e.w AND e.pos < x.pos GROUP BY ALL) GROUP BY ALL),
{out}s AS (SELECT w.*, coalesce(o.c / len(list_distinct(ws))::DOUBLE, 0.0) AS overlap, 1 - len(ws) / n_words::DOUBLE AS stop_ratio FROM {out}w w LEFT JOIN {out}o o USING (ctx_id, pos, line_no)),
{out}t AS (SELECT *, CASE WHEN stop_ratio > 0.7 THEN 0.1 WHEN stop_ratio > 0.6 THEN 0.3 ELSE 0.8 END::DOUBLE AS stop FROM {out}s),
{out}score AS (SELECT ctx_id, pos, line_no, line, greatest(0.0, least(1.0, (stop * 0.20::DOUBLE + CASE WHEN overlap > 0.7 THEN 0.1 WHEN overlap > 0.5 THEN 0.4 ELSE 0.9 END::DOUBLE * 0.20::DOUBLE
+ CASE WHEN starts_with(bare, '#') THEN 1.0 WHEN starts_with(bare, '- ') OR starts_with(bare, '* ') OR starts_with(bare, '1.') THEN 0.7 WHEN role = 'assistant' THEN 0.6 ELSE 0.65 END::DOUBLE * 0.10::DOUBLE
+ CASE WHEN filler THEN 0.1 ELSE 0.9 END::DOUBLE * 0.20::DOUBLE + CASE WHEN n_words < 4 AND NOT starts_with(bare, '#') THEN 0.2 WHEN n_words < 8 THEN 0.5 ELSE 0.9 END::DOUBLE * 0.15::DOUBLE
+ CASE WHEN nn <= 1 THEN 0.5 ELSE 0.3 + pos / greatest(nn - 1, 1)::DOUBLE * 0.7 END::DOUBLE * 0.10::DOUBLE) * CASE WHEN filler AND n_words < 8 THEN 0.1 WHEN stop <= 0.3 AND n_words < 6 THEN 0.1 ELSE 1.0 END::DOUBLE)) AS score FROM {out}t),
{out}k AS (SELECT l.ctx_id, l.pos, string_agg(l.line, chr(10) ORDER BY l.line_no) FILTER (WHERE s.line_no IS NULL) AS text FROM {out}l l LEFT JOIN (SELECT * FROM {out}score WHERE score < {threshold}) s USING (ctx_id, pos, line_no) GROUP BY ALL),
{out} AS (SELECT n.* EXCLUDE (protected, nn, fp) REPLACE (CASE WHEN protected THEN content WHEN trim(coalesce(k.text, ''), ' ' || chr(9) || chr(10)) = '' THEN '{prune.PLACEHOLDER}' ELSE k.text END AS content,
CASE WHEN protected THEN token_count ELSE ceil(strlen(CASE WHEN trim(coalesce(k.text, ''), ' ' || chr(9) || chr(10)) = '' THEN '{prune.PLACEHOLDER}' ELSE k.text END) / 4.0)::BIGINT END AS token_count) FROM {out}n n JOIN {out}k k USING (ctx_id, pos))"""


@query(from_chunks(DOCS, "SELECT ctx_id, pos::BIGINT AS pos, line_no::INTEGER AS line_no, line, round(score, 6) AS score FROM pruscore", prune_sql("chunks", "pru", 0.75)))
def prune_line_scores(spark, d):
    return rounded(prune.line_scores(documents(spark, d)), "score")


@query(from_chunks(CONV, f"SELECT {COLS} FROM pru", prune_sql("chunks", "pru", 0.3)))
def prune_apply(spark, d):
    return shown(prune.prune(conversations(spark, d), 0.3))


@query(from_chunks(DOCS, f"SELECT {COLS} FROM pru", prune_sql("chunks", "pru", 0.743)))
def prune_documents(spark, d):
    return shown(prune.prune(documents(spark, d), 0.743))


ZONES = """back AS (SELECT *, row_number() OVER (PARTITION BY ctx_id, role = 'system' ORDER BY pos DESC) AS bk FROM chunks),
zone AS (SELECT *, CASE WHEN role = 'system' THEN 'system' WHEN bk <= 6 THEN 'recent' WHEN bk <= 12 THEN 'aging' ELSE 'archived' END AS zone FROM back)"""


@query(from_chunks(DOCS, "SELECT ctx_id, pos::BIGINT AS pos, zone FROM zone", ZONES))
def summarize_zones(spark, d):
    return documents(spark, d).withColumn("zone", summarize.recency_zone()).select("ctx_id", "pos", "zone")


SUMMARY = f"""{ZONES}, kept AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY zone <> 'system', pos) - 1 AS np FROM zone WHERE zone <> 'archived'),
sums AS (SELECT ctx_id, (SELECT sum(token_count) FROM kept k WHERE k.ctx_id = c.ctx_id) < sum(token_count) AS shrunk FROM chunks c GROUP BY ctx_id),
summed AS (SELECT k.* EXCLUDE (np, bk, zone) REPLACE (np AS pos) FROM kept k JOIN sums USING (ctx_id) WHERE shrunk UNION ALL SELECT c.* FROM chunks c JOIN sums USING (ctx_id) WHERE NOT shrunk)"""


@query(from_chunks(DOCS, f"SELECT {COLS} FROM summed", SUMMARY))
def summarize_fallback(spark, d):
    return shown(summarize.summarize(documents(spark, d)))


WEIGHTS = f"""v0 AS (SELECT ctx_id, pos, {words_sql('content', '', 2, text.STOP_VECTOR)} AS ws, n FROM chunks),
v1 AS (SELECT ctx_id, pos, n, len(ws) AS n_words, unnest(ws) AS word FROM v0), v2 AS (SELECT ctx_id, pos, n, n_words, word, count(*) AS c FROM v1 GROUP BY ALL),
v3 AS (SELECT ctx_id, word, count(*) AS df FROM v2 GROUP BY ALL),
weights AS (SELECT ctx_id, pos, word, c / n_words::DOUBLE * greatest(ln(n / (1 + df)::DOUBLE), 0.0) AS weight FROM v2 JOIN v3 USING (ctx_id, word))"""


@query(from_chunks(CONV, "SELECT ctx_id, pos::BIGINT AS pos, word, round(weight, 6) AS weight FROM weights", WEIGHTS))
def tfidf_weights(spark, d):
    return rounded(tfidf.tfidf_weights(conversations(spark, d)), "weight")


@query(from_chunks(CONV, "SELECT ctx_id, pos_a::BIGINT AS pos_a, pos_b::BIGINT AS pos_b, round(similarity, 6) AS similarity FROM cos WHERE similarity >= 0.05", f"""{WEIGHTS},
nrm AS (SELECT ctx_id, pos, sqrt(sum(weight * weight)) AS norm FROM weights WHERE weight > 0 GROUP BY ALL),
cos AS (SELECT a.ctx_id, a.pos AS pos_a, b.pos AS pos_b, least(1.0, sum(a.weight / na.norm * (b.weight / nb.norm))) AS similarity FROM weights a JOIN weights b ON a.ctx_id = b.ctx_id AND a.word = b.word AND a.pos < b.pos
JOIN nrm na ON na.ctx_id = a.ctx_id AND na.pos = a.pos JOIN nrm nb ON nb.ctx_id = b.ctx_id AND nb.pos = b.pos WHERE a.weight > 0 AND b.weight > 0 GROUP BY ALL)"""))
def cosine_pairs(spark, d):
    return rounded(tfidf.cosine_pairs(tfidf.tfidf_weights(conversations(spark, d)), 0.05), "similarity")


@query("""WITH n AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a::DOUBLE[], b::DOUBLE[]) / (sqrt(list_dot_product(a::DOUBLE[], a::DOUBLE[])) * sqrt(list_dot_product(b::DOUBLE[], b::DOUBLE[]))), 4) AS similarity FROM n WHERE b IS NOT NULL""")
def embedding_cosine(spark, d):
    from pyspark.sql.window import Window

    nxt = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    rows = table(spark, d, "embeddings").withColumn("b", nxt).where("b is not null")
    return rounded(rows.select("vec_id", text.cosine(F.col("embedding"), F.col("b")).alias("similarity")), "similarity", digits=4)


@query()
def dedup_semantic(spark, d):
    return shown(dedup.dedup_semantic(documents(spark, d), threshold=0.85))


class FirstLetters:
    """Vectors that SQL can make too: how many words begin with each letter."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[sum(w[:1] == chr(97 + k) for w in words) for k in range(26)] for words in (t.lower().split(" ") for t in texts)]


def _letters(column: str) -> str:
    return f"list_transform(range(26), lambda k: len(list_filter(string_split(lower({column}), ' '), lambda w: w[1] = chr((97 + k)::INTEGER)))::DOUBLE)"


def _cosine(a: str, b: str) -> str:
    return f"(CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) ELSE 0 END)"


@query(f"""WITH t AS (SELECT doc_id // 2 AS ctx_id, doc_id % 2 AS pos, coalesce(text, '') AS content, ceil(strlen(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM documents),
v AS (SELECT *, {_letters('content')} AS vec FROM t),
pr AS (SELECT a.ctx_id, a.tokens >= b.tokens AS first_stays, {_cosine('a.vec', 'b.vec')} >= 0.9 AS alike FROM v a JOIN v b ON a.ctx_id = b.ctx_id AND a.pos = 0 AND b.pos = 1),
st AS (SELECT v.*, coalesce(alike, false) AS alike, coalesce(alike AND (first_stays <> (pos = 0)), false) AS dropped FROM v LEFT JOIN pr USING (ctx_id)),
se AS (SELECT ctx_id, vec, list_filter(list_transform(flatten(list_transform(string_split(content, chr(10)), lambda x: string_split(x, '. '))), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: strlen(x) > 5) AS parts FROM st WHERE dropped),
un AS (SELECT s.ctx_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n, o.vec AS kept FROM se s JOIN st o ON o.ctx_id = s.ctx_id AND NOT o.dropped),
ex AS (SELECT ctx_id, string_agg(part, '. ' ORDER BY k) AS extra FROM (SELECT *, {_letters('part')} AS pv FROM un WHERE n > 1) WHERE {_cosine('pv', 'kept')} < 0.7 GROUP BY ctx_id),
fin AS (SELECT st.ctx_id, content || coalesce(chr(10) || chr(10) || '[merged from duplicate]: ' || extra, '') AS content, row_number() OVER (PARTITION BY st.ctx_id ORDER BY pos) - 1 AS pos FROM st LEFT JOIN ex USING (ctx_id) WHERE NOT dropped)
SELECT ctx_id, pos::BIGINT AS pos, content, ceil(strlen(content) / 4.0)::BIGINT AS token_count FROM fin""")
def dedup_semantic_pairs(spark, d):
    """Every two neighbouring documents a context: one of two alike goes, and its sentences that are new join the other."""
    rows = table(spark, d, "documents").select(F.expr("doc_id div 2").alias("ctx_id"), (F.col("doc_id") % 2).alias("pos"), F.lit("document").alias("role"), F.col("text").alias("content"))
    return dedup.dedup_semantic(chunks.build_chunks(rows), FirstLetters(), 0.9).select("ctx_id", "pos", "content", "token_count")


_ORDER = "'created_at', '2024-01-01', 'metadata', named_struct('k', 1), 'id', o_orderkey, 'uuid', 'x', 'total', cast(o_totalprice as string), 'body', named_struct('status', o_orderstatus)"


@query("""SELECT o_orderkey, '```json' || chr(10) || '{' || chr(10) || '  "body": {' || chr(10) || '    "status": "' || o_orderstatus || '"' || chr(10) || '  },' || chr(10) || '  "id": ' || o_orderkey || chr(10) || '}' || chr(10) || '```' AS content FROM orders""")
def structural_json(spark, d):
    body = F.expr(f"to_json(named_struct({_ORDER.replace(chr(39) + 'total' + chr(39) + ', cast(o_totalprice as string), ', '')}))")
    return table(spark, d, "orders").select("o_orderkey", structural.compressed(body).alias("content"))


@query("""SELECT n_nationkey, '```python' || chr(10) || 'def ' || lower(replace(n_name, ' ', '_')) || '():' || chr(10) || '    # ... (24 lines)' || chr(10) || '```' AS content FROM nation""")
def structural_code(spark, d):
    code = F.concat(F.lit("```py\ndef "), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("():\n"), F.lit("\n".join(f"    x{i} = {i}" for i in range(24))), F.lit("\n```"))
    return table(spark, d, "nation").select("n_nationkey", structural.compressed(code).alias("content"))


@query("""SELECT n_nationkey, '# ' || n_name || chr(10) || 'about budgets' || chr(10) || '# Other [collapsed: 1 paragraphs, ~5 tokens]' AS content FROM nation""")
def structural_markdown(spark, d):
    doc = F.concat(F.lit("# "), "n_name", F.lit("\nabout budgets\n# Other\none two three four"))
    return table(spark, d, "nation").select("n_nationkey", structural.compressed(doc, "Budgets?").alias("content"))


_DEEP = """'data', named_struct('k', named_struct('deeper', named_struct('fields', named_struct('x', 1, 'y', 2), 'list', array(1, 2, 3), 'status', o_orderstatus)), 'ref', '123e4567-e89b-12d3-a456-426614174000', 'updated_at', 'x'), 'meta', array(1)"""


@query("""SELECT o_orderkey, '```json' || chr(10) || '{' || chr(10) || '  "k": {' || chr(10) || '    "deeper": {' || chr(10) || '      "fields": "{...2 fields}",' || chr(10) || '      "list": "[...3 items]",' || chr(10) || '      "status": "' || o_orderstatus || '"'
|| chr(10) || '    }' || chr(10) || '  }' || chr(10) || '}' || chr(10) || '```' AS content FROM orders""")
def structural_json_depth(spark, d):
    """A wrapper that is taken off, a field that holds a UUID, and what lies too deep."""
    return table(spark, d, "orders").select("o_orderkey", structural.compressed(F.expr(f"to_json(named_struct({_DEEP}))")).alias("content"))


def _braces(head: str, tag: str, lines: int) -> Column:
    return F.concat(F.lit(f"```{tag}\n{head} "), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))), F.lit("() {\n"), F.lit("\n".join(f"  x({i});" for i in range(lines))), F.lit("\n}\nlast();\n```"))


@query("""SELECT n_nationkey, 'js' AS tag, '```js' || chr(10) || 'function ' || lower(replace(n_name, ' ', '_')) || '() {' || chr(10) || '    /* ... (24 lines) */' || chr(10) || '}' || chr(10) || 'last();' || chr(10) || '```' AS content FROM nation
UNION ALL SELECT n_nationkey, 'rust', '```rust' || chr(10) || 'pub fn ' || lower(replace(n_name, ' ', '_')) || '() {' || chr(10) || '    /* ... (30 lines) */' || chr(10) || '}' || chr(10) || 'last();' || chr(10) || '```' FROM nation
UNION ALL SELECT n_nationkey, 'short', '```ts' || chr(10) || 'function ' || lower(replace(n_name, ' ', '_')) || '() {' || chr(10) || '  x(0);' || chr(10) || '}' || chr(10) || 'last();' || chr(10) || '```' FROM nation""")
def structural_braces(spark, d):
    """Functions of languages with braces; short code stays."""
    kinds = [("js", _braces("function", "js", 24)), ("rust", _braces("pub fn", "rs", 30)), ("short", _braces("function", "ts", 1))]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("tag"), c.alias("code")) for k, c in kinds])).alias("e")
    return table(spark, d, "nation").select("n_nationkey", each).select("n_nationkey", "e.tag", structural.compressed(F.col("e.code")).alias("content"))


SAFE = f"{BOOKEND}, {zoned('(SELECT * EXCLUDE (attention_zone) FROM placed)', 'safe')}"


@query(from_chunks(CONV, f"SELECT {COLS} FROM safe", SAFE))
def preset_safe(spark, d):
    return shown(pipeline.optimize(conversations(spark, d), preset="safe"))


@query(from_chunks(CONV, f"SELECT {COLS} FROM safe", SAFE))  # these texts have nothing that structural compression changes
def preset_balanced(spark, d):
    return shown(pipeline.optimize(conversations(spark, d), preset="balanced"))


@query(from_chunks(CONV, f"SELECT {COLS} FROM fin", f"""{BOOKEND},
ded AS (SELECT * EXCLUDE (dk) REPLACE (row_number() OVER (PARTITION BY ctx_id ORDER BY pos) - 1 AS pos) FROM (SELECT *, row_number() OVER (PARTITION BY ctx_id, content ORDER BY pos) AS dk FROM placed) WHERE dk = 1),
{prune_sql('ded', 'pru', 0.3)}, {zoned('(SELECT * EXCLUDE (attention_zone) FROM pru)', 'fin')}"""))  # no context has more than 12 turns, so nothing is archived
def preset_aggressive(spark, d):
    return shown(pipeline.optimize(conversations(spark, d), preset="aggressive"))


@query(from_chunks(CONV, f"SELECT {COLS} FROM fin", f"{CUT}, {zoned('(SELECT * EXCLUDE (attention_zone) FROM cut)', 'fin')}"))
def compress(spark, d):
    return shown(pipeline.compress(conversations(spark, d), LIMIT))


@query(from_chunks(CONV, """SELECT * FROM (SELECT 0 AS step, 'bookend' AS strategy, (SELECT sum(token_count) FROM chunks)::BIGINT AS before_tokens, (SELECT sum(token_count) FROM placed)::BIGINT AS after_tokens
UNION ALL SELECT 1, 'dedup', (SELECT sum(token_count) FROM placed)::BIGINT, (SELECT sum(token_count) FROM ded)::BIGINT UNION ALL SELECT 2, 'prune', (SELECT sum(token_count) FROM ded)::BIGINT, (SELECT sum(token_count) FROM pru)::BIGINT)""", f"""{BOOKEND},
ded AS (SELECT * EXCLUDE (dk) REPLACE (row_number() OVER (PARTITION BY ctx_id ORDER BY pos) - 1 AS pos) FROM (SELECT *, row_number() OVER (PARTITION BY ctx_id, content ORDER BY pos) AS dk FROM placed) WHERE dk = 1), {prune_sql('ded', 'pru', 0.3)}"""))
def pipeline_steps(spark, d):
    return pipeline.explain_steps(conversations(spark, d), ["bookend", "dedup", "prune"])


@query(from_chunks(CONV, "SELECT c.ctx_id, c.pos::BIGINT AS pos_before, p.pos::BIGINT AS pos_after, c.role FROM chunks c JOIN placed p ON c.ctx_id = p.ctx_id AND c.chunk_index = p.chunk_index WHERE c.pos <> p.pos", BOOKEND))
def diff_moved(spark, d):
    before = conversations(spark, d)
    return diff.moved(before, bookend.bookend(before))


@query(from_chunks(CONV, "SELECT ctx_id, pos::BIGINT AS pos_before, role, token_count::BIGINT AS before_tokens FROM b1 WHERE dropped", CUT))
def diff_removed(spark, d):
    before = conversations(spark, d)
    return diff.compressed_and_removed(before, budget.truncate_to_budget(before, LIMIT)).where("after_tokens is null").drop("after_tokens")


def side_sql(source: str, name: str) -> str:
    """The health report of the chunks in ``source``, its columns called by ``name``."""
    return f"""{name} AS (SELECT ctx_id, total_tokens AS {name}_tokens, n_chunks AS {name}_messages, dead_zone_tokens AS {name}_dead_zone_tokens, duplicate_tokens AS {name}_duplicate_tokens, health_score AS {name}_health_score
FROM (WITH source AS (SELECT * FROM {source}), {HEALTH.replace('FROM chunks', 'FROM source')} SELECT * FROM health))"""


@query(from_chunks(CONV, "SELECT *, round((after_tokens - before_tokens) / before_tokens::DOUBLE * 100, 6) AS token_change_pct, after_health_score - before_health_score AS health_score_delta FROM before JOIN after USING (ctx_id)", f"{CUT}, {side_sql('chunks', 'before')}, {side_sql('cut', 'after')}"))
def diff_summary(spark, d):
    before = conversations(spark, d)
    return rounded(diff.diff_summary(before, budget.truncate_to_budget(before, LIMIT)), "token_change_pct")


@query("""WITH t AS (SELECT doc_id AS ctx_id, coalesce(text, '') AS b0, 'x ' || coalesce(text, '') AS b1, CASE WHEN doc_id % 3 = 0 THEN 'gone ' || coalesce(text, '') WHEN doc_id % 3 = 1 THEN coalesce(text, '') || ' and more' ELSE 'x ' || left(coalesce(text, ''), 90) || '.' END AS a FROM documents),
f AS (SELECT *, starts_with(a, left(b0, 80)) OR starts_with(b0, left(a, 80)) AS fit0, starts_with(a, left(b1, 80)) OR starts_with(b1, left(a, 80)) AS fit1 FROM t)
SELECT ctx_id, 0::BIGINT AS pos_before, 'document' AS role, ceil(strlen(b0) / 4.0)::BIGINT AS before_tokens, CASE WHEN fit0 THEN ceil(strlen(a) / 4.0)::BIGINT END AS after_tokens FROM f WHERE b0 <> a
UNION ALL SELECT ctx_id, 1, 'document', ceil(strlen(b1) / 4.0)::BIGINT, CASE WHEN fit1 AND NOT fit0 THEN ceil(strlen(a) / 4.0)::BIGINT END FROM f WHERE b1 <> a""")
def diff_by_prefix(spark, d):
    """Each document a context of two rows; of the one row that is left, some begin like the first, some like the second, some like none."""
    text_, x = F.coalesce("text", F.lit("")), F.lit("x ")
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ctx_id"), text_.alias("t"))
    kind = F.col("ctx_id") % 3
    after = F.when(kind == 0, F.concat(F.lit("gone "), "t")).when(kind == 1, F.concat("t", F.lit(" and more"))).otherwise(F.concat(x, F.substring("t", 1, 90), F.lit(".")))
    old = rows.select("ctx_id", F.posexplode(F.array("t", F.concat(x, "t"))).alias("pos", "content"), F.lit("document").alias("role"))
    new = rows.select("ctx_id", F.lit(0).alias("pos"), after.alias("content"), F.lit("document").alias("role"))
    return diff.compressed_and_removed(chunks.build_chunks(old), chunks.build_chunks(new))


@query(from_chunks(CONV, "SELECT ctx_id, sum(token_count)::BIGINT AS before_tokens, sum(CASE WHEN dropped THEN 0 ELSE token_count END)::BIGINT AS after_tokens, sum(CASE WHEN dropped THEN token_count ELSE 0 END)::BIGINT AS saved, round(sum(CASE WHEN dropped THEN token_count ELSE 0 END) / sum(token_count)::DOUBLE * 100, 6) AS reduction_pct FROM b1 GROUP BY ctx_id", CUT))
def reduction(spark, d):
    before = conversations(spark, d)
    return rounded(diff.reduction(before, budget.truncate_to_budget(before, LIMIT)), "reduction_pct")


def _raw(spark, d, message, **more):
    rows = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("ctx_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), message).alias("m"))
    return rows.select("ctx_id", F.to_json("m").alias("raw"))


MESSAGES = "SELECT conv_id AS ctx_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text AS content FROM conversations"


@query(MESSAGES)
def parse_openai(spark, d):
    raw = _raw(spark, d, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return formats.parse_messages(raw).select("ctx_id", "pos", "role", "content")


@query(MESSAGES.replace("text AS content", "text || chr(10) || chr(10) || 'more' AS content"))
def parse_anthropic(spark, d):
    block = lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"))
    raw = _raw(spark, d, lambda m: F.struct(m["role"].alias("role"), F.array(block(m["text"]), block(F.lit("more"))).alias("content")))
    return formats.parse_messages(raw).select("ctx_id", "pos", "role", "content")


@query("SELECT doc_id AS ctx_id, 0::BIGINT AS pos, 'document' AS role, text AS content, n_chars / 2.0::DOUBLE AS relevance_score FROM documents")
def parse_rag_chunks(spark, d):
    raw = table(spark, d, "documents").select(F.col("doc_id").alias("ctx_id"), F.to_json(F.array(F.struct(F.col("text").alias("content"), (F.col("n_chars") / 2.0).alias("score"), F.lit("x").alias("metadata")))).alias("raw"))
    return formats.parse_messages(raw).select("ctx_id", "pos", "role", "content", "relevance_score")


@query("SELECT page_id AS ctx_id, 0::BIGINT AS pos, 'document' AS role, html AS content FROM pages")
def parse_raw(spark, d):
    raw = table(spark, d, "pages").select(F.col("page_id").alias("ctx_id"), F.col("html").alias("raw"))
    return formats.parse_messages(raw).select("ctx_id", "pos", "role", "content")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'rag_chunks' WHEN 3 THEN 'raw' ELSE 'openai' END AS format FROM events")
def detect_format(spark, d):
    samples = ['[{"role":"user","content":"a"}]', '[{"role":"user","content":[{"type":"text","text":"a"}]}]', '[{"content":"a","score":0.5}]', '{"role":"user"}', " [] "]
    rows = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, samples)), (F.col("event_id") % 5 + 1).cast("int")).alias("raw"))
    return rows.select("event_id", formats.detect_format("raw").alias("format"))


@query("""WITH e AS (SELECT conv_id AS ctx_id, turn, role, text FROM conversations),
u AS (SELECT ctx_id, turn, 0 AS part, role, text AS content FROM e UNION ALL SELECT ctx_id, turn, 1, 'tool_interaction', '[Tool: Read] Input: {"turn":' || turn || '} Output: ' || text FROM e WHERE role = 'assistant' AND strlen(text) <= 2000)
SELECT ctx_id, (row_number() OVER (PARTITION BY ctx_id ORDER BY role <> 'system', turn, part) - 1)::BIGINT AS pos, role, content FROM u WHERE content <> ''""")
def transcript_normalize(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("ctx_id"), "turn", "role", "text")
    calls = (F.col("role") == "assistant") & (F.octet_length("text") <= 2000)
    blocks = F.when(calls, F.array(F.to_json(F.struct(F.lit("text").alias("type"), "text")), F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("t"), "turn").alias("id"), F.lit("Read").alias("name"), F.struct("turn").alias("input")))))
    content = F.when(calls, F.concat(F.lit("["), F.array_join(blocks, ","), F.lit("]"))).otherwise(F.substring(F.to_json(F.array("text")), 2, 1 << 30))
    content = F.when(calls, content).otherwise(F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"))
    line = F.concat(F.lit('{"type":"'), "role", F.lit('","message":{"role":"'), "role", F.lit('","content":'), content, F.lit("}}"))
    result = F.concat(F.lit('{"type":"user","message":{"role":"user","content":['), F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("t"), "turn").alias("tool_use_id"), F.col("text").alias("content"))), F.lit("]}}"))
    lines = rows.select("ctx_id", (F.col("turn") * 2).cast("long").alias("entry_no"), line.alias("line")).unionByName(rows.where(calls).select("ctx_id", (F.col("turn") * 2 + 1).cast("long").alias("entry_no"), result.alias("line")))
    return transcript.normalize(transcript.parse_transcript(lines)).select("ctx_id", "pos", "role", "content")


_CUT_AT = "list_filter(range(500, least(length(t), 2400) + 1), lambda c: strlen(left(t, c::BIGINT)) % 64 = 0 AND strlen(left(t, c::BIGINT)) >= 1997)[1]"


@query(f"""WITH d AS (SELECT doc_id AS ctx_id, text AS t, ceil(strlen(text) / 4.0)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL)
SELECT ctx_id, 0::BIGINT AS pos, 'tool_interaction' AS role, '[Tool: Read] Input: {{"n":' || ctx_id || '}} Output: ' || CASE WHEN tokens > 500 THEN rtrim(left(t, coalesce({_CUT_AT}, length(t))), ' ' || chr(9) || chr(10) || chr(13)) || ' … [output truncated, ' || tokens || ' tokens]' ELSE t END AS content FROM d
UNION ALL SELECT doc_id, 0, 'tool_interaction', '[Tool: Read] Input: {{"n":' || doc_id || '}} Output: (no result)' FROM documents WHERE text IS NULL""")
def transcript_outputs(spark, d):
    """Every document the output of a tool call; long ones are cut."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("ctx_id"), "text")
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.lit("t").alias("id"), F.lit("Read").alias("name"), F.struct(F.col("ctx_id").alias("n")).alias("input")))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.lit("t").alias("tool_use_id"), F.col("text").alias("content")))
    line = lambda role, block: F.concat(F.lit(f'{{"type":"{role}","message":{{"role":"{role}","content":['), block, F.lit("]}}"))
    lines = rows.select("ctx_id", F.posexplode(F.array(line("assistant", use), line("user", result))).alias("entry_no", "line"))
    return transcript.normalize(transcript.parse_transcript(lines)).select("ctx_id", "pos", "role", "content")


LOG = """log AS (SELECT event_id AS request_id, ['gpt-4o', 'gpt-4.1', 'unknown'][(user_id % 3 + 1)::INTEGER] AS model, CASE WHEN event_id % 2 = 0 THEN ['bookend', 'prune'] ELSE ['bookend'] END AS strategies, floor(abs(value) * 10)::BIGINT AS original_tokens,
floor(floor(abs(value) * 10) * 0.75::DOUBLE)::BIGINT AS optimized_tokens, event_id % 5 <> 0 AS was_optimized, event_id % 10 = 0 AS was_fallback, event_id % 3 = 0 AS is_streaming, event_id % 7 AS latency_ms FROM events),
priced AS (SELECT *, CASE model """ + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRICES.items()) + """ ELSE 1.0 END::DOUBLE AS price FROM log)"""


@query(f"WITH {LOG} SELECT model, count(*)::BIGINT AS requests, sum(greatest(original_tokens - optimized_tokens, 0))::BIGINT AS tokens_saved, round(sum(greatest(original_tokens - optimized_tokens, 0)) * max(price) / 1e6, 2) AS saved_usd FROM priced WHERE original_tokens > 0 GROUP BY model")
def model_metrics(spark, d):
    return metrics.model_metrics(request_log(spark, d))


@query(f"WITH {LOG} SELECT strategy, count(*)::BIGINT AS n FROM (SELECT unnest(strategies) AS strategy FROM log WHERE was_optimized) GROUP BY strategy")
def strategy_counts(spark, d):
    return metrics.strategy_counts(request_log(spark, d))


@query(f"""WITH {LOG}, t AS (SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE NOT was_fallback AND was_optimized)::BIGINT AS optimized, count(*) FILTER (WHERE NOT was_fallback AND NOT was_optimized)::BIGINT AS passthrough, count(*) FILTER (WHERE was_fallback)::BIGINT AS failed, count(*) FILTER (WHERE is_streaming)::BIGINT AS streaming,
sum(original_tokens)::BIGINT AS input_original, sum(optimized_tokens)::BIGINT AS input_optimized, round(sum(greatest(original_tokens - optimized_tokens, 0) * price / 1e6), 2) AS estimated_saved_usd, round(avg(latency_ms) FILTER (WHERE latency_ms > 0), 1) AS avg_optimize_latency_ms FROM priced)
SELECT *, input_original - input_optimized AS saved, round(input_optimized / input_original::DOUBLE, 3) AS compression_ratio FROM t""")
def request_totals(spark, d):
    return metrics.request_totals(request_log(spark, d))


@query(f"WITH {LOG} SELECT model, original_tokens, optimized_tokens, latency_ms FROM log ORDER BY request_id DESC LIMIT 1")
def last_request(spark, d):
    return metrics.last_request(request_log(spark, d))


TOTALS = SQL["request_totals"].removeprefix("WITH ")


@query(f"""WITH {TOTALS.replace('SELECT *, input_original', ', tot AS (SELECT *, input_original', 1)}),
md AS (SELECT string_agg(model || ':' || requests || ':' || tokens_saved || ':' || round(saved_usd * 100)::BIGINT, ',' ORDER BY model) AS models FROM (SELECT model, count(*)::BIGINT AS requests, sum(greatest(original_tokens - optimized_tokens, 0))::BIGINT AS tokens_saved, round(sum(greatest(original_tokens - optimized_tokens, 0)) * max(price) / 1e6, 2) AS saved_usd FROM priced WHERE original_tokens > 0 GROUP BY model)),
sg AS (SELECT string_agg(strategy || ':' || n, ',' ORDER BY strategy) AS strategies FROM (SELECT strategy, count(*) AS n FROM (SELECT unnest(strategies) AS strategy FROM log WHERE was_optimized) GROUP BY strategy)),
lr AS (SELECT model || ':' || original_tokens || ':' || optimized_tokens || ':' || latency_ms AS last FROM log ORDER BY request_id DESC LIMIT 1)
SELECT tot.*, models, strategies, last FROM tot, md, sg, lr""")
def metrics_snapshot(spark, d):
    """All figures in one row, the maps as texts."""
    joined = lambda key, *values: F.concat_ws(":", key, *values)
    r = F.col("last_request")
    models = F.transform(F.array_sort(F.map_entries("by_model")), lambda e: joined(e["key"], e["value"]["requests"].cast("string"), e["value"]["tokens_saved"].cast("string"), F.round(e["value"]["saved_usd"] * 100).cast("long").cast("string")))
    strategies = F.transform(F.array_sort(F.map_entries("strategies")), lambda e: joined(e["key"], e["value"].cast("string")))
    out = metrics.snapshot(request_log(spark, d))
    return out.withColumns({"models": F.array_join(models, ","), "last": joined(r["model"], r["original_tokens"].cast("string"), r["optimized_tokens"].cast("string"), r["latency_ms"].cast("string")), "strategies": F.array_join(strategies, ",")}).drop("by_model", "last_request")


@query("SELECT conv_id AS request_id, true AS was_optimized, false AS was_fallback, sum(ceil(strlen(text) / 4.0))::BIGINT AS original_tokens, sum(ceil(strlen(text) / 4.0))::BIGINT AS optimized_tokens FROM conversations GROUP BY conv_id")
def optimized_requests(spark, d):
    raw = _raw(spark, d, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    rows = raw.select(F.col("ctx_id").alias("request_id"), F.lit("/v1/chat/completions").alias("path"), F.concat(F.lit('{"model":"m","messages":'), "raw", F.lit("}")).alias("body"))
    return optimize_requests(rows, ["bookend"]).select("request_id", "was_optimized", "was_fallback", "original_tokens", "optimized_tokens")


def _items(spark, d):
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select(F.col("doc_id").alias("ctx_id"), F.col("doc_id").cast("string").alias("item_id"), F.lit("Other").alias("category"), F.col("text").alias("content"), F.ceil(F.coalesce("n_chars", F.lit(0)) / 4).cast("long").alias("tokens"), (1.0 / (1 + F.col("doc_id") % 7)).alias("priority_score"), F.array("doc_id").alias("source_positions"))


ITEM_WORDS = words_sql("text", "", 1, [])
LOSS = f"""it AS (SELECT doc_id AS ctx_id, text, list_distinct({ITEM_WORDS}) AS own, list_distinct({words_sql('substr(text, 1, length(text) // 2)', '', 1, [])}) AS said FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
ov AS (SELECT ctx_id, CASE WHEN len(own) > 0 THEN len(list_intersect(own, said)) / len(own)::DOUBLE ELSE 0.0 END AS overlap_score FROM it),
cls AS (SELECT *, CASE WHEN overlap_score >= 0.7 THEN 'preserved' WHEN overlap_score >= 0.3 THEN 'paraphrased' ELSE 'lost' END AS state FROM ov)"""


@query(f"WITH {LOSS} SELECT ctx_id, round(overlap_score, 6) AS overlap_score, state FROM cls")
def loss_classify(spark, d):
    half = table(spark, d, "documents").select(F.col("doc_id").alias("ctx_id"), F.expr("substr(text, 1, length(text) div 2)").alias("summary"))
    return rounded(compaction.loss_classify(_items(spark, d), half).select("ctx_id", "overlap_score", "state"), "overlap_score")


@query(f"WITH {LOSS} SELECT state, count(*)::BIGINT AS n FROM cls GROUP BY state")
def loss_states(spark, d):
    return loss_classify(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


INJECT = """i0 AS (SELECT try_cast(substr(source, 4) AS BIGINT) AS ctx_id, doc_id::VARCHAR AS item_id, ceil(coalesce(n_chars, 0) / 4.0)::BIGINT AS tokens, 1.0::DOUBLE / (1 + doc_id % 7) AS pr FROM documents),
i1 AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY pr DESC, item_id) AS rank, sum(tokens) OVER (PARTITION BY ctx_id ORDER BY pr DESC, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM i0)"""


@query(f"WITH {INJECT} SELECT ctx_id, item_id, rank::INTEGER AS rank, least(tokens, 1000)::BIGINT AS tokens, rank = 1 AND tokens > 1000 AS truncated FROM i1 WHERE s <= 1000 OR (rank = 1 AND tokens > 1000)")
def injection_select(spark, d):
    source = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("item_id"), F.expr("try_cast(substr(source, 4) AS bigint)").alias("src"))
    items = _items(spark, d).join(source, "item_id").withColumn("ctx_id", F.col("src"))
    return compaction.injection_select(items, 1000).select("ctx_id", "item_id", "rank", "tokens", "truncated")


_KINDS = " ".join(f"WHEN regexp_matches(content, '{p}') THEN '{k}'" for k, p in compaction.PATTERNS.items())
ITEMS = f"""sh AS (SELECT *, CASE WHEN sum(token_count) OVER (PARTITION BY ctx_id) > 0 THEN coalesce(sum(token_count) OVER (PARTITION BY ctx_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(token_count) OVER (PARTITION BY ctx_id)::DOUBLE ELSE 0 END AS share FROM chunks),
pc AS (SELECT ctx_id, pos, n, share, trim(unnest(string_split(regexp_replace(content, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)))) AS content FROM sh),
kd AS (SELECT *, CASE {_KINDS} END AS category FROM pc WHERE content <> ''),
it AS (SELECT ctx_id, lower(content) AS key, arg_min(content, pos) AS content, arg_min(category, pos) AS category, count(*) AS occurrence_count, max(pos) AS last, max(n) AS n, arg_min(share, pos) AS share FROM kd WHERE category IS NOT NULL GROUP BY ALL),
pr AS (SELECT ctx_id, substr(sha256(key), 1, 16) AS item_id, category, occurrence_count, ceil(strlen(content) / 4.0)::BIGINT AS tokens, 1.0::DOUBLE / occurrence_count * exp(-0.05::DOUBLE * (n - 1 - last)) * (1 - abs(share - 0.5::DOUBLE) * 2) AS priority FROM it),
best AS (SELECT *, row_number() OVER (PARTITION BY ctx_id ORDER BY priority DESC, item_id) AS rank FROM pr WHERE priority >= 0.1)"""


@query(from_chunks(DOCS, "SELECT ctx_id, item_id, category, occurrence_count::BIGINT AS occurrence_count, tokens FROM best WHERE rank <= 200", ITEMS))
def fingerprint_items(spark, d):
    return compaction.keep_best(compaction.extract_items(documents(spark, d))).select("ctx_id", "item_id", "category", "occurrence_count", "tokens")


@query(f"""SELECT doc_id, len({words_sql('text', '$', 1, [])})::INTEGER AS n_query_words, len(list_distinct({words_sql('text', '$', 2, text.STOP_DUPLICATE)}))::INTEGER AS n_duplicate_words, len({words_sql('text', '', 2, text.STOP_VECTOR)})::INTEGER AS n_vector_words,
len({words_sql('text', '', 2, text.STOP_PRUNE)})::INTEGER AS n_prune_words, len(list_filter(flatten(list_transform(string_split(text, chr(10)), lambda x: string_split(x, '. '))), lambda s: strlen(trim(s)) > 5))::INTEGER AS n_sentences, regexp_replace(source || ' /x', '[^A-Za-z0-9_-]', '_', 'g') AS safe FROM documents""")
def text_functions(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(text.query_words(c)).alias("n_query_words"), F.size(text.duplicate_words(c)).alias("n_duplicate_words"), F.size(text.vector_words(c)).alias("n_vector_words"), F.size(text.prune_words(c)).alias("n_prune_words"), F.size(text.sentences(c)).alias("n_sentences"), text.safe_id(F.concat("source", F.lit(" /x"))).alias("safe"))


@query("SELECT conv_id AS ctx_id, to_json(list(struct_pack(role := role, content := text) ORDER BY turn))::VARCHAR AS json FROM conversations GROUP BY conv_id")
def messages_json(spark, d):
    return chunks.to_messages(conversations(spark, d)).select("ctx_id", "json")


@query()
def exact_token_counts(spark, d):
    """Tokens of each conversation by a public byte-pair vocabulary instead of the estimate."""
    return chunks.count_tokens(chunks.recount(conversations(spark, d), tokens.public_bpe()))


def _store(spark) -> state.StateStore:
    return state.StateStore(spark, state.scratch_folder(spark))


@query("""WITH v AS (SELECT source AS session_id, doc_id::VARCHAR AS item_id, 1::BIGINT AS version FROM documents UNION ALL SELECT source, doc_id::VARCHAR, 2 FROM documents WHERE doc_id % 3 = 0 AND ends_with(source, '1')),
n AS (SELECT session_id, max(version) AS version FROM v GROUP BY session_id) SELECT v.* FROM v JOIN n USING (session_id, version)""")
def state_latest(spark, d):
    """What was written last for each session, some of which were written twice."""
    store, rows = _store(spark), table(spark, d, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("item_id"))
    store.append("fingerprints", rows, 1)
    store.append("fingerprints", rows.where("cast(item_id as long) % 3 = 0 and session_id like '%1'"), 2)
    return store.latest("fingerprints")


@query("""SELECT source AS session_id, count(*)::BIGINT AS compactions, sum(coalesce(n_chars, 0))::BIGINT AS items, sum(coalesce(n_chars, 0) // 2)::BIGINT AS preserved,
round(CASE WHEN sum(coalesce(n_chars, 0)) > 0 THEN sum(coalesce(n_chars, 0) // 2) / sum(coalesce(n_chars, 0))::DOUBLE ELSE 0 END, 6) AS preserved_ratio FROM documents GROUP BY source""")
def state_history(spark, d):
    """Figures over the event log, written in two appends."""
    n = F.coalesce("n_chars", F.lit(0)).cast("long")
    rows = table(spark, d, "documents").select(F.col("source").alias("session_id"), F.col("doc_id").cast("string").alias("timestamp"), F.lit("auto").alias("trigger"), n.alias("total_items"), F.floor(n / 2).cast("long").alias("preserved"))
    store = _store(spark)
    for k in (0, 1):
        store.append("compaction_log", rows.where(F.col("timestamp").cast("long") % 2 == k), k)
    return rounded(state.history_ratios(store.history()), "preserved_ratio")


@query(f"WITH {TOTALS.replace('FROM priced)', 'FROM priced WHERE request_id > (SELECT max(event_id) FROM events WHERE event_id % 1000 = 0))')}")
def metrics_after_reset(spark, d):
    """Totals since the last reset."""
    resets = table(spark, d, "events").where("event_id % 1000 = 0").select(F.col("event_id").alias("request_id"))
    return metrics.request_totals(metrics.after_reset(request_log(spark, d), resets))


@query("""SELECT event_id, event_id % 4 IN (0, 1) AS looks FROM events""")
def transcript_sniff(spark, d):
    """Texts that are read as transcripts: by their name, or by a brace at the start of their first line that isn't blank."""
    e = F.col("event_id")
    path = F.when(e % 4 == 0, "a.jsonl").when(e % 4 == 2, "a.json")
    raw = F.when(e % 4 == 1, " \n {}").otherwise("[1]")
    return table(spark, d, "events").select("event_id", transcript.is_transcript(path, raw).alias("looks"))


FENCED = """m AS (SELECT conv_id AS ctx_id, turn AS pos0, CASE WHEN turn % 2 = 0 THEN 'assistant' ELSE role END AS role, 'sure thing' || chr(10) || '```' || chr(10) || 'ok' || chr(10) || '# x' || chr(10) || '  ```' || chr(10) || coalesce(text, '') || chr(10) || '```js' || chr(10) || 'got it' AS content, NULL::DOUBLE AS given FROM conversations)"""


@query(from_chunks(FENCED, f"SELECT {COLS} FROM pru", prune_sql("chunks", "pru", 0.6)))
def prune_fences(spark, d):
    """Filler in fences stays, also in one that is never closed; the same filler before them goes."""
    role = F.when(F.col("turn") % 2 == 0, "assistant").otherwise(F.col("role"))
    content = F.concat(F.lit("sure thing\n```\nok\n# x\n  ```\n"), F.coalesce("text", F.lit("")), F.lit("\n```js\ngot it"))
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("ctx_id"), F.col("turn").alias("pos"), role.alias("role"), content.alias("content"))
    return shown(prune.prune(chunks.build_chunks(rows), 0.6))


@query("""SELECT conv_id * 4 + k AS request_id, k = 0 AS was_optimized, k = 1 AS was_fallback, CASE WHEN k = 0 THEN t ELSE 0 END AS original_tokens, CASE WHEN k = 0 THEN t ELSE 0 END AS optimized_tokens, true AS unchanged
FROM (SELECT conv_id, sum(ceil(strlen(text) / 4.0))::BIGINT AS t FROM conversations GROUP BY conv_id), (SELECT unnest([0, 1, 2, 3]) AS k)""")
def requests_dry_run(spark, d):
    """Measured and sent on as they came: requests that fit, whose messages don't, without messages, and to another path."""
    raw = _raw(spark, d, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    chat = F.concat(F.lit('{"model":"m","messages":'), "raw", F.lit("}"))
    bodies = F.array(chat, F.lit('{"messages":[{"role":"user","content":7}]}'), F.lit('{"messages":[]}'), chat)
    rows = raw.select("ctx_id", F.posexplode(bodies).alias("k", "body")).select((F.col("ctx_id") * 4 + F.col("k")).alias("request_id"), F.when(F.col("k") == 3, "/v1/models").otherwise("/v1/chat/completions").alias("path"), "body")
    done = optimize_requests(rows, ["bookend"], dry_run=True).withColumnRenamed("body", "sent")
    return done.join(rows, "request_id").select("request_id", "was_optimized", "was_fallback", "original_tokens", "optimized_tokens", (F.col("sent") == F.col("body")).alias("unchanged"))


class SaysTheSame:
    """A provider whose answers SQL knows."""

    def complete(self, system: str, prompt: str) -> str:
        return "one\n* two"


@query(from_chunks(DOCS, f"SELECT {COLS} FROM done", f"""{ZONES},
told AS (SELECT *, 1 AS rk FROM zone WHERE zone <> 'archived'),
said AS (SELECT * REPLACE ('- one' || chr(10) || '* two' AS content, 3 AS token_count) FROM told WHERE zone = 'aging' UNION ALL SELECT * FROM told WHERE zone <> 'aging'
UNION ALL SELECT DISTINCT ON (ctx_id) * REPLACE (0 AS pos, 0 AS chunk_index, 'system' AS role, '{summarize.SUMMARY_HEAD.strip()}' || chr(10) || 'one' || chr(10) || '* two' AS content, ceil({len(summarize.SUMMARY_HEAD) + 9} / 4.0)::BIGINT AS token_count, 0.8 AS relevance_score, 'strong' AS attention_zone), 0 FROM zone WHERE zone = 'archived'),
sums AS (SELECT ctx_id, (SELECT sum(token_count) FROM said x WHERE x.ctx_id = c.ctx_id) < sum(token_count) AS shrunk FROM chunks c GROUP BY ctx_id),
done AS (SELECT ctx_id, row_number() OVER (PARTITION BY ctx_id ORDER BY rk, pos) - 1 AS pos, chunk_index, role, content, token_count, relevance_score, attention_zone FROM said JOIN sums USING (ctx_id) WHERE shrunk
UNION ALL SELECT c.ctx_id, c.pos, c.chunk_index, c.role, c.content, c.token_count, c.relevance_score, c.attention_zone FROM chunks c JOIN sums USING (ctx_id) WHERE NOT shrunk)"""))
def summarize_provider(spark, d):
    """Archived turns as one summary, aging ones as bullets, by a provider."""
    return shown(summarize.summarize(documents(spark, d), SaysTheSame()))
