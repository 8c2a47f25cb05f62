"""Session transcripts: JSON lines with tool calls and their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tokens import TokenCounter, bytes4
from ..operators.chunks import default_relevance, size_of_context, with_zones
from ..schema import COLUMNS

#: Longest output of a tool that stays whole, in tokens.
OUTPUT_TOKENS = 500
#: A tool's input of more bytes is cut to so many characters.
INPUT_BYTES, INPUT_CHARS = 300, 297
NO_RESULT = "(no result)"


def is_transcript(path: Column, raw: Column) -> Column:
    """A .jsonl file, or a text whose first line that isn't blank begins with a brace."""
    return F.coalesce(path.endswith(".jsonl"), F.lit(False)) | raw.rlike(r"\A\s*\{")


def _get(v: str, key: str) -> str:
    return f"try_variant_get({v}, '$.{key}', 'variant')"


def _text(v: str, key: str) -> str:
    """SQL: a string field; null where there is none or another kind."""
    return f"CASE WHEN schema_of_variant({_get(v, key)}) = 'STRING' THEN try_variant_get({v}, '$.{key}', 'string') END"


_ABSENT = "({0} IS NULL OR is_variant_null({0}))"


def parse_transcript(lines: DataFrame) -> DataFrame:
    """ctx_id, entry_no, entry_type, role, content, blocks, valid of each line of ``lines`` (ctx_id, entry_no, line) that isn't blank.

    Invalid lines stay, marked; ``blocks`` is null where the content is a string.
    """
    block = f"""named_struct('type', {_text('b', 'type')}, 'text', {_text('b', 'text')}, 'id', {_text('b', 'id')}, 'name', {_text('b', 'name')},
        'input', CASE WHEN {_get('b', 'input')} IS NOT NULL THEN to_json({_get('b', 'input')}) END, 'tool_use_id', {_text('b', 'tool_use_id')}, 'content', {_text('b', 'content')},
        'content_ok', {_ABSENT.format(_get('b', 'content'))} OR schema_of_variant({_get('b', 'content')}) = 'STRING')"""
    rows = lines.where(F.trim("line") != "").withColumn("v", F.expr("try_parse_json(line)"))
    rows = rows.selectExpr("ctx_id", "entry_no", f"{_text('v', 'type')} AS entry_type", f"NOT {_ABSENT.format(_get('v', 'message'))} AS has_message", f"{_text('v', 'message.role')} AS role", f"{_text('v', 'message.content')} AS content", f"transform(try_variant_get(v, '$.message.content', 'array<variant>'), b -> {block}) AS blocks")
    ok = """forall(blocks, b -> b.type IS NOT NULL AND CASE b.type WHEN 'text' THEN b.text IS NOT NULL
        WHEN 'tool_use' THEN b.id IS NOT NULL AND b.name IS NOT NULL AND b.input IS NOT NULL WHEN 'tool_result' THEN b.tool_use_id IS NOT NULL AND b.content_ok ELSE true END)"""
    return rows.withColumn("valid", F.expr(f"coalesce(entry_type IS NOT NULL AND (NOT has_message OR (role IS NOT NULL AND (content IS NOT NULL OR coalesce({ok}, false)))), false)"))


def shortened(output: Column, counter: TokenCounter = bytes4) -> Column:
    """A tool's output cut near OUTPUT_TOKENS tokens, with a note of its whole size, where it has more.

    It is cut after the first character that ends a multiple of 64 bytes with that many tokens, four
    bytes each; where no character ends at one, only white space at its end goes.
    """
    total, raw = counter(output), output.cast("binary")
    least = -(-(4 * OUTPUT_TOKENS - 3) // 64) * 64
    places = F.when(F.length(raw) >= least, F.sequence(F.lit(least), F.length(raw), F.lit(64)))
    # a character ends before every byte that isn't 10xxxxxx
    ends = F.filter(places, lambda m: (m == F.length(raw)) | ~F.hex(F.substring(raw, m + 1, 1)).rlike("^[89AB]"))
    cut = F.coalesce(F.substring(raw, 1, F.get(ends, F.lit(0))).cast("string"), output)
    return F.when(total > OUTPUT_TOKENS, F.concat(F.regexp_replace(cut, r"(?U)\s+\z", ""), F.lit(" … [output truncated, "), total, F.lit(" tokens]"))).otherwise(output)


_ITEM = "array<struct<block_no:int,role:string,content:string,id:string,name:string,input:string>>"


def normalize(parsed: DataFrame, counter: TokenCounter = bytes4) -> DataFrame:
    """The chunk table of parsed transcripts: system texts first, each text block a chunk, each tool call one with its result.

    The last result of an id counts; results without a call go. Entries are looked at twice: once for what they say or call,
    once for results, which are joined to the calls by id.
    """
    told = F.expr("valid AND role IS NOT NULL")
    each = parsed.select("ctx_id", "entry_no", F.posexplode(F.expr("CASE WHEN valid AND role IS NOT NULL THEN blocks END")).alias("block_no", "b"))
    results = each.where("b.type = 'tool_result' AND b.content IS NOT NULL").groupBy("ctx_id", F.col("b.tool_use_id").alias("id")).agg(F.max_by("b.content", F.struct("entry_no", "block_no")).alias("output"))
    joined = F.array_join(F.transform(F.filter("blocks", lambda b: b["type"] == "text"), lambda b: b["text"]), "\n\n")
    one = lambda content: F.array(F.struct(F.lit(0), F.col("role"), content, F.lit(None), F.lit(None), F.lit(None))).cast(_ITEM)
    none = F.array().cast(_ITEM)
    placed = F.filter(F.transform("blocks", lambda b, i: F.struct(i.alias("i"), b.alias("b"))), lambda x: ((x["b"]["type"] == "text") & (x["b"]["text"] != "")) | (x["b"]["type"] == "tool_use"))
    call = lambda x, field: F.when(x["b"]["type"] == "tool_use", x["b"][field])
    many = F.transform(placed, lambda x: F.struct(x["i"], F.col("role"), x["b"]["text"], call(x, "id"), call(x, "name"), call(x, "input"))).cast(_ITEM)
    plain, system = F.col("blocks").isNull(), F.col("role") == "system"
    items = F.when(~told, none).when(plain, F.when(system | (F.col("content") != ""), one(F.col("content"))).otherwise(none)).when(system, F.when(joined != "", one(joined)).otherwise(none)).otherwise(many)
    rows = parsed.select("ctx_id", "entry_no", F.inline(items))
    given = F.when(F.octet_length("input") > INPUT_BYTES, F.concat(F.substring("input", 1, INPUT_CHARS), F.lit("…"))).otherwise(F.col("input"))
    merged = F.concat(F.lit("[Tool: "), "name", F.lit("] Input: "), given, F.lit(" Output: "), shortened(F.coalesce("output", F.lit(NO_RESULT)), counter))
    is_call = F.col("name").isNotNull()
    every = rows.join(results, ["ctx_id", "id"], "left").select("ctx_id", "entry_no", "block_no", F.when(is_call, F.lit("tool_interaction")).otherwise(F.col("role")).alias("role"), F.when(is_call, merged).otherwise(F.col("content")).alias("content"))
    pos = F.row_number().over(Window.partitionBy("ctx_id").orderBy((F.col("role") != "system").cast("int"), "entry_no", "block_no")) - 1
    out = every.withColumn("pos", pos.cast("long")).withColumns({"chunk_index": F.col("pos"), "token_count": counter(F.col("content"))})
    out = out.withColumn("relevance_score", default_relevance(F.col("role"), F.col("pos"), size_of_context()))
    return with_zones(out).select(*COLUMNS)


def transcript_lines(raw: DataFrame) -> DataFrame:
    """ctx_id, entry_no, line of whole texts (ctx_id, raw)."""
    return raw.select("ctx_id", F.posexplode(F.split("raw", "\r?\n")).alias("entry_no", "line")).withColumn("entry_no", F.col("entry_no").cast("long"))
