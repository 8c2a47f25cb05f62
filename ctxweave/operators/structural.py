"""Shrinking structured content: JSON without noise, code down to signatures, markdown down to what a query asks for."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import TokenCounter, bytes4

FENCE = "```"
#: Nesting below this becomes a note of its size.
DEPTH = 3
#: Code of up to so many lines stays.
SHORT = 20

# JSON keys that go, and keys that only wrap.
NOISE_SUFFIXES, NOISE_KEYS = ("_at", "_time", "_timestamp"), {"uuid", "guid", "metadata", "meta"}
WRAPPERS = {"data", "result", "results", "response", "body", "payload", "value", "item"}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")

# How declarations begin.
PYTHON = re.compile(r"(async )?def |class ")
JAVASCRIPT = re.compile(r"(async )?function |class |export ((async )?function |class |default (function |class ))|(const|let) .*=>")
RUST = re.compile(r"(pub(\((crate|super)\))? )?fn |(pub )?(async|unsafe) fn ")


def text_lines(text: str) -> list[str]:
    """Lines between \\n or \\r\\n; no empty one after a final line end."""
    return [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []


def dump(value: object) -> str:
    return json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False)


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(text: str) -> object:
    """The JSON value of ``text``; ValueError where it is none."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError(str(e)) from e


def lean(value: object, depth: int = 0) -> object:
    """``value`` without noise fields, single wrappers and what is nested below DEPTH."""
    if isinstance(value, list):
        return f"[...{len(value)} items]" if depth > DEPTH else [lean(v, depth + 1) for v in value]
    if not isinstance(value, dict):
        return value
    if depth > DEPTH:
        return f"{{...{len(value)} fields}}"
    kept = {k: lean(v, depth + 1) for k, v in value.items() if not is_noise(k, v)}
    if len(kept) == 1:
        (key, inner), = kept.items()
        if key.lower() in WRAPPERS and isinstance(inner, dict):
            return inner
    return kept


def is_noise(key: str, value: object) -> bool:
    low = key.lower()
    return low.endswith(NOISE_SUFFIXES) or low in NOISE_KEYS or isinstance(value, str) and bool(_UUID.fullmatch(value))


def lean_json(text: str) -> str:
    try:
        return dump(lean(parse(text.strip())))
    except ValueError:
        return text


def _note(n: int) -> str:
    return f"... ({n} line{'' if n == 1 else 's'})"


def python_outline(code: str) -> str:
    """Definitions with their docstrings; what is indented below them, as its number of lines."""
    rows = text_lines(code)
    indent = [len(r.encode()) - len(r.lstrip().encode()) for r in rows]
    out, i = [], 0
    while i < len(rows):
        out.append(rows[i])
        here = i
        i += 1
        if not PYTHON.match(rows[here].strip()):
            continue
        mark = rows[i].strip()[:3] if i < len(rows) else ""
        if mark in ('"""', "'''"):
            last = i
            if mark not in rows[i].strip()[3:]:
                last = next((k for k in range(i + 1, len(rows)) if rows[k].strip().endswith(mark)), len(rows) - 1)
            out += rows[i : last + 1]
            i = last + 1
        end = next((k for k in range(i, len(rows)) if rows[k].strip() and indent[k] <= indent[here]), len(rows))
        if end > i:
            out.append(" " * (indent[here] + 4) + "# " + _note(end - i))
        i = end
    return "\n".join(out)


def brace_outline(code: str, is_declaration: Callable[[str], object]) -> str:
    """Declarations up to their opening brace; the body, as its number of lines."""
    rows = text_lines(code)
    level = [0, *accumulate(r.count("{") - r.count("}") for r in rows)]
    out, i = [], 0
    while i < len(rows):
        out.append(rows[i])
        start, i = i, i + 1
        if not is_declaration(rows[start].strip()):
            continue
        if level[i] == level[start]:  # no brace is left open: look for it on the next five lines
            limit = min(i + 5, len(rows))
            i = next((k + 1 for k in range(i, limit) if level[k + 1] > level[start]), limit)
            out += rows[start + 1 : i]
        if level[i] <= level[start]:
            continue
        end = next((k + 1 for k in range(i, len(rows)) if level[k + 1] <= level[start]), len(rows))
        if end - i > 1:
            out.append(f"    /* {_note(end - i - 1)} */")
        out.append("}")
        i = end
    return "\n".join(out)


def bare_words(text: str) -> set[str]:
    """Lower-case words without marks at their ends."""
    def bare(w: str) -> str:
        a, b = 0, len(w)
        while a < b and not w[a].isalnum():
            a += 1
        while b > a and not w[b - 1].isalnum():
            b -= 1
        return w[a:b]

    return {x for w in text.lower().split() if (x := bare(w))}


def is_heading(line: str) -> bool:
    return line.lstrip().startswith("#")


def relevant_sections(text: str, query: str | None) -> str:
    """Sections that share a word with ``query`` as they are, others as their heading with a note of their size."""
    if not query:
        return text
    asked = bare_words(query)
    out = []
    numbered = accumulate((is_heading(x) for x in text_lines(text)))
    for _, rows in groupby(zip(numbered, text_lines(text), strict=True), key=lambda x: x[0]):
        section = [x for _, x in rows]
        head = section.pop(0) if is_heading(section[0]) else ""
        body = "\n".join(section).lstrip("\n")
        if not head or asked & bare_words(f"{head} {body}"):
            out += [x for x in (head, body) if x]
        elif not body.strip():
            out.append(head)
        else:
            paragraphs = sum(bool(p.strip()) for p in body.split("\n\n"))
            out.append(f"{head} [collapsed: {paragraphs} paragraphs, ~{int(len(body.split()) / 0.75 + 0.5)} tokens]")
    return "\n".join(out)


def blocks(content: str) -> Iterator[tuple[str | None, str]]:
    """(language, code) of each fenced block, (None, text) of what is between; bare JSON counts as fenced."""
    held: list[str] = []
    lang: str | None = None

    def text_block() -> Iterator[tuple[str | None, str]]:
        text = "\n".join(held).lstrip("\n")
        if text:
            t = text.strip()
            if (t[:1], t[-1:]) in (("{", "}"), ("[", "]")) and is_json(t):
                yield "json", t
            else:
                yield None, text

    for line in text_lines(content):
        if not line.strip().startswith(FENCE):
            held.append(line)
        elif lang is None:
            yield from text_block()
            lang, held = line.strip()[3:].strip(), []
        else:
            yield lang, "\n".join(held).lstrip("\n")
            lang, held = None, []
    if lang is None:
        yield from text_block()
    else:
        yield None, f"\n{FENCE}{lang}\n" + "\n".join(held).lstrip("\n")


def is_json(text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def compress_text(content: str, query: str | None = None) -> str:
    """``content`` with each block shrunk by its kind."""
    out = []
    for lang, body in blocks(content):
        if lang is None:
            out.append(relevant_sections(body, query) if any(map(is_heading, text_lines(body))) else body)
            continue
        kind, tag = lang.lower(), lang
        long = len(text_lines(body)) > SHORT
        if kind == "json":
            body, tag = lean_json(body), "json"
        elif kind in ("python", "py") and long:
            body, tag = python_outline(body), "python"
        elif kind in ("javascript", "js", "typescript", "ts") and long:
            body = brace_outline(body, JAVASCRIPT.match)
        elif kind in ("rust", "rs") and long:
            body, tag = brace_outline(body, RUST.match), "rust"
        out.append(f"{FENCE}{tag}\n{body}\n{FENCE}")
    return "\n".join(out)


def compressed(content: Column, query: str | None = None) -> Column:
    """``compress_text`` of a column. Rows that it can't change don't leave the JVM with their text."""
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else compress_text(t, query))

    touched = content.rlike(r"(?s)```|#|\A\s*[{\[]|\r|\A\n|\n\z")
    return F.coalesce(run(F.when(touched, content)), content)


def structural(chunks: DataFrame, query: str | None = None, counter: TokenCounter = bytes4) -> DataFrame:
    """Every chunk's content compressed, also system rows; tokens counted anew."""
    out = chunks.withColumn("content", compressed(F.col("content"), query))
    return out.withColumn("token_count", counter(F.col("content"))).select(*chunks.columns)
