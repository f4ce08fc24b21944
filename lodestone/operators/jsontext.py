"""JSON to text: strategies for settings, records, prose and logs; JSON lines; repair.

A document's form is known only when it is read, so values are walked in vectorised
functions over Arrow batches; what a strategy gives are rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions import rules as R

DEEPEST, SPLIT = 10, 3


def flat(value: Any, path: str = "", depth: int = 0) -> Iterator[str]:
    """``path: value`` lines; arrays of plain values in one line, others item by item."""
    if depth > DEEPEST:
        yield f"{path}: [max depth exceeded]"
    elif isinstance(value, dict):
        for key, inner in value.items():
            yield from flat(inner, f"{path}.{key}" if path else key, depth + isinstance(inner, dict | list))
    elif isinstance(value, list) and any(isinstance(x, dict | list) for x in value):
        for k, inner in enumerate(value):
            yield from flat(inner, f"{path}[{k}]", depth + isinstance(inner, dict | list))
    else:
        shown = f"[{', '.join(map(str, value))}]" if isinstance(value, list) else str(value)
        yield f"{path}: {shown}" if path or isinstance(value, list) else shown


def flatten(value: Any) -> str:
    return "\n".join(flat(value))


def _records(value: Any) -> bool:
    return isinstance(value, list) and len(value) >= SPLIT and isinstance(value[0], dict)


def strategy(value: Any) -> str:
    """logs, semantic, records or flatten: what suits a document."""
    if isinstance(value, dict):
        keys = {k.lower() for k in value}
        if keys & {*R.TIME_FIELDS} and keys & {*R.LOG_MARKS}:
            return "logs"
        if any(k.lower() in R.TEXT_FIELDS and isinstance(v, str) and len(v) > 100 for k, v in value.items()):
            return "semantic"
        return "records" if any(map(_records, value.values())) else "flatten"
    return "records" if _records(value) else "flatten"


def schema_hint(value: Any) -> str:
    return {dict: "object", list: "array"}.get(type(value), "primitive")


def _kept(value: Any) -> dict:
    return {k: value[k] for k in R.KEPT_FIELDS if k in value} if isinstance(value, dict) else {}


Chunk = tuple[str, dict, str | None]


def log_line(entry: dict) -> tuple[str, dict]:
    """``[time] | [level] | message | key: value`` and the time and level found."""
    named = {"timestamp": R.TIME_FIELDS, "log_level": R.LEVEL_FIELDS, "message": R.MESSAGE_FIELDS}
    found = {name: next((str(v) for k, v in reversed(entry.items()) if k.lower() in fields), None) for name, fields in named.items()}
    taken = {f for fields in named.values() for f in fields}
    head = [f"[{found[n]}]" for n in ("timestamp", "log_level") if found[n]]
    rest = [f"{k}: {json.dumps(v) if isinstance(v, dict) else v}" for k, v in entry.items() if k.lower() not in taken and isinstance(v, str | int | float | bool | dict)]
    line = " | ".join([*head, *([found["message"]] if found["message"] else []), *rest])
    return line, {n: found[n] for n in ("timestamp", "log_level") if found[n]}


def _semantic(value: Any) -> Iterator[Chunk]:
    texts = [(f, value[f]) for f in R.TEXT_FIELDS if isinstance(value.get(f), str) and len(value[f]) > 20] if isinstance(value, dict) else []
    title = next((value[f] for f in R.TITLE_FIELDS if isinstance(value.get(f), str)), None) if isinstance(value, dict) else None
    parts = ([f"Title: {title}"] if title else []) + [f"{f.capitalize()}: {t}" for f, t in texts]
    if not parts:
        yield from parsed(value, "flatten")
        return
    plain = {f"json_{k}": v for k, v in value.items() if k.lower() not in {*R.TEXT_FIELDS, *R.TITLE_FIELDS} and isinstance(v, str | int | float | bool)}
    yield "\n\n".join(parts), {"json_parsing_strategy": "semantic"} | _kept(value) | plain, title


def _split(value: Any) -> Iterator[Chunk]:
    many = [({}, value)] if isinstance(value, list) else [({"parent_key": k}, v) for k, v in value.items() if isinstance(v, list) and len(v) >= SPLIT] if isinstance(value, dict) else []
    empty = True
    for owner, items in many:
        for k, item in enumerate(items):
            if isinstance(item, dict):
                empty = False
                yield flatten(item), {"json_parsing_strategy": "records"} | owner | {"record_index": k, "total_records": len(items)} | _kept(item), None
    if empty and isinstance(value, dict):
        yield from parsed(value, "flatten")


def parsed(value: Any, how: str = "auto") -> Iterator[Chunk]:
    """(content, meta, title) of a document's chunks."""
    how = strategy(value) if how == "auto" else how
    if how == "records":
        yield from _split(value)
    elif how == "semantic":
        yield from _semantic(value)
    elif how == "logs" and isinstance(value, dict | list):
        for k, entry in enumerate(value if isinstance(value, list) else [value]):
            if isinstance(entry, dict):
                line, meta = log_line(entry)
                yield line, {"json_parsing_strategy": "logs", "log_index": k} | meta, None
    else:
        yield flatten(value), {"json_parsing_strategy": "flatten", "json_schema_hint": schema_hint(value)} | _kept(value), None


def _load(text: str | None) -> tuple[bool, Any]:
    try:
        return True, json.loads(text)
    except (TypeError, ValueError):
        return False, None


CHUNK = "array<struct<content:string,meta:string,title:string>>"


def _rows(chunks: Iterator[Chunk]) -> list[dict]:
    return [{"content": c, "meta": json.dumps(m, sort_keys=True), "title": t} for c, m, t in chunks]


def json_chunks(docs: DataFrame, id_col: str = "doc_id", json_col: str = "json", how: str = "auto") -> DataFrame:
    """(id, chunk_index, content, meta, title) of JSON documents; what can't be read has none."""

    @F.pandas_udf(CHUNK)
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _rows(parsed(v[1], how)) if (v := _load(t))[0] else [])

    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(json_col))).alias("chunk_index", "c"))
    return rows.select(F.col("id").alias(id_col), "chunk_index", "c.*")


@F.pandas_udf(StringType())
def detected(texts: pd.Series) -> pd.Series:
    """The strategy of each document; null for what can't be read."""
    return texts.map(lambda t: strategy(v[1]) if (v := _load(t))[0] else None)


def json_lines(lines: DataFrame, how: str = "auto", errors: int = 10) -> DataFrame:
    """(path, line, content, meta, title) of lines (path, line from 0, text) of JSON files.

    A file's first line names its strategy; blank lines are skipped; after more than
    ``errors`` lines that can't be read the rest of a file is left out."""
    w = Window.partitionBy("path").orderBy("line")
    rows = lines.where(F.trim("text") != "").withColumn("bad", F.when(F.try_parse_json("text").isNull(), 1).otherwise(0))
    # counts alone go through the window; the errors up to a line, itself included
    rows = rows.withColumn("bad_so_far", F.sum("bad").over(w)).where(F.col("bad_so_far") <= errors)
    first = lines.where("line = 0").select("path", (F.lit(how) if how != "auto" else detected(F.col("text"))).alias("how"))
    rows = rows.where("bad = 0").join(first, "path", "left").withColumn("how", F.coalesce("how", F.lit("flatten")))

    @F.pandas_udf("struct<content:string,meta:string,title:string>")
    def cut(texts: pd.Series, hows: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        out = []
        for text, mine, n in zip(texts, hows, numbers, strict=True):
            value = json.loads(text)
            # a line is one record
            chunk = next(parsed(value, "flatten" if mine == "records" else mine), (None, {}, None))
            meta = {k: v for k, v in chunk[1].items() if k not in ("json_schema_hint", "log_index")} | {"line_index": int(n), "source_type": "jsonl"}
            out.append((chunk[0], json.dumps(meta, sort_keys=True), chunk[2]))
        return pd.DataFrame(out, columns=["content", "meta", "title"])

    made = rows.select("path", "line", cut("text", "how", "line").alias("c")).select("path", "line", "c.*")
    return made.where("content is not null")


def reply_json(reply: str) -> Any:
    """The JSON of a model's reply: of a fenced block, else from the first bracket on; comments
    and trailing commas go, brackets that were cut off are closed; null if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", reply, re.DOTALL)
    text = fenced.group(1) if fenced else reply
    begin = min((k for k in (text.find("{"), text.find("[")) if k >= 0), default=-1)
    if begin < 0:
        return None
    text = re.sub(r"(?m)^\s*//.*$", "", text[begin:])
    decoder = json.JSONDecoder()
    open_, quoted, skip = [], False, False
    for c in text:
        if quoted:
            skip, quoted = (c == "\\" and not skip), quoted and (c != '"' or skip)
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_.append("}" if c == "{" else "]")
        elif c in "}]" and open_:
            open_.pop()
            if not open_:
                break
    for candidate in (text, text + ('"' if quoted else "") + "".join(reversed(open_)), text.rstrip().rstrip(",:") + ('"' if quoted else "") + "".join(reversed(open_))):
        try:
            return decoder.raw_decode(re.sub(r",(\s*[}\]])", r"\1", candidate))[0]
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def extract_json(replies: pd.Series) -> pd.Series:
    return replies.map(lambda r: None if r is None or (v := reply_json(r)) is None else json.dumps(v))
