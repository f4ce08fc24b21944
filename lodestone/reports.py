"""Reports of one query's results, a bounded list: Markdown, HTML, JSON and plain text."""

from __future__ import annotations

import html
import json
import textwrap
from pathlib import Path


def normal_scores(scores: list[float]) -> list[float]:
    """Scaled to 0..100; 100 where all are equal."""
    lo, hi = min(scores, default=0), max(scores, default=0)
    return [100.0 if hi == lo else 100 * (s - lo) / (hi - lo) for s in scores]


def _parts(query: str, answer: str | None, hits: list[dict], most: int) -> list[tuple[str, list[str]]]:
    shown = [f"{k}. {h.get('title') or h['doc_id']} ({s:.0f}): {(h.get('content') or '')[:200]}" for k, (h, s) in enumerate(zip(hits[:most], normal_scores([h["score"] for h in hits[:most]]), strict=True), 1)]
    return [("Query", [query]), *([("Answer", [answer])] if answer is not None else []), ("Sources", shown or ["none"])]


def render(form: str, query: str, answer: str | None, hits: list[dict], most: int = 10) -> str:
    """A report as md, html, json or txt; hits have doc_id, score and, where known, title and content."""
    parts = _parts(query, answer, hits, most)
    if form == "json":
        return json.dumps({"query": query, "answer": answer, "sources": hits[:most]}, ensure_ascii=False, indent=2)
    if form == "md":
        return "\n\n".join(f"## {head}\n\n" + "\n".join(lines) for head, lines in parts) + "\n"
    if form == "html":
        body = "".join(f"<h2>{html.escape(head)}</h2>" + "".join(f"<p>{html.escape(x)}</p>" for x in lines) for head, lines in parts)
        return f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(query)}</title></head><body>{body}</body></html>"
    if form == "txt":
        return "\n\n".join("\n".join([head.upper(), *(w for x in lines for w in textwrap.wrap(x, 80) or [""])]) for head, lines in parts) + "\n"
    raise ValueError(f"no form {form!r}")


def save(path: str, query: str, answer: str | None, hits: list[dict], most: int = 10) -> None:
    """The report in the form of the file's extension; text for others."""
    form = {".md": "md", ".markdown": "md", ".html": "html", ".htm": "html", ".json": "json"}.get(Path(path).suffix.lower(), "txt")
    Path(path).write_text(render(form, query, answer, hits, most), encoding="utf-8")
