"""Settings: environment over file over defaults, each with its type."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

PREFIX = "LODESTONE_"
PLACES = ("lodestone.json", "conf/lodestone.json", "~/.lodestone.json")


@dataclass(frozen=True)
class Config:
    """What a pipeline takes; every field is read by something."""

    chunk_size: int = 512
    chunk_overlap: int = 50
    hierarchical: bool = True
    embed_parents: bool = False
    dimension: int = 384
    dense_k: int = 10
    sparse_k: int = 10
    fused_k: int = 15
    rrf_constant: int = 60
    rerank_k: int = 8
    min_similarity: float = 0.0
    merge_children: int = 2
    search_scope: str = "leaves"
    context_characters: int = 3000


PROFILES = {"default": Config(), "shipped": Config(dense_k=5, sparse_k=5, fused_k=10)}


def _typed(kind: str, text: object) -> object:
    if kind == "bool":
        word = str(text).strip().lower()
        if word not in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            raise ValueError(f"not a yes or no: {text!r}")
        return word in ("1", "true", "yes", "on")
    return {"int": int, "float": float, "str": str}[kind](text)


def find(places: tuple[str, ...] = PLACES) -> Path | None:
    named = os.environ.get(PREFIX + "CONFIG")
    return next((p for p in map(lambda x: Path(x).expanduser(), ([named] if named else []) + list(places)) if p.is_file()), None)


def load(path: str | None = None, profile: str = "default") -> Config:
    """The profile, changed by a JSON file and then by LODESTONE_<FIELD> in the environment."""
    file = Path(path) if path else find()
    given = json.loads(file.read_text()) if file else {}
    known = {f.name: f.type for f in fields(Config)}
    if unknown := given.keys() - known.keys():
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    given |= {n: os.environ[PREFIX + n.upper()] for n in known if PREFIX + n.upper() in os.environ}
    return replace(PROFILES[profile], **{n: _typed(known[n], v) for n, v in given.items()})
