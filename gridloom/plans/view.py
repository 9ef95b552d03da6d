"""A view: one source and a linear pipeline of operations, as JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..functions.predicates import predicate_columns
from ..functions.scalars import scalar_columns

KINDS = ("filter", "select", "drop", "sort", "derive", "deduplicate", "sample", "group_by", "rename", "limit", "top_k", "approximate")
#: The canonical order of the operations' classes.
ORDER = {"approximate": 0, "select": 1, "drop": 2, "filter": 3, "derive": 4, "deduplicate": 5, "sample": 5, "group_by": 6, "rename": 7, "sort": 8, "top_k": 8, "limit": 9}


@dataclass(frozen=True)
class View:
    source_id: str
    ops: list[dict] = field(default_factory=list)

    @staticmethod
    def from_json(text: str | dict) -> View:
        raw = json.loads(text) if isinstance(text, str) else text
        for op in raw["ops"]:
            if op.get("type") not in KINDS:
                raise ValueError(f"unknown operation: {op.get('type')}")
        return View(raw["source_id"], list(raw["ops"]))

    def to_json(self) -> str:
        return json.dumps({"source_id": self.source_id, "ops": self.ops}, sort_keys=True, separators=(",", ":"))

    def key(self) -> str:
        """A 64-bit FNV-1a hash of the operations, as 16 hex digits."""
        h = 0xCBF29CE484222325
        for b in json.dumps(self.ops, sort_keys=True, separators=(",", ":")).encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return f"{h:016x}"


def canonical(ops: list[dict]) -> list[dict]:
    """Operations in canonical order; within a class the given order stays.

    A filter on a column that a derive makes runs after that derive, one on an
    aggregate's alias after the group-by, and one on a renamed column after the rename.
    """
    derived = {op["name"] for op in ops if op["type"] == "derive"}
    made = {a["alias"] for op in ops if op["type"] == "group_by" for a in op["aggs"]}
    keys = {k for op in ops if op["type"] == "group_by" for k in op["keys"]}
    renamed = {b for op in ops if op["type"] == "rename" for _, b in op["mappings"]}

    def place(op: dict) -> float:
        at = ORDER[op["type"]]
        if op["type"] == "filter":
            needs = predicate_columns(op["predicate"])
            if needs & (made - derived - keys):
                return 6.5
            if needs & (renamed - derived):
                return 7.5
            if needs & derived:
                return 4.5
        return at

    placed = [(place(op), i, op) for i, op in enumerate(ops)]
    # select and drop must not take away what later filters and derives read
    needed = set()
    for at, _, op in placed:
        if op["type"] == "filter" and at < 6:
            needed |= predicate_columns(op["predicate"])
        if op["type"] == "derive":
            needed |= scalar_columns(op["expr"])
    kept = None
    for op in ops:
        if op["type"] == "select":
            kept = set(op["columns"])
    dropped = {c for op in ops if op["type"] == "drop" for c in op["columns"]}
    late = needed & dropped or kept is not None and needed - kept - derived
    out = [(4.6 if late and op["type"] in ("select", "drop") else at, i, op) for at, i, op in placed]
    if late:
        # the derived columns stay when the select runs after them
        out = [(at, i, op | {"columns": [*op["columns"], *[d["name"] for d in ops if d["type"] == "derive" and d["name"] not in op["columns"]]]} if at == 4.6 and op["type"] == "select" else op) for at, i, op in out]
    return [op for _, _, op in sorted(out, key=lambda x: x[:2])]
