"""Functions on whole documents, given as JSON text.

Documents nest to any depth and keep the order of their fields, which fixed
schemas can't; each function here is plain Python on one document and has a
vectorised Arrow form. What a flat column expression can say is one (`get_field`,
`first_field`, `has_prefix`).
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def load(text: str | None) -> dict:
    return json.loads(text) if text else {}


def save(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def vectorised(f: Callable[..., str | None]) -> Callable[..., Column]:
    """Arrow form of a function from texts to a text."""

    @F.pandas_udf("string")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*columns)], dtype=object)

    return run


def get_field(doc: Column, key: str = "_id") -> Column:
    """Text of a top-level field; null if it is missing. Dots and dollars are part of the name."""
    return F.get_json_object(doc, f"$['{key}']")


def first_field(doc: Column) -> Column:
    return F.get(F.json_object_keys(doc), F.lit(0))


def has_field(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def has_prefix(doc: Column, prefix: str = "$") -> Column:
    """Whether some top-level field starts with ``prefix``; ``$`` tells operator updates."""
    return F.coalesce(F.exists(F.json_object_keys(doc), lambda k: F.startswith(k, F.lit(prefix))), F.lit(False))


def remove_field(text: str | None, key: str) -> str | None:
    doc = load(text)
    doc.pop(key, None)
    return save(doc)


def set_field(text: str | None, key: str, value: str) -> str | None:
    """Replaces a field that is there; adds none. ``value`` is JSON."""
    doc = load(text)
    if key in doc:
        doc[key] = json.loads(value)
    return save(doc)


def to_map(text: str | None, keep: tuple[str, ...] = ()) -> dict:
    """Unordered form of a document; embedded documents too, but neither arrays nor the fields in ``keep``."""
    return {k: to_map(save(v)) if isinstance(v, dict) and k not in keep else v for k, v in sorted(load(text).items())}


class Pairs(list):
    """Fields in order, in which a name may come more than once."""

    def text(self) -> str:
        return "{" + ",".join(f"{save(k)}:{save(v)}" for k, v in self) + "}"


def diff_to_update(diff: dict, path: str = "") -> tuple[Pairs, bool]:
    """A delta document as (update operators in order, whether they are the stages of a pipeline).

    On a level ``d`` names fields to remove, ``i`` and ``u`` fields to set, and
    ``s<name>`` holds the delta of a field; in an array's delta (marked by ``a``)
    ``u<n>`` holds an element and ``l`` the new length. Every part takes effect.
    Only a pipeline can cut an array; its cuts come before all other changes, so
    a level that names a cut after other changes is an error.
    """
    cuts, changes = Pairs(), Pairs()

    def walk(level: dict, at: str) -> None:
        full = (lambda name: f"{at}.{name}") if at else (lambda name: name)
        before = len(changes)
        for key, value in level.items():
            kind, name = key[:1], key[1:]
            if key == "a" and value is True:
                pass
            elif key == "l" and len(changes) == before:
                cuts.append(("$set", {at: {"$slice": [f"${at}", value]}}))
            elif key in ("d", "i", "u"):
                changes.append(("$unset" if key == "d" else "$set", {full(k): v for k, v in value.items()}))
            elif kind == "u" and name:
                changes.append(("$set", {full(name): value}))
            elif kind == "s" and name:
                walk(value, full(name))
            else:
                raise ValueError(f"delta field {key!r} at {at!r}")

    walk(diff, path)
    return Pairs([*cuts, *changes]), bool(cuts)


def diff_text(text: str | None) -> str:
    """``diff_to_update`` from text to text; a pipeline becomes an array of stages."""
    found, pipeline = diff_to_update(load(text))
    if not pipeline:
        return found.text()
    return "[" + ",".join(save({name: list(fields) if name == "$unset" else fields}) for name, fields in found) + "]"


def rewrite_dbref(value, db: str, rename: Callable[[str], str]):
    """References {$ref, $id, $db} with the renamed namespace; ``db`` where $db is missing. Arrays stay as they are."""
    if not isinstance(value, dict):
        return value
    if next(iter(value), None) == "$ref":
        home, _, coll = rename(f"{value.get('$db', db)}.{value['$ref']}").partition(".")
        return {**{k: v for k, v in value.items() if k != "$db"}, "$ref": coll, "$db": home}
    return {k: rewrite_dbref(v, db, rename) for k, v in value.items()}


def clean_apply_ops(text: str | None) -> str:
    """A command without $db and ui, and its operations without ui."""
    doc = {k: v for k, v in load(text).items() if k not in ("$db", "ui")}
    if isinstance(doc.get("applyOps"), list):
        doc["applyOps"] = [{k: v for k, v in x.items() if k != "ui"} for x in doc["applyOps"]]
    return save(doc)


def create_indexes_command(text: str | None) -> str:
    """The log's flat index document as a command with a list of one index."""
    doc = load(text)
    return save({"createIndexes": doc.pop("createIndexes"), "indexes": [doc]})


def commit_index_build_command(text: str | None) -> str:
    doc = load(text)
    return save({"createIndexes": doc["commitIndexBuild"], "indexes": doc["indexes"]})


def clean_create(text: str | None) -> str:
    """A create command without autoIndexId if it also has idIndex."""
    doc = load(text)
    if doc.get("idIndex") is not None:
        doc.pop("autoIndexId", None)
    return save(doc)


def equal(a: str | None, b: str | None) -> bool:
    """Deep equality, fields in any order."""
    return load(a) == load(b)


def at_path(doc: dict, path: str):
    """Value at a dotted path: a literal key of $set wins, then the steps downward; None if there is none."""
    chosen = doc.get("$set") if isinstance(doc.get("$set"), dict) else doc
    if path in chosen:
        return chosen[path]
    for step in path.split("."):
        if not isinstance(chosen, dict) or step not in chosen:
            return None
        chosen = chosen[step]
    return chosen


def unique_key(text: str | None, columns: str) -> str | None:
    """Exact key of an index, whose columns are joined by ``|``; null if all are missing."""
    doc = load(text)
    values = [at_path(doc, c) for c in columns.split("|")]
    return None if all(v is None for v in values) else save(values)


def apply_update(doc: dict | None, change: dict) -> dict:
    """A document after $set, $unset and $inc by dotted paths, or after replacement (which keeps _id)."""
    if not any(k.startswith("$") for k in change):
        return ({"_id": doc["_id"]} if doc and "_id" in doc else {}) | change
    out = json.loads(save(doc or {}))
    for name, fields in change.items():
        if name in ("$v",):
            continue
        for path, value in fields.items():
            *steps, last = path.split(".")
            at = out
            for step in steps:
                at = at[int(step)] if isinstance(at, list) else at.setdefault(step, {})
            slot = int(last) if isinstance(at, list) else last
            if name == "$unset":
                if isinstance(at, list):
                    at[slot] = None
                else:
                    at.pop(slot, None)
            elif name == "$inc":
                at[slot] = (at.get(slot, 0) if isinstance(at, dict) else at[slot]) + value
            elif name == "$set":
                if isinstance(at, list):
                    at.extend([None] * (slot + 1 - len(at)))
                at[slot] = value
            else:
                raise ValueError(f"update operator {name} isn't known")
    return out
