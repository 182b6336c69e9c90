"""Query specifications: discovery, validation, parameter resolution and derivation."""

from __future__ import annotations

import ast
import json
import re
from dataclasses import dataclass, field
from pathlib import Path

REQUIRED = {"name": str, "query": str}
OPTIONAL = {"family": str, "language": str, "parameters": dict, "dataset": dict, "oracle": dict, "warm_runs": int}

#: Defaults of parameters that a template names but neither the spec nor the caller gives.
DEFAULTS = {"threshold": 0.5, "limit": 100, "max_depth": 3, "k": 10}


@dataclass
class Spec:
    name: str
    query: str
    family: str = ""
    language: str = "cypher"
    parameters: dict = field(default_factory=dict)
    dataset: dict = field(default_factory=dict)
    oracle: dict = field(default_factory=dict)
    warm_runs: int = 5


def faults(record: object) -> list[str]:
    """What is wrong with a record: missing or unknown keys and wrong types."""
    if not isinstance(record, dict):
        return ["not a mapping"]
    out = [f"{k} is missing" for k in REQUIRED if k not in record]
    out += [f"{k} is unknown" for k in record if k not in REQUIRED | OPTIONAL]
    return out + [f"{k} is no {t.__name__}" for k, t in (REQUIRED | OPTIONAL).items() if k in record and not isinstance(record[k], t)]


#: JSON types and the Python ones that stand for them.
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float), "null": type(None)}


def violations(schema: dict | bool, value: object, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema: the Draft-7 keywords that specifications use.

    Types, enum, const, required, properties, patternProperties,
    additionalProperties, items, bounds of numbers and lengths, pattern,
    uniqueItems, allOf, anyOf, oneOf, not, and references within the schema's
    ``definitions``.
    """
    return _violations(schema, value, at, schema if isinstance(schema, dict) else {})


def _is(value: object, kind: str) -> bool:
    if isinstance(value, bool) and kind in ("integer", "number"):
        return False
    return isinstance(value, _TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def _violations(schema: dict | bool, value: object, at: str, root: dict) -> list[str]:
    if isinstance(schema, bool):
        return [] if schema else [f"{at} is not allowed"]
    if "$ref" in schema:
        target: object = root
        for part in schema["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        return _violations(target, value, at, root)
    out: list[str] = []
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at} is no {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at} is none of {schema['enum']}")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at} is not {schema['const']!r}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for word, broken in (("minimum", lambda x: value < x), ("maximum", lambda x: value > x), ("exclusiveMinimum", lambda x: value <= x), ("exclusiveMaximum", lambda x: value >= x), ("multipleOf", lambda x: value % x != 0)):
            if word in schema and broken(schema[word]):
                out.append(f"{at} breaks {word} {schema[word]}")
    if isinstance(value, (str, list, dict)):
        kind = "Length" if isinstance(value, str) else "Items" if isinstance(value, list) else "Properties"
        if len(value) < schema.get(f"min{kind}", 0) or len(value) > schema.get(f"max{kind}", len(value)):
            out.append(f"{at} has {len(value)} {kind.lower()}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at} does not match {schema['pattern']}")
    if isinstance(value, list):
        if schema.get("uniqueItems") and any(x in value[:k] for k, x in enumerate(value)):
            out.append(f"{at} repeats an item")
        items = schema.get("items", True)
        each = [*items, *[schema.get("additionalItems", True)] * max(0, len(value) - len(items))] if isinstance(items, list) else [items] * len(value)
        for k, (own, x) in enumerate(zip(each, value, strict=False)):
            out += _violations(own, x, f"{at}[{k}]", root)
    if isinstance(value, dict):
        out += [f"{at}.{name} is missing" for name in schema.get("required", []) if name not in value]
        for name, x in value.items():
            own = [schema["properties"][name]] if name in schema.get("properties", {}) else []
            own += [s for p, s in schema.get("patternProperties", {}).items() if re.search(p, name)]
            for s in own or [schema.get("additionalProperties", True)]:
                out += _violations(s, x, f"{at}.{name}", root)
    for s in schema.get("allOf", []):
        out += _violations(s, value, at, root)
    for word, fits in (("anyOf", lambda n: n > 0), ("oneOf", lambda n: n == 1)):
        if word in schema and not fits(sum(not _violations(s, value, at, root) for s in schema[word])):
            out.append(f"{at} fits {'none' if word == 'anyOf' else 'not exactly one'} of {word}")
    if "not" in schema and not _violations(schema["not"], value, at, root):
        out.append(f"{at} fits what it must not")
    return out


def load(path: str | Path) -> Spec:
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        record = json.loads(text)
    else:
        import yaml  # optional

        record = yaml.safe_load(text)
    if wrong := faults(record):
        raise ValueError(f"{path}: {'; '.join(wrong)}")
    return Spec(**record)


def discover(directory: str | Path) -> list[tuple[str, Spec | None, str]]:
    """(path, spec or None, error) of every specification below a folder."""
    out = []
    for path in sorted(p for p in Path(directory).rglob("*") if p.suffix in (".json", ".yaml", ".yml")):
        try:
            out.append((str(path), load(path), ""))
        except Exception as e:  # an error is a row of the listing
            out.append((str(path), None, str(e)))
    return out


def resolve(spec: Spec, overrides: dict | None = None) -> dict:
    """Defaults under overrides; a parameter may be a value or a mapping with ``default``."""
    values = {k: v.get("default") if isinstance(v, dict) else v for k, v in spec.parameters.items()}
    return values | (overrides or {})


def derive(spec: Spec, values: dict) -> dict:
    """Adds threshold = 1 - selectivity, max_id = row count and k = top_k, then keeps the names the query uses."""
    out = dict(values)
    if "selectivity" in out:
        out.setdefault("threshold", 1 - out["selectivity"])
    if "top_k" in out:
        out.setdefault("k", out["top_k"])
    if "row_count" in spec.dataset:
        out.setdefault("max_id", spec.dataset["row_count"])
    out = DEFAULTS | out
    return {k: v for k, v in out.items() if f"${k}" in spec.query}


def literal(text: str):
    """A command-line value: list, integer, float, boolean or text."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return {"true": True, "false": False}.get(text.lower(), text)
