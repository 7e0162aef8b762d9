"""YAML as version 1.2's core schema reads it, and the normal form of a specification."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import yaml


class _Loader(yaml.CSafeLoader if hasattr(yaml, "CSafeLoader") else yaml.SafeLoader):
    yaml_implicit_resolvers: dict = {}

    def construct_mapping(self, node: yaml.MappingNode, deep: bool = False) -> dict:
        if isinstance(node, yaml.MappingNode):
            self.flatten_mapping(node)
        found: dict = {}
        for k, v in node.value:
            key = self.construct_object(k, deep=True)
            key = json.dumps(key) if isinstance(key, (list, dict)) else key
            if key in found:
                raise yaml.constructor.ConstructorError(None, None, f"duplicated mapping key: {key}", k.start_mark)
            found[key] = self.construct_object(v, deep=deep)
        return found


def _int(loader: yaml.Loader, node: yaml.ScalarNode) -> int:
    text = node.value.replace("_", "")
    sign = -1 if text[0] == "-" else 1
    text = text.lstrip("+-")
    base = {"0b": 2, "0o": 8, "0x": 16}.get(text[:2].lower())
    return sign * (int(text[2:], base) if base else int(text))


def _float(loader: yaml.Loader, node: yaml.ScalarNode) -> float:
    text = node.value.replace("_", "").lower()
    special = {".inf": math.inf, "+.inf": math.inf, "-.inf": -math.inf, ".nan": math.nan}
    return special[text] if text in special else float(text)


def _map(loader: _Loader, node: yaml.MappingNode) -> Iterator[dict]:
    out: dict = {}
    yield out
    out.update(loader.construct_mapping(node))


for _tag, _pattern, _first in (
    ("null", r"~|null|Null|NULL|", ["~", "n", "N", ""]),
    ("bool", r"true|True|TRUE|false|False|FALSE", list("tTfF")),
    ("int", r"[-+]?(?:0b[01_]+|0o[0-7_]+|0x[0-9a-fA-F_]+|[0-9][0-9_]*)", list("-+0123456789")),
    ("float", r"[-+]?(?:[0-9][0-9_]*\.[0-9_]*|\.[0-9]+|[0-9][0-9_]*(?=[eE]))(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)", list("-+0123456789.")),
    ("timestamp", r"\d{4}-\d\d-\d\d|\d{4}-\d\d?-\d\d?(?:[Tt]|[ \t]+)\d\d?:\d\d:\d\d(?:\.\d*)?(?:[ \t]*(?:Z|[-+]\d\d?(?::\d\d)?))?", list("0123456789")),
    ("merge", r"<<", ["<"]),
):
    _Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(rf"^(?:{_pattern})$"), _first)
_Loader.add_constructor("tag:yaml.org,2002:int", _int)
_Loader.add_constructor("tag:yaml.org,2002:float", _float)
_Loader.add_constructor("tag:yaml.org,2002:map", _map)


def load(text: str) -> Any:
    return yaml.load(text, _Loader)  # noqa: S506 (a safe loader)


_SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(v: Any) -> str:
    """Empty unless a string; trimmed if an end is a space, line feed or tab."""
    if not isinstance(v, str):
        return ""
    return v.strip(_SPACES) if v and (v[0] in " \n\t" or v[-1] in " \n\t") else v


def _get(raw: Any, key: str) -> Any:
    return raw.get(key) if isinstance(raw, dict) else None


def _typed(kind: type, v: Any, default: Any, where: str) -> Any:
    v = default if v is None else v
    if not isinstance(v, kind) or (kind is not bool and isinstance(v, bool)):
        raise ValueError(f"{where}: expected {kind.__name__}, got {type(v).__name__}")
    return v


def example(raw: Any) -> dict:
    return {
        "id": _typed(str, _get(raw, "id"), "", "example id"),
        "name": _typed(str, _get(raw, "name"), "", "example name"),
        "code": trimmed(_get(raw, "code")),
        "description": trimmed(_get(raw, "description")),
        "dataSql": trimmed(_get(_get(raw, "data"), "sql")),
        "response": trimmed(_get(raw, "response")),
        "isSpotlight": _typed(bool, _get(raw, "isSpotlight"), False, "isSpotlight"),
    }


def operation(raw: Any) -> dict:
    over = _typed(list, _get(raw, "overwriteParams"), [], "overwriteParams")
    for o in over:
        _typed(dict, o, None, "overwriteParams entry")
    return {
        "id": _typed(str, _get(raw, "id"), "", "operation id"),
        "title": _typed(str, _get(raw, "title"), "", "operation title"),
        "description": trimmed(_get(raw, "description")),
        "notes": trimmed(_get(raw, "notes")),
        "examples": [example(e) for e in _typed(list, _get(raw, "examples"), [], "examples")],
        "overwriteParams": [json.dumps(o, ensure_ascii=False, default=str) for o in over],
    }


def info(raw: Any) -> dict:
    libraries = _typed(list, _get(raw, "libraries"), [], "libraries")
    for lib in libraries:
        for v in _typed(dict, lib, None, "library").values():
            _typed(str, v, None, "library value")
    url = _get(raw, "specUrl")
    if isinstance(raw, dict) and "specUrl" in raw:
        _typed(str, url, None, "specUrl")
    return {
        "id": _typed(str, _get(raw, "id"), "", "info id"),
        "title": _typed(str, _get(raw, "title"), "", "info title"),
        "description": trimmed(_get(raw, "description")),
        "specUrl": url,
        "slugPrefix": _typed(str, _get(raw, "slugPrefix"), "/", "slugPrefix"),
        "libraries": libraries,
    }


def spec(text: str) -> dict:
    """{info, operations} of a specification's text; a ValueError or YAMLError if it isn't one."""
    raw = load(text)
    if raw is None:
        raise ValueError("the document is empty")
    return {"info": info(_get(raw, "info")), "operations": [operation(f) for f in _typed(list, _get(raw, "functions"), [], "functions")]}


def spec_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, spec as JSON, error) of rows (path, text), for mapInPandas."""
    for frame in frames:
        rows = []
        for path, text in zip(frame["path"], frame["text"], strict=True):
            try:
                rows.append((path, json.dumps(spec(text or ""), ensure_ascii=False), None))
            except (ValueError, yaml.YAMLError) as e:
                rows.append((path, None, str(e)))
        yield pd.DataFrame(rows, columns=["path", "spec", "error"])
