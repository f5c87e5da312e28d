"""Canonical JSON and digests over it."""

from __future__ import annotations

import hashlib
import json
import math

#: Members whose integers are written as ``1.0`` (fixed values).
FLOATS = {
    "base_confidence", "confidence", "containment", "markdown_reference_coverage", "minimum_accept_confidence", "nested_overlap_containment", "union_area_fraction",
}


def _number(v: float) -> str:
    """A number as the shortest text that gives it back, exponents as in JavaScript."""
    if isinstance(v, int):
        return str(v)
    if not math.isfinite(v):
        raise ValueError("a canonical number is finite")
    if v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    s = repr(v)
    if "e" in s:
        base, exp = s.split("e")
        n = int(exp)
        if -6 <= n < 0:
            digits = base.replace(".", "").lstrip("-")
            return ("-" if v < 0 else "") + "0." + "0" * (-n - 1) + digits
        return f"{base}e{'+' if n > 0 else '-'}{abs(n)}"
    return s


def canonical_json(v: object, parent: str | None = None) -> str:
    """JSON with sorted members and no blanks."""
    if v is None or isinstance(v, (bool, str)):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, (int, float)):
        text = _number(v)
        return text + ".0" if parent in FLOATS and float(v).is_integer() else text
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical_json(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v[k], k)}" for k in sorted(v, key=lambda k: k.encode("utf-16-be"))) + "}"
    raise TypeError(f"no canonical form of {type(v).__name__}")


def canonical_sha256(v: object) -> str:
    return hashlib.sha256(canonical_json(v).encode()).hexdigest()
