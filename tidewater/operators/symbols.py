"""Symbols of Go and Python sources: kind, name, signature, lines and bytes."""

from __future__ import annotations

import ast
import re

SIGNATURE = 256
SYMBOLS = "array<struct<kind string, name string, signature string, byte_start long, byte_end long, line_start int, line_end int>>"


def _symbol(kind: str, name: str, raw: bytes, start: int, end: int) -> dict:
    head = raw[start : min(end, start + SIGNATURE)].decode("utf-8", "ignore")
    return {"kind": kind, "name": name, "signature": head, "byte_start": start, "byte_end": end, "line_start": raw.count(b"\n", 0, start) + 1, "line_end": raw.count(b"\n", 0, max(start, end - 1)) + 1}


def python_symbols(source: str) -> list[dict]:
    """Classes, methods (functions anywhere below a class) and functions, in source order. Raises SyntaxError."""
    raw = source.encode()
    lines = [0]
    for line in raw.split(b"\n"):
        lines.append(lines[-1] + len(line) + 1)
    out: list[dict] = []

    def walk(node: ast.AST, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(child, ast.ClassDef)
                start = lines[child.lineno - 1] + child.col_offset
                out.append(_symbol("class" if is_class else "method" if in_class else "function", child.name, raw, start, lines[child.end_lineno - 1] + child.end_col_offset))
                walk(child, in_class or is_class)
            else:
                walk(child, in_class)

    walk(ast.parse(raw), False)
    return out


_SKIP = re.compile(rb'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|`[^`]*`?|\'(?:\\.|[^\'\\\n])*\'?', re.S)
_FUNC = re.compile(rb"func\s*(\([^)]*\))?\s*([A-Za-z_]\w*)")
_TYPE = re.compile(rb"([A-Za-z_]\w*)\s*(?:\[[^\]]*\]\s*)?(struct\b|interface\b|=?\s*\S)")


def _blank(raw: bytes) -> bytes:
    """The source with comments and literals made spaces, lines kept."""
    return _SKIP.sub(lambda m: re.sub(rb"[^\n]", b" ", m[0]), raw)


def _close(code: bytes, at: int) -> int:
    """The end of the declaration that begins at ``at``: a line end outside all brackets."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in b"({[":
            depth += 1
        elif c in b")}]":
            depth -= 1
        elif c == 10 and depth <= 0:
            return i
    return len(code)


def go_symbols(source: str) -> list[dict]:
    """Top-level functions, methods, structs, interfaces and other types, grouped ones included."""
    raw = source.encode()
    code = _blank(raw)
    out: list[dict] = []

    def add_type(at: int, start: int, end: int) -> None:
        if m := _TYPE.match(code, at):
            kind = {b"struct": "struct", b"interface": "interface"}.get(m[2], "type")
            out.append(_symbol(kind, m[1].decode(), raw, start, len(raw[:end].rstrip())))

    at = depth = 0
    while at < len(code):
        end = _close(code, at)
        head = code[at:end]
        lead = at + len(head) - len(head.lstrip())
        if code.startswith(b"func", lead) and (m := _FUNC.match(code, lead)):
            out.append(_symbol("method" if m[1] else "function", m[2].decode(), raw, lead, len(raw[:end].rstrip())))
        elif m := re.compile(rb"type\s+").match(code, lead):
            if code[m.end() : m.end() + 1] == b"(":
                inner, stop = m.end() + 1, code.rfind(b")", m.end(), end)
                while inner < stop:
                    close = min(_close(code, inner), stop)
                    part = code[inner:close]
                    if part.strip():
                        first = inner + len(part) - len(part.lstrip())
                        add_type(first, first, close)
                    inner = close + 1
            else:
                add_type(m.end(), m.end(), end)
        at = end + 1
    return out


def symbols_of(path: str, source: str) -> list[dict]:
    """By extension; none for other languages and for sources that can't be parsed."""
    try:
        if path.endswith(".py"):
            return python_symbols(source)
        if path.endswith(".go"):
            return go_symbols(source)
    except (SyntaxError, ValueError, RecursionError):
        pass
    return []
