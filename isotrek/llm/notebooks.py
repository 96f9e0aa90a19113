"""Notebook texts to cells: JSON notebooks, percent scripts, Markdown exports and session logs.

A segment is (cell, part, kind, text): the number of the cell, ``source`` or ``output``, the kind of
the cell (``text`` or ``code``) and what stands there with escapes decoded and comment signs of the
notation removed. Embedded images are no text and give no segment.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

FORMATS = ("ipynb", "percent", "md_export", "log")


class Segment(NamedTuple):
    cell: int
    part: str
    kind: str
    text: str


_PERCENT_HEAD = re.compile(r"^#[ \t]*%%(.*)$", re.M)
_LOG_HEAD = re.compile(r"^(\[text\]|In \[[^\]\n]*\]:|Out\[[^\]\n]*\]:)[ \t]*$", re.M)
_FENCE = re.compile(r"^(```+|~~~+)")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_COMMENT = re.compile(r"^#(?!>|!)[ \t]?", re.M)


def sniff(text: str) -> str:
    """The notation a text seems to be in."""
    start = text.lstrip("﻿ \t\r\n")[:1]
    if start == "{" and '"cells"' in text or start == "{" and '"cell_type"' in text:
        return "ipynb"
    if _PERCENT_HEAD.search(text):
        return "percent"
    if _LOG_HEAD.search(text):
        return "log"
    return "md_export"


def segments(text: str | None, nb_format: str | None) -> list[Segment]:
    """The segments of a notebook; none for a null or blank text. An unknown or null format is sniffed."""
    if not text or text.isspace():
        return []
    nb_format = nb_format if nb_format in FORMATS else sniff(text)
    if nb_format == "ipynb":
        return _ipynb(text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return {"percent": _percent, "log": _log, "md_export": _markdown}[nb_format](text)


def _joined(value: object) -> str:
    if isinstance(value, str):
        return value
    return "".join(x for x in value if isinstance(x, str)) if isinstance(value, list) else ""


def _ipynb(text: str) -> list[Segment]:
    try:
        book = json.loads(text.lstrip("﻿"), strict=False)
    except (ValueError, RecursionError):
        return _broken_ipynb(text)
    if not isinstance(book, dict):
        return _broken_ipynb(text)
    cells = book.get("cells")
    if not isinstance(cells, list):
        sheets = book.get("worksheets") if isinstance(book.get("worksheets"), list) else []
        cells = [c for s in sheets if isinstance(s, dict) for c in s.get("cells") or []]
    out = []
    for i, cell in enumerate(c for c in cells if isinstance(c, dict)):
        kind = "code" if cell.get("cell_type") == "code" else "text"
        out.append(Segment(i, "source", kind, _joined(cell.get("source", cell.get("input")))))
        for output in cell.get("outputs") or ():
            out += [Segment(i, "output", kind, t) for t in _output_texts(output) if t]
    return out


def _output_texts(output: object) -> list[str]:
    if not isinstance(output, dict):
        return []
    texts = [_joined(output.get("text"))]
    if isinstance(output.get("traceback"), list):
        texts.append("\n".join(x for x in output["traceback"] if isinstance(x, str)))
    if isinstance(output.get("evalue"), str):
        texts.append(output["evalue"])
    data = output.get("data")
    if isinstance(data, dict):
        texts += [_joined(v) for k, v in data.items() if not k.startswith(("image/", "audio/", "video/"))]
    return texts


def _broken_ipynb(text: str) -> list[Segment]:
    """String literals in their order: a new source starts at each "source", an output at each "text" or "text/plain"."""
    out, cell, part, kind, parts = [], -1, None, "text", []

    def close() -> None:
        if part and parts:
            out.append(Segment(max(cell, 0), part, kind, "".join(parts)))
        parts.clear()

    expect_kind = False
    for m in _STRING.finditer(text):
        try:
            value = json.loads(m.group(), strict=False)
        except ValueError:
            value = m.group(1)
        is_key = text[m.end() : m.end() + 8].lstrip()[:1] == ":"
        if is_key:
            close()
            part = {"source": "source", "input": "source", "text": "output", "text/plain": "output", "traceback": "output"}.get(value)
            expect_kind = value == "cell_type"
            cell += part == "source"
        elif expect_kind:
            kind, expect_kind = ("code" if value == "code" else "text"), False
        else:
            parts.append(value)
    close()
    return out


def _percent(text: str) -> list[Segment]:
    heads = list(_PERCENT_HEAD.finditer(text))
    out = []
    if heads and (front := text[: heads[0].start()].strip()) and not front.startswith("# ---"):
        out.append(Segment(0, "source", "code", front))
    for i, head in enumerate(heads):
        body = text[head.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)].strip("\n")
        if "[markdown]" in head.group(1) or "[md]" in head.group(1):
            out.append(Segment(i + 1, "source", "text", _COMMENT.sub("", body)))
            continue
        source, output = [], []
        for line in body.split("\n"):
            (output if line.startswith(("#>", "#!")) else source).append(line)
        out.append(Segment(i + 1, "source", "code", "\n".join(source)))
        if output:
            out.append(Segment(i + 1, "output", "code", "\n".join(x[3:] if x[2:3] == " " else x[2:] for x in output)))
    if not heads:
        out.append(Segment(0, "source", "code", text))
    return out


def _log(text: str) -> list[Segment]:
    heads = list(_LOG_HEAD.finditer(text))
    out, cell = [], 0
    if front := text[: heads[0].start() if heads else len(text)].strip():
        out.append(Segment(0, "source", "text", front))
    for i, head in enumerate(heads):
        body = text[head.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)].strip("\n")
        output = head.group().startswith("Out")
        cell += not output
        out.append(Segment(cell, "output" if output else "source", "text" if head.group().startswith("[text]") else "code", body))
    return out


def _markdown(text: str) -> list[Segment]:
    out, cell, lines, part, kind, fence = [], 0, [], "source", "text", ""

    def close() -> None:
        nonlocal cell
        body = "\n".join(lines).strip("\n")
        if body.strip():
            cell += part == "source"
            out.append(Segment(cell, part, kind, body))
        lines.clear()

    after_code = False
    for line in text.split("\n"):
        if fence:
            if line.startswith(fence):
                close()
                part, kind, fence, after_code = "source", "text", "", True
            else:
                lines.append(line)
            continue
        if m := _FENCE.match(line):
            close()
            part, kind, fence = "source", "code", m.group(1)
            continue
        indented = line.startswith(("    ", "\t"))
        if part == "output" and (indented or not line.strip()):
            lines.append(line[4:] if line.startswith("    ") else line.lstrip("\t"))
            continue
        if indented and (after_code or part == "output"):
            close()
            part, kind = "output", "code"
            lines.append(line[4:] if line.startswith("    ") else line.lstrip("\t"))
            continue
        if part == "output":
            close()
            part, kind = "source", "text"
        if line.strip():
            after_code = False
        lines.append(line)
    close()
    return out
