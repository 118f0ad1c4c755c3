"""Presentation of results: text and structure side by side, with a limit on the text."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame

_format: ContextVar[str] = ContextVar("format", default="json")


def current() -> str:
    return _format.get()


@contextmanager
def formatted(how: str) -> Iterator[None]:
    """The form of the texts rendered inside the block: json or markdown."""
    token = _format.set(how)
    try:
        yield
    finally:
        _format.reset(token)

#: The longest text, and what is kept of a longer one.
TEXT_LIMIT = 25_000
TEXT_KEPT = 24_800


def header(level: int, text: str) -> str:
    return f"{'#' * level} {text}"


def meta(**values: object) -> str:
    """A line of the given values, nulls left out."""
    return " · ".join(f"{k}: {v}" for k, v in values.items() if v is not None)


def bold_marks(snippet: str) -> str:
    """Marked matches in bold."""
    return re.sub("</?mark>", "**", snippet)


def limited(text: str) -> tuple[str, str | None]:
    """The text, cut if too long, and the notice that was added."""
    if len(text) <= TEXT_LIMIT:
        return text, None
    notice = f"\n\n[Cut from {len(text)} to {TEXT_KEPT} characters: ask for a later offset, a smaller limit or a narrower scope.]"
    return text[:TEXT_KEPT] + notice, notice


def render(payload: dict, markdown: Callable[[dict], str] | None = None) -> dict:
    """text (markdown by the renderer given or asked for, else JSON) and the payload, stamped if the text was cut."""
    if markdown is None and _format.get() == "markdown":
        markdown = as_markdown
    text, notice = limited(markdown(payload) if markdown else json.dumps(payload, ensure_ascii=False, indent=2, default=str))
    return {"text": text, "data": payload if notice is None else payload | {"truncated": True, "truncation_message": notice}}


def rows(df: DataFrame) -> list[dict]:
    """All rows, for results that belong to one book, page or key."""
    return [r.asDict(recursive=True) for r in df.collect()]


def as_markdown(payload: dict) -> str:
    """Any payload: a line of its single values, a section for each list or part, matches in bold."""
    single = {k: v for k, v in payload.items() if not isinstance(v, (dict, list)) and "\n" not in str(v)}
    out = [meta(**single)] if single else []
    for k, v in payload.items():
        if k in single or v is None:
            continue
        out.append(header(2, k.replace("_", " ")))
        if isinstance(v, dict):
            out.append(meta(**v))
        elif isinstance(v, list):
            out.append(markdown_table(v) if v and isinstance(v[0], dict) else "\n".join(f"- {x}" for x in v) or "_no rows_")
        else:
            out.append(str(v))
    return bold_marks("\n\n".join(out))


def markdown_table(items: list[dict]) -> str:
    if not items:
        return "_no rows_"
    names = list(dict.fromkeys(n for r in items for n in r))
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *["| " + " | ".join(cell(r.get(n)) for n in names) + " |" for r in items]])
