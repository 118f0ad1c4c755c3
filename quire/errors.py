"""Errors a caller can act on: a code, a message, and what helps."""

from __future__ import annotations

#: The codes, and whether trying again may help.
CODES = {
    "BAD_ARG": False, "BOOK_NOT_FOUND": False, "BOOK_NOT_DOWNLOADED": False, "PAGE_NOT_FOUND": False, "TITLE_NOT_FOUND": False, "AUTHOR_NOT_FOUND": False, "CATEGORY_NOT_FOUND": False,
    "AYA_NOT_FOUND": False, "EMPTY_SCOPE": False, "OPTION_NOT_SUPPORTED": False, "OPTION_CONFLICT": False, "SOURCE_NOT_FOUND": False, "SERVICE_KEY_NOT_FOUND": False, "INTERNAL": True,
}


class LibraryError(ValueError):
    def __init__(self, code: str, message: str, details: dict | None = None) -> None:
        if code not in CODES:
            raise ValueError(f"no such code: {code}")
        super().__init__(f"{code}: {message}")
        self.code, self.details, self.retry = code, details or {}, CODES[code]


def empty_scope(diagnostics: list[tuple[str, int]]) -> LibraryError:
    """The error of a scope without books, with the size of each source."""
    return LibraryError("EMPTY_SCOPE", "no book lies in the scope", {"diagnostics": [{"source": s, "contributed": n} for s, n in diagnostics]})
