from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from splitboard.session import session

    s = session("4", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__driver__memory="3g")
    yield s
    s.stop()


def xlsx(sheets: dict) -> bytes:
    """A small file of sheets {name: (headings, rows)}, for readers."""
    import io

    from splitboard.sinks.books import Book

    out = io.BytesIO()
    book = Book(out, {}, {})
    for name, (head, rows) in sheets.items():
        book.begin(name)
        for row in (head, *rows):
            book.row([None if v is None else str(v) for v in row], None)
    book.close()
    return out.getvalue()


@pytest.fixture(scope="session")
def workbook():
    return xlsx
