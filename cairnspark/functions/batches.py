"""Output of Python tasks in frames of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

#: Rows and characters of a frame.
ROWS, CHARS = 20_000, 4_000_000


def in_frames(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """``rows``, which may come lazily, as frames; nothing more than one of them is held."""
    held: list[tuple] = []
    chars = 0
    for r in rows:
        held.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= ROWS or chars >= CHARS:
            yield pd.DataFrame(held, columns=columns)
            held, chars = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)
