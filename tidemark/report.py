"""Reports in text: small results, already aggregated and limited, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def render(title: str, rows: DataFrame, most: int = 25) -> str:
    """A titled table of at most ``most`` rows; the rest is counted."""
    got = rows.limit(most + 1).collect()
    cells = [[str(c) for c in rows.columns], *[["" if v is None else f"{v:.2f}" if isinstance(v, float) else str(v) for v in r] for r in got[:most]]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in cells]
    return "\n".join([title, "=" * len(title), *lines, *(["..."] if len(got) > most else [])])
