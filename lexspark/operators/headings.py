"""Where a block stands under headings: shared by chunking and clause comparison."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, groupby


def level_of(block: dict) -> int:
    """A heading's level; 3 where it has none."""
    return int(block.get("level") or 3)


def under_headings(blocks: Iterable[dict], name) -> Iterator[tuple[dict | None, dict[int, str], list[dict]]]:
    """Sections: the heading that opens one (None before the first), the names by level of the headings it stands under,
    its own last, and the blocks up to the next heading. A heading ends all of its level and deeper."""
    blocks = list(blocks)
    number = accumulate(b["type"] == "heading" for b in blocks)
    above: dict[int, str] = {}
    for _, own in groupby(zip(number, blocks, strict=True), key=lambda x: x[0]):
        section = [b for _, b in own]
        head = section[0] if section[0]["type"] == "heading" else None
        if head:
            level = level_of(head)
            above = {k: v for k, v in above.items() if k < level} | {level: name(head)}
        yield head, above, section[1:] if head else section
