"""Edit distance and alignment of two strings with bit-parallel columns.

The columns of the dynamic-programming table are held as bit vectors (Myers 1999, in the form of
Hyyro 2003), as Python integers of any length. Whole texts of 100,000 characters and more stay cheap.
"""

from __future__ import annotations

from collections.abc import Iterator

_BLOCK = 2048  # columns recomputed at a time when an alignment is traced


def _masks(pattern: str) -> dict[str, int]:
    """Per character a bit vector of where it stands in the pattern."""
    backwards = pattern[::-1]
    zeros = dict.fromkeys(map(ord, set(pattern)), "0")
    return {char: int(backwards.translate({**zeros, ord(char): "1"}), 2) for char in set(pattern)}


def _columns(masks: dict[str, int], height: int, text: str, up: int, down: int) -> Iterator[tuple[int, int, int]]:
    """Per text character (up, down, level): where the table rises or falls by one from the row above,
    and where it equals its upper left neighbour."""
    full = (1 << height) - 1
    find = masks.get
    for char in text:
        same = find(char, 0)
        level = (((same & up) + up) ^ up) | same | down
        rise = ((down | (full ^ (full & (level | up)))) << 1) | 1
        fall = (up & level) << 1
        up = (fall | (full ^ (full & (level | rise)))) & full
        down = level & rise & full
        yield up, down, level


def distance(left: str, right: str) -> int:
    """Least number of inserted, deleted and replaced characters between two strings."""
    low, high = 0, min(len(left), len(right))
    while low < high and left[low] == right[low]:
        low += 1
    end = 0
    while end < high - low and left[-1 - end] == right[-1 - end]:
        end += 1
    left, right = left[low : len(left) - end], right[low : len(right) - end]
    if len(left) < len(right):  # few wide columns are cheaper than many narrow ones
        left, right = right, left
    if not right:
        return len(left)
    up, down = (1 << len(left)) - 1, 0
    for up, down, _ in _columns(_masks(left), len(left), right, up, down):  # noqa: B007
        pass
    return len(right) + up.bit_count() - down.bit_count()


def alignment(source: str, target: str) -> list[tuple[str, int, int]]:
    """A shortest edit script as (tag, source position, target position), in order.

    Scripts are not unique. This one is traced from the end and takes, of the steps that are
    shortest, the first of: match, replace, delete, insert.
    """
    height = len(source)
    masks = _masks(source)
    up, down = (1 << height) - 1, 0
    starts = [(up, down)]  # vectors before every block, so that only one block of columns is in memory
    for end in range(_BLOCK, len(target), _BLOCK):
        for up, down, _ in _columns(masks, height, target[end - _BLOCK : end], up, down):  # noqa: B007
            pass
        starts.append((up, down))
    script = []
    row, col, block, columns = height, len(target), None, []
    while row and col:
        if source[row - 1] == target[col - 1]:
            row, col = row - 1, col - 1
            continue
        if (col - 1) // _BLOCK != block:
            block = (col - 1) // _BLOCK
            columns = list(_columns(masks, height, target[block * _BLOCK : (block + 1) * _BLOCK], *starts[block]))
        up, _, level = columns[(col - 1) % _BLOCK]
        if not level >> (row - 1) & 1:
            row, col = row - 1, col - 1
            script.append(("replace", row, col))
        elif up >> (row - 1) & 1:
            row -= 1
            script.append(("delete", row, col))
        else:
            col -= 1
            script.append(("insert", row, col))
    script += [("delete", place, 0) for place in reversed(range(row))]
    script += [("insert", 0, place) for place in reversed(range(col))]
    return script[::-1]
