"""Words of whole texts, counted inside tasks before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text cut into words at once.
SLICE_BYTES = 1 << 20

#: Counted entries a task holds before it hands them on; counts of one key then simply add up.
HELD = 400_000


def letters_table(non_ascii_from: int) -> bytes:
    """Table for bytes.translate: a-z and bytes from non_ascii_from stay, A-Z are lower-cased, all else becomes a space."""
    return bytes(b if 97 <= b <= 122 or b >= non_ascii_from else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def word_lists(data: bytes, table: bytes) -> Iterator[list[bytes]]:
    """Words of data in lists of about a slice; a word is never cut."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            end = next((i for i in range(end, len(data)) if table[data[i]] == 32), len(data))
        yield data[at:end].translate(table).split()
        at = end
