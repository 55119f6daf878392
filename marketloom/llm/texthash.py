"""Word hashes of many texts at once, in numpy: used inside tasks by the scans over n-grams and shingles."""

from __future__ import annotations

from collections.abc import Iterator

CHUNK = 1 << 18  # bytes of text hashed at a time: what a worker holds is a small multiple of it

_P = 0x9E3779B97F4A7C15  # odd, so powers have inverses modulo 2**64
_INVERSE = pow(_P, -1, 1 << 64)
_held: dict[str, object] = {}


def _powers(size: int):
    """Powers of _P and of its inverse; a longer table replaces a shorter one."""
    import numpy as np

    if not _held or len(_held["up"]) < size:
        for name, base in (("up", _P), ("down", _INVERSE)):
            table = np.full(1 << max(18, size.bit_length()), base, dtype=np.uint64)
            table[0] = 1
            _held[name] = np.multiply.accumulate(table)
    return _held["up"], _held["down"]


def mixed(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def runs(values, starts, ends):
    """Hash of values[start:end] for every pair, independent of the place."""
    import numpy as np

    up, down = _powers(len(values) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def lowered():
    """Byte values plus one, A-Z as a-z."""
    import numpy as np

    table = np.arange(256, dtype=np.uint64) + np.uint64(1)
    table[65:91] += np.uint64(32)
    return table


def word_bounds(texts: list[bytes]):
    """All bytes (texts parted by spaces), and the document number, start and end of every word; words are parted by ``[\\x20\\x09-\\x0D]``."""
    import numpy as np

    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    data = np.frombuffer(b" ".join([b"", *texts, b""]), dtype=np.uint8)
    gap = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return data, np.searchsorted(begins, starts, side="right") - 1, starts, ends


def chunks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, encoded texts) of about CHUNK bytes; a longer text is a chunk of its own."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        blob = text.encode("utf-8", "surrogatepass")
        if held and size + len(blob) > CHUNK:
            yield first, held
            held, size, first = [], 0, i
        held.append(blob)
        size += len(blob)
    if held:
        yield first, held
