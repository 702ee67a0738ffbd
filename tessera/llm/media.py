"""Copies of pictures by local descriptors: multiscale corners, orientation-normalised binary tests, a join of
Hamming tables, and geometric consensus.

A picture is eight-bit grey in a binary column: square, or as wide as a width column says; any size, resampled to
64 x 64. Corners are all Harris maxima above a threshold on three scales. A descriptor has 128 bits; each compares
two smoothed pixels of a pattern that is turned by the corner's orientation. Two descriptors match when they differ
in at most ``HAMMING`` bits. A match votes for a change of angle, scale and place; two pictures are copies when at
least ``INLIERS`` corners vote for the same change.

Tables: single descriptors are far from unique, so a table's key is made of a corner and one of its ``NEAREST``
neighbours: ``KEY_BITS`` sampled bits of both, their distance, the direction from one to the other and the
difference of their orientations, the latter three in cells. Entries also carry ``MORE_BITS`` further bits of both.
A hit is a pair of entries of one table with the same key that differ in at most ``NEAR`` further bits. All entries of a key
are compared, so what is found depends on the two pictures alone, not on how many others there are or how they lie.
A key with more than ``CROWD`` entries in a block is split by its further bits: of eight groups of them, entries that near agree
in one whole group at least, so they meet under a group's value, and count in the first that they share. Pairs
with ``HITS`` hits are compared whole: all descriptors, then the consensus. Recall against exhaustive comparison is in the tests.

Equal pictures are one class, by a hash of their bytes, and are searched once.

Scale: one pass describes the pictures, one shuffle deals their corners (about a KB a picture) into blocks of about ``BLOCK``, and every
two blocks meet in one task. It makes the tables of both from their corners, joins them and compares the candidates where they are
found, so that neither entries nor hits nor candidates travel or lie on a disk: what is written grows with the pictures. A task
holds the tables of one block (20 bytes an entry), those of ``SLAB`` pictures of the other, and three bytes for each of a pair's first
``HITS`` hits.
The work has a part that grows with the square of the pictures: each block is read, and its tables made, for every other, and chance
hits of unlike pictures are compared. Longer keys (``KEY_BITS``) and more tables keep these down, larger blocks those.

Defined cases: null, empty or misshapen pictures (fewer than 32 pixels a side, bytes that are no whole rows) and flat
ones have no corners and link with nothing; null ids are left out; an id with several pictures has a row for each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.arrow import as_long, batch, batches_of, bounded, look_up, saved
from tessera.llm.components import components

SIDE = 64
SCALES = (1.0, 0.8, 0.64)
ANGLES = 32
RADIUS = 8
BITS = 128
HAMMING = 18
INLIERS = 7
#: Tables: how many, neighbours of a corner, sampled bits of each corner in the key and beside it, cells of the
#: difference of orientations and of the direction, octaves of a cell of distance.
TABLES, NEAREST, KEY_BITS, MORE_BITS, TURN_CELLS, WAY_CELLS, OCTAVES = 4, 5, 9, 28, 6, 6, 0.7
#: Further bits that may differ in a hit, their groups, and the hits that make a candidate.
NEAR, GROUPS, HITS = 7, 8, 2
#: Entries of a key in a block from which it is split by its further bits.
CROWD = 4096
#: Cells of a consensus that are counted in place.
CELLS = 1 << 20
PICTURES, ENTRIES = 64, 1 << 16
#: Pictures of a block in the mean, pictures that a block meets at once, bits of a picture's place in a list of hits, pairs of
#: entries that are compared at once and hits that are held unpacked; the number of the other block's first picture.
BLOCK, SLAB, PLACE, HELD, OTHER = 8192, 1024, 12, 1 << 20, 1 << 30
#: Blocks that a task brings to its own, at about 10 MB.
OTHERS = 4


@lru_cache(maxsize=1)
def patterns() -> np.ndarray:
    """The tests' pixel pairs for every orientation: (angle, bit, end, y or x)."""
    rng = np.random.default_rng(7)
    pairs = rng.uniform(-RADIUS, RADIUS, (BITS, 2, 2)) * 0.7  # within the radius, whatever the turn
    pairs[:, 1, 1] = pairs[:, 0, 1]  # both ends as far along the orientation: else most bits are the same everywhere
    out = []
    for k in range(ANGLES):
        a = 2 * np.pi * k / ANGLES
        turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        out.append(np.rint(pairs @ turn).astype(np.int64))
    return np.stack(out)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares of side 2 r + 1 (the border repeats)."""
    for axis in (1, 2):
        width = [(0, 0)] * 3
        width[axis] = (r + 1, r)
        sums = np.cumsum(np.pad(x, width, mode="edge"), axis=axis, dtype=np.float32)
        n = x.shape[axis]
        x = np.take(sums, np.arange(2 * r + 1, 2 * r + 1 + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)
    return x


def _resized(x: np.ndarray, side: int) -> np.ndarray:
    """Bilinear samples of a stack of square pictures."""
    n = x.shape[1]
    at = (np.arange(side) + 0.5) * n / side - 0.5
    low = np.clip(np.floor(at).astype(int), 0, n - 2)
    f = np.clip(at - low, 0, 1).astype(np.float32)
    rows = x[:, low] * (1 - f)[None, :, None] + x[:, low + 1] * f[None, :, None]
    return rows[:, :, low] * (1 - f) + rows[:, :, low + 1] * f


def corners(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """picture, y, x of the corners of a stack of pictures."""
    gy, gx = np.zeros_like(x), np.zeros_like(x)
    gy[:, 1:-1] = x[:, 2:] - x[:, :-2]
    gx[:, :, 1:-1] = x[:, :, 2:] - x[:, :, :-2]
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    top = response.copy()
    for axis in (1, 2):
        for d in (1, 2):
            for s in (d, -d):
                np.maximum(top, np.roll(response if axis == 1 else side_top, s, axis=axis), out=top)
        side_top = top.copy()
    edge = RADIUS + 1
    ok = (response >= top) & (response > 1e4)
    ok[:, :edge], ok[:, -edge:], ok[:, :, :edge], ok[:, :, -edge:] = False, False, False, False
    return np.nonzero(ok)


def described(pictures: np.ndarray) -> tuple[np.ndarray, ...]:
    """picture, y, x (pixels of its scale), scale number, angle number, and two 64-bit halves of each corner."""
    out = []
    disc_y, disc_x = np.mgrid[-RADIUS + 1 : RADIUS, -RADIUS + 1 : RADIUS]
    inside = disc_y**2 + disc_x**2 < RADIUS**2
    disc_y, disc_x = disc_y[inside], disc_x[inside]
    for level, scale in enumerate(SCALES):
        side = int(round(SIDE * scale))
        x = pictures.astype(np.float32) if side == SIDE else _resized(pictures.astype(np.float32), side)
        smooth = _box(x, 1)
        k, y, c = corners(smooth / 9)
        if not len(k):
            continue
        patch = smooth[k[:, None], y[:, None] + disc_y, c[:, None] + disc_x]
        angle = np.arctan2((patch * disc_y).sum(axis=1), (patch * disc_x).sum(axis=1))
        turn = np.rint(angle / (2 * np.pi) * ANGLES).astype(int) % ANGLES
        tests = patterns()[turn]
        wide = _box(x, 2)
        ends = wide[k[:, None, None], y[:, None, None] + tests[..., 0], c[:, None, None] + tests[..., 1]]
        bits = np.packbits(ends[:, :, 0] < ends[:, :, 1], axis=1, bitorder="little")
        halves = np.ascontiguousarray(bits).view("<i8")
        out.append((k, y, c, np.full(len(k), level, np.int32), turn.astype(np.int32), halves[:, 0], halves[:, 1]))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_CORNER = np.dtype([("lo", "<u8"), ("hi", "<u8"), ("row", "u1"), ("column", "u1"), ("level", "u1"), ("angle", "u1")])
_CORNERS = pa.schema([("key", pa.int64()), ("corners", pa.binary())])


def shaped(raw: bytes | None, width: int | None) -> np.ndarray | None:
    """A picture's bytes as SIDE x SIDE pixels; None where they are no picture of at least half that side."""
    n = len(raw) if raw is not None else 0
    width = width or int(n**0.5 + 0.5)
    if width < SIDE // 2 or n % width or n // width < SIDE // 2:
        return None
    x = np.frombuffer(raw, np.uint8).reshape(-1, width)
    if x.shape == (SIDE, SIDE):
        return x
    x = x.astype(np.float32)
    for axis in (0, 1):  # means over whole steps first, so that large pictures don't alias
        step = x.shape[axis] // SIDE
        if step > 1:
            x = np.moveaxis(x, axis, 0)
            x = np.moveaxis(x[: len(x) // step * step].reshape(len(x) // step, step, -1).mean(axis=1), 0, axis)
    at = [(np.arange(SIDE) + 0.5) * n_ / SIDE - 0.5 for n_ in x.shape]
    low = [np.clip(np.floor(a).astype(int), 0, n_ - 2) for a, n_ in zip(at, x.shape, strict=True)]
    f, g = (np.clip(a - b, 0, 1).astype(np.float32) for a, b in zip(at, low, strict=True))
    rows = x[low[0]] * (1 - f)[:, None] + x[low[0] + 1] * f[:, None]
    return np.rint(rows[:, low[1]] * (1 - g) + rows[:, low[1] + 1] * g).astype(np.uint8)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The corners of rows (key, picture, width), a row for each picture that has any."""
    for rows in batches:
        for a in range(0, rows.num_rows, PICTURES):
            some = rows.slice(a, PICTURES)
            pixels = [shaped(x, w) for x, w in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)]
            fine = [k for k, x in enumerate(pixels) if x is not None]
            if not fine:
                continue
            k, y, x, level, angle, lo, hi = described(np.stack([pixels[j] for j in fine]))
            out = np.zeros(len(k), _CORNER)
            for name, values in (("lo", lo.view(np.uint64)), ("hi", hi.view(np.uint64)), ("row", y), ("column", x), ("level", level), ("angle", angle)):
                out[name] = values
            out = out[np.argsort(k, kind="stable")]
            ends = np.cumsum(np.bincount(k, minlength=len(fine)))
            keys = np.asarray(some.column(0))[fine]
            kept = [(key, out[b:e].tobytes()) for key, b, e in zip(keys.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True) if e > b]
            if kept:
                yield batch(_CORNERS, *zip(*kept, strict=True))


def neighbours(group: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of corners and their NEAREST of the same group (sorted), each pair once."""
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(starts, len(group)))
    out = [np.zeros((2, 0), np.int64)]
    for n in np.unique(size).tolist():  # groups of a size together
        at = starts[size == n][:, None] + np.arange(n)
        if n < 2:
            continue
        far = (y[at][:, :, None] - y[at][:, None]) ** 2 + (x[at][:, :, None] - x[at][:, None]) ** 2
        far = far.astype(np.int64) * n + np.arange(n)  # of equally far ones the first
        far[:, np.arange(n), np.arange(n)] = np.iinfo(np.int64).max
        near = np.argpartition(far, min(NEAREST, n - 1) - 1, axis=2)[:, :, : min(NEAREST, n - 1)]
        a = np.broadcast_to(at[:, :, None], near.shape).ravel()
        b = at[np.arange(len(at))[:, None, None], near].ravel()
        out.append(np.stack(np.divmod(np.unique(np.minimum(a, b) * len(group) + np.maximum(a, b)), len(group))))
    return tuple(np.concatenate(out, axis=1))


@lru_cache(maxsize=1)
def sampled() -> list[tuple[np.ndarray, np.ndarray]]:
    """Each table's bits (those of the key first) and the shifts of its cells; tests of one pixel with itself are left out."""
    rng = np.random.default_rng(11)
    sound = np.flatnonzero((patterns()[:, :, 0] != patterns()[:, :, 1]).any(axis=2).all(axis=0))
    return [(rng.choice(sound, KEY_BITS + MORE_BITS, replace=False), rng.random(3)) for _ in range(TABLES)]


@lru_cache(maxsize=1)
def _gathering() -> np.ndarray:
    """What bits are multiplied by to give each table's code, and its further bits at every second place, half of them at a time."""
    out, half = np.zeros((BITS, TABLES, 3)), MORE_BITS // 2
    for t, (chosen, _) in enumerate(sampled()):
        out[chosen[:KEY_BITS], t, 0] = 2.0 ** np.arange(KEY_BITS)
        out[chosen[KEY_BITS : KEY_BITS + half], t, 1] = 4.0 ** np.arange(half)
        out[chosen[KEY_BITS + half :], t, 2] = 4.0 ** np.arange(MORE_BITS - half)
    return out.reshape(BITS, -1)


#: Bits of a group of further bits, and those of a bucket that its key leaves.
_GROUP = 2 * MORE_BITS // GROUPS
_PART = 1 + (GROUPS << _GROUP).bit_length() - 1
#: Pictures that lie together: their keys, their corners one after the other, and how many each has.
Side = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Entries of one table, sorted by bucket: their buckets, their further bits, their pictures' numbers. A bucket is a key (part -1), or
#: the value of a group of further bits under a key that is split.
Table = tuple[np.ndarray, np.ndarray, np.ndarray]


def _side(keys: pa.Array, corners: pa.Array) -> Side:
    raw = corners.to_pylist()
    return np.asarray(keys), np.frombuffer(b"".join(raw), _CORNER), np.array([len(r) // _CORNER.itemsize for r in raw], np.int64)


def tables(side: Side, first: int = 0) -> list[Table]:
    """The tables of pictures that are numbered from ``first``; no key is split."""
    _, corners_, size = side
    ends, n, most = np.cumsum(size), 0, NEAREST * len(corners_)
    bucket, further, picture = (np.empty((TABLES, most), kind) for kind in (np.int64, np.int64, np.int32))
    for start in range(0, len(size), 4 * PICTURES):
        stop = min(start + 4 * PICTURES, len(size))
        c = corners_[ends[start] - size[start] : ends[stop - 1]]
        owner = np.repeat(np.arange(start, stop), size[start:stop])
        group = owner * len(SCALES) + c["level"]
        by = np.argsort(group, kind="stable")
        c, owner, group = c[by], owner[by], group[by]
        y, x = c["row"].astype(np.float64), c["column"].astype(np.float64)
        a, b = neighbours(group, y, x)
        if not len(a):
            continue
        bits = np.unpackbits(np.stack([c["lo"], c["hi"]], axis=1).view(np.uint8), axis=1, bitorder="little").astype(np.float64)
        values = (bits @ _gathering()).astype(np.int64).reshape(len(c), TABLES, 3)
        turn, some = c["angle"] / ANGLES, slice(n, n + len(a))
        n += len(a)
        dy, dx = y[b] - y[a], x[b] - x[a]
        far, way, turned = np.log2(np.hypot(dy, dx)) / OCTAVES, np.arctan2(dy, dx) / (2 * np.pi), np.arctan2(-dy, -dx) / (2 * np.pi)
        for t, (_, shift) in enumerate(sampled()):
            code, more = values[:, t, 0], values[:, t, 1] | values[:, t, 2] << MORE_BITS
            swap = code[a] > code[b]  # the corner with the lesser code first
            p, q = np.where(swap, b, a), np.where(swap, a, b)
            cells = (
                np.floor((turn[q] - turn[p]) % 1 * TURN_CELLS + shift[0]) % TURN_CELLS,
                np.floor((np.where(swap, turned, way) - turn[p]) % 1 * WAY_CELLS + shift[1]) % WAY_CELLS,
                np.floor(far + shift[2]),
            )
            entry = (t << KEY_BITS | code[p]) << KEY_BITS | code[q]
            for cell in cells:
                entry = entry << 5 | cell.astype(np.int64)
            bucket[t, some], further[t, some], picture[t, some] = entry << _PART, more[p] | more[q] << 1, owner[p] + first
    for rows in zip(bucket[:, :n], further[:, :n], picture[:, :n], strict=True):
        for x, values in zip(rows, _sorted(*rows), strict=True):
            x[:] = values
    return list(zip(bucket[:, :n], further[:, :n], picture[:, :n], strict=True))


def _sorted(key: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    by = np.argsort(key, kind="stable")
    return key[by], *(x[by] for x in rest)


_HITS = pa.schema([("a_slab", pa.int64()), ("b_slab", pa.int64()), ("hits", pa.binary())])


def split(table: Table, keys: np.ndarray) -> Table:
    """The table with the buckets of the given keys (sorted) in their place."""
    bucket, more, picture = table
    if not len(keys):
        return table
    hot = keys[np.minimum(np.searchsorted(keys, bucket), len(keys) - 1)] == bucket
    rows = [(bucket[~hot], more[~hot], picture[~hot])]
    for g in range(GROUPS):
        part = g << _GROUP | more[hot] >> g * _GROUP & (1 << _GROUP) - 1
        rows.append((bucket[hot] | part + 1, more[hot], picture[hot]))
    return _sorted(*(np.concatenate(x) for x in zip(*rows, strict=True)))


def crowded(table: Table, crowd: int) -> np.ndarray:
    """The keys with more than so many entries."""
    keys, n = np.unique(table[0], return_counts=True)
    return keys[n > crowd]


def _counts(part: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which pairs of entries that differ in these bits count here: in a split key, those that share no group before this one."""
    group = part >> _GROUP
    first = np.ones(len(part), bool)
    for g in range(GROUPS):
        first &= (g >= group) | ((apart >> np.uint64(g * _GROUP)) & np.uint64((1 << _GROUP) - 1) != 0)
    return first


def packed(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of pictures' numbers (a < b), as one sorted list for each two slabs: the steps from one pair's places to the next's,
    all low bytes first. Of equal pairs HITS stay."""
    mask = (1 << PLACE) - 1
    codes = np.sort((a >> PLACE) << 44 | (b >> PLACE) << 2 * PLACE | (a & mask) << PLACE | b & mask)
    new = np.ones(len(codes), bool)
    new[HITS:] = codes[HITS:] != codes[:-HITS]
    codes = codes[new]
    slabs, places = codes >> 2 * PLACE, codes & ((1 << 2 * PLACE) - 1)
    starts = np.flatnonzero(np.append(True, slabs[1:] != slabs[:-1])) if len(codes) else np.zeros(0, np.int64)
    steps = np.diff(places, prepend=0)
    steps[starts] = places[starts]
    steps = steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    lists = [steps[i:j].T.tobytes() for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(codes)], strict=False)]
    if lists:
        yield batch(_HITS, slabs[starts] >> 44 - 2 * PLACE, slabs[starts] & ((1 << 44 - 2 * PLACE) - 1), lists)


def _codes(lists: list[bytes]) -> np.ndarray:
    steps = (np.frombuffer(x, np.uint8).reshape(3, -1).astype(np.int64) for x in lists)
    return np.sort(np.concatenate([np.cumsum(x[0] | x[1] << 8 | x[2] << 16) for x in steps]))


def unpacked(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs that come at least HITS times in lists of two slabs."""
    codes = _codes(lists)
    codes = np.unique(codes[HITS - 1 :][codes[HITS - 1 :] == codes[: max(len(codes) - HITS + 1, 0)]])
    return codes >> PLACE, codes & ((1 << PLACE) - 1)


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of pictures with entries of a bucket that are near each other, once for each such two entries, packed. Rows
    (entry, part, more, picture) come sorted by bucket."""

    def buckets():
        held, size = [], 0
        for rows in chain(batches, [None]):
            if rows is not None:
                held.append(np.stack([np.asarray(c).astype(np.int64) for c in rows.columns]))
                size += rows.num_rows
                if size < ENTRIES:
                    continue
            whole = np.concatenate(held, axis=1) if held else np.zeros((4, 0), np.int64)
            same = (whole[0] == whole[0, -1]) & (whole[1] == whole[1, -1]) if size else np.zeros(0, bool)
            end = size if rows is None else int(size - np.argmin(same[::-1])) if not same.all() else 0
            if end:  # the last bucket may go on in the next batch
                yield whole[:, :end]
                held, size = [whole[:, end:]], size - end

    found, n = [], 0
    for entry, part, more, picture in buckets():
        bits = more.view(np.uint64)
        at, step = np.arange(len(picture)), 0
        while len(at):
            step += 1
            at = at[at + step < len(picture)]
            at = at[(entry[at] == entry[at + step]) & (part[at] == part[at + step])]
            apart = bits[at] ^ bits[at + step]
            ok = (np.bitwise_count(apart) <= NEAR) & (picture[at] != picture[at + step])
            mine, apart = at[ok], apart[ok]
            first = _counts(part[mine], apart)
            mine = mine[first]
            found.append(np.stack([np.minimum(picture[mine], picture[mine + step]), np.maximum(picture[mine], picture[mine + step])]))
            n += len(mine)
            if n >= HELD:
                yield from packed(*np.concatenate(found, axis=1))
                found, n = [], 0
    if n:
        yield from packed(*np.concatenate(found, axis=1))


def _within(table: Table) -> Iterator[pa.RecordBatch]:
    """The hits within a table, packed."""
    bucket, more, picture = table
    some = (slice(k, k + ENTRIES) for k in range(0, len(bucket), ENTRIES))
    yield from _hits(pa.record_batch([pa.array(x) for x in (bucket[k] >> _PART, (bucket[k] & (1 << _PART) - 1) - 1, more[k], picture[k])], ["entry", "part", "more", "picture"]) for k in some)


def _meeting(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (k, j) with low[k] <= j < high[k], at most HELD at once."""
    n = high - low
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, HELD):
        pair = np.arange(at, min(at + HELD, total))
        first, last = np.searchsorted(ends, [pair[0], pair[-1]], "right")
        some = slice(first, last + 1)
        k = np.repeat(np.arange(first, last + 1), np.minimum(ends[some], pair[-1] + 1) - np.maximum(ends[some] - n[some], at))
        yield k, low[k] + pair - (ends[k] - n[k])


def _between(held: Table, asked: Table) -> Iterator[pa.RecordBatch]:
    """The hits of two tables, packed; the pictures of the first have the lesser numbers. Keys are split as they are there."""
    bucket, more, picture = held
    whole = np.unique(bucket[bucket & (1 << _PART) - 1 > 0] >> _PART << _PART)
    buckets, mores, pictures = split(asked, whole)
    found, n = [], 0
    for k, j in _meeting(np.searchsorted(bucket, buckets, "left"), np.searchsorted(bucket, buckets, "right")):
        apart = (mores[k] ^ more[j]).view(np.uint64)
        ok = np.bitwise_count(apart) <= NEAR
        k, j, apart = k[ok], j[ok], apart[ok]
        if len(whole):
            ok = _counts((buckets[k] & (1 << _PART) - 1) - 1, apart)
            k, j = k[ok], j[ok]
        found.append(np.stack([picture[j], pictures[k]]).astype(np.int64))
        n += len(k)
        if n >= HELD:
            yield from packed(*np.concatenate(found, axis=1))
            found, n = [], 0
    if n:
        yield from packed(*np.concatenate(found, axis=1))


def candidates(hits: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the pictures of the pairs with HITS hits. Of longer lists only HITS of equal pairs are held."""
    lists: dict[tuple[int, int], list[bytes]] = {}
    for rows in hits:
        for x, y, raw in zip(*rows.to_pydict().values(), strict=True):
            own = lists.setdefault((x, y), [])
            own.append(raw)
            if len(own) > 8 and sum(map(len, own)) > 12 * HELD:
                codes = _codes(own)
                own[:] = [r for b in packed(x << PLACE | codes >> PLACE, y << PLACE | codes & (1 << PLACE) - 1) for r in b.column(2).to_pylist()]
    found = [np.zeros((2, 0), np.int64)]
    for (x, y), raws in lists.items():
        a, b = unpacked(raws)
        found.append(np.stack([x << PLACE | a, y << PLACE | b]))
    return tuple(np.concatenate(found, axis=1))


def matching(left: Side, right: Side, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of pairs (picture a of the left side, b of the right), some at a time: numbers of pairs, and of all their corners
    those that differ in at most HAMMING bits."""
    starts = [np.cumsum(size) - size for _, _, size in (left, right)]
    halves = [[np.ascontiguousarray(corners_[half]) for half in ("lo", "hi")] for _, corners_, _ in (left, right)]
    by = np.argsort(b, kind="stable")  # all pictures that a right one meets are compared with it together, a few at a time
    first = np.flatnonzero(np.append(True, b[by][1:] != b[by][:-1])) if len(by) else np.zeros(0, np.int64)
    cuts = [k for x, y in zip(first.tolist(), [*first[1:].tolist(), len(by)], strict=False) for k in range(x, y, PICTURES)]
    found, n = [np.zeros((3, 0), np.int64)], 0
    for x, y in zip(cuts, [*cuts[1:], len(by)], strict=False):
        pair, own = by[x:y], b[by[x]]
        size = left[2][a[pair]]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(starts[0][a[pair]] - (ends - size), size)
        own = slice(starts[1][own], starts[1][own] + right[2][own])
        apart = np.bitwise_count(halves[0][0][at] ^ halves[1][0][own, None])
        apart += np.bitwise_count(halves[0][1][at] ^ halves[1][1][own, None])
        j, i = np.divmod(np.flatnonzero(apart <= HAMMING), len(at))
        found.append(np.stack([np.repeat(pair, size)[i], at[i], own.start + j]))
        n += len(pair) + len(i)
        if n >= HELD // 4:
            yield tuple(np.concatenate(found, axis=1))
            found, n = found[:1], 0
    yield tuple(np.concatenate(found, axis=1))


def _crowded(*cell: np.ndarray) -> np.ndarray:
    """Which rows share their cell with enough others for a consensus. Few possible cells are counted without a sort."""
    if not len(cell[0]):
        return np.zeros(0, bool)
    key, size = np.zeros(len(cell[0]), np.int64), 1
    for c in cell:
        low = int(c.min())
        width = int(c.max()) - low + 1
        if size * width > CELLS:  # only what occurs is numbered
            values, key = np.unique(key, return_inverse=True)
            size = len(values)
        key, size = key * width + (c - low), size * width
    if size > CELLS:
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        return n[at] >= INLIERS
    return np.bincount(key)[key] >= INLIERS


def _zooms(q: np.ndarray, m: np.ndarray, qi: np.ndarray, mi: np.ndarray) -> np.ndarray:
    """The cell of zoom of matches, of the same size with the pictures changed round."""
    scale = np.array(SCALES)
    return np.rint(np.log(scale[:, None] / scale) / 0.2231 / 2).astype(np.int64)[q["level"][qi], m["level"][mi]]


def consensus(q: np.ndarray, m: np.ndarray, qi: np.ndarray, mi: np.ndarray, pair: np.ndarray) -> dict[int, tuple[int, float, int]]:
    """(inliers, zoom, turn) of the best consensus of the matches (corner qi of q with mi of m), for the numbered pairs
    of pictures that have one."""
    scale = np.array(SCALES)
    zoom = scale[q["level"][qi]] / scale[m["level"][mi]]
    c_zoom = _zooms(q, m, qi, mi)
    turn = (m["angle"][mi].astype(np.int64) - q["angle"][qi].astype(np.int64)) % ANGLES
    a = turn * (2 * np.pi / ANGLES)
    place = lambda c, at, axis: (c[axis][at] / scale[c["level"][at]]).astype(np.float32).astype(float)
    q_x, q_y = place(q, qi, "column"), place(q, qi, "row")
    dx = place(m, mi, "column") - zoom * (np.cos(a) * q_x - np.sin(a) * q_y)
    dy = place(m, mi, "row") - zoom * (np.sin(a) * q_x + np.cos(a) * q_y)
    # a consensus lies in one cell of zoom, turn and shift, of cells that overlap by half: matches with too few
    # others in their cell of zoom and turn cannot be in one and drop out before the finer cells are made
    best: dict[int, tuple[int, float, int]] = {}
    for s_turn in (0.0, 0.5):
        c_turn = np.floor((turn / 4 + s_turn) % (ANGLES / 4)).astype(np.int64)
        some = np.flatnonzero(_crowded(pair, c_zoom, c_turn))
        c_turn = c_turn[some]
        for s_x in (0.0, 0.5):
            for s_y in (0.0, 0.5):
                c_x, c_y = np.floor(dx[some] / 14 + s_x).astype(np.int64), np.floor(dy[some] / 14 + s_y).astype(np.int64)
                ok = _crowded(pair[some], c_zoom[some], c_turn, c_x, c_y)
                votes: dict[tuple, list[int]] = {}
                for k, *cell in zip(some[ok].tolist(), pair[some][ok].tolist(), c_zoom[some][ok].tolist(), c_turn[ok].tolist(), c_x[ok].tolist(), c_y[ok].tolist(), strict=True):
                    votes.setdefault(tuple(cell), []).append(k)
                for rows in votes.values():
                    inliers = len(set(qi[rows].tolist()))
                    if inliers >= INLIERS:
                        own, found = int(pair[rows[0]]), (inliers, round(float(zoom[rows].mean()), 12), int(turn[rows].min()))
                        best[own] = max(best.get(own, found), found)
    return best


_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("inliers", pa.int64()), ("zoom", pa.float64()), ("turn", pa.int64())])
FOUND = "a long, b long, inliers long, zoom double, turn long"


def _copies(left: Side, right: Side, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The copies among pairs (picture a of the left side, b of the right), in both directions."""
    (keys, q, _), (others, m, _) = left, right
    for pair, qi, mi in matching(left, right, a, b):
        ok = _crowded(pair, _zooms(q, m, qi, mi))
        pair, qi, mi = pair[ok], qi[ok], mi[ok]
        for best, x, y in ((consensus(q, m, qi, mi, pair), keys[a], others[b]), (consensus(m, q, mi, qi, pair), others[b], keys[a])):
            if best:
                at = list(best)
                yield batch(_FOUND, x[at], y[at], *zip(*best.values(), strict=True))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The copies among given pairs (a, b, corners of a, corners of b), in both directions."""
    for rows in batches:
        at = np.arange(rows.num_rows)
        yield from _copies(_side(rows.column(0), rows.column(2)), _side(rows.column(1), rows.column(3)), at, at)


def compared(crowd: int):
    """(block, its pictures, other block, its pictures) to the copies among the pictures of the two blocks, in both directions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for rows in batches:
            for k, (one, other) in enumerate(zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                if one != block:  # the same as before for the most part
                    block, left = one, _side(*rows.column(1)[k].values.flatten())
                    held = [split(x, crowded(x, crowd)) for x in tables(left)]
                if one == other:
                    yield from _copies(left, left, *candidates(b for x in held for b in _within(x)))
                    continue
                keys, corners_, size = _side(*rows.column(3)[k].values.flatten())
                ends = np.cumsum(size)
                for start in range(0, len(keys), SLAB):
                    some = slice(start, start + SLAB)
                    right = keys[some], corners_[ends[start] - size[start] : ends[some][-1]], size[some]
                    a, b = candidates(x for pair in zip(held, tables(right, OTHER), strict=True) for x in _between(*pair))
                    yield from _copies(left, right, a, b - OTHER)

    return run


def _linked(pictures: DataFrame, id_column: str, media_column: str, width_column: str | None) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every picture with an id, key a hash of its bytes; and the copies (a, b, inliers, zoom, turn) of keys."""
    width = F.col(f"`{width_column}`").cast("int") if width_column else F.lit(None).cast("int")
    media = bounded(pictures).select(as_long(pictures, id_column).alias("id"), F.col(f"`{media_column}`").alias("picture"), width.alias("width")).where("id is not null")
    media = media.withColumn("key", F.when(F.col("picture").isNotNull(), F.xxhash64("picture", "width")))
    keyed = saved(media.select("id", "key"), "pictures")
    described_ = media.where("key is not null").select("key", "picture", "width").mapInArrow(_describe, "key long, corners binary").dropDuplicates(["key"])
    n = -(-keyed.where("key is not null").select(F.approx_count_distinct("key")).first()[0] // BLOCK) or 1
    block = F.pmod("key", F.lit(n)).alias("block")
    blocks = saved(described_.groupBy(block).agg(F.collect_list(F.struct("key", "corners")).alias("pictures")), "blocks")
    one, other = (blocks.select(F.col("block").alias(name), F.col("pictures").alias(f"{name}_pictures")) for name in ("one", "other"))
    # each two blocks once; which of them leads alternates, so that no task has all its blocks' pairs and another none; a
    # leading block's tables are made once for the others of a task
    met = one.join(other.coalesce(-(-n // OTHERS)), F.expr("one = other or (one < other) = ((one + other) % 2 = 1)"))
    with batches_of(keyed.sparkSession, 1):  # two blocks have about 20 MB
        return keyed, saved(met.select("one", "one_pictures", "other", "other_pictures").mapInArrow(compared(CROWD), FOUND), "copies")


def copies(pictures: DataFrame, queries: str = "true", id_column: str = "id", media_column: str = "picture", width_column: str | None = None) -> DataFrame:
    """(query_id, match_id, members, inliers, turn, zoom): for every picture that satisfies ``queries`` (a condition on
    id), the classes of equal pictures that are copies of it, its own class left out. ``match_id`` is a class's least
    id, ``turn`` in degrees and ``zoom`` as a factor are those of the consensus."""
    keyed, found = _linked(pictures, id_column, media_column, width_column)
    asked = keyed.where(queries).select(F.col("id").alias("query_id"), F.col("key").alias("a"))
    leads = keyed.groupBy(F.col("key").alias("b")).agg(F.min("id").alias("match_id"), F.count("*").alias("members"))
    return asked.join(found, "a").join(leads, "b").select("query_id", "match_id", "members", "inliers", (F.col("turn") * (360.0 / ANGLES)).alias("turn"), "zoom")


def joined(pictures: DataFrame, id_column: str = "id", media_column: str = "picture", width_column: str | None = None) -> DataFrame:
    """(id, class_id, equal_id, members, n_links): every picture with its class, the least id that copies of copies reach;
    the least id of equal pictures and how many they are; and how many other pictures, equal ones once, are its copies."""
    keyed, found = _linked(pictures, id_column, media_column, width_column)
    own = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("equal_id"), F.count("*").alias("members"))
    own = own.join(components(found.select("a", "b")).withColumnRenamed("id", "key"), "key", "left")
    own = own.join(found.groupBy(F.col("a").alias("key")).agg(F.countDistinct("b").alias("n_links")), "key", "left")
    own = saved(own.withColumn("component", F.coalesce("component", "key")), "classes")
    groups = own.groupBy("component").agg(F.min("equal_id").alias("class_id"), F.count("*").alias("n"))
    own = saved(look_up(own, groups, ["component"], "n").drop("n"), "classes")
    out = look_up(keyed, own, ["key"], "members", "left")
    return out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("equal_id", "id").alias("equal_id"), F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def draw(scene: int, variant: int, vector: np.ndarray) -> np.ndarray:
    """A picture for a row of ``embeddings``: a scene of clouds and rectangles, by variant as it is, cropped and enlarged,
    or turned by a quarter and brightened, with a faint texture of the row's vector."""
    rng = np.random.default_rng(scene)
    big = 70 + _resized(rng.random((1, 22, 22), np.float32) * 120, 80)[0]
    y, x, h, w, v = rng.integers(0, 72, 10), rng.integers(0, 72, 10), rng.integers(3, 14, 10), rng.integers(3, 14, 10), rng.integers(10, 240, 10)
    for k in range(10):
        big[y[k] : y[k] + h[k], x[k] : x[k] + w[k]] = v[k]
    out = big[8:72, 8:72]
    if variant == 1:
        out = _resized(big[None, 12:63, 14:65], SIDE)[0]
    elif variant == 2:
        out = np.rot90(out) * 0.85 + 25
    texture = np.outer(vector[:SIDE], np.roll(vector[:SIDE], 7)) * 40 if len(vector) >= SIDE else 0
    return np.clip(out + texture, 0, 255).astype(np.uint8)


_DRAWN = pa.schema([("id", pa.int64()), ("picture", pa.binary())])


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for a in range(0, rows.num_rows, 512):
            some = rows.slice(a, 512)
            ids, vectors = some.column(0).to_pylist(), some.column(1).to_pylist()
            # of four ids in a row the first three show one scene, the fourth its own
            scenes = [(i // 4 if i % 4 < 3 else (1 << 40) + i, i % 4 % 3) if i is not None else (0, 0) for i in ids]
            yield batch(_DRAWN, ids, [draw(s, v, np.array(x if x is not None else (), np.float32)).tobytes() for (s, v), x in zip(scenes, vectors, strict=True)])


def drawn(embeddings: DataFrame) -> DataFrame:
    """(id, picture): the tables hold no pictures, so each vector gets one."""
    return bounded(embeddings).select(as_long(embeddings, "vec_id").alias("id"), "embedding").mapInArrow(_draw, "id long, picture binary")
