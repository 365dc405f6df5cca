"""Shingle sets and PartEnum signatures of many texts at once, in numpy.

Link rule: 100 * |x & y| >= least * |x | y|.  With d = |x ^ y| this is d <= k for
k = floor((100 - least) * (|x| + |y|) / (100 + least)), and needs 100 * min >= least * max of the
sizes.  Sizes fall into bands; one instance covers the pairs inside a band, another those across
each border.  An instance has one k, the largest of its pairs, and partitions the feature domain
into more than k parts, so linked sets agree on some part: the elements in it are the signature.
"""

from __future__ import annotations

import numpy as np

LEAST = 85
WORDS = 4
SEEDS = 6
_CHUNK = 1 << 20
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _STEP)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < size:
        table = np.full(max(size, _CHUNK + 1), _U(base))
        table[0] = 1
        have = _powers[base] = np.cumprod(table, dtype=np.uint64)
    return have


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of ``raw``, where bytes of white space separate words."""
    b = _FOLDED[np.frombuffer(raw, np.uint8)]
    inside = ~_SPACE[b]
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    values = np.where(inside, _BYTES[b], _U(0)) * _power_table(_BASE, len(b))[: len(b)]
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    sums = (running[ends] - running[starts]) * _power_table(_BACK, len(b) + 1)[starts]
    return mix(sums + (ends - starts).astype(np.uint64) * _STEP), starts


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles of ``words`` words; none for a text without words."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for text in [*texts, None]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if part and (size + len(raw) > _CHUNK or len(out) + len(part) == len(texts)):
            out += _sets(part, words)
            part, size = [], 0
        part.append(raw + b" ")
        size += len(raw) + 1
    return out


def _sets(part: list[bytes], words: int) -> list[np.ndarray]:
    places = mix(np.arange(11, 11 + words, dtype=np.uint64) * _STEP) | _U(1)
    hashes, starts = _word_hashes(b"".join(part))
    borders = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(p) for p in part])]))
    found = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        w = hashes[a:b]
        n = len(w)
        if n == 0:
            found.append(np.zeros(0, np.uint64))
        elif n < words:
            found.append(mix((w * places[:n]).sum(dtype=np.uint64)[None] + _U(n)))
        else:
            s = sum(w[i : n - words + 1 + i] * places[i] for i in range(words))
            found.append(np.unique(mix(s)))
    return found


def set_key(elements: np.ndarray) -> bytes:
    """A 128-bit key that equal sets share."""
    a = mix(elements + _STEP).sum(dtype=np.uint64)
    b = mix(elements * _STEP + _U(len(elements))).sum(dtype=np.uint64)
    return np.array([a, b], np.uint64).tobytes()


LEAST_CELLS = 512


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """A bit per cell and set: the parity of the set's elements in that cell, for 2 to 4 cells per element.

    An element that only one of two sets has changes one bit, so sketches never differ in more
    bits than the sets do in elements.  The number of cells is a power of two, so halves of a sketch fold
    to the sketch of half as many cells.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    cells = np.array([max(LEAST_CELLS, 1 << (2 * n - 1).bit_length()) if n else LEAST_CELLS for n in sizes.tolist()], np.int64)
    ends = np.cumsum(cells)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    place = (flat & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(ends - cells, sizes)
    counts = np.bincount(place, minlength=int(cells.sum()))
    raw = np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()
    return [raw[(e - c) // 8 : e // 8] for c, e in zip(cells.tolist(), ends.tolist())]


def _stacked(held: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to ``width`` bytes."""
    out = np.zeros((len(held), width // 8), np.uint64)
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    for size in np.unique(sizes).tolist():
        at = np.nonzero(sizes == size)[0]
        rows = np.frombuffer(b"".join([held[i] for i in at.tolist()]), np.uint64).reshape(len(at), size // 8)
        while rows.shape[1] > width // 8:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[at] = rows
    return out


def _few(apart: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    fits = 100 * np.minimum(a, b) >= least * np.maximum(a, b)
    return fits & (apart <= (100 - least) * (a + b) // (100 + least))


def may_link(a: list[bytes | None], size_a: np.ndarray, b: list[bytes | None], size_b: np.ndarray, least: int) -> np.ndarray:
    """Matrix of the pairs of sets that their sketches and sizes do not rule out; without a sketch nothing is."""
    open_a, open_b = (np.array([s is None for s in side], bool) for side in (a, b))
    width = min((len(s) for s in [*a, *b] if s is not None), default=8)
    blank = bytes(width)
    x, y = (_stacked([blank if s is None else s for s in side], width) for side in (a, b))
    apart = np.zeros((len(a), len(b)), np.int64)
    for word in range(width // 8):
        apart += np.bitwise_count(x[:, word, None] ^ y[None, :, word])
    return _few(apart, size_a[:, None], size_b[None, :], least) | open_a[:, None] | open_b[None, :]


def pairs_may_link(a: list[bytes | None], size_a: np.ndarray, b: list[bytes | None], size_b: np.ndarray, least: int) -> np.ndarray:
    """``may_link`` of each element of ``a`` with the one at its place in ``b``."""
    width = np.array([0 if x is None or y is None else min(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    near = width == 0
    for w in np.unique(width[width > 0]).tolist():
        at = np.nonzero(width == w)[0].tolist()
        x, y = _stacked([a[i] for i in at], w), _stacked([b[i] for i in at], w)
        near[at] = _few(np.bitwise_count(x ^ y).sum(1, dtype=np.int64), size_a[at], size_b[at], least)
    return near


def bands(largest: int, least: int = LEAST) -> np.ndarray:
    """Upper ends of the size bands up to ``largest``: each about (100 / least) ** 2 times the last."""
    ends = [1]
    while ends[-1] < largest:
        ends.append(max(ends[-1] + 1, ends[-1] * 10_000 // (least * least)))
    return np.array(ends, np.int64)


def most_different(a: int, b: int, least: int = LEAST) -> int:
    return (100 - least) * (a + b) // (100 + least)


def instances(size: int, ends: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(number, k) of the instances that a set of ``size`` takes part in; those with k = 0 link only equal sets."""
    band = int(np.searchsorted(ends, size))
    found = [(2 * band, most_different(int(ends[band]), int(ends[band]), least))]
    for border in (band - 1, band):  # the band's lower and upper border
        if border < 0:
            continue
        end = int(ends[border])
        partner = end * 100 // least  # the largest set that can link across with one of ``end``
        if partner <= end:
            continue
        if band == border and 100 * size >= least * (end + 1) or band == border + 1 and size <= partner:
            found.append((2 * border + 1, most_different(end, partner, least)))
    return [(number, k) for number, k in found if k > 0]


def _part_sums(sets: list[np.ndarray], parts: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(set, part, sum of mixed elements, count) of every part that is not empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    e = np.concatenate(sets) if seed == 0 else mix(np.concatenate(sets) + mix(np.array([seed], np.uint64)))
    part = ((e >> _U(32)) * np.repeat(parts, sizes).astype(np.uint64) >> _U(32)).astype(np.int64)
    if seed:
        order = np.lexsort((part, owner))
        owner, part, e = owner[order], part[order], e[order]
    new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(part) != 0)])
    at = np.nonzero(new)[0]
    sums = np.add.reduceat(mix(e ^ _STEP), at)
    return owner[at], part[at], sums, np.diff(np.concatenate([at, [len(e)]]))


def signatures(sets: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of all sets, in any order: ``sided_signatures`` without the sides."""
    return sided_signatures(sets, least)[:2]


INSIDE, BELOW, ABOVE = 0, 1, 2  # an instance of a band, or the set's side of the border that an instance is for


def sided_signatures(sets: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, side) of all sets, in any order.

    Of k + 1 + spare parts linked sets agree on spare + 1 at least, so where one of the two has at
    most ``spare`` empty parts they share a part that is not empty.  A set with more empty parts
    also signs under the next seed; under the last seed its empty parts sign too.
    """
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends = bands(max(map(len, sets)), least)
    work = [(i, number, k) for i, s in enumerate(sets) if len(s) for number, k in instances(len(s), ends, least)]
    owners, found, sides = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for seed in range(SEEDS):
        if not work:
            break
        index = np.array([w[0] for w in work])
        number = np.array([w[1] for w in work], np.uint64)
        k = np.array([w[2] for w in work])
        spare = 2 + k // 50
        parts = k + 1 + spare
        which, part, sums, counts = _part_sums([sets[i] for i in index.tolist()], parts, seed)
        salt = mix(number * _U(SEEDS) + _U(seed + 1))
        held = np.bincount(which, minlength=len(work))
        if seed == SEEDS - 1:
            for j in np.nonzero(parts - held > spare)[0].tolist():
                gone = np.setdiff1d(np.arange(parts[j]), part[which == j])
                which, part = np.concatenate([which, np.full(len(gone), j)]), np.concatenate([part, gone])
                sums = np.concatenate([sums, np.zeros(len(gone), np.uint64)])
                counts = np.concatenate([counts, np.zeros(len(gone), np.int64)])
        found.append(mix(sums + salt[which] + mix(part.astype(np.uint64) * _STEP + counts.astype(np.uint64))))
        owners.append(index[which])
        border = np.where([len(sets[i]) <= ends[n // 2] for i, n, _ in work], BELOW, ABOVE)
        sides.append(np.where(number % _U(2) == 1, border, INSIDE)[which])
        work = [work[j] for j in np.nonzero(parts - held > spare)[0].tolist()]
    return np.concatenate(owners), np.concatenate(found), np.concatenate(sides)


def cut_by_size(signature: np.ndarray, sizes: np.ndarray, sides: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, group): holders of signatures cut where their sizes leave a gap that no link spans.

    Two holders link only where 100 * min >= least * max of their sizes, and through the instance of a border only from
    one side of it to the other: one side alone has no link there, and a holder must reach the other side's nearest.
    Holders that are left alone go.  No pair that could link through the signature is parted.
    """
    order = np.lexsort((sizes, signature))
    while True:
        s, n, side = signature[order], sizes[order], sides[order]
        new = np.ones(len(order), bool)
        new[1:] = (s[1:] != s[:-1]) | (100 * n[:-1] < least * n[1:])
        group = np.cumsum(new) - 1
        if not len(order):
            return order, group
        at = np.nonzero(new)[0]
        several = np.diff([*at.tolist(), len(order)]) > 1
        plain = np.maximum.reduceat(side == INSIDE, at)  # then borders bind nobody: two instances met by chance
        low = np.maximum.reduceat(np.where(side == BELOW, n, 0), at)
        high = np.minimum.reduceat(np.where(side == ABOVE, n, np.iinfo(np.int64).max // 200), at)
        reach = np.where(side == BELOW, 100 * n >= least * high[group], least * n <= 100 * low[group])
        stay = several[group] & (plain[group] | reach)
        if stay.all():
            return order, group
        order = order[stay]


def common_counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``.

    Only elements that occur in both lists become columns of 0/1 matrices, multiplied in strips.
    """
    total = np.zeros((len(a), len(b)), np.float32)
    ea, eb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(ea, eb)
    sides = []
    for sets, e in ((a, ea), (b, eb)):
        at = np.searchsorted(shared, e)
        at[at == len(shared)] = 0
        kept = shared[at] == e if len(shared) else np.zeros(len(e), bool)
        sides.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[kept], at[kept]))
    for start in range(0, len(shared), columns):
        strips = []
        for sets, (row, column) in zip((a, b), sides):
            here = (column >= start) & (column < start + columns)
            strip = np.zeros((len(sets), min(columns, len(shared) - start)), np.float32)
            strip[row[here], column[here] - start] = 1
            strips.append(strip)
        total += strips[0] @ strips[1].T
    return np.rint(total).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """The link rule for two sorted sets."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(len(a) and len(b)) and 100 * common >= least * (len(a) + len(b) - common)
