"""A counting quotient filter: an exact multiset of fingerprints in slots, with three bits of metadata each.

A fingerprint of `quotient_bits + remainder_bits` bits is split: its quotient names its home slot and its remainder is
what is stored. Remainders of one quotient form a run, ascending; a run that finds its home taken begins in the next
free slot, so runs follow one another in the order of their quotients. The bits say of a slot whether it is some
run's home (occupied), whether it goes on with a run (continuation), and whether what it holds stands away from its home
(shifted). From these alone every fingerprint is read back. Counts stand beside the remainders, one byte each;
those that need more are kept in a list of their own.
"""

from __future__ import annotations

import numpy as np

#: What the count byte says of a count that doesn't fit.
_LARGE = 255
_HEADER = np.dtype([("quotient_bits", "<i4"), ("remainder_bits", "<i4"), ("slots", "<i8"), ("large", "<i8")])


class CountingQuotientFilter:
    def __init__(self, quotient_bits: int, remainder_bits: int, slots: int):
        self.quotient_bits, self.remainder_bits = quotient_bits, remainder_bits
        self.remainders = np.zeros(slots, dtype=np.uint64)
        self.counts = np.zeros(slots, dtype=np.uint8)
        self.occupied, self.continuation, self.shifted = (np.zeros(slots, dtype=bool) for _ in range(3))
        self.large: dict[int, int] = {}  # by slot

    # -- filling

    @classmethod
    def of_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From ascending distinct fingerprints of so many bits. The number of slots is a power of two plus what the last runs spill."""
        n = len(fingerprints)
        quotient_bits = min(bits, max(3, int(np.ceil(np.log2(max(n, 1) / 0.9)))))
        low = np.uint64(bits - quotient_bits)
        quotients = (fingerprints >> low).astype(np.int64)
        place = np.arange(n)
        at = place + np.maximum.accumulate(quotients - place) if n else place  # home, or behind what came before
        made = cls(quotient_bits, bits - quotient_bits, max(1 << quotient_bits, int(at[-1]) + 1 if n else 0))
        made.remainders[at] = fingerprints & ((np.uint64(1) << low) - np.uint64(1))
        made.occupied[quotients] = True
        made.continuation[at[1:]] = quotients[1:] == quotients[:-1]
        made.shifted[at] = at != quotients
        made.counts[at] = np.minimum(counts, _LARGE)
        over = np.flatnonzero(counts >= _LARGE)
        made.large = dict(zip(at[over].tolist(), counts[over].tolist(), strict=True))
        return made

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From fingerprints in any order, copies included."""
        distinct, counts = np.unique(fingerprints, return_counts=True)
        return cls.of_sorted(distinct, counts.astype(np.int64), bits)

    # -- reading

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints, counts), ascending: the runs' quotients are the occupied homes, in the same order."""
        used = np.flatnonzero(self.counts)
        run = np.cumsum(~self.continuation[used]) - 1
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64) if len(used) else np.zeros(0, dtype=np.uint64)
        counts = self.counts[used].astype(np.int64)
        for i in np.flatnonzero(counts == _LARGE):
            counts[i] = self.large[int(used[i])]
        return (quotients << np.uint64(self.remainder_bits)) | self.remainders[used], counts

    def count(self, fingerprint: int) -> int:
        """How often one fingerprint was put in: walks to its run by the metadata alone."""
        home, remainder = fingerprint >> self.remainder_bits, fingerprint & ((1 << self.remainder_bits) - 1)
        if home >= len(self.occupied) or not self.occupied[home]:
            return 0
        start = home
        while self.shifted[start]:  # back to where the cluster begins
            start -= 1
        slot = start
        for _ in range(int(np.count_nonzero(self.occupied[start:home]))):  # on by as many runs as homes are before this one
            slot += 1
            while self.continuation[slot]:
                slot += 1
        while True:
            if int(self.remainders[slot]) == remainder:
                return self.large.get(slot, int(self.counts[slot]))
            slot += 1
            if slot == len(self.counts) or not self.continuation[slot]:
                return 0

    # -- merging

    @classmethod
    def merged(cls, filters: list[CountingQuotientFilter], bits: int) -> CountingQuotientFilter:
        """The filter of all inputs together: their sorted remainders are walked side by side and the counts of equal ones add up."""
        streams = [f.items() for f in filters]
        while len(streams) > 1:  # neighbours in pairs, so that each item is walked log(filters) times
            streams = [walked(*streams[i], *streams[i + 1]) if i + 1 < len(streams) else streams[i] for i in range(0, len(streams), 2)]
        none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        return cls.of_sorted(*(streams[0] if streams else none), bits)

    # -- as bytes

    def pack(self) -> bytes:
        """Slots with remainders of whole bytes, as few as they need."""
        slots, width = len(self.counts), -(-self.remainder_bits // 8)
        header = np.array([(self.quotient_bits, self.remainder_bits, slots, len(self.large))], dtype=_HEADER)
        large = np.array([*self.large, *self.large.values()], dtype="<i8")
        flags = np.packbits(np.concatenate([self.occupied, self.continuation, self.shifted]))
        low = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(slots, 8)[:, :width])
        return b"".join(x.tobytes() for x in (header, large, flags, self.counts, low))

    @classmethod
    def unpack(cls, data: bytes) -> CountingQuotientFilter:
        header = np.frombuffer(data, _HEADER, 1)[0]
        slots, n, at = int(header["slots"]), int(header["large"]), _HEADER.itemsize
        made = cls(int(header["quotient_bits"]), int(header["remainder_bits"]), 0)
        large = np.frombuffer(data, "<i8", 2 * n, at).tolist()
        made.large = dict(zip(large[:n], large[n:], strict=True))
        at += 16 * n
        flags = np.unpackbits(np.frombuffer(data, np.uint8, -(-3 * slots // 8), at), count=3 * slots).astype(bool)
        made.occupied, made.continuation, made.shifted = flags[:slots], flags[slots : 2 * slots], flags[2 * slots :]
        at += -(-3 * slots // 8)
        made.counts = np.frombuffer(data, np.uint8, slots, at)
        width = -(-made.remainder_bits // 8)
        wide = np.zeros((slots, 8), dtype=np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, slots * width, at + slots).reshape(slots, width)
        made.remainders = wide.view("<u8").ravel()
        return made


def walked(a: np.ndarray, a_counts: np.ndarray, b: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two ascending streams of distinct items as one, counts of equal items added; nothing is sorted again."""
    at = np.searchsorted(a, b)
    both = np.zeros(len(b), dtype=bool)
    inside = at < len(a)
    both[inside] = a[at[inside]] == b[inside]
    counts = a_counts.copy()
    counts[at[both]] += b_counts[both]
    return np.insert(a, at[~both], b[~both]), np.insert(counts, at[~both], b_counts[~both])
