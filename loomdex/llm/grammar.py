"""Re-Pair grammar compression of token ids, with random-access decoding.

A shard's bytes, little-endian:
  magic "RPG1"; u32: documents, rules, base, bytes per symbol; u64: symbols, tokens
  i64 doc_id, u8 doc_id is null, u32 tokens, u64 end in symbols, per document
  u32 left, u32 right, u32 expansion length, per rule (symbol base + k)
  symbols (u16, or u32 where base + rules need it)
Symbols under base are token ids. No rule's expansion crosses the end of a document, so a document is a range of symbols, and expansion
lengths find the symbol that holds a given token without decoding what stands before it.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

_HEAD = struct.Struct("<4sIIIIQQ")
_SPREAD = {np.dtype(np.uint32): (np.uint32(0x9E3779B1), 32), np.dtype(np.uint64): (np.uint64(0x9E3779B97F4A7C15), 64)}
_SLOTS = 18


def _slot(key: np.ndarray) -> np.ndarray:
    factor, width = _SPREAD[key.dtype]
    return (key * factor) >> key.dtype.type(width - _SLOTS)


def _places(key: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in key of members of chosen, their indices into chosen); of two members with one slot only the later is found."""
    table = np.zeros(1 << _SLOTS, np.int32)
    table[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
    which = table[_slot(key)]
    at = np.flatnonzero(chosen[which] == key)
    return at, which[at]


def compress(ids: np.ndarray, ends: np.ndarray, least: int = 8, rounds: int | None = None, per_round: int = 4096) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base, left, right, expansion lengths, symbols, each document's end in symbols).

    Rounds go on until no pair occurs `least` times any more or symbols run out, unless `rounds` bounds them. Each round counts adjacent pairs,
    takes the most frequent ones that occur `least` times or more, and replaces their occurrences from left to right, where chosen pairs overlap
    the earlier; a pair that keeps fewer than `least`, or shares its slot in the lookup table, waits for the next round. Symbols stay under
    2 ** 16 if the ids leave room; pairs are then counted as 32-bit numbers.

    The shard is a linked list over the ids' places. A pair's number only falls once both its symbols exist, so a round looks at the places that
    still had a frequent pair and at those beside new symbols: the first round reads the whole shard, later ones ever less.
    """
    base = max(1, int(ids.max()) + 1 if len(ids) else 1)
    narrow = base < 1 << 16
    room = (1 << 16) - base if narrow else 1 << 20
    kind, half = (np.uint32, 16) if narrow else (np.uint64, 32)
    low = kind((1 << half) - 1)
    s = ids.astype(kind)
    after = np.arange(1, len(s) + 1, dtype=np.int32)  # the next place, -1 at a document's end
    after[ends[ends > 0] - 1] = -1
    before = np.arange(-1, len(s) - 1, dtype=np.int32)
    before[1:][after[:-1] < 0] = -1
    here = np.ones(len(s), bool)  # whether a place still has a symbol
    place = np.flatnonzero(after >= 0).astype(np.int32)  # places whose pair may be frequent
    left, right, size = [], [], np.ones(base, np.uint32)
    made = 0
    never, alone = np.zeros(0, kind), False  # pairs of one symbol twice that occur too rarely but for their own overlaps; whether a round takes one pair only
    while rounds is None or rounds > 0:
        rounds = None if rounds is None else rounds - 1
        if not len(place) or made >= room:
            break
        key = (s[place] << kind(half)) | s[after[place]]
        order = np.sort(key)
        cut = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]]))
        count = np.diff(np.append(cut, len(order)))
        often = np.flatnonzero(count >= least)
        if len(never):
            often = often[~np.isin(order[cut[often]], never)]
        if not len(often):
            break
        # other places can't come to a frequent pair again; a slot shared with a frequent one keeps some of them, which costs time only
        slots = np.zeros(1 << _SLOTS, bool)
        slots[_slot(order[cut[often]])] = True
        keep = slots[_slot(key)]
        place, key = place[keep], key[keep]
        if alone:  # one of two different symbols does not overlap itself
            value = order[cut[often]]
            often = often[(value >> kind(half)) != (value & low)]
        n = 1 if alone else min(per_round, room - made)
        if len(often) > n:
            often = often[np.argpartition(-count[often], n - 1)[:n]]
        chosen = np.sort(order[cut[often]])
        del order, cut, count
        at, which = _places(key, chosen)
        at = place[at]
        for again in range(2):  # once more without the pairs that overlaps left too rare
            nth = np.arange(len(at), dtype=np.int32)
            fresh = np.concatenate([[True], at[1:] != after[at[:-1]]])
            free = ((nth - np.maximum.accumulate(np.where(fresh, nth, np.int32(0)))) & 1) == 0
            poor = np.bincount(which[free], minlength=len(chosen)) < least
            if again or not poor.any():
                break
            ok = ~poor[which]
            at, which = at[ok], which[ok]
        ok = free & ~poor[which]
        at, which = at[ok], which[ok]
        good = np.flatnonzero(~poor)
        if not len(good):  # pairs overlapped each other: the most frequent goes alone; twice one symbol can only overlap itself
            twice = (chosen >> kind(half)) == (chosen & low)
            alone = not twice.all()
            if not alone:
                found = np.zeros(1 << _SLOTS, np.int32)
                found[_slot(chosen)] = np.arange(len(chosen), dtype=np.int32)
                never = np.concatenate([never, chosen[found[_slot(chosen)] == np.arange(len(chosen))]])
            continue
        alone = False
        rename = np.zeros(len(chosen), kind)
        rename[good] = base + made + np.arange(len(good), dtype=kind)
        a, b = (chosen[good] >> kind(half)).astype(np.uint32), (chosen[good] & low).astype(np.uint32)
        left.append(a)
        right.append(b)
        size = np.concatenate([size, size[a] + size[b]])
        made += len(good)
        s[at] = rename[which]
        gone = after[at]
        here[gone] = False
        then = after[gone]
        after[at] = then
        before[then[then >= 0]] = at[then >= 0]
        place = np.concatenate([place, before[at]])
        place = place[(place >= 0) & here[place] & (after[place] >= 0)]
        if len(place) * 8 > len(s):
            look = np.zeros(len(s), bool)
            look[place] = True
            place = np.flatnonzero(look).astype(np.int32)
        else:
            place.sort()
            place = place[np.diff(place, prepend=-1) > 0]
    s, after = s[here], after[here]
    full = np.diff(np.concatenate([[0], ends])) > 0
    sym_ends = np.zeros(len(ends), np.int64)
    sym_ends[full] = np.flatnonzero(after < 0) + 1
    sym_ends = np.maximum.accumulate(sym_ends) if len(ends) else sym_ends
    none = np.zeros(0, np.uint32)
    return base, np.concatenate([none, *left]), np.concatenate([none, *right]), size[base:], s, sym_ends


def pack_shard(doc_ids: list[int | None], ids: np.ndarray, ends: np.ndarray, **kw) -> bytes:
    base, left, right, size, s, sym_ends = compress(ids, ends, **kw)
    width = 2 if base + len(left) <= 1 << 16 else 4
    n = np.diff(np.concatenate([[0], ends]))
    return b"".join([
        _HEAD.pack(b"RPG1", len(doc_ids), len(left), base, width, len(s), len(ids)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], "u1").tobytes(),
        n.astype("<u4").tobytes(), sym_ends.astype("<u8").tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), size.astype("<u4").tobytes(), s.astype(f"<u{width}").tobytes(),
    ])


@dataclass
class Shard:
    """A shard opened for reading."""

    doc_ids: list[int | None]
    n_tokens: np.ndarray
    sym_ends: np.ndarray
    base: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    symbols: np.ndarray

    @classmethod
    def open(cls, blob: bytes) -> Shard:
        magic, docs, rules, base, width, symbols, _ = _HEAD.unpack_from(blob)
        if magic != b"RPG1":
            raise ValueError("not a grammar shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        own, null = take("<i8", docs), take("u1", docs)
        n, sym = take("<u4", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        left, right, size = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        return cls([None if z else int(x) for x, z in zip(own, null, strict=True)], n, sym, base, left, right, size, take(f"<u{width}", symbols).astype(np.int64))

    def _table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all rules' expansions, where each starts, how long it is), the token ids themselves first."""
        if not hasattr(self, "_flat"):
            long = np.concatenate([np.ones(self.base, np.int64), self.size.astype(np.int64)])
            start = np.concatenate([[0], np.cumsum(long)])[:-1]
            flat = np.empty(int(long.sum()), np.uint32)
            flat[: self.base] = np.arange(self.base)
            done = 0
            while done < len(self.left):  # rules of one round refer only to earlier symbols
                ready = np.maximum(self.left[done:], self.right[done:]) < self.base + done
                stop = done + (len(ready) if ready.all() else int(np.argmin(ready)))
                for half, shift in ((self.left, np.zeros(stop - done, np.int64)), (self.right, long[self.left[done:stop]])):
                    src = half[done:stop].astype(np.int64)
                    n = long[src]
                    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    flat[np.repeat(start[self.base + done : self.base + stop] + shift, n) + step] = flat[np.repeat(start[src], n) + step]
                done = stop
            self._flat = flat, start, long
        return self._flat

    def expand(self, first: int, stop: int) -> np.ndarray:
        """Token ids of symbols first to stop."""
        flat, start, long = self._table()
        s = self.symbols[first:stop]
        n = long[s]
        ends = np.cumsum(n)
        return flat[np.repeat(start[s] - ends + n, n) + np.arange(ends[-1] if len(n) else 0)]

    def document(self, k: int) -> np.ndarray:
        return self.expand(int(self.sym_ends[k - 1]) if k else 0, int(self.sym_ends[k]))

    def tokens(self, k: int, first: int, stop: int) -> np.ndarray:
        """Tokens first to stop of document k; only the symbols that hold them are expanded."""
        a, b = (int(self.sym_ends[k - 1]) if k else 0), int(self.sym_ends[k])
        ends = np.cumsum(self._table()[2][self.symbols[a:b]])
        i, j = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, stop)
        skip = first - (int(ends[i - 1]) if i else 0)
        return self.expand(a + int(i), min(b, a + int(j) + 1))[skip : skip + max(0, stop - first)]
