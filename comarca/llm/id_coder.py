"""Token ids in binary files: an adaptive range coder that mixes the predictions of three contexts.

A block of ids is coded on its own: its model starts empty, and it carries checksums of its coded bytes
and of its ids. The ids of a block stand in lanes of `STEPS` ids each, one below the other; step t codes
the t-th id of every lane with one model that all lanes share, so that numpy works on whole columns,
and each lane writes a stream of its own. What a step codes updates the model before the next step, in
coder and decoder alike.

An id is predicted
- by order 2: the id that followed the last two ids of the lane, with a confidence,
- by order 1: the id that followed the last one, with a confidence,
- by order 0: the frequencies of all ids of the block so far.
The weights of the three are learnt while coding, for each combination of confidences: how often order 2
was right, how often else order 1, how often neither. The mixed prediction gives order 2's and order 1's
ids their weights as intervals, and divides the rest by the frequencies of order 0.

Range coder: `low` and `width` of 64 bits a lane, words of 32 bits, carries are added to words already
written. Everything is integer arithmetic, so a block decodes alike on every machine.

    block   b"CMB1", ids, lanes, words, vocabulary, crc32 of the ids, crc32 of the rest; words of each
            lane (u16), words (u32)
    group   b"CMG1", rows, blocks, bytes of the table, bytes of the blocks, crc32 of the table; table
            (deflated: row has an id u8, its id i64, its number of ids u64), blocks
A group holds whole documents. A file is any number of groups, each followed by b"CME1". All numbers
are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Ids of a lane, and the most ids of a block.
STEPS = 256
BLOCK_IDS = 1 << 20
#: Intervals are parts of 2**TOTAL, order-0 frequencies parts of 2**COARSE.
TOTAL = 30
COARSE = 22
#: Confidences of a context go from 0 to 7; contexts of order 2 are hashed into 2**SLOTS places.
CONFIDENT = 7
SLOTS = 18
_BLOCK, _GROUP = struct.Struct("<4sIIIIII"), struct.Struct("<4sIIQQI")
END = b"CME1"
#: What a hit (the upper 8) or a miss (the lower 8) adds to a confidence; a miss at 0 or 1 puts another id there.
_SURER = np.array([0, 0, *((k >> 1) - k for k in range(2, 8)), *[1] * 7, 0], np.int32)
_ONE, _WORD, _LOW = np.uint64(1), np.uint64(32), np.uint64(0xFFFFFFFF)


class Damaged(ValueError):
    """A file that isn't what was written."""


class _Mixer:
    """The model of a block: what it predicts for a column of lanes, and how it learns from their ids."""

    def __init__(self, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        # Predicted id and confidence of a context in one number.
        self.first = np.zeros(vocabulary, np.int32)
        self.second = np.zeros(1 << SLOTS, np.int32)
        self.seen = np.ones(vocabulary, np.int64)
        self.every = np.arange(vocabulary + 1, dtype=np.uint64)
        contexts = (CONFIDENT + 1) ** 2 * 2
        # How often order 2, else order 1, or neither was right, a row each.
        self.right = np.repeat(np.array([[2], [2], [4]], np.int64), contexts, axis=1)
        self.right[1, 1::2] = 0  # both predict the same id
        self.step = 0
        self.fresh: list[np.ndarray] = []

    def _renew(self) -> None:
        """Cumulative frequencies of order 0, 0 to 2**COARSE, with the ids learnt since the last time; every
        id keeps a part."""
        if self.fresh:
            self.seen += np.bincount(np.concatenate(self.fresh), minlength=self.vocabulary) * 32
            self.fresh = []
        upto = np.zeros(self.vocabulary + 1, np.uint64)
        np.cumsum(self.seen, out=upto[1:].view(np.int64))
        total = upto[-1]
        upto *= np.uint64((1 << COARSE) - self.vocabulary)
        upto //= total
        upto += self.every
        self.cumulative = upto.astype(np.uint32)  # narrow: it is looked up at random

    def predict(self, last: np.ndarray, before: np.ndarray) -> None:
        """Ids predicted by order 2 and 1 and the bounds of their intervals."""
        # Order 0 is renewed at each of the first steps and then now and then.
        if self.step < 8 or self.step % 8 == 0:
            self._renew()
        self.last = last
        self.slot = ((before * 40503 + last) * 2654435761 >> 10) & ((1 << SLOTS) - 1)
        self.one, self.two = one, two = self.first.take(last), self.second.take(self.slot)
        self.id1, self.id2 = one >> 3, two >> 3
        self.sure1, self.sure2 = one & 7, two & 7
        self.context = ((self.sure2 << 3 | self.sure1) << 1 | (self.id1 == self.id2)).astype(np.int64)
        share = (1 << TOTAL) - (1 << COARSE)  # what is left to order 0 at least
        upto = np.cumsum(self.right, axis=0)
        bounds = (upto[:2] * share // upto[2]).astype(np.uint64)
        self.to2, self.to1 = bounds[0].take(self.context), bounds[1].take(self.context)

    def interval(self, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of order 2's id where `second` holds, elsewhere of order 1's."""
        return self.to2 * ~second, np.where(second, self.to2, self.to1)

    def rest(self, at: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of ids that neither predicts, in the lanes `at`."""
        over = self.to1.take(at)
        left = np.uint64(1 << TOTAL) - over
        begin, end = (left * self.cumulative.take(x) >> np.uint64(COARSE) for x in (ids, ids + 1))
        return over + begin, over + end

    def learn(self, ids: np.ndarray) -> None:
        self.step += 1
        hit2, hit1 = self.id2 == ids, self.id1 == ids
        outcome = (2 - hit1.view(np.int8)) * ~hit2
        self.right += np.bincount(outcome * np.int16(self.right.shape[1]) + self.context, minlength=self.right.size).reshape(3, -1)
        high = self.right.sum(axis=0) > 1 << 20
        if high.any():
            self.right[:, high] = (self.right[:, high] + 1) >> 1
        anew = (ids << 3 | 1).astype(np.int32)
        for table, at, had, sure, hit in (
            (self.second, self.slot, self.two, self.sure2, hit2),
            (self.first, self.last, self.one, self.sure1, hit1),
        ):
            table[at] = np.where(hit | (sure > 1), had + _SURER.take(hit.view(np.int8) << 3 | sure), anew)
        self.fresh.append(ids)


def _lanes(n: int) -> tuple[int, int]:
    """Lanes, and lanes that have an id in every step of the last lane's absence."""
    lanes = -(-n // STEPS)
    return lanes, n - (lanes - 1) * STEPS


def encode_block(ids: np.ndarray) -> bytes:
    """One block of at most `BLOCK_IDS` ids (unsigned 32 bit, below 2**21)."""
    ids = np.asarray(ids, "<u4")
    n, vocabulary = len(ids), int(ids.max(initial=0)) + 1
    if n > BLOCK_IDS or vocabulary > 1 << 21:
        raise ValueError("too many ids for a block" if n > BLOCK_IDS else "ids beyond 21 bits")
    lanes, short = _lanes(n)
    flat = np.zeros(lanes * STEPS, "<u4")
    flat[:n] = ids
    table = np.ascontiguousarray(flat.reshape(lanes, STEPS).T)
    model = _Mixer(vocabulary)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    # Words of all lanes, one lane behind the other, and where the next word of each goes.
    words = np.zeros(lanes * (STEPS + 2), np.uint32)
    begins = np.arange(lanes) * (STEPS + 2)
    place = begins.copy()
    last = before = np.zeros(lanes, np.int64)

    def carry(at: np.ndarray) -> None:
        at = place[at] - 1
        while len(at):
            words[at] += np.uint32(1)
            at = at[words[at] == 0] - 1

    for t in range(STEPS if n else 0):
        use = lanes if t < short else lanes - 1
        if not use:
            break
        now = table[t, :use].astype(np.int64)
        model.predict(last[:use], before[:use])
        hit2 = model.id2 == now
        begin, end = model.interval(hit2)
        new = np.flatnonzero(~(hit2 | (model.id1 == now)))
        begin[new], end[new] = model.rest(new, now[new])
        unit = width[:use] >> np.uint64(TOTAL)
        moved = low[:use] + unit * begin
        over = np.flatnonzero(moved < low[:use])
        if len(over):
            carry(over)
        low[:use], width[:use] = moved, unit * (end - begin)
        out = np.flatnonzero(width[:use] <= _LOW)
        due = low.take(out)
        words[place.take(out)] = due >> _WORD
        place[out] += 1
        low[out] = due << _WORD
        width[out] <<= _WORD
        model.learn(now)
        last, before = now, last
    # The last word: the smallest number from `low` on whose lower word is 0.
    final = (low + _LOW) & ~_LOW
    carry(np.flatnonzero(final < low))
    words[place] = final >> _WORD
    count = place + 1 - begins
    rest = count.astype("<u2").tobytes() + words.reshape(lanes, STEPS + 2)[np.arange(STEPS + 2) < count[:, None]].astype("<u4").tobytes()
    return _BLOCK.pack(b"CMB1", n, lanes, int(count.sum()), vocabulary, zlib.crc32(ids), zlib.crc32(rest)) + rest


def decode_block(raw: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block that begins at `at`, and where it ends."""
    if len(raw) < at + _BLOCK.size:
        raise Damaged("block cut off")
    mark, n, lanes, number, vocabulary, crc, crc_rest = _BLOCK.unpack_from(raw, at)
    begin = at + _BLOCK.size
    stop = begin + 2 * lanes + 4 * number
    if mark != b"CMB1" or n > BLOCK_IDS or not 0 < vocabulary <= 1 << 21 or lanes != -(-n // STEPS) or stop > len(raw) or zlib.crc32(raw[begin:stop]) != crc_rest:
        raise Damaged("block damaged")
    count = np.frombuffer(raw, "<u2", lanes, begin).astype(np.int64)
    if int(count.sum()) != number:
        raise Damaged("block damaged")
    words = np.append(np.frombuffer(raw, "<u4", number, begin + 2 * lanes), [0, 0]).astype(np.uint64)
    ends = np.cumsum(count)
    place = ends - count

    def following(of: np.ndarray) -> np.ndarray:
        """The next word of these lanes; zeros follow a lane's last word."""
        at = place.take(of)
        place[of] = at + 1
        return words.take(np.where(at < ends.take(of), at, number))

    every = np.arange(lanes, dtype=np.uint64)
    inside = following(every.view(np.int64)) << _WORD | following(every.view(np.int64))
    width = np.full(lanes, 2**64 - 1, np.uint64)
    table = np.zeros((STEPS, lanes), "<u4")
    last = before = np.zeros(lanes, np.int64)
    model = _Mixer(vocabulary)
    _, short = _lanes(n) if n else (0, 0)
    for t in range(STEPS if n else 0):
        use = lanes if t < short else lanes - 1
        if not use:
            break
        model.predict(last[:use], before[:use])
        unit = width[:use] >> np.uint64(TOTAL)
        part = np.minimum(inside[:use] // unit, np.uint64((1 << TOTAL) - 1))
        hit2 = part < model.to2
        now = np.where(hit2, model.id2, model.id1).astype(np.int64)
        begin, end = model.interval(hit2)
        new = np.flatnonzero(part >= model.to1)
        over = model.to1.take(new)
        rest = np.uint64(1 << TOTAL) - over
        coarse = (((part.take(new) - over + _ONE) << np.uint64(COARSE)) - _ONE) // rest
        # In the order of what is searched, for which one way through the frequencies does.
        coarse = np.sort(coarse << _WORD | new.astype(np.uint64))
        new = (coarse & _LOW).view(np.int64)
        found = np.searchsorted(model.cumulative, (coarse >> _WORD).astype(np.uint32), "right") - 1
        now[new] = found
        begin[new], end[new] = model.rest(new, found)
        inside[:use] -= unit * begin
        width[:use] = unit * (end - begin)
        out = np.flatnonzero(width[:use] <= _LOW)
        inside[out] = inside.take(out) << _WORD | following(out)
        width[out] <<= _WORD
        table[t, :use] = now
        model.learn(now)
        last, before = now, last
    ids = table.T.reshape(-1)[:n]
    if zlib.crc32(ids) != crc:
        raise Damaged("ids differ from what was written")
    return ids, stop


def encode_group(doc_ids: list[int | None], parts: list[np.ndarray]) -> bytes:
    """Whole documents: their ids one after the other, cut into blocks."""
    ids = np.concatenate([np.zeros(0, "<u4"), *parts]).astype("<u4")
    blocks = [encode_block(ids[k : k + BLOCK_IDS]) for k in range(0, len(ids), BLOCK_IDS)]
    known = np.array([x is not None for x in doc_ids], "u1")
    names = np.array([x or 0 for x in doc_ids], "<i8")
    sizes = np.array([len(x) for x in parts], "<u8")
    table = zlib.compress(known.tobytes() + names.tobytes() + sizes.tobytes())
    body = b"".join(blocks)
    return _GROUP.pack(b"CMG1", len(parts), len(blocks), len(table), len(body), zlib.crc32(table)) + table + body


def decode_groups(raw: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, numbers of ids, ids of all) of each group of a file; each is followed by `END`."""
    at = 0
    while at < len(raw):
        if len(raw) < at + _GROUP.size:
            raise Damaged("group cut off")
        mark, rows, blocks, size, body, crc = _GROUP.unpack_from(raw, at)
        at += _GROUP.size
        if mark != b"CMG1" or at + size + body > len(raw) or zlib.crc32(raw[at : at + size]) != crc:
            raise Damaged("group damaged")
        table = zlib.decompress(raw[at : at + size])
        at += size
        if len(table) != 17 * rows:
            raise Damaged("group damaged")
        known = np.frombuffer(table, "u1", rows)
        names = np.frombuffer(table, "<i8", rows, rows).tolist()
        sizes = np.frombuffer(table, "<u8", rows, 9 * rows).astype(np.int64)
        ids = [np.zeros(0, "<u4")]
        stop = at + body
        for _ in range(blocks):
            part, at = decode_block(raw, at)
            ids.append(part)
        whole = np.concatenate(ids)
        if at != stop or len(whole) != sizes.sum() or raw[at : at + len(END)] != END:
            raise Damaged("group damaged")
        at += len(END)
        yield [n if k else None for n, k in zip(names, known, strict=True)], sizes, whole
