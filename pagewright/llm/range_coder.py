"""An adaptive range coder for token ids, many blocks side by side.

A block of ids starts from an empty model and knows nothing of other blocks. For each id, the last id that followed the same
two ids (order 2) and the same one id (order 1) are predictions, each with a confidence from its latest hits; order 0 is
the block's own frequencies of an id's high and low byte. The three are mixed: the joint confidence of the two
predictions selects the weights of predicting order 2, order 1 and order 0, learned from the block's outcomes so far. The
mixture's interval for the id drives a range coder with carries: 64 bits of state, 16-bit words out.

Contexts share slots by a hash, so a prediction may come from another context; encoder and decoder agree on that. Weights
and frequencies are renewed at fixed places (RENEWED), so that all of it is integer arithmetic on whole arrays, one row for
each block: the encoder finds all predictions of all blocks by one stable sort and the coder takes one step for each id's place,
whatever the number of blocks.
"""

from __future__ import annotations

import numpy as np

#: Ids in a block at most.
BLOCK = 4096
#: Ids must be smaller.
IDS = 1 << 16
#: Slots of the predictions of one order in a block.
SLOTS = 4096
#: Places in a block where weights and frequencies are computed anew.
RENEWED = [0, 16, 32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 3072]

_JOINT = 32  # two confidences of 0 to 3, and whether both orders predict the same id
_PARTS = 4096  # of each of the three nested intervals: which order, high byte, low byte
_LEAST = 1 << 48  # the range is kept at this or more
_SHIFT = np.uint64(36)
_WORD = np.uint64(16)


def _slots(last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of order 1 and order 2 after the ids ``before``, ``last``."""
    one = last * 40503 & 0xFFFF
    two = (last * 2654435761 ^ before * 2246822519) >> 7
    return one >> 4, two & (SLOTS - 1)


def _predictions(ids: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id last seen in each place's slot, and the confidence: 0 none, 1 seen, 2 and 3 after one and more hits."""
    order = np.argsort(slots, axis=1, kind="stable")
    slot, x = np.take_along_axis(slots, order, 1), np.take_along_axis(ids, order, 1)
    same, hit = np.zeros(ids.shape, bool), np.zeros(ids.shape, bool)
    same[:, 1:] = slot[:, 1:] == slot[:, :-1]
    hit[:, 1:] = same[:, 1:] & (x[:, 1:] == x[:, :-1])
    seen, confidence = np.zeros_like(ids), same.astype(np.uint8)
    seen[:, 1:] = np.where(same[:, 1:], x[:, :-1], 0)
    confidence[:, 1:] += same[:, 1:] & hit[:, :-1]
    confidence[:, 2:] += same[:, 2:] & hit[:, 1:-1] & hit[:, :-2]
    back = np.empty_like(order)
    np.put_along_axis(back, order, np.arange(ids.shape[1])[None, :], 1)
    return np.take_along_axis(seen, back, 1), np.take_along_axis(confidence, back, 1)


def _bounds(outcomes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the intervals of order 1 and of order 0 begin, by block and joint confidence; ``outcomes`` has counts of the three."""
    n = outcomes.reshape(-1, 3) + np.array([1, 1, 2])
    total = n.sum(1)
    first = 1 + n[:, 0] * (_PARTS - 3) // total
    return first, first + 1 + n[:, 1] * (_PARTS - 3) // total


def _starts(counts: np.ndarray) -> np.ndarray:
    """257 interval starts for each row of 256 counts; every byte keeps a part at least."""
    sums = np.zeros((len(counts), 257), np.int64)
    np.cumsum(counts, axis=1, out=sums[:, 1:])
    total = np.maximum(sums[:, -1:], 1)
    sums[:, 1:] += (sums[:, -1:] == 0) * np.arange(1, 257) // 256  # nothing seen yet: the spare parts go to the last byte
    return np.arange(257) + sums * (_PARTS - 256) // total


class _Model:
    """What some blocks have learned by now."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.outcomes = np.zeros(blocks * _JOINT * 3, np.int64)
        self.high, self.low = np.zeros((blocks, 256), np.int64), np.zeros((blocks, 256), np.int64)

    def learn(self, joint: np.ndarray, outcome: np.ndarray, block: np.ndarray, ids: np.ndarray) -> None:
        """Count what happened: rows of joint confidence, outcome (0, 1, 2), block and id."""
        self.outcomes += np.bincount((block * _JOINT + joint) * 3 + outcome, minlength=len(self.outcomes))
        plain = outcome == 2
        block, ids = block[plain] * 256, ids[plain]
        self.high += np.bincount(block + (ids >> 8), minlength=self.high.size).reshape(self.high.shape)
        self.low += np.bincount(block + (ids & 255), minlength=self.low.size).reshape(self.low.shape)

    def intervals(self, block: np.ndarray, joint: np.ndarray, outcome: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id's interval in the mixture, in 2 ** 36 parts."""
        weights = block * _JOINT + joint
        first, second = self.first[weights], self.second[weights]
        begin = np.where(outcome == 0, 0, np.where(outcome == 1, first, second))
        size = np.where(outcome == 0, first, np.where(outcome == 1, second - first, _PARTS - second))
        c, f = begin << 24, size << 24
        plain = np.nonzero(outcome == 2)[0]
        row, high, low, size = block[plain] * 257, ids[plain] >> 8, ids[plain] & 255, size[plain]
        h, l = self.high_starts.ravel(), self.low_starts.ravel()  # noqa: E741
        hs, ls = h[row + high], l[row + low]
        hw, lw = h[row + high + 1] - hs, l[row + low + 1] - ls
        c[plain] += size * ((hs << 12) + hw * ls)
        f[plain] = size * hw * lw
        return c, f

    def renew(self) -> None:
        self.first, self.second = _bounds(self.outcomes)
        self.high_starts, self.low_starts = _starts(self.high), _starts(self.low)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The coded bytes of each block, an array of 1 to BLOCK ids under IDS."""
    sizes = np.array([len(x) for x in blocks])
    by_size = np.argsort(-sizes, kind="stable")
    n = sizes[by_size]
    ids = np.zeros((len(blocks), int(n[0])), np.uint16)
    for row, k in enumerate(by_size):
        ids[row, : n[row]] = blocks[k]
    joint, outcome = np.empty(ids.shape, np.uint8), np.empty(ids.shape, np.uint8)
    for i in range(0, len(blocks), 64):
        joint[i : i + 64], outcome[i : i + 64] = _foreseen(ids[i : i + 64].astype(np.int32))
    model, coder = _Model(len(blocks)), _Coder(len(blocks), ids.shape[1])
    for at, until in zip(RENEWED, [*RENEWED[1:], BLOCK], strict=True):
        if at < ids.shape[1]:
            model.renew()
            for a in range(at, min(until, ids.shape[1]), 128):
                z = min(a + 128, until, ids.shape[1])
                block, place = np.nonzero(np.arange(a, z)[None, :] < n[:, None])
                j, o, x = (m[block, place + a].astype(np.int64) for m in (joint, outcome, ids))
                start, width = np.zeros((z - a, len(blocks)), np.uint64), np.zeros((z - a, len(blocks)), np.uint64)
                start[place, block], width[place, block] = model.intervals(block, j, o, x)
                coder.put(start, width, np.searchsorted(-n, -np.arange(a, z), side="left"))
                model.learn(j, o, block, x)
    out = coder.words()
    result: list[bytes] = [b""] * len(blocks)
    for row, k in enumerate(by_size):
        result[k] = out[row]
    return result


def _foreseen(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint confidence and outcome (0: order 2 foresaw the id, 1: order 1 did, 2: neither) at each place of some blocks."""
    last, before = np.zeros(ids.shape, np.int64), np.zeros(ids.shape, np.int64)
    last[:, 1:], before[:, 2:] = ids[:, :-1], ids[:, :-2]
    one, two = _slots(last, before)
    (guess_1, sure_1), (guess_2, sure_2) = _predictions(ids, one.astype(np.uint16)), _predictions(ids, two.astype(np.uint16))
    outcome = np.where((sure_2 > 0) & (guess_2 == ids), 0, np.where((sure_1 > 0) & (guess_1 == ids), 1, 2))
    return sure_2 * 4 + sure_1 + 16 * (guess_1 == guess_2), outcome


class _Coder:
    """The words of some blocks, a lane each, for intervals of 2 ** 36 parts."""

    def __init__(self, lanes: int, places: int):
        self.size = 3 * places + 4
        self.flat, self.line = np.zeros(lanes * self.size, np.uint16), np.arange(lanes) * self.size
        self.used = np.zeros(lanes, np.int64)
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, np.iinfo(np.uint64).max, np.uint64)

    def put(self, start: np.ndarray, width: np.ndarray, live: np.ndarray) -> None:
        """Code a row of intervals (start, width) after the other, each for the first ``live`` lanes."""
        flat, line, used, low, span = self.flat, self.line, self.used, self.low, self.span
        for at, b in enumerate(live):
            part = span[:b] >> _SHIFT
            add = start[at, :b] * part
            low[:b] += add
            over, step = np.nonzero(low[:b] < add)[0], 1
            while over.size:  # a carry goes into the words before
                k = line[over] + used[over] - step
                flat[k] += 1
                over, step = over[flat[k] == 0], step + 1
            np.multiply(width[at, :b], part, out=span[:b])
            short = np.nonzero(span[:b] < _LEAST)[0]
            while short.size:
                flat[line[short] + used[short]] = low[short] >> np.uint64(48)
                used[short] += 1
                low[short] <<= _WORD
                span[short] <<= _WORD
                short = short[span[short] < _LEAST]

    def words(self) -> list[bytes]:
        for k in range(4):
            self.flat[self.line + self.used + k] = (self.low >> np.uint64(48 - 16 * k)) & np.uint64(0xFFFF)
        return [self.flat[i : i + k + 4].astype("<u2").tobytes() for i, k in zip(self.line.tolist(), self.used.tolist(), strict=True)]


def decode(coded: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    """The ids of each block (uint16) from its coded bytes and its number of ids."""
    given = np.array(sizes)
    by_size = np.argsort(-given, kind="stable")
    n, lanes = given[by_size], len(sizes)
    most = max(len(x) for x in coded) // 2 + 8
    words = np.zeros((lanes, most), np.uint16)
    for row, k in enumerate(by_size):
        w = np.frombuffer(coded[k], "<u2")
        words[row, : len(w)] = w
    words, line = words.ravel(), np.arange(lanes) * most
    code, used = np.zeros(lanes, np.uint64), np.full(lanes, 4)
    for k in range(4):
        code = (code << _WORD) | words[line + k]
    span = np.full(lanes, np.iinfo(np.uint64).max, np.uint64)
    places = int(n[0])
    ids, joints, outcomes = np.zeros((places, lanes), np.uint16), np.zeros((places, lanes), np.uint8), np.zeros((places, lanes), np.uint8)
    seen_1, seen_2 = np.zeros(lanes * SLOTS, np.int32), np.zeros(lanes * SLOTS, np.int32)  # id * 4 + confidence
    base, weights_at, table_at = np.arange(lanes) * SLOTS, np.arange(lanes) * _JOINT, np.arange(lanes) * 257
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    model, model_at = _Model(lanes), 0
    live = np.searchsorted(-n, -np.arange(places), side="left")
    renewed, top = set(RENEWED), np.uint64((1 << 36) - 1)
    every_byte = np.tile(np.arange(256, dtype=np.uint8), lanes)
    for at, b in enumerate(live):
        if at in renewed:
            if at:
                for begin in range(model_at, at, 128):
                    until = min(begin + 128, at)
                    place, block = np.nonzero(np.arange(lanes)[None, :] < live[begin:until, None])
                    model.learn(*(m[place + begin, block].astype(np.int64) for m in (joints, outcomes)), block, ids[place + begin, block].astype(np.int64))
                model_at = at
            model.renew()
            first, second = model.first, model.second
            high_starts, low_starts = model.high_starts.ravel(), model.low_starts.ravel()
            high_byte = np.repeat(every_byte, np.diff(model.high_starts, axis=1).ravel())
            low_byte = np.repeat(every_byte, np.diff(model.low_starts, axis=1).ravel())
        one, two = _slots(last[:b], before[:b])
        one += base[:b]
        two += base[:b]
        known_1, known_2 = seen_1[one], seen_2[two]
        guess_1, guess_2, sure_1, sure_2 = known_1 >> 2, known_2 >> 2, known_1 & 3, known_2 & 3
        joint = sure_2 * 4 + sure_1 + 16 * (guess_1 == guess_2)
        weights = weights_at[:b] + joint
        a, z = first[weights], second[weights]
        part = span[:b] >> _SHIFT
        value = np.minimum(code[:b] // part, top).astype(np.int64)
        order = value >> 24
        two_hit, plain = order < a, np.nonzero(order >= z)[0]
        x = np.where(two_hit, guess_2, guess_1).astype(np.int64)
        c, f = np.where(two_hit, 0, a), np.where(two_hit, a, z - a)
        c <<= 24
        f <<= 24
        outcome = 1 - two_hit.astype(np.int64)
        if plain.size:
            begin = z[plain]
            size = _PARTS - begin
            begin <<= 24
            rest = ((value[plain] - begin) / size).astype(np.int64)  # exact: quotients of 36 by 12 bits
            row, pick = table_at[plain], plain * _PARTS
            high = high_byte[pick + (rest >> 12)].astype(np.int64)
            hs = high_starts[row + high]
            hw = high_starts[row + high + 1] - hs
            rest = ((rest - (hs << 12)) / hw).astype(np.int64)
            low = low_byte[pick + rest].astype(np.int64)
            ls = low_starts[row + low]
            lw = low_starts[row + low + 1] - ls
            c[plain] = begin + size * ((hs << 12) + hw * ls)
            f[plain] = size * hw * lw
            x[plain] = high << 8 | low
            outcome[plain] = 2
        code[:b] -= c.astype(np.uint64) * part
        np.multiply(f.astype(np.uint64), part, out=span[:b])
        short = np.nonzero(span[:b] < _LEAST)[0]
        while short.size:
            code[short] = (code[short] << _WORD) | words[line[short] + used[short]]
            used[short] += 1
            span[short] <<= _WORD
            short = short[span[short] < _LEAST]
        seen_1[one] = x * 4 + 1 + (guess_1 == x) * np.minimum(sure_1, 2)
        seen_2[two] = x * 4 + 1 + (guess_2 == x) * np.minimum(sure_2, 2)
        ids[at, :b], joints[at, :b], outcomes[at, :b] = x, joint, outcome
        before, last = last[:b], x
    result: list[np.ndarray] = [np.zeros(0, np.uint16)] * lanes
    by_block = np.ascontiguousarray(ids.T)
    for row, k in enumerate(by_size):
        result[k] = by_block[row, : n[row]]
    return result
