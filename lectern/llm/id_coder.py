"""Adaptive context-mixing range coder for token ids, in blocks that are coded and decoded by themselves.

A block is cut into lanes of consecutive ids, which take their steps together and share the block's model; numpy runs
several blocks side by side. Every block starts from an empty model. What decides an interval is integer arithmetic, so
that another machine repeats it exactly.

An id is coded as an outcome: the guess of order 2 (the id that followed these two ids last), a place in the list of
order 1 (ids that followed this one, the frequent ones moving to the front), or neither; then by order 0, how often each
id was needed where the others did not know it, with an even chance of ids not met at all. Two distributions over the
outcomes are learnt, one by what order 2 knows and one by what order 1 knows; their weighted mean drives the range coder.
The weights follow how well each foretells the block.
"""

from __future__ import annotations

import numpy as np

#: Ids must be below this.
MOST_ID = (1 << 16) - 1
#: Ids in a list of order 1, and contexts of order 1 and 2 in a block's tables (they are hashed).
SLOTS, CONTEXTS, PAIRS = 16, 8192, 1 << 17
NOTHING = np.uint16(MOST_ID)
#: Outcomes: order 2's guess, the places of the list, none.
GUESS, NONE, OUTCOMES = 0, SLOTS + 1, SLOTS + 2
#: Columns of the outcomes' table: those below the last outcome, and a margin to whole words.
COLUMNS = 24
#: States of order 2 (confidence, agreement with order 1) and of order 1 (length of the list, how good it was lately).
STATES2, STATES1 = 8, (SLOTS + 1) * 4
STATES = STATES2 * STATES1
#: Steps of a lane at most and at least, lanes that suffice to have the most, and lanes coded side by side.
STEPS, FEWEST, WIDE, TOGETHER = 1024, 32, 4096, 8192
#: Frequencies are in units of 1 / 65536, weights of 1 / 256.
UNIT = np.uint64(16)
ONE = 1 << 16
#: The interval is held to 48 bits; below 32 it is renewed by a word of 16, so that one step always fits in.
BOTTOM, WORD, LOW = np.uint64(1 << 32), np.uint64(16), np.uint64((1 << 32) - 1)
#: Words that a reader holds of each lane.
AHEAD = 3
#: Steps after which the outcomes' frequencies, and those of order 0, are drawn up anew, ever rarer.
OUTCOMES_ANEW = frozenset([*range(1, 17), *range(18, 33, 2), *range(36, 65, 4), *range(72, 129, 8), *range(144, STEPS, 32)])
ORDER0_ANEW = frozenset([*range(1, 9), 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 56, 64, *range(80, 129, 16), *range(160, STEPS, 64)])

#: Gathers the lowest bits of eight bytes into the highest byte, or the sum of the bytes.
GATHER, SUM, BYTES = np.uint64(0x0102040810204080), np.uint64(0x0101010101010101), np.uint64(56)
#: The lowest set bit of a mask of SLOTS bits; SLOTS for none.
LOWEST = np.full(1 << SLOTS, SLOTS, np.int64)
for _k in reversed(range(SLOTS)):
    LOWEST[1 << _k :: 2 << _k] = _k


class Model:
    """What predicts the next id of every lane, and what is learnt from it; ``blocks`` models side by side."""

    def __init__(self, blocks: int, lanes: int):
        self.blocks = blocks
        self.block = np.repeat(np.arange(blocks), lanes)
        self.rows, self.pairs, self.first = self.block * CONTEXTS, self.block * PAIRS, self.block * STATES
        self.lists = np.full((blocks * CONTEXTS, SLOTS), NOTHING)
        self.cells = self.lists.reshape(-1)
        self.known = np.zeros(blocks * CONTEXTS, np.uint8)  # length of the list * 4 + how good it was lately
        self.after = np.zeros(blocks * PAIRS, np.int32)  # id * 4 + confidence
        self.row, self.pair, self.last = self.rows, self.pairs, np.zeros(len(self.block), np.int64)
        self.counts = np.zeros((blocks, STATES2, STATES1, OUTCOMES), np.int64)
        self.held: list[np.ndarray] = []
        self.won = np.repeat([[1], [2]], blocks, axis=1)
        self.needed, self.start, self.size = np.zeros((3, blocks * ONE), np.int32)
        self.met = np.zeros(0, np.int64)
        self.fresh: list[np.ndarray] = []
        self.new = np.full(blocks, 8)
        self.weigh()
        self.order0()

    def weigh(self) -> None:
        """Draws up the outcomes' cumulative frequencies for every pair of states, and the weights behind them."""
        if self.held:
            last = self.held[-1] // OUTCOMES % STATES, self.held[-1] % OUTCOMES
            p2, p1 = (o.reshape(-1).take((self.block * n + state) * OUTCOMES + last[1]) for o, n, state in zip(self.odds, (STATES2, STATES1), (last[0] // STATES1, last[0] % STATES1)))
            p2, p1 = p2 * self.weight[self.block], p1 * (256 - self.weight)[self.block]
            self.won[0] += np.bincount(self.block, p2 * 256 // (p2 + p1), minlength=self.blocks).astype(np.int64)
            self.won[1] += 256 * (len(self.block) // self.blocks)
            self.counts += np.bincount(np.concatenate(self.held), minlength=self.counts.size).reshape(self.counts.shape)
            self.held = []
        self.weight = np.clip(self.won[0] * 256 // self.won[1], 1, 255)
        until = []
        for axis in (2, 1):
            cum = np.cumsum(self.counts.sum(axis=axis) + 1, axis=-1)
            cum = cum * (ONE - OUTCOMES) // cum[..., -1:] + np.arange(1, OUTCOMES + 1)
            until.append(cum)
        self.odds = [np.diff(cum, axis=-1, prepend=0) for cum in until]
        w = self.weight[:, None, None, None]
        mixed = until[0][:, :, None, :-1] * w + until[1][:, None, :, :-1] * (256 - w) >> 8
        # column k: where outcome k begins; the last one ends at ONE; the margin is never reached
        table = np.full((self.blocks * STATES, COLUMNS), ONE - 1, np.uint16)
        table[:, 0] = 0
        table[:, 1:OUTCOMES] = mixed.reshape(-1, OUTCOMES - 1)
        self.table = table

    def order0(self) -> None:
        """Draws up order 0's frequencies; what is left over is for ids not met."""
        if self.fresh:
            self.met = np.sort(np.concatenate([self.met, *map(np.sort, self.fresh)]), kind="stable")
            self.met = self.met[np.concatenate([[True], self.met[1:] != self.met[:-1]])]
            self.fresh = []
        seen = self.met
        block, n = seen >> 16, self.needed[seen].astype(np.int64)
        many = np.bincount(block, minlength=self.blocks)
        total = np.bincount(block, n, minlength=self.blocks).astype(np.int64) + self.new
        often = 1 + n * (ONE - 1 - many)[block] // total[block]
        self.taken = np.bincount(block, often, minlength=self.blocks).astype(np.int64)
        self.size[seen] = often
        self.start[seen] = np.cumsum(often) - often - (np.cumsum(self.taken) - self.taken)[block]
        self.owners: np.ndarray | None = None

    def owner(self) -> np.ndarray:
        """For each block and unit of order 0 the id whose part it is in (ids not met: any)."""
        if self.owners is None:
            all_ids = np.repeat(self.met.astype(np.uint16), self.size[self.met])
            self.owners = np.zeros((self.blocks, ONE), np.uint16)
            for o, part in zip(self.owners, np.split(all_ids, np.cumsum(self.taken)[:-1])):
                o[: len(part)] = part
            self.owners = self.owners.reshape(-1)
        return self.owners

    def predict(self) -> None:
        """Looks up both orders for every lane."""
        self.list = self.lists.take(self.row, axis=0)
        guess = self.after.take(self.pair)
        self.sure, self.guess = guess & 3, (guess >> 2).astype(np.uint16)
        self.state1 = self.known.take(self.row)
        self.key = self.first + (self.sure * 2 + (self.list[:, 0] == self.guess)) * STATES1 + self.state1

    def bounds(self, outcome: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of an outcome's part."""
        at, flat = self.key * COLUMNS + outcome, self.table.reshape(-1)
        start = flat.take(at).astype(np.int64)
        return start, flat.take(at + 1) - start + (outcome == NONE)

    def outcome(self, value: np.ndarray) -> np.ndarray:
        """The outcome in whose part each value is."""
        over = (self.table.take(self.key, axis=0) <= value.astype(np.uint16)[:, None]).view("<u8")
        many = (over[:, 0] + over[:, 1] + over[:, 2]) * SUM >> BYTES
        return np.minimum(many.astype(np.int64) - 1, NONE)

    def learn(self, ids: np.ndarray, now: np.ndarray, outcome: np.ndarray, place: np.ndarray, missed: np.ndarray) -> None:
        """``place``: where the id stands in the list (SLOTS: nowhere); ``missed``: lanes whose outcome was NONE."""
        self.held.append(self.key * OUTCOMES + outcome)
        # the list: a known id moves half way to the front, another takes the last place
        base, length = self.row * SLOTS, self.state1 >> 2
        unlisted = place == SLOTS
        old = np.minimum(place, np.minimum(length, SLOTS - 1) * unlisted + SLOTS * ~unlisted)
        ahead = base + (old >> ~unlisted)
        self.cells[base + old] = self.cells.take(ahead)
        self.cells[ahead] = now
        lately = self.state1 & 3
        better = place < 2 + lately
        lately = np.minimum(lately + better, 3) - ((lately > 0) & ~better)
        self.known[self.row] = (np.minimum(length + unlisted, SLOTS) << 2) + lately
        if len(missed):
            np.add.at(self.needed, (self.block[missed] << 16) + ids[missed], np.int32(1))
        right = self.guess == now
        kept = np.minimum(self.sure + 1, 3) * right + (self.sure - 1) * ~right
        stay = kept > 0
        self.after[self.pair] = (self.guess * stay + now * ~stay) * np.int32(4) + np.maximum(kept, 1)
        mixed = ids * 40503
        self.row = self.rows + (mixed >> 3 & CONTEXTS - 1)
        self.pair = self.pairs + ((mixed ^ self.last * 30011) >> 2 & PAIRS - 1)
        self.last = ids


def place_in(lists: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Where each id stands in its list; SLOTS for nowhere."""
    same = (lists == ids[:, None]).view("<u8")
    return LOWEST.take(((same[:, 0] * GATHER) >> BYTES | (same[:, 1] * GATHER) >> BYTES << np.uint64(8)).astype(np.int64))


def shape(n: int, block_ids: int) -> tuple[int, int, int]:
    """(blocks, lanes of a block, steps) for ``n`` ids in blocks of about ``block_ids``."""
    blocks = max(1, -(-n // block_ids))
    steps = int(np.clip(n // WIDE, FEWEST, STEPS))
    return blocks, max(1, -(-n // (blocks * steps))), steps


def encode(ids: np.ndarray, steps: int) -> list[bytes]:
    """Codes each row of a matrix of ids as a block; a row holds lanes of ``steps`` ids, one after another."""
    if ids.size and (ids.min() < 0 or ids.max() >= MOST_ID):
        raise ValueError(f"ids must be from 0 to {MOST_ID - 1}")
    blocks, lanes = ids.shape[0], ids.shape[1] // steps
    columns = np.ascontiguousarray(ids.reshape(blocks * lanes, steps).astype(np.uint16).T)
    model, n = Model(blocks, lanes), blocks * lanes
    low, span = np.zeros(n, np.uint64), np.full(n, np.uint64((1 << 48) - 1))
    width = 3 * steps + AHEAD + 1
    # a word may carry into the one before it: 17 bits until all are there; a lane's first place takes no word
    out, place = np.zeros(n * width, np.uint32), np.arange(n) * width + 1
    order: list[np.ndarray] = []

    def renew(need: np.ndarray) -> None:
        part, spot = low.take(need), place.take(need)
        out[spot] = part >> np.uint64(32)
        place[need] = spot + 1
        low[need] = (part & LOW) << WORD
        span[need] = span.take(need) << WORD
        order.append(spot)

    for t, now in enumerate(columns):
        ids = now.astype(np.int64)
        model.predict()
        stands = place_in(model.list, now)
        outcome = (stands + 1) * ((model.guess != now) | (model.sure == 0))
        start, size = model.bounds(outcome)
        missed = np.flatnonzero(outcome == NONE)
        span >>= UNIT
        low += span * start.astype(np.uint64)
        span *= size.astype(np.uint64)
        renew(np.flatnonzero(span < BOTTOM))
        if len(missed):
            which = model.block[missed]
            where = (which << 16) + ids[missed]
            size, taken = model.size.take(where), model.taken.take(which)
            new = size == 0
            part = span.take(missed) >> UNIT
            low[missed] += part * np.where(new, taken, model.start.take(where)).astype(np.uint64)
            part *= np.where(new, ONE - taken, size).astype(np.uint64)
            span[missed] = part
            renew(missed[part < BOTTOM])
            if new.any():
                lane = missed[new]
                part = span.take(lane) >> UNIT
                low[lane] += part * ids[lane].astype(np.uint64)
                span[lane] = part
                np.add.at(model.new, which[new], 1)
                model.fresh.append(where[new])
                renew(lane[part < BOTTOM])
        model.learn(ids, now, outcome, stands, missed)
        if t + 1 in OUTCOMES_ANEW:
            model.weigh()
        if t + 1 in ORDER0_ANEW:
            model.order0()
    for shift in (32, 16, 0):
        out[place] = (low >> np.uint64(shift)) & np.uint64(0xFFFF) if shift < 32 else low >> np.uint64(32)
        place += 1
    over = np.flatnonzero(out >> 16)
    while len(over):
        out[over] &= 0xFFFF
        out[over - 1] += 1
        over = (over - 1)[out[over - 1] >> 16 > 0]
    # a reader takes AHEAD words of every lane, then one at each renewal, in the order of the renewals
    spots = np.concatenate([np.zeros(0, np.int64), *order])
    owner = spots // (width * lanes)
    by_block = np.argsort(owner.astype(np.uint16), kind="stable")
    words, ends = out[spots[by_block] + AHEAD], np.cumsum(np.bincount(owner, minlength=blocks))
    heads = out.reshape(blocks, lanes, width)[:, :, 1 : AHEAD + 1]
    return [np.concatenate([h.ravel(), w]).astype("<u2").tobytes() for h, w in zip(heads, np.split(words, ends[:-1]))]


def decode(coded: list[bytes], lanes: int, steps: int) -> np.ndarray:
    """The ids of each block, as a matrix; a block's ids do not depend on the others."""
    blocks, n = len(coded), len(coded) * lanes
    words = np.concatenate([*[np.frombuffer(b, "<u2") for b in coded], np.zeros(1, np.uint16)])
    sizes = np.array([len(b) // 2 for b in coded], np.int64)
    if (sizes < AHEAD * lanes).any():
        raise ValueError("a block is damaged")
    at = np.cumsum(sizes) - sizes
    code = np.zeros(n, np.uint64)  # less the interval's start
    for w in words[at[:, None] + np.arange(AHEAD * lanes)].reshape(n, AHEAD).T:
        code = code << WORD | w
    at += AHEAD * lanes
    model = Model(blocks, lanes)
    span = np.full(n, np.uint64((1 << 48) - 1))
    out, cells = np.zeros((steps, n), np.uint16), np.arange(n) * SLOTS - 1
    most = np.uint64(ONE - 1)

    def renew(need: np.ndarray) -> None:
        owner = model.block[need]
        many = np.bincount(owner, minlength=blocks)
        spot = (at - (np.cumsum(many) - many))[owner]
        spot += np.arange(len(need))
        code[need] = code.take(need) << WORD | words.take(spot, mode="clip")
        at[:] += many
        span[need] = span.take(need) << WORD

    for t in range(steps):
        model.predict()
        span >>= UNIT
        outcome = model.outcome(np.minimum(code // span, most))
        start, size = model.bounds(outcome)
        code -= span * start.astype(np.uint64)
        span *= size.astype(np.uint64)
        guessed = outcome == GUESS
        now = out[t]
        now[:] = model.list.reshape(-1).take(np.minimum(np.maximum(outcome, 1), SLOTS) + cells)
        now *= ~guessed
        now += model.guess * guessed
        missed = np.flatnonzero(outcome == NONE)
        renew(np.flatnonzero(span < BOTTOM))
        if len(missed):
            which = model.block[missed]
            taken = model.taken.take(which)
            part = span.take(missed) >> UNIT
            value = np.minimum(code.take(missed) // part, most).astype(np.int64)
            new = value >= taken
            found = model.owner().take((which << 16) + value)
            where = (which << 16) + found
            code[missed] -= part * np.where(new, taken, model.start.take(where)).astype(np.uint64)
            part *= np.where(new, ONE - taken, model.size.take(where)).astype(np.uint64)
            span[missed] = part
            now[missed] = found
            renew(missed[part < BOTTOM])
            if new.any():
                lane = missed[new]
                part = span.take(lane) >> UNIT
                found = np.minimum(code.take(lane) // part, most)
                now[lane] = found
                code[lane] -= part * found
                span[lane] = part
                np.add.at(model.new, which[new], 1)
                model.fresh.append((which[new] << 16) + found.astype(np.int64))
                renew(lane[part < BOTTOM])
        stands = outcome - 1
        at_guess = np.flatnonzero(guessed)
        stands[at_guess] = place_in(model.list.take(at_guess, axis=0), now[at_guess])
        model.learn(now.astype(np.int64), now, outcome, stands, missed)
        if t + 1 in OUTCOMES_ANEW:
            model.weigh()
        if t + 1 in ORDER0_ANEW:
            model.order0()
    return np.ascontiguousarray(out.T).reshape(blocks, lanes * steps)
