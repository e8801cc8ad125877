"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word of every training text, and the end of the text, is a customer.  A restaurant
stands for each pair of words (the two before), and its tables are customers of the
restaurant of the nearer word alone; the tables of those are customers of the root, whose
parent is uniform over the vocabulary and one unseen word.  All words are dishes and all
contexts have restaurants: what is gathered grows with the corpus.

Seating is sampled by Gibbs: for each dish of a restaurant the number of its tables given
all others (the seating within the dish summed out by generalised Stirling numbers, for a
dish of many customers by their saddle point).  After the burn-in the predictive
probabilities of several samples are averaged.

Plan: tokens meet by the word before, so the restaurant of a word and those of all pairs
that end in it are in one task, with parent and children side by side; a task handles one
shard of about SHARD tokens at a time.  A first pass seats the shards under a unigram
parent and sends the tables of each word to the root; the root's probability of a word
depends on its number of customers alone, so the root is sampled over the distinct numbers.
A second pass seats the shards again under the root's probabilities and scores every token;
both read one exchange.  Words travel as ranks of a bounded table of frequent words, rarer
ones as hashes, packed by run of texts and shard.

A word of very many occurrences has several restaurants, one for each class of the word
before it, so it is dealt to several shards; where both are very frequent the class is
also one of texts, so that no pair of words is more than one task holds.  How many classes
there are depends on the words' counts alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace, give_back, row_binaries, texts_of

#: Frequent words that are sent to every task, with counts (a bounded table: the others travel as hashes).
SENT = 262_144
#: Tokens of a shard on average, and occurrences of a word for each of its restaurants.
SHARD, PART = 1 << 21, 1 << 18
#: Occurrences of both words of a pair for each class of texts it's divided into.
PAIR = 1 << 22
#: Sweeps before the first sample, samples, strength, and discount of the root.
BURN, SAMPLES, STRENGTH, ROOT_DISCOUNT = 4, 4, 1.0, 0.5
#: Customers up to which a dish's tables are drawn from their exact conditional.
EXACT = 128
#: Dishes, times numbers of tables, that are drawn at once.
SEATED = 1 << 18
#: Customers up to which weights of tables are multiplied, not added as logarithms: no product comes near overflow.
NARROW = 32
#: Customers up to which the saddle point is corrected by the recursion, and places between one table and a table each.
TABLED, PLACES = 2048, 257
#: Bound of the numbers that columns are joined to.
MOST = 1 << 62
#: Trigrams whose probabilities are worked out at once.
SAMPLED = 1 << 17
#: Bytes of text of a run.
RUN_BYTES = 6 << 20


# --- tokens -----------------------------------------------------------------


def _hashes(words: list) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _hash(word: bytes | memoryview) -> int:
    return int(_hashes([word])[0])


#: No word holds a line feed, so these can't be one's hash.
END, START = _hash(b"\n"), _hash(b"\n\n")


@dataclass
class Run:
    """Tokens of several texts: places in ``hashes``; every text ends with place 0, the end."""

    place: np.ndarray
    text: np.ndarray
    hashes: np.ndarray


def _slices(column) -> list[bytes]:
    """The values of a string column without nulls."""
    _, offsets, data = column.buffers()
    wide = np.int64 if str(column.type).startswith("large") else np.int32
    off = np.frombuffer(offsets, wide, len(column) + 1, column.offset * wide().itemsize) if len(column) else np.zeros(1, np.int64)
    raw = memoryview(data)[int(off[0]):int(off[-1])].tobytes() if data is not None else b""
    off = (off - off[0]).tolist()
    return [raw[a:b] for a, b in zip(off, off[1:])]


def tokens_of(column) -> Run:
    """Words between ASCII white space, A-Z lower-cased, then the end; a null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    coded = parts.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    words = _slices(coded.dictionary)
    found = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32) + np.int32(1)
    lens = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if b"" in words:  # white space at an edge
        real = found != words.index(b"") + 1
        lens = np.bincount(np.repeat(np.arange(len(lens)), lens)[real], minlength=len(lens))
        found = found[real]
    text = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 1)
    is_word = np.ones(len(text), bool)
    is_word[np.cumsum(lens + 1) - 1] = False
    place = np.zeros(len(text), np.int32)
    place[is_word] = found
    return Run(place, text, np.append(END, _hashes(words)))


def _runs(batches) -> Iterator:
    """(doc_id, text, held_out) batches joined to runs of a few megabytes."""
    import pyarrow as pa

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size > RUN_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from table.to_batches()


def _tally(batches) -> Iterator:
    """Counts of the words of training texts: one row a run and word."""
    import pyarrow as pa

    for run in _runs(batches):
        t = tokens_of(run.column(1))
        n = np.bincount(t.place, minlength=len(t.hashes))
        used = n > 0
        yield pa.record_batch([pa.array(t.hashes[used]), pa.array(n[used])], names=["h", "n"])


# --- shards of tokens -------------------------------------------------------


@dataclass
class Frequent:
    """The words that are sent: hashes by rank (the most frequent first), their counts, and the first probabilities."""

    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    rare: float

    def __post_init__(self) -> None:
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash, -1 for a word that isn't sent."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int32)
        order = np.argsort(hashes)  # a search for what is near the last one stays in the cache
        hashes = hashes[order]
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        out = np.empty(len(hashes), np.int32)
        out[order] = np.where(self.sorted[at] == hashes, self.order[at], -1)
        return out


_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two: order counts."""
    z = (x.astype(np.int64).view(np.uint64) * _A + y.astype(np.int64).view(np.uint64)) * _B
    z ^= z >> _C
    z *= _A
    return (z ^ (z >> _C)).view(np.int64)


def _group(a: np.ndarray, ids: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> np.ndarray:
    """Number of the restaurant of a word of ``count_b`` occurrences after the word ``a``, in the text of the id."""
    parts = (count_b // PART + 1).astype(np.uint64)
    texts = (np.minimum(count_a, count_b) // PAIR + 1).astype(np.uint64)
    return (mixed(a, (mixed(ids, ids).view(np.uint64) % texts).astype(np.int64)).view(np.uint64) % parts).astype(np.int64)


#: A blob: tokens, rare words, and the run; then text, rank of the two words before and of the word, group, and hashes of rare words.
HEAD, HEAD_BYTES = "<iiq", 16


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(run: int, doc: np.ndarray, words: np.ndarray, group: np.ndarray, hashes: np.ndarray, ranks: np.ndarray) -> bytes:
    """Tokens in order of their texts; ``words`` is (3, n) of places in ``hashes``, ``doc`` holds 2 * text + 1 for a held-out one."""
    import zstandard

    code = ranks[words.ravel()]
    rare = np.nonzero(code < 0)[0]
    places, of = np.unique(words.ravel()[rare], return_inverse=True)  # of the rare words alone: the others have their rank
    code[rare] = SENT + of
    body = b"".join([_planes(np.diff(doc, prepend=0)), *map(_planes, code.reshape(3, -1)), _planes(group), hashes[places].astype("<i8").tobytes()])
    return struct.pack(HEAD, len(doc), len(places), run) + zstandard.ZstdCompressor(level=3).compress(body)


@dataclass
class Tokens:
    """Unpacked tokens: run, text, whether held out, hashes of the word two before and of the word, key of the restaurant of the one before."""

    run: int
    text: np.ndarray
    held: np.ndarray
    a: np.ndarray
    key: np.ndarray
    w: np.ndarray


@dataclass
class Codes:
    """The same in codes: a frequent word's rank, or SENT and the place in ``rare``; and the group of the restaurant."""

    run: int
    text: np.ndarray
    held: np.ndarray
    a: np.ndarray
    b: np.ndarray
    w: np.ndarray
    group: np.ndarray
    rare: np.ndarray


def unpack_codes(blob: bytes) -> Codes:
    import zstandard

    n, rare, run = struct.unpack_from(HEAD, blob)
    body = zstandard.ZstdDecompressor().decompress(blob[HEAD_BYTES:], max_output_size=20 * n + 8 * rare)
    doc, a, b, w, group = (np.array(np.frombuffer(body, np.uint8, 4 * n, 4 * n * k).reshape(4, n).T, order="C").view("<i4").ravel() for k in range(5))
    doc = np.cumsum(doc, dtype=np.int32)
    return Codes(run, doc >> 1, (doc & 1).astype(bool), a, b, w, group, np.frombuffer(body, "<i8", rare, 20 * n))


def unpack(blob: bytes, known: Frequent) -> Tokens:
    t = unpack_codes(blob)
    a, b, w = (_names(x, known, t.rare) for x in (t.a, t.b, t.w))
    return Tokens(t.run, t.text, t.held, a, mixed(b, t.group), w)


def _names(codes: np.ndarray, known: Frequent, rare: np.ndarray) -> np.ndarray:
    """The hashes that codes stand for."""
    out, some = np.empty(len(codes), np.int64), codes < SENT
    out[some], out[~some] = known.hashes[codes[some]], rare[codes[~some] - SENT]
    return out


def contexts(t: Run, ids: np.ndarray, known: Frequent, starts: int, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(3, n) places of the two words before and the word, the group of the restaurant of each token, and the hashes, the start's last.

    ``rank`` holds the ranks of those hashes where they are known already.
    """
    start = len(t.hashes)
    hashes = np.append(t.hashes, START)
    rank = known.ranks(hashes) if rank is None else rank
    count = np.where(rank >= 0, np.append(known.counts, 0)[rank], 0)
    count[start] = starts
    words = np.empty((3, len(t.place)), np.int32)
    first = np.ones(len(t.place), bool)
    first[1:] = t.text[1:] != t.text[:-1]
    words[2] = t.place
    for k in (1, 0):
        words[k, :1], words[k, 1:] = start, words[k + 1, :-1]
        words[k, first] = start
    group = np.zeros(len(t.place), np.int32)
    some = np.nonzero((count >= PART)[words[1]])[0]  # the others have one restaurant
    a, b = words[0, some], words[1, some]
    group[some] = _group(hashes[a], ids[t.text[some]], count[a], count[b])
    return words, group, hashes


DEALT = "shard int, kind int, payload binary"


def _dealt(b: np.ndarray, group: np.ndarray, shards: int) -> np.ndarray:
    """Shards of restaurants, in as few bytes as they need: 16 bits are sorted by their digits."""
    return (mixed(b, group).view(np.uint64) % np.uint64(shards)).astype(np.uint16 if shards <= 1 << 16 else np.int32)


def _deal(sent, shards: int, starts: int):
    """Texts to packed tokens (kind 1) by shard, and a row a run with its ids (kind 2)."""

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        run_id = (context.partitionId() if context else 0) << 33
        known = sent.value
        for block in _runs(batches):
            t = tokens_of(block.column(1))
            ids, held = block.column(0), block.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            ranks = known.ranks(np.append(t.hashes, START))
            words, group, hashes = contexts(t, ids.fill_null(0).to_numpy(), known, starts, ranks)
            shard = _dealt(hashes, np.zeros(len(hashes), np.int64), shards)[words[1]]
            some = np.nonzero(group)[0]
            shard[some] = _dealt(hashes[words[1, some]], group[some], shards)
            order = np.argsort(shard, kind="stable")
            shard, doc, words, group = shard[order], (2 * t.text + held[t.text])[order], words.take(order, 1), group[order]
            cut = np.nonzero(np.append(True, shard[1:] != shard[:-1]))[0].tolist()
            out = [(int(shard[i]), 1, pack(run_id, doc[i:j], words[:, i:j], group[i:j], hashes, ranks)) for i, j in zip(cut, [*cut[1:], len(order)])]
            info = struct.pack(HEAD, block.num_rows, 0, run_id) + ids.fill_null(0).to_numpy().astype("<i8").tobytes()
            info += np.asarray(ids.is_valid()).astype(np.uint8).tobytes() + held.astype(np.uint8).tobytes()
            out.append((run_id % shards, 2, info))
            yield pa.record_batch([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())],
                                  names=["shard", "kind", "payload"])
            run_id += 1

    return run


def _shards(batches) -> Iterator[tuple[int, list[bytes]]]:
    """Rows (shard, kind, payload) sorted by shard to the packed tokens of one shard at a time."""
    now, blobs = None, []
    for batch in batches:
        for number, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), row_binaries(batch.column(2))):
            if number != now:
                if blobs:
                    yield now, blobs
                now, blobs = number, []
            if kind == 1:
                blobs.append(bytes(blob))
    if blobs:
        yield now, blobs


# --- seating ----------------------------------------------------------------


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """log S[c, t]: ways to seat c customers at t tables, generalised Stirling numbers."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    with np.errstate(divide="ignore"):
        for c in range(1, most + 1):
            stay = c - 1 - discount * np.arange(1, c + 1)
            s[c, 1:c + 1] = np.logaddexp(s[c - 1, :c], s[c - 1, 1:c + 1] + np.log(np.maximum(stay, 0)))
    return s


def sample_tables(c: np.ndarray, t: np.ndarray, base: np.ndarray, u: np.ndarray, strength: float, discount: float, stirling: np.ndarray,
                  rng: np.random.Generator, groups: int = 4, others: np.ndarray | int = 0) -> np.ndarray:
    """One Gibbs sweep over the dishes of many restaurants: new table counts given customers ``c`` and parent ``base``.

    ``u`` numbers the restaurants; ``others`` are tables of theirs that never change.
    Dishes are updated in ``groups`` turns; within a turn the other dishes of the group
    count with their tables from before it.
    """
    t = t.copy()
    with np.errstate(invalid="ignore"):
        odds = np.nan_to_num(np.exp(np.diff(stirling[:NARROW + 1, 1:NARROW + 1])))
    turn = np.where(c > 1, rng.integers(0, groups, len(c)), -1)
    for g in range(groups):
        own = np.nonzero(turn == g)[0]
        if not len(own):
            continue
        rest = ((np.bincount(u, t) + others)[u[own]] - t[own]).astype(np.int64)
        customers = c[own]
        two = customers == 2  # one table or two: a single draw decides
        dish = own[two]
        more = odds[2, 0] * (strength + discount * (rest[two] + 1)) * base[dish]
        t[dish] = 1 + (rng.random(len(dish)) * (1 + more) < more)
        some = np.nonzero((customers > 2) & (customers <= EXACT))[0]
        for part, wide in _by_width(customers[some]):
            tables = np.arange(wide)
            for at in range(0, len(part), SEATED // wide):
                i = some[part[at:at + SEATED // wide]]
                dish = own[i]
                if wide <= NARROW:  # the weight of a table more over the weight before it
                    more = odds[customers[i], :wide - 1] * (strength + discount * (rest[i, None] + tables[1:])) * base[dish][:, None]
                    most = 1 + np.cumsum(np.cumprod(more, axis=1), axis=1)
                    drawn = rng.random(len(i)) * most[:, -1]
                    t[dish] = np.minimum(1 + (drawn >= 1) + (drawn[:, None] >= most[:, :-1]).sum(1), customers[i])
                    continue
                opened = np.cumsum(np.log(strength + discount * (rest[i, None] + tables)), axis=1)
                logit = stirling[customers[i], 1:wide + 1] + opened + (tables + 1) * np.log(base[dish])[:, None]
                t[dish] = 1 + (logit + rng.gumbel(size=logit.shape)).argmax(1)
        large = np.nonzero(customers > EXACT)[0]
        if len(large):
            dish = own[large]
            t[dish] = _draw_large(c[dish], base[dish], rest[large], strength, discount, numbers_of(discount), rng, t[dish])
    return t


def _by_width(c: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """Places of counts from 3 to EXACT with the number of columns they need: most dishes have few customers."""
    low, wide = 2, 4
    while low < EXACT:
        some = np.nonzero((c > low) & (c <= wide))[0]
        if len(some):
            yield some, wide
        low, wide = wide, wide * 2


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function of positive numbers: Stirling's series eight places further on."""
    y = x + 8.0
    one = 1.0 / y
    two = one * one
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + one * (1 / 12 - two * (1 / 360 - two / 1260))
    product = x * (x + 1.0)
    for i in range(2, 8):
        product *= x + i
    return series - np.log(product)  # of eight factors: far from overflow for any count of customers


@dataclass
class Stirling:
    """Generalised Stirling numbers of any size by saddle point: c! / t! [z^c] ((1 - (1 - z)^d) / d)^t.

    The saddle depends on c / t alone, so it's tabulated once; an error in it is of
    second order in the value.  With a large discount one table may hold most customers,
    which the saddle point misses: its error against the recursion is tabulated by log c
    and log t / log c up to TABLED customers, and carried on in a line beyond.
    """

    discount: float

    def __post_init__(self) -> None:
        self.way = np.exp(np.linspace(np.log(1e-9), np.log(900.0), 1 << 15))  # -log(1 - z)
        with np.errstate(over="ignore"):
            self.ratio = np.log(self._at(self.way)[2])
        rows, places = [], np.linspace(0, 1, PLACES)
        exact = np.zeros(1)  # log S[1, 1 ..]
        for n in range(2, TABLED + 1):
            t = np.arange(1, n)
            stay = exact + np.log(n - 1 - self.discount * t)
            exact = np.append(np.append(stay[:1], np.logaddexp(stay[1:], exact[:-1])), 0.0)
            if n >= EXACT and n & (n - 1) == 0:
                t = np.arange(1, n + 1)
                error = exact - self._saddle(np.full(n, float(n)), t.astype(float))
                error[-1] = error[-2]
                rows.append(np.interp(places * np.log(n), np.log(t), error))
        self.error = np.array(rows)

    def _at(self, way):
        """log g, log z, h = z g' / g and dh / dlog z at z = 1 - exp(-way)."""
        d, z = self.discount, -np.expm1(-way)
        g = -np.expm1(-d * way) / d
        h = z * np.exp((1 - d) * way) / g
        return np.log(g), np.log(z), h, h * (1 + (1 - d) * np.expm1(way) - h)

    def _saddle(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            g, z, _, v = self._at(np.exp(np.interp(np.log(c / t), self.ratio, np.log(self.way))))
            return log_gamma(c + 1) - log_gamma(t + 1) + t * g - c * z - 0.5 * np.log(2 * np.pi * t * v)

    def log(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """log S[c, t] for c above EXACT."""
        c, t = np.broadcast_arrays(np.asarray(c, float), np.asarray(t, float))
        row, place = np.log2(c / EXACT), np.log(t) / np.log(c) * (PLACES - 1)
        i, j = (np.clip(np.floor(x).astype(int), 0, m) for x, m in ((row, len(self.error) - 2), (place, PLACES - 2)))
        e, y = self.error, place - j
        low, high = (e[k, j] * (1 - y) + e[k, j + 1] * y for k in (i, i + 1))
        out = self._saddle(c, t) + low + (high - low) * (row - i)
        out = np.where(t == 1, log_gamma(c - self.discount) - log_gamma(np.array(1 - self.discount)), out)
        return np.where(t == c, 0.0, out)


@lru_cache(maxsize=32)
def numbers_of(discount: float) -> Stirling:
    return Stirling(discount)


#: Points at which the distribution of a large dish's tables is evaluated, and standard deviations to either side.
POINTS, REACH = 65, 7.0
#: Points at which the mode is looked for between two numbers of tables.
GRID = 17
#: Dishes that are drawn at once.
DRAWN = 16_384


def _draw_large(c: np.ndarray, base: np.ndarray, rest: np.ndarray, strength: float, discount: float, numbers: Stirling, rng: np.random.Generator,
                near: np.ndarray | None = None) -> np.ndarray:
    """Tables of large dishes given the others' ``rest``: the exact conditional up to the saddle point, around its mode.

    ``near`` is where the search for the mode begins; the draw doesn't depend on it.

    Where the window is wider than POINTS tables, points stand for steps of equal width.
    """
    out = np.empty(len(c), np.int64)
    for at in range(0, len(c), DRAWN):
        own = slice(at, at + DRAWN)
        n, others = c[own].astype(float)[:, None], rest[own].astype(float)[:, None]
        price = np.log(base[own] * discount)[:, None]

        def weight(t, n=n, others=others, price=price):
            return numbers.log(n, t) + t * price + log_gamma(strength / discount + others + t)

        low, high = np.ones_like(n), n.copy()
        if near is not None:  # brackets the mode from both sides
            t = near[own].astype(float)[:, None]
            left, right = np.floor(t * 0.75), np.minimum(np.ceil(t * 1.25) + 2, n)
            w = weight(np.hstack([np.maximum(left, 1), np.maximum(left - 1, 1), np.minimum(right + 1, n), right]))
            low = np.where((left > 1) & (w[:, :1] > w[:, 1:2]), left, low)
            high = np.where(w[:, 2:3] <= w[:, 3:], right, high)
            low = np.minimum(low, high)
        while (low < high).any():  # the weight rises to its mode and falls from there, so that's between the neighbours of the best
            grid = np.floor(low + (high - low) * np.linspace(0, 1, GRID))
            best = weight(grid).argmax(1)[:, None]
            low, high = (np.where(high - low < GRID, np.take_along_axis(grid, best, 1), np.take_along_axis(grid, np.clip(best + k, 0, GRID - 1), 1)) for k in (-1, 1))
        mode = low
        gap = np.maximum(1.0, np.floor(np.sqrt(mode) / 8))
        a, b = np.maximum(mode - gap, 1), np.minimum(mode + gap, n)
        w = weight(np.hstack([mode, a, b]))
        drop = np.maximum(w[:, :1] - w[:, 1:].min(1, keepdims=True), 1e-6)
        spread = np.maximum(gap / np.sqrt(2 * drop), 1.0)
        step = np.maximum(1.0, np.ceil(2 * REACH * spread / (POINTS - 1)))
        t = mode + step * (np.arange(POINTS) - POINTS // 2)
        fits = (t >= 1) & (t <= n)
        logit = np.where(fits, weight(np.clip(t, 1, n)), -np.inf)
        t = np.take_along_axis(t, (logit + rng.gumbel(size=logit.shape)).argmax(1)[:, None], 1)
        t += np.floor(rng.random(t.shape) * step) - np.floor(step / 2)
        out[own] = np.clip(t, 1, n)[:, 0]
    return out


def discount_of(c: np.ndarray) -> float:
    """The usual estimate from the numbers of things counted once and twice."""
    once, twice = int((c == 1).sum()), int((c == 2).sum())
    return float(np.round(np.clip(once / (once + 2 * twice) if once else 0.5, 0.05, 0.95), 2))


class Level:
    """Dishes of a level of restaurants; ``most`` are the customers that each can have, none where only held-out texts ask for it.

    A dish of one customer has one table for good, so only the others (``at``) are sampled;
    ``alone`` counts the dishes of one customer of each restaurant that has others.
    """

    def __init__(self, most: np.ndarray, u: np.ndarray) -> None:
        self.single, self.at = (most == 1).astype(np.int32), np.nonzero(most > 1)[0]
        names, self.u = np.unique(u[self.at], return_inverse=True)
        self.alone = np.bincount(u, self.single, int(u.max(initial=-1)) + 1)[names].astype(np.int64)
        self.t = np.ones(len(self.at), np.int64)

    def whole(self, values: np.ndarray) -> np.ndarray:
        out = self.single.copy()
        out[self.at] = values
        return out

    def sweep(self, c: np.ndarray, base: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        self.t = sample_tables(c, np.clip(self.t, 1, c), base, self.u, STRENGTH, discount, log_stirling_of(discount), rng, others=self.alone)


def joined(*parts: tuple[np.ndarray, int]) -> np.ndarray:
    """A number for each row of several columns of numbers (each with its bound), in their order and without clashes."""
    out, size = parts[0][0].astype(np.int64), parts[0][1]
    for x, most in parts[1:]:
        if size * most >= MOST:  # only distinct values count then
            names, out = np.unique(out, return_inverse=True)
            size = len(names)
        out = out * most
        out += x
        size *= most
    return out


def _keys(b: np.ndarray, group: np.ndarray, codes: int) -> tuple[np.ndarray, int]:
    """A number for each restaurant of a word, and their bound; most words have group 0 alone."""
    used = np.zeros(codes, bool)
    used[b] = True
    place = np.cumsum(used, dtype=np.int32) - np.int32(1)
    key, keys = place[b], int(place[-1]) + 1
    some = np.nonzero(group)[0]
    names, of = np.unique(joined((b[some], codes), (group[some], int(group.max(initial=0)) + 1)), return_inverse=True)
    key[some] = keys + of
    return key, keys + len(names)


class Shard:
    """The restaurants of some words and of all pairs that end in them, seated from packed tokens.

    Dishes are numbered by the tokens of all texts, held-out ones too, so that every token
    knows its trigram (``of``) and nothing is looked up: a held-out token's has no customers.
    """

    def __init__(self, blobs: list[bytes], known: Frequent) -> None:
        n = sum(struct.unpack_from(HEAD, x)[0] for x in blobs)
        a, b, w, group, text, held = (np.empty(n, kind) for kind in (np.int32, np.int32, np.int32, np.int32, np.int32, bool))
        self.known, self.spans, names, at, before = known, [], [], 0, 0
        for t in map(unpack_codes, blobs):  # into arrays of the whole shard: pieces of it would be held beside them
            own = slice(at, at + len(t.text))
            a[own], b[own], w[own], group[own], text[own], held[own] = t.a, t.b, t.w, t.group, t.text, t.held
            for code in (a[own], b[own], w[own]):
                code[code >= SENT] += before
            self.spans.append((t.run, text[own]))
            names.append(t.rare.copy())
            at, before = own.stop, before + len(t.rare)
        # rare words get codes of the shard
        names, places = np.unique(np.concatenate(names), return_inverse=True)
        for code in (a, b, w):
            some = np.nonzero(code >= SENT)[0]
            code[some] = SENT + places[code[some] - SENT]
        del t, code, some, places
        codes = SENT + len(names)
        key, keys = _keys(b, group, codes)
        del b, group
        # sorted by restaurant, word and the word two before: words after a word, and trigrams of those, lie side by side
        tri = joined((key, keys), (w, codes), (a, codes))
        order = np.argsort(tri)
        tri = tri[order]
        new = np.append(True, tri[1:] != tri[:-1])
        del tri
        first = order[new]
        self.of = np.empty(len(order), np.int32)
        self.of[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
        del order, new
        self.c2 = np.bincount(self.of, ~held, len(first)).astype(np.int32)
        key, w, a = key[first], w[first], a[first]
        del first, held
        self.u2 = np.unique(joined((key, keys), (a, codes)), return_inverse=True)[1].astype(np.int32)
        del a
        self.n2 = np.bincount(self.u2, self.c2)
        new = np.append(True, (key[1:] != key[:-1]) | (w[1:] != w[:-1]))
        self.up = np.cumsum(new, dtype=np.int32) - np.int32(1)
        at = np.nonzero(new)[0]
        key, w = key[at], w[at]
        self.u1 = np.cumsum(np.append(False, key[1:] != key[:-1]), dtype=np.int32)
        del key, new
        used = np.zeros(codes, bool)
        used[w] = True
        used = np.nonzero(used)[0]
        words = _names(used, known, names)
        order = np.argsort(words)
        self.words = words[order]
        place = np.empty(codes, np.int32)
        place[used[order]] = np.arange(len(used))
        self.w1 = place[w]
        del w, used, words, order, place
        children = np.bincount(self.up, self.c2 > 0, len(at)).astype(np.int64)
        self.d2, self.d1 = discount_of(self.c2), discount_of(children)
        self.two = Level(self.c2, self.u2)
        self.one = Level(np.bincount(self.up, self.c2, len(at)).astype(np.int64), self.u1)
        # of the bigrams that are sampled: customers from trigrams of one customer, and their places by trigram
        place = np.full(len(at), -1)
        place[self.one.at] = np.arange(len(self.one.at))
        self.under = place[self.up[self.two.at]]
        self.fixed = children[self.one.at] - np.bincount(self.under, minlength=len(self.one.at))

    def first(self) -> np.ndarray:
        """The parent's probabilities of the shard's words before the root is known: unigrams."""
        rank = self.known.ranks(self.words)
        return np.where(rank >= 0, np.append(self.known.first, 0.0)[rank], self.known.rare)

    def customers(self) -> np.ndarray:
        """Of the bigrams that are sampled: the tables of their trigrams."""
        return self.fixed + np.bincount(self.under, self.two.t, len(self.fixed)).astype(np.int64)

    def sweep(self, p0: np.ndarray, rng: np.random.Generator) -> None:
        """Pairs under their words, then words under ``p0`` (by place in ``words``)."""
        one, two, base = self.one, self.two, p0[self.w1[self.one.at]]
        if not len(one.at):
            return
        c1 = self.customers()
        n = STRENGTH + one.alone + np.bincount(one.u, c1)
        room = (STRENGTH + self.d1 * (one.alone + np.bincount(one.u, one.t))) / n
        parent = (c1 - self.d1 * np.minimum(one.t, c1)) / n[one.u] + room[one.u] * base
        two.sweep(self.c2[two.at], parent[self.under], self.d2, rng)
        one.sweep(self.customers(), base, self.d1, rng)

    def served(self) -> np.ndarray:
        """Tables of each of ``words`` over all restaurants: the root's customers."""
        return np.bincount(self.w1, self.one.whole(self.one.t), len(self.words)).astype(np.int64)

    def predict(self, p0: np.ndarray, burn: int, samples: int, rng: np.random.Generator) -> np.ndarray:
        """Probability of every trigram's word, averaged over the seatings of ``samples`` sweeps after ``burn`` sweeps."""
        for _ in range(burn):
            self.sweep(p0, rng)
        one, two = self.one, self.two
        # the same in every seating: tables of dishes of one customer, and customers of pairs
        alone1, alone2 = np.bincount(self.u1, one.single), np.bincount(self.u2, two.single)
        u1, u2 = self.u1[one.at], self.u2[two.at]
        n2, base = STRENGTH + self.n2, p0[self.w1]
        out, below = np.zeros(len(self.c2)), np.empty(len(base))
        for _ in range(samples):
            self.sweep(p0, rng)
            c1 = self.customers()
            n1 = STRENGTH + alone1 + np.bincount(u1, c1, len(alone1))
            # a context without customers leaves all to its parent
            room1 = (STRENGTH + self.d1 * (alone1 + np.bincount(u1, one.t, len(alone1)))) / n1
            alone = (1 - self.d1) / n1
            for at in range(0, len(below), SAMPLED):  # several arrays as long as the shard would be held at once
                i = slice(at, at + SAMPLED)
                u = self.u1[i]
                below[i] = room1[u] * base[i] + one.single[i] * alone[u]
            below[one.at] += (c1 - self.d1 * one.t) / n1[u1]
            room2 = alone2 + np.bincount(u2, two.t, len(alone2))
            room2 *= self.d2
            room2 += STRENGTH
            room2 /= n2
            for at in range(0, len(out), SAMPLED):
                i = slice(at, at + SAMPLED)
                out[i] += room2[self.u2[i]] * below[self.up[i]]
            del room2
            out[two.at] -= self.d2 * two.t / n2[u2]
        out /= samples
        for at in range(0, len(out), SAMPLED):
            i = slice(at, at + SAMPLED)
            out[i] += (self.c2[i] - self.d2 * two.single[i]) / n2[self.u2[i]]
        return out

    def by_text(self, *values: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Run, texts, and of each text its number of tokens and the sums of their trigrams' ``values``."""
        at = 0
        for run, text in self.spans:
            of = self.of[at:at + len(text)]
            at += len(text)
            begin = np.nonzero(np.append(True, text[1:] != text[:-1]))[0]  # tokens are in order of their texts
            yield run, text[begin], [np.diff(begin, append=len(text)), *(np.add.reduceat(x[of], begin) for x in values)]


@lru_cache(maxsize=128)
def log_stirling_of(discount: float) -> np.ndarray:
    return log_stirling(discount)


TABLES = "shard int, w bigint, t bigint"


def _seat(sent, burn: int, seed: int):
    """First pass: tables of every word of a shard, the words of held-out texts with none."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for number, blobs in _shards(batches):
            give_back()
            shard, rng = Shard(blobs, sent.value), np.random.default_rng((seed, number))
            blobs.clear()
            give_back()
            p0 = shard.first()
            for _ in range(burn):
                shard.sweep(p0, rng)
            n = len(shard.words)
            yield pa.record_batch([pa.array(np.full(n, number, np.int32)), pa.array(shard.words), pa.array(shard.served())], names=["shard", "w", "t"])

    return run


def seat_root(customers: np.ndarray, words: np.ndarray, vocab: int, rng: np.random.Generator, sweeps: int) -> np.ndarray:
    """Probability of a word by its number of customers; ``words`` says how many words have each number.  The first entry is an unseen word's.

    Words of one number are alike to the root: their tables are drawn together, each word's
    given all the other tables from before.
    """
    c, k = np.append(0, customers), np.append(0, words)
    d, base, stirling = ROOT_DISCOUNT, 1.0 / (vocab + 1), log_stirling_of(ROOT_DISCOUNT)
    tables = k.copy()  # in all, of the words of each number
    mean, kept, large = np.zeros(len(c)), 0, np.nonzero(c > EXACT)[0]
    for sweep in range(sweeps):
        total = float(tables.sum())
        for i in np.nonzero((c > 1) & (c <= EXACT))[0].tolist():
            n, t = int(c[i]), np.arange(1, int(c[i]) + 1)
            rest = total - tables[i] / k[i]
            logit = stirling[n, 1:n + 1] + np.cumsum(np.log(STRENGTH + d * (rest + t - 1))) + t * np.log(base)
            p = np.exp(logit - logit.max())
            tables[i] = int((rng.multinomial(int(k[i]), p / p.sum()) * t).sum())
        if len(large):
            others = np.repeat((total - tables[large] / k[large]).astype(np.int64), k[large])
            drawn = _draw_large(np.repeat(c[large], k[large]), np.full(len(others), base), others, STRENGTH, d, numbers_of(d), rng)
            tables[large] = np.bincount(np.repeat(np.arange(len(large)), k[large]), drawn, len(large)).astype(np.int64)
        if sweep >= sweeps // 2:
            mean, kept = mean + tables, kept + 1
    mean /= max(1, kept)
    room = (STRENGTH + d * mean.sum()) * base
    return (c - d * mean / np.maximum(k, 1) + room) / (STRENGTH + float((c * k).sum()))


def _root(vocab: int, sweeps: int, seed: int):
    """(n, words), a row a number of customers, to (n, p); n = 0 is an unseen word."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        rows = [b for b in batches if b.num_rows]
        n, k = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in rows]) if rows else np.empty(0, np.int64) for i in (0, 1))
        n, k = n[n > 0], k[n > 0]  # a row of zeros stands for the table without training texts
        order = np.argsort(n)
        p = seat_root(n[order], k[order], vocab, np.random.default_rng(seed), sweeps)
        yield pa.record_batch([pa.array(np.append(0, n[order])), pa.array(p)], names=["n", "p"])

    return run


# --- scoring ----------------------------------------------------------------

SUMS = "run bigint, sums binary, info binary"


def _score(sent, total: int, vocab: int, burn: int, samples: int, seed: int):
    """Second pass, a shard with its words (w, p, c): sums of each text over the tokens; the infos of runs go on as they are.

    A shard holds about SHARD tokens, or a restaurant of up to PAIR, packed.
    """

    def run(dealt, words):
        import pyarrow as pa

        blobs, rows, number = [], [], None
        for batch in dealt.to_batches():
            for number, kind, blob in zip(*(batch.column(i).to_pylist() for i in (0, 1)), row_binaries(batch.column(2))):
                if kind == 1:
                    blobs.append(blob)
                else:
                    rows.append((struct.unpack_from(HEAD, blob)[2], None, bytes(blob)))
        if blobs:
            give_back()
            shard = Shard(blobs, sent.value)
            del blobs
            give_back()
            w, p, c = (words.column(n).to_numpy() for n in ("w", "p", "c"))
            order = np.argsort(w)
            if not np.array_equal(w[order], shard.words):
                raise RuntimeError("a shard's words are not those of its tokens")
            score = shard.predict(p[order], burn, samples, np.random.default_rng((seed, number)))
            np.log10(score, out=score)
            count, of = c[order], shard.w1[shard.up]
            for run_id, texts, sums in shard.by_text((count > 0).astype(float)[of], np.log10((count + 1.0) / (total + vocab + 1))[of], score):
                rows.append((run_id, pack_sums(texts, sums), None))
        return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["run", "sums", "info"])

    return run


def pack_sums(texts: np.ndarray, sums: list[np.ndarray]) -> bytes:
    """Sums over the tokens of some texts: numbers of tokens, of known ones, base score, score."""
    import zstandard

    body = b"".join(_planes(x) for x in (np.diff(texts, prepend=0), *sums[:2])) + b"".join(x.astype("<f8").tobytes() for x in sums[2:])
    return struct.pack("<i", len(texts)) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack_sums(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    import zstandard

    (n,) = struct.unpack_from("<i", blob)
    body = zstandard.ZstdDecompressor().decompress(blob[4:], max_output_size=28 * n)
    texts, tokens, known = (np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, 4 * n * k).reshape(4, n).T).view("<i4").ravel() for k in range(3))
    return np.cumsum(texts), [tokens, known, *(np.frombuffer(body, "<f8", n, 12 * n + 8 * n * k) for k in (0, 1))]


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _total(batches) -> Iterator:
    """Sums sorted by run to one row a text."""
    import pyarrow as pa

    now, info, parts = None, None, []

    def close():
        n = struct.unpack_from(HEAD, info)[0]
        ids = np.frombuffer(info, "<i8", n, HEAD_BYTES)
        good, held = (np.frombuffer(info, np.uint8, n, HEAD_BYTES + 8 * n + n * k).astype(bool) for k in (0, 1))
        sums = [np.zeros(n) for _ in range(4)]
        for texts, values in map(unpack_sums, parts):
            for to, x in zip(sums, values):
                to[texts] += x
        return pa.record_batch([pa.array(ids.astype(np.int64), mask=~good), pa.array(held), *(pa.array(x.astype(np.int64)) for x in sums[:2]),
                                *map(pa.array, sums[2:])], names=[x.split()[0] for x in SCORED.split(", ")])

    for batch in batches:
        for run, own, about in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if run != now:
                if now is not None:
                    yield close()
                now, info, parts = run, None, []
            if about is not None:
                info = about
            else:
                parts.append(own)
    if now is not None:
        yield close()


def _most_frequent(counts: DataFrame, most: int):
    """Rows of the most frequent words, ``most`` to twice as many (fewer if ties of one count are more): an Arrow table."""
    level = F.floor(F.log2("c") * 16).cast("int")
    at, left = 1 << 30, most
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1,024 levels
        if left - r["count"] < -most:
            break
        at, left = r["level"], left - r["count"]
        if left <= 0:
            break
    return counts.where(level >= at).toArrow()


def language_scores(docs: DataFrame, held_out: Column, sent_words: int = SENT, shard_tokens: int = SHARD, burn: int = BURN, samples: int = SAMPLES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows for which ``held_out`` is false.  ``base_score`` is add-one over
    the training words, ``score`` the model's log10 probability of the text, its end
    included.  A null or empty text is its end alone; a null id counts as training if
    ``held_out`` says so; repeated rows are scored and counted each.  Without training
    texts every word is unseen.  An empty table gives no rows.  The rows are
    read three times, in any order.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "hpylm")
    rows = texts_of(docs, id_col, text_col).select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    counts = ws.keep(rows.where(~F.col("held_out")).mapInArrow(_tally, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    all_ = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count("*").alias("vocab"), F.coalesce(F.sum(F.when(F.col("h") == END, F.col("c"))), F.lit(0)).alias("texts")).first()
    total, vocab, starts = all_["total"], all_["vocab"], all_["texts"]
    top = _most_frequent(counts, sent_words)
    h, c = top.column("h").to_numpy(), top.column("c").to_numpy()
    order = np.lexsort((h, -c))[:min(sent_words, SENT)]
    h, c = h[order], c[order]
    rare = max(1.0, total - c.sum()) / max(1, vocab - len(c))
    sent = spark.sparkContext.broadcast(Frequent(h, c, (c + 1.0) / (total + vocab + 1), float(min(1.0, rare / (total + vocab + 1)))))

    shards = max(1, -(-total // shard_tokens))
    # both passes read this one exchange
    dealt = rows.mapInArrow(_deal(sent, shards, starts), DEALT).repartition(shards, "shard")
    seats = dealt.sortWithinPartitions("shard").mapInArrow(_seat(sent, burn, 5), TABLES)
    # customers of the root and corpus count of each word, wherever it is asked for: a word has a row a shard
    word = Window.partitionBy("w")
    both = seats.withColumn("c", F.lit(0).cast("bigint")).unionByName(counts.select(F.lit(None).cast("int").alias("shard"), F.col("h").alias("w"), F.lit(0).cast("bigint").alias("t"), "c"))
    asked = both.select("shard", "w", F.sum("t").over(word).alias("n"), F.max("c").over(word).alias("c"))
    numbers = asked.where("shard is null and n > 0 and c > 0").groupBy("n").agg(F.count("*").alias("words"))  # a training word once; c keeps the exchange that both sides read
    numbers = numbers.unionByName(spark.range(1).select(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("words")))
    root = numbers.repartition(1).mapInArrow(_root(vocab, burn + samples, 13), "n bigint, p double")
    words = asked.where("shard is not null").join(root, "n").select("shard", "w", "p", "c")
    sums = dealt.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(_score(sent, total, vocab, burn, samples, 7), SUMS)
    scored = sums.repartition("run").sortWithinPartitions("run").mapInArrow(_total, SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")
