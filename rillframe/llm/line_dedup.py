"""Line deduplication by a segment-partition edit join.

Equal lines are folded first.  A line of length l is cut into TAU + 1 even segments and
indexed under (l, segment number, segment); a line probes the indexes of lengths l - TAU
to l with the substrings that a match within TAU edits can't avoid (the windows of the
multi-match-aware selection).  Lines that meet under a key are compared in blocks: the
parity of their characters bounds the edits from below, banded bit-parallel edit distance
decides.  A pair is taken only at its first common key, so it is counted once.

No pair is emitted for being in a group: a block sends a spanning forest of its links and
a count of links a line.  A key with very many lines is cut into blocks that meet in
separate tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import Workspace, row_binaries, texts_of
from rillframe.llm.components import connected_components
from rillframe.llm.simhash import Forest

#: Edits of near lines; characters a line needs for each edit it may take.
TAU, PER_EDIT = 2, 10
#: Lines of a block; entries of a bucket on average; entries of one key that a task sends to its bucket.
BLOCK, BUCKET, LOCAL = 512, 150_000, 256


def allowed(n: int, tau: int = TAU) -> int:
    """Edits allowed between lines of which the shorter has n characters."""
    return min(tau, n // PER_EDIT)


def segments(n: int, parts: int) -> list[tuple[int, int]]:
    """(start, length) of the even cut of n characters; later segments take the remainder."""
    short, longer = n // parts, n % parts
    out, at = [], 0
    for i in range(parts):
        size = short + (1 if i >= parts - longer else 0)
        out.append((at, size))
        at += size
    return out


def windows(n: int, other: int, tau: int = TAU) -> Iterator[tuple[int, int, int, int]]:
    """(segment, its length, first and last start) of the substrings of n characters that probe length ``other``."""
    gap = n - other
    for i, (at, size) in enumerate(segments(other, tau + 1)):
        low = max(0, at - i, at + gap - (tau - i))
        high = min(n - size, at + i, at + gap + (tau - i))
        if low <= high:
            yield i, size, low, high


def _seed(n: int, i: int) -> int:
    return n * 16 + i


@lru_cache(maxsize=1 << 14)
def _pieces(n: int, tau: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """(seed, first, stop) of the index pieces and of the probe pieces of a line of n characters."""
    index = tuple((_seed(n, i), at, at + size) for i, (at, size) in enumerate(segments(n, tau + 1)))
    probe = tuple((_seed(other, i), at, at + size) for other in range(max(n - tau, tau + 1), n + 1)
                  for i, size, low, high in windows(n, other, tau) for at in range(low, high + 1))
    return index, probe


def _key(seed: int, piece: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(piece, seed)


def keys_of(line: str, tau: int = TAU) -> tuple[list[int], list[int]]:
    """Index keys and probe keys of a line, unsigned."""
    if line.isascii():
        view = memoryview(line.encode())
        return tuple([_key(seed, view[a:b]) for seed, a, b in part] for part in _pieces(len(line), tau))
    return tuple([_key(seed, line[a:b].encode()) for seed, a, b in part] for part in _pieces(len(line), tau))


def first_key(indexed: str, probing: str, tau: int = TAU) -> int | None:
    """The first key under which the probing line finds the indexed one, unsigned."""
    cut = segments(len(indexed), tau + 1)
    for i, size, low, high in windows(len(probing), len(indexed), tau):
        piece = indexed[cut[i][0]:cut[i][0] + size]
        if any(probing.startswith(piece, at) for at in range(low, high + 1)):
            return _key(_seed(len(indexed), i), piece.encode())
    return None


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: a band of bits slides along the diagonal."""
    if abs(len(a) - len(b)) > most:
        return False
    if a == b:
        return True
    if not most:
        return False
    # equal ends don't change the distance
    n, low, high = min(len(a), len(b)), 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a.startswith(b[low:mid], low):
            low = mid
        else:
            high = mid - 1
    a, b, n = a[low:], b[low:], n - low
    low, high = 0, n
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid:len(a) - low] == b[len(b) - mid:len(b) - low]:
            low = mid
        else:
            high = mid - 1
    a, b = a[:len(a) - low], b[:len(b) - low]
    if len(a) < len(b):
        a, b = b, a
    return len(a) <= most or _banded(a, b, most)


_WORD = 64
_ALL = (1 << _WORD) - 1


def _banded(a: str, b: str, most: int) -> bool:
    """Bit-parallel edit distance in a band: the word's top bit lies ``most`` rows below the diagonal.

    ``a`` is at least as long as ``b`` and longer than ``most``.  Vertical steps of the
    present column are bits (up by one, down by one); the word moves down a row a column.
    The score is followed along the top bit, and along a's last row once it is reached.
    """
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    rise, fall = _ALL << (_WORD - most - 1) & _ALL, 0
    score, start, last = most, most + 1 - _WORD, 1 << (_WORD - 2)
    diagonal, hopeless = 1 << (_WORD - 1), 2 * most + len(b) - len(a)
    for j, c in enumerate(b):
        match = where.get(c, 0)
        match = (match << -start if start < 0 else match >> start) & _ALL
        same = ((((match & rise) + rise) ^ rise) | match | fall) & _ALL
        across_up, across_down = (fall | ~(same | rise)) & _ALL, same & rise
        if j < len(a) - most:
            score += not same & diagonal
            if score > hopeless:
                return False
        else:
            score += bool(across_up & last) - bool(across_down & last)
            last >>= 1
        rise, fall = (across_down | ~((same >> 1) | across_up)) & _ALL, (same >> 1) & across_up
        start += 1
    return score <= most


# --- tasks ------------------------------------------------------------------

def digest_of(line: str) -> bytes:
    """Sixteen bytes that stand for a line."""
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def _short(digest: bytes) -> int:
    """62 bits of a digest.  Two lines of one value only cost a comparison: links are decided on texts."""
    return int.from_bytes(digest[:8], "little") >> 2


def _blank(line: str) -> bool:
    return not line.strip()


def _new_lines(batches, least: int) -> Iterator[tuple[bytes, str]]:
    """Lines of at least that many characters, each once a task as far as a bounded memory reaches."""
    seen: set[bytes] = set()
    for batch in batches:
        for text in batch.column(1).to_pylist():
            for line in (text or "").split("\n"):
                if len(line) < least or _blank(line):
                    continue
                digest = digest_of(line)
                if digest not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(digest)
                    yield digest, line


def _occurrences(batches) -> Iterator:
    """(doc_id, pos, digest) of every line; blank lines have no digest."""
    import pyarrow as pa

    for batch in batches:
        ids, pos, digests = [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = (text or "").split("\n")
            ids += [doc_id] * len(lines)
            pos += range(len(lines))
            digests += [None if _blank(x) else digest_of(x) for x in lines]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "pos", "digest"])


ENTRIES = "bucket bigint, keys binary, lines binary"


def _entries(tau: int, buckets: int):
    """Texts to index and probe entries, a row a bucket; ``lines`` holds 62 bits of the line and 1 for a probe.

    Of a key that a task sees very often the first index and probe entries go to the
    bucket and the rest are named at once, in a bucket below 0, so that no bucket has to hold
    them.  A line probes its own segments too, so those first entries already meet.
    """

    def flush(keys: list, lines: list):
        import pyarrow as pa

        k, v = np.array(keys, np.uint64).view(np.int64), np.array(lines, np.int64)
        order = np.lexsort((v, v & 1, k))
        k, v = k[order], v[order]
        new = np.append(True, (k[1:] != k[:-1]) | ((v[1:] ^ v[:-1]) & 1 > 0))[: len(k)]
        start = np.nonzero(new)[0]
        nth = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
        bucket = np.where(nth < LOCAL, (k & 0x7FFFFFFFFFFFFFFF) % buckets, -1)
        order = np.argsort(bucket, kind="stable")
        bucket, k, v = bucket[order], k[order], v[order]
        cut = np.nonzero(np.diff(bucket, prepend=-2))[0]
        ends = np.append(cut[1:], len(k))
        names = np.where(bucket[cut] < 0, -1 - (k[cut] & 0xFFFFF), bucket[cut])  # what is named at once goes anywhere
        return pa.record_batch([pa.array(names), pa.array([k[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()),
                                pa.array([v[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary())], names=["bucket", "keys", "lines"])

    def run(batches) -> Iterator:
        keys: list[int] = []
        lines: list[int] = []
        for digest, line in _new_lines(batches, PER_EDIT):
            index, probe = keys_of(line, tau)
            short = _short(digest) * 2
            keys += index
            lines += [short] * len(index)
            keys += probe
            lines += [short + 1] * len(probe)
            if len(keys) > 1_000_000:
                yield flush(keys, lines)
                keys, lines = [], []
        if keys:
            yield flush(keys, lines)

    return run


#: Entries of a bucket that are held before they are sorted and thinned.
HELD = 1 << 20


def _meetings(batches) -> Iterator:
    """Rows sorted by bucket to the entries whose key has an index and a probe entry of two different lines: (key, short, probe).

    One bucket is held at a time, and of its entries each distinct one once.
    """
    import pyarrow as pa

    def rows(k, v):
        return pa.record_batch([pa.array(k), pa.array(v >> 1), pa.array((v & 1).astype(bool))], names=["key", "short", "probe"])

    def distinct(ks, vs):
        k, v = np.concatenate(ks), np.concatenate(vs)
        order = np.lexsort((v, k))
        k, v = k[order], v[order]
        new = np.append(True, (k[1:] != k[:-1]) | (v[1:] != v[:-1]))  # a line comes from every task that has it
        return k[new], v[new]

    def close(ks, vs):
        k, v = distinct(ks, vs)
        start = np.nonzero(np.append(True, k[1:] != k[:-1]))[0]
        size = np.diff(np.append(start, len(k)))
        probes = np.add.reduceat(v & 1, start)
        # a line always meets itself: two lines at least are needed, one of them indexed and another probing
        ids = np.repeat(np.arange(len(start)), size)
        lines = np.add.reduceat(np.append(True, (k[1:] != k[:-1]) | (v[1:] >> 1 != v[:-1] >> 1)).astype(np.int64), start)
        live = (lines > 1) & (probes > 0) & (probes < size)
        keep = live[ids]
        if keep.any():
            yield rows(k[keep], v[keep])

    now, ks, vs, held, limit = None, [], [], 0, HELD
    for batch in batches:
        raw = [row_binaries(batch.column(i)) for i in (1, 2)]
        for bucket, k, v in zip(batch.column(0).to_pylist(), *raw):
            if bucket != now:
                if ks:
                    yield from close(ks, vs)
                now, ks, vs, held, limit = bucket, [], [], 0, HELD
            k, v = np.frombuffer(k, np.int64).copy(), np.frombuffer(v, np.int64).copy()
            if bucket < 0:
                yield rows(k, v)
                continue
            ks.append(k)
            vs.append(v)
            held += len(k)
            if held > limit:
                k, v = distinct(ks, vs)
                ks, vs, held = [k], [v], len(k)
                limit = max(HELD, 2 * held)
    if ks:
        yield from close(ks, vs)


def _bits(short: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a value in a filter of ``size`` bits, a power of two."""
    return short & (size - 1), (short >> 31) & (size - 1)


def _mark(size: int):
    """Short values to one filter a task."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        bits = np.zeros(size, bool)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False), size):
                bits[at] = True
        yield pa.record_batch([pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["bits"])

    return run


#: Bits of the filter at most (8 MB); beyond it more texts travel, the result is the same.
FILTER_BITS = 1 << 26
#: Tasks that mark the filter: the driver joins as many partial filters, one at a time.
MARKERS = 16


def _fetch(filter_bits):
    """(digest, short, line) of the lines that pass the filter."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        marks = filter_bits.value
        size = len(marks) * 8
        held: list[tuple] = []
        grown = 0

        def rows():
            kinds = (pa.binary(), pa.int64(), pa.string())
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["digest", "short", "line"])

        for digest, line in _new_lines(batches, PER_EDIT):
            short = _short(digest)
            a, b = short & (size - 1), (short >> 31) & (size - 1)
            if marks[a >> 3] >> (a & 7) & 1 and marks[b >> 3] >> (b & 7) & 1:
                held.append((digest, short, line))
                grown += len(line) + 64
                if grown > 4 << 20:
                    yield rows()
                    held, grown = [], 0
        if held:
            yield rows()

    return run


PARITY = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def _parity(line: str) -> int:
    """Bit c is the parity of the characters that are c modulo 64; an edit changes two bits at most."""
    return int(np.bitwise_xor.reduce(PARITY[np.frombuffer(line.encode("utf-32-le"), "<u4") & 63])) if line else 0


MASK = (1 << 64) - 1
BLOCKS = "key bigint, block bigint, rows array<struct<lid:bigint,probe:boolean,line:string>>"
FOUND = "a bigint, b bigint, n bigint"


def _compare(tau: int):
    """Two blocks of one key (the second null: a block with itself) to forest edges (a, b, null) and link counts (a, null, n)."""

    def load(rows):
        return ([x for x in rows.field("lid").to_pylist()], rows.field("probe").to_numpy(zero_copy_only=False).astype(bool), rows.field("line").to_pylist())

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            edges, links = [], {}
            for r, key in enumerate(batch.column(0).to_pylist()):
                lids, probe, lines = load(batch.column(1)[r].values)
                if batch.column(2)[r].is_valid:
                    more = load(batch.column(2)[r].values)
                    half = len(lids)
                    lids, probe, lines = lids + more[0], np.concatenate([probe, more[1]]), lines + more[2]
                else:
                    half = 0
                parity = np.array([_parity(x) for x in lines], np.uint64)
                side = np.arange(len(lids)) >= half
                index, asks = np.nonzero(~probe)[0], np.nonzero(probe)[0]
                size = np.array([len(x) for x in lines])
                ids = np.array(lids)
                forest = Forest(len(lids))
                seat: dict[int, int] = {}
                spot = [seat.setdefault(x, i) for i, x in enumerate(lids)]
                for i in index.tolist():
                    gap = size[asks] - size[i]
                    good = (gap >= 0) & (gap <= tau) & (np.bitwise_count(parity[asks] ^ parity[i]) <= 2 * tau) & (ids[asks] != ids[i])
                    good &= (gap > 0) | (ids[asks] > ids[i])
                    if half:
                        good &= side[asks] != side[i]
                    for j in asks[good].tolist():
                        if first_key(lines[i], lines[j], tau) == key & MASK and within(lines[i], lines[j], allowed(len(lines[i]), tau)):
                            links[lids[i]] = links.get(lids[i], 0) + 1
                            links[lids[j]] = links.get(lids[j], 0) + 1
                            if forest.join(spot[i], spot[j]):
                                edges.append((lids[i], lids[j]))
            yield pa.record_batch([pa.array([a for a, _ in edges] + list(links), pa.int64()), pa.array([b for _, b in edges] + [None] * len(links), pa.int64()),
                                   pa.array([None] * len(edges) + list(links.values()), pa.int64())], names=["a", "b", "n"])

    return run


# --- operator ---------------------------------------------------------------


def line_classes(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, digest, blank, owner_doc, owner_pos, n_links) of every line.

    Lines are in one class when they are equal or joined by links of at most ``tau``
    edits (fewer for short lines: one for each ``PER_EDIT`` characters of the shorter).
    The owner is the class's first occurrence by (doc_id, pos), null ids last; n_links
    counts the different lines that link to this one.  Blank lines are in no class.  A
    null text is one empty line.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    texts = texts_of(docs, id_col, text_col)
    lines = ws.keep(texts.mapInArrow(_occurrences, "doc_id bigint, pos int, digest binary"), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "pos")
    owners = lines.where("digest is not null").groupBy("digest").agg(F.min(place).alias("owner"))

    # which lines meet under a key, without texts; then the texts of those alone
    buckets = max(8, lines.count() * 15 // BUCKET)
    live = ws.keep(texts.mapInArrow(_entries(tau, buckets), ENTRIES).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meetings, "key bigint, short bigint, probe boolean").distinct(), "live")
    size = 1 << 14
    while size < min(FILTER_BITS, 8 * live.count()):
        size *= 2
    marks = np.zeros(size // 8, np.uint8)
    for r in live.select("short").distinct().repartition(MARKERS).mapInArrow(_mark(size), "bits binary").toLocalIterator():
        marks |= np.frombuffer(bytes(r["bits"]), np.uint8)
    fetched = texts.mapInArrow(_fetch(spark.sparkContext.broadcast(marks.tobytes())), "digest binary, short bigint, line string")
    some = ws.keep(fetched.join(live.select("short").distinct(), "short", "left_semi").dropDuplicates(["digest"])
                   .select(F.monotonically_increasing_id().alias("lid"), "digest", "short", "line"), "some")

    cuts = live.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("cut"))
    blocks = ws.keep(
        live.join(cuts, "key").join(some.select("lid", "short", "line"), "short").groupBy("key", F.pmod(F.xxhash64("lid"), "cut").alias("block"), "cut")
        .agg(F.sort_array(F.collect_list(F.struct("lid", "probe", "line"))).alias("rows")), "blocks")
    none = F.lit(None).cast("array<struct<lid:bigint,probe:boolean,line:string>>")
    cut_up = blocks.where("cut > 1").select("key", F.col("block").alias("block2"), F.col("rows").alias("rows2"))
    pairs = blocks.select("key", "rows", none.alias("rows2")).unionByName(
        blocks.where("cut > 1").join(cut_up, "key").where("block < block2").select("key", "rows", "rows2"))
    found = ws.keep(pairs.mapInArrow(_compare(tau), FOUND), "found")
    comp = connected_components(found.where("b is not null").select("a", "b"), ws)
    counted = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    members = comp.join(some.select(F.col("lid").alias("node"), "digest"), "node").join(owners, "digest")
    firsts = members.groupBy("component").agg(F.min("owner").alias("first"))
    near = members.select("node", "digest", "component").join(firsts, "component").join(counted, "node", "left").select("digest", "first", "n_links")
    # written, so that both sides of the last join are plain exchanges and AQE can split a line that is everywhere
    classes = ws.keep(owners.join(near, "digest", "left").select(
        "digest", F.coalesce("first", "owner").alias("owner"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    return lines.join(classes, "digest", "left").select(
        "doc_id", "pos", "digest", F.col("digest").isNull().alias("blank"), F.col("owner.doc_id").alias("owner_doc"), F.col("owner.pos").alias("owner_pos"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _kept():
    return F.col("blank") | (F.col("doc_id").eqNullSafe(F.col("owner_doc")) & (F.col("pos") == F.col("owner_pos")))


def line_dedup(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per doc_id: n_lines, n_kept, n_links, class_id.

    n_kept counts the lines that stay: blank ones and the owners of their classes.
    n_links sums the links of the document's lines.  class_id is the smallest doc_id
    that owns a class of one of its lines (its own id if all are blank).  Rows with one
    doc_id are one document (null ids too); their equal lines at one place stay together.
    An empty table gives no rows.
    """
    return line_classes(docs, tau, id_col, text_col).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(_kept()).alias("n_kept"), F.sum("n_links").alias("n_links"), F.min("owner_doc").alias("class_id"),
    ).withColumn("class_id", F.coalesce("class_id", "doc_id"))


def _row_lines(batches) -> Iterator:
    """(row, doc_id, text) to (row, doc_id, pos, digest) of the lines that aren't blank."""
    import pyarrow as pa

    for batch in batches:
        out = [(row, doc_id, pos, digest_of(x)) for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns))
               for pos, x in enumerate((text or "").split("\n")) if not _blank(x)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["row", "doc_id", "pos", "digest"])


def _without(batches) -> Iterator:
    """(doc_id, text, gone) to the text without the lines at the places ``gone``."""
    import pyarrow as pa

    for batch in batches:
        out = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            places = set(gone or ())
            out.append("\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in places))
        yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def drop_lines(docs: DataFrame, tau: int = TAU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row without the lines that another occurrence owns.

    Rows of one id (or of none) are one document, as in :func:`line_dedup`: the line that
    owns its class stays in each of them that has it at the owner's place.  A text all of
    whose lines go is empty, a null text is the empty text, an empty table gives no rows;
    other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "kept")
    rows = ws.keep(texts_of(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "rows")
    gone = line_classes(rows, tau).where(~_kept()).select("doc_id", "pos", "digest").distinct()
    each = rows.mapInArrow(_row_lines, "row bigint, doc_id bigint, pos int, digest binary").alias("e")
    same = F.col("e.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("e.pos") == F.col("g.pos")) & (F.col("e.digest") == F.col("g.digest"))
    places = each.join(gone.alias("g"), same, "left_semi").groupBy("row").agg(F.collect_list("pos").alias("gone"))  # a row's own lines
    return rows.join(places, "row", "left").select("doc_id", "text", "gone").mapInArrow(_without, "doc_id bigint, text string")
