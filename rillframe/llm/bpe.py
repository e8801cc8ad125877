"""Byte-level BPE encoding and decoding with a minimal acyclic transducer lexicon.

The words that are frequent in the whole corpus are merged once on the driver and
compiled to a transducer (a bounded file); every task memory-maps it.  Words that
are not in it are merged exactly, many at a time in numpy.  Both fill a bounded
cache of word -> id bytes, so a text is one split and one join.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rillframe.llm.common import Workspace, texts_of

#: Words of the lexicon at most: bounds the driver's work and the broadcast file (about 3 MB).
LEXICON_WORDS = 50_000
#: Cached words of a worker process and their characters, dropped together when either is full (about 80 MB).
CACHE_WORDS, CACHE_CHARS = 400_000, 8 << 20

#: Fixed value: the pre-tokenizer's pattern; White_Space is spelt out because \s means more to Python.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
           r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary file in the JSON form of the tokenizers library.

    A file that asks for more than byte-level merges (a normaliser, a leading space, merges
    left out for whole words, special strings that take in the spaces beside them) is refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        plain = plain and not spec["model"].get("ignore_merges") and not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if not plain:
            raise ValueError(f"{path}: only plain byte-level vocabularies are supported")
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = raw(token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.size = len(self.bytes_of)
        self.byte_id = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right, made = (np.array([vocab[t] for t in side], np.int64) for side in
                             ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left * self.size + right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order.astype(np.int64), made[order]

    NONE = 1 << 40

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (NONE if it doesn't merge) and its place in the tables."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], self.NONE), at

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact merges of each word: its ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_len.setdefault(min(1 << (len(w) - 1).bit_length(), 1 << 30) if len(w) > 24 else len(w), []).append(i)
        for group in by_len.values():
            room = max(1, 400_000 // max(len(words[group[0]]), 1))
            for at in range(0, len(group), room):
                part = group[at:at + room]
                if len(part) == 1 or len(words[part[0]]) > 512:
                    for i in part:
                        out[i] = self._merge_one(words[i])
                else:
                    for i, ids in zip(part, self._merge_many([words[i] for i in part])):
                        out[i] = ids
        return out

    def _merge_many(self, words: list[bytes]) -> list[bytes]:
        n, wide = len(words), max(map(len, words))
        ids = np.full((n, wide), -1, np.int64)
        for r, w in enumerate(words):
            ids[r, :len(w)] = self.byte_id[np.frombuffer(w, np.uint8)]
        live = np.arange(n)
        now = ids
        rank, place = self._ranks(now[:, :-1], now[:, 1:])
        cols = np.arange(wide)
        while wide > 1 and len(live):
            at = rank.argmin(axis=1)
            rows = np.arange(len(live))
            some = rank[rows, at] < self.NONE
            if not some.all():
                ids[live[~some]] = now[~some]
                live, now, rank, place, at = live[some], now[some], rank[some], place[some], at[some]
                rows = rows[:len(live)]
                if not len(live):
                    break
            now[rows, at] = self.made[place[rows, at]]
            take = np.minimum(cols + (cols > at[:, None]), wide - 1)
            now = np.take_along_axis(now, take, 1)
            now[:, -1] = np.where(at == wide - 2, -1, now[:, -1])
            now[:, -1] = -1
            take = np.minimum(cols[:-1] + (cols[:-1] > at[:, None]), wide - 2)
            rank, place = np.take_along_axis(rank, take, 1), np.take_along_axis(place, take, 1)
            rank[:, -1] = self.NONE
            for side in (at - 1, at):  # only the pairs beside the merge are new
                ok = (side >= 0) & (side < wide - 1)
                r, c = rows[ok], side[ok]
                rank[r, c], place[r, c] = self._ranks(now[r, c], now[r, c + 1])
        if len(live):
            ids[live] = now
        counts = (ids >= 0).sum(1)
        flat = ids[ids >= 0].astype("<u4").tobytes()
        ends = (np.cumsum(counts) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _merge_one(self, word: bytes) -> bytes:
        """A heap over a linked list: for a word of any length, n log n."""
        import heapq

        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        pair = self.__dict__.setdefault("_pair", None) or self._table()
        heap = [(pair[k][0], i, k) for i in range(n - 1) if (k := (ids[i], ids[i + 1])) in pair]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = after[i] if ids[i] == k[0] else -1
            if j < 0 or ids[j] != k[1]:
                continue
            ids[i], ids[j] = pair[k][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (k := (ids[a], ids[b])) in pair:
                    heapq.heappush(heap, (pair[k][0], a, k))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _table(self) -> dict:
        left, right = np.divmod(self.keys, self.size)
        self._pair = dict(zip(zip(left.tolist(), right.tolist()), zip(self.rank.tolist(), self.made.tolist())))
        return self._pair

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per process and path."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Encoder:
    """Whole texts to id bytes: lexicon first, exact merges for the rest."""

    def __init__(self, path: str, lexicon: bytes) -> None:
        import regex

        from rillframe.llm.lexicon import Lexicon

        self.vocab, self.lexicon = vocabulary(path), Lexicon(lexicon)
        self.split = regex.compile(PATTERN).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")") if self.vocab.special else None
        self.cache: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """Empty the cache but for the special strings; the pattern cuts those up, so no word is one."""
        self.cache.clear()
        self.chars = 0
        self.cache.update({s: int(i).to_bytes(4, "little") for s, i in self.vocab.special.items()})

    def learn(self, words: set[str]) -> None:
        names = list(words)
        raw = [w.encode() for w in names]
        ranks = self.lexicon.find(raw).tolist()
        rest = [i for i, r in enumerate(ranks) if r < 0]
        for i, r in enumerate(ranks):
            if r >= 0:
                self.cache[names[i]] = self.lexicon.ids_of(r).tobytes()
        for i, ids in zip(rest, self.vocab.merge([raw[i] for i in rest])):
            self.cache[names[i]] = ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Texts are taken in runs of about a million characters, so a batch of long texts stays small."""
        run: list[str] = []
        size = 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size > 1_000_000:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        pieces = [self._pieces(t) for t in texts]
        new: set[str] = set()
        for words in pieces:
            new.update(words)
        unknown = new - self.cache.keys()
        if unknown and (len(self.cache) + len(unknown) > CACHE_WORDS or self.chars > CACHE_CHARS):
            self._forget()
            unknown = new - self.cache.keys()
        if unknown:
            self.chars += sum(map(len, unknown))
            self.learn(unknown)
        get = self.cache.__getitem__
        for words in pieces:
            yield b"".join(map(get, words))

    def _pieces(self, text: str) -> list[str]:
        if self.specials is None or not any(s in text for s in self.vocab.special):
            return self.split(text)
        out: list[str] = []
        for part in self.specials.split(text):
            out += [part] if part in self.vocab.special else self.split(part)
        return out


_encoders: dict[tuple, Encoder] = {}


def encoder_of(path: str, lexicon: bytes) -> Encoder:
    """The process's encoder for this vocabulary and lexicon: its cache outlives a task."""
    key = (path, hashlib.sha256(lexicon).digest())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, lexicon)
    return _encoders[key]


#: Bytes of text that are counted together.
COUNT_BYTES = 12 << 20


def _count(batches) -> Iterator:
    """Words of letters only, as they stand after a space, with counts: one row a word and run of texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def rows(texts: list):
        words = pc.split_pattern(pa.chunked_array(texts, pa.string()).combine_chunks(), " ")
        words = pc.list_slice(words, 1).flatten()
        counts = pc.value_counts(words.filter(pc.utf8_is_alpha(words)))
        return pa.record_batch([counts.field(0), counts.field(1)], names=["word", "n"])

    held, size = [], 0
    for batch in batches:
        held.append(batch.column(0).drop_null())
        size += held[-1].nbytes
        if size > COUNT_BYTES:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The corpus's most frequent space-led words, counted over every text; ties by code point.

    A histogram of the logarithms of the counts finds the level from which about
    ``most`` words are left, so no task sends its own list of candidates.
    """
    ws = Workspace(docs.sparkSession, "lexicon")
    counted = ws.keep(docs.select("text").mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    at, left = 0, most
    for r in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # at most 1,024 levels
        at, left = r["level"], left - r["count"]
        if left <= 0:
            break
    if left <= -most:  # a level with very many words of one rare count: the rarest words gain nothing
        at += 1
    rows = counted.where(level >= at).collect()
    return [w for _, w in sorted((-r["n"], r["word"]) for r in rows)][:most]


def build_lexicon(words: list[str], path: str) -> bytes:
    """Transducer file of the words with their leading space."""
    from rillframe.llm.lexicon import compile_lexicon

    raw = sorted({b" " + w.encode() for w in words})
    return compile_lexicon({w: np.frombuffer(ids, "<u4").tolist() for w, ids in zip(raw, vocabulary(path).merge(raw))})


def _tasks(path: str, lexicon, digests: bool):
    """(doc_id, text, carried columns) to the encoded rows, the carried columns last."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        encoder = encoder_of(path, lexicon.value)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            ids = list(encoder.encode([t or "" for t in batch.column(1).to_pylist()]))
            counts = pa.array([len(b) // 4 for b in ids], pa.int64())
            if digests:
                decoded = [sha(encoder.vocab.decode(np.frombuffer(b, "<u4")).encode()) for b in ids]
                out = {"doc_id": batch.column(0), "n_tokens": counts, "ids_sha256": pa.array(map(sha, ids), pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            else:
                out = {"doc_id": batch.column(0), "n_tokens": counts, "ids": pa.array(ids, pa.binary())}
            yield pa.record_batch([*out.values(), *batch.columns[2:]], names=[*out, *batch.schema.names[2:]])

    return run


def bpe_encode(docs: DataFrame, path: str, most: int = LEXICON_WORDS, digests: bool = False,
               id_col: str = "doc_id", text_col: str = "text", carry: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit), or with ``digests`` the SHA-256 of
    the ids and of the text decoded from them; then the columns ``carry`` names, as they are.

    A null text is encoded as empty (no ids).  The vocabulary's special strings in a
    text become their ids.  Repeated rows all come back; an empty table gives no rows;
    other columns are ignored.
    """
    rows = texts_of(docs, id_col, text_col)
    spark = docs.sparkSession
    lexicon = spark.sparkContext.broadcast(build_lexicon(frequent_words(rows, most), path))
    schema = StructType.fromDDL(DIGESTS if digests else ENCODED)
    if carry:
        if set(carry) & set(schema.names):
            raise ValueError(f"carried columns need other names than {', '.join(schema.names)}")
        also = docs.select(*[c.alias(n) for n, c in carry.items()])
        rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[c.alias(n) for n, c in carry.items()])
        schema = StructType([*schema.fields, *also.schema.fields])
    return rows.mapInArrow(_tasks(path, lexicon, digests), schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give a null text."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if b is None else vocab.decode(np.frombuffer(b, "<u4")) for b in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
