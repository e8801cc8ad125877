"""Exact deduplication with Patricia-trie owners.

Plan: every scan task folds its texts into a trie and sends one row per distinct
text (a combiner, so copies never travel twice from one task); rows meet by
(length, content hash); each reducer inserts the full byte strings into its trie
and its terminal nodes name the owner of each group; the documents' digests join
the owners by (length, SHA-256).  A group that holds a third of all rows costs a
reducer one row per scan task, and its join rows are split by AQE's skew join.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rillframe.llm.common import row_binaries, small_batches, texts_of
from rillframe.llm.patricia import PatriciaTrie

#: Bytes of edges that a task's trie holds before it spills a subtree (reducer) or sends its rows on (combiner).
TRIE_BYTES = 32 << 20

DIGEST_SCHEMA = "doc_id bigint, n_bytes bigint, digest binary"
PART_SCHEMA = "n_bytes bigint, part bigint, body binary, low bigint, high bigint, n bigint"
OWNER_SCHEMA = "n_bytes bigint, digest binary, low bigint, high bigint, group_size bigint"
BATCH_BYTES = 4 << 20


def _normalised(batch):
    import pyarrow.compute as pc

    return pc.ascii_lower(batch.column(1).fill_null(""))


def _digests(batches) -> Iterator:
    """One row per document: length and SHA-256 of the normalised text."""
    import hashlib

    import pyarrow as pa

    for batch in batches:
        views = row_binaries(_normalised(batch))
        yield pa.record_batch(
            [batch.column(0), pa.array([len(v) for v in views], pa.int64()),
             pa.array([hashlib.sha256(v).digest() for v in views], pa.binary())],
            names=["doc_id", "n_bytes", "digest"])


def _part_rows(trie: PatriciaTrie) -> Iterator:
    import xxhash

    rows: list[tuple] = []
    size = 0
    for body, o in trie.owners():
        rows.append((len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body, o.low, o.high, o.count))
        size += len(body) + 64
        if size > BATCH_BYTES:
            yield _table(rows)
            rows, size = [], 0
    if rows:
        yield _table(rows)


def _table(rows: list[tuple]):
    import pyarrow as pa

    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                           names=["n_bytes", "part", "body", "low", "high", "n"])


def _combine(batches) -> Iterator:
    """Map side: a trie per task, sent on whenever it is full."""
    trie = PatriciaTrie(1 << 62)
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for doc_id, view in zip(ids, row_binaries(_normalised(batch))):
            trie.insert(bytes(view), doc_id, doc_id, 1)
        if trie.held > TRIE_BYTES:
            yield from _part_rows(trie)
            trie = PatriciaTrie(1 << 62)
    yield from _part_rows(trie)


def _own(batches) -> Iterator:
    """Reduce side: full strings into a radix trie, one owner row per distinct string."""
    import hashlib

    import pyarrow as pa

    trie = PatriciaTrie(TRIE_BYTES)
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in (3, 4, 5)]
        for view, low, high, n in zip(row_binaries(batch.column(2)), *cols):
            trie.insert(bytes(view), low, high, n)
    rows: list[tuple] = []
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    names = ["n_bytes", "digest", "low", "high", "group_size"]
    for body, o in trie.owners():
        rows.append((len(body), hashlib.sha256(body).digest(), o.low, o.high, o.count))
        if len(rows) >= 10_000:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def owners(docs: DataFrame) -> DataFrame:
    """(n_bytes, digest, low, high, group_size): one row per distinct normalised text."""
    parts = docs.mapInArrow(_combine, PART_SCHEMA)
    return parts.repartition("n_bytes", "part").mapInArrow(_own, OWNER_SCHEMA)


def exact_dedup(docs: DataFrame, keep: str = "low", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; a null text counts as
    empty, and empty texts form one group.  ``keep`` names the owner: "low" (the
    smallest identifier) or "high".  A null doc_id never owns a group unless all
    its members have none (then keep_id is null and none of them is kept out).
    Rows repeated with one doc_id are all returned, with the same decision.
    An empty table gives an empty result; other columns are ignored.
    """
    if keep not in ("low", "high"):
        raise ValueError(f"keep must be low or high, not {keep!r}")
    rows = texts_of(docs, id_col, text_col)
    own = owners(rows).select("n_bytes", "digest", F.col(keep).alias("keep_id"), "group_size")
    return rows.mapInArrow(_digests, DIGEST_SCHEMA).join(own, ["n_bytes", "digest"]).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


KEPT_PARTS = PART_SCHEMA + ", payload binary"


def _whole_rows(batch, others: list[int]) -> Iterator[tuple[bytes, int | None, bytes]]:
    """(normalised text, id, payload) of every row; the payload holds its text, where lower-casing changes it, and its other values."""
    import pickle

    texts = batch.column(1).to_pylist()
    values = zip(*(batch.column(i).to_pylist() for i in others)) if others else [()] * batch.num_rows
    for doc_id, view, text, rest in zip(batch.column(0).to_pylist(), row_binaries(_normalised(batch)), texts, values):
        body = bytes(view)
        yield body, doc_id, pickle.dumps((None if text is not None and text.encode() == body else (text,), rest), 5)


def _combine_rows(others: list[int], last: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        def send(trie):
            for batch, payloads in _owner_batches(trie):
                yield pa.record_batch([*batch.columns, pa.array(payloads, pa.binary())], names=[*batch.schema.names, "payload"])

        trie = PatriciaTrie(1 << 62, last=last)
        for batch in batches:
            for body, doc_id, payload in _whole_rows(batch, others):
                trie.insert(body, doc_id, doc_id, 1, payload)
            if trie.held > TRIE_BYTES:
                yield from send(trie)
                trie = PatriciaTrie(1 << 62, last=last)
        yield from send(trie)

    return run


def _owner_batches(trie: PatriciaTrie) -> Iterator[tuple]:
    import xxhash

    rows, payloads, size = [], [], 0
    for body, o in trie.owners():
        rows.append((len(body), xxhash.xxh64_intdigest(body) - (1 << 63), body, o.low, o.high, o.count))
        payloads.append(o.payload)
        size += len(body) + len(o.payload) + 64
        if size > BATCH_BYTES:
            yield _table(rows), payloads
            rows, payloads, size = [], [], 0
    if rows:
        yield _table(rows), payloads


def _own_rows(schema, at: int, last: bool):
    """Reduce side: the owning row of every distinct string; ``schema`` is Arrow's of the table, ``at`` the text's place."""

    def run(batches) -> Iterator:
        import pickle

        import pyarrow as pa

        trie = PatriciaTrie(TRIE_BYTES, last=last)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in (3, 4, 5, 6)]
            for view, low, high, n, payload in zip(row_binaries(batch.column(2)), *cols):
                trie.insert(bytes(view), low, high, n, payload)
        rows, size = [], 0
        for body, o in trie.owners():
            text, rest = pickle.loads(o.payload)
            rows.append((*rest[:at], body.decode() if text is None else text[0], *rest[at:]))
            size += len(body) + 200
            if size > BATCH_BYTES:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def drop_copies(docs: DataFrame, keep: str = "low", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that own their text, with all columns: one row a distinct text.

    Texts are equal and owners chosen as in :func:`exact_dedup`; a row without an
    identifier owns its text only where no row of it has one.  Of rows with one
    identifier and equal texts one stays, the same whatever their order.  Decisions are by text, not
    by identifier, so ids that are null or stand on several texts lose nothing.  Whole rows
    go through the tries, so texts are exchanged once and nothing is joined; a column
    may have any name and type that Arrow knows.  An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if keep not in ("low", "high"):
        raise ValueError(f"keep must be low or high, not {keep!r}")
    small_batches(docs.sparkSession)
    fields, places = docs.schema, range(len(docs.columns))
    # by place: two added columns in front never clash with the table's names
    plain = docs.toDF(*[f"c{i}" for i in places])
    at = fields.names.index(text_col)
    rows = plain.select(F.col(f"c{fields.names.index(id_col)}").cast("bigint").alias("key"), F.col(f"c{at}").cast("string").alias("body"),
                        *[f"c{i}" for i in places if i != at])
    others = list(range(2, len(fields) + 1))
    kinds = StructType([StructField(f"c{i}", StringType() if i == at else f.dataType) for i, f in enumerate(fields)])
    parts = rows.mapInArrow(_combine_rows(others, keep == "high"), KEPT_PARTS)
    kept = parts.repartition("n_bytes", "part").mapInArrow(_own_rows(to_arrow_schema(kinds), at, keep == "high"), kinds)
    return kept.toDF(*fields.names)
