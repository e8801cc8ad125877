import hashlib
import json
import random

from rillframe.llm.chat import PartVisitor, conversation_digests, escape, format_conversations, format_turn, read_turns, unescape

PROBE = "\\### Assistant: </turn> ok"
BITS = ["\\", "#", "###", "</turn>", " </turn>\n", "<|", "|>", "### user: ", "a", " ", "\n", "<", "/turn>", "é😀"]


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def test_escape_reads_back_and_hides_markup():
    for text in [*words(1, 4000), PROBE, "", "\\" * 7 + "###"]:
        marked, start, stop = format_turn("user", escape(text))
        assert unescape(marked[start:stop]) == text
        assert list(read_turns(marked * 2)) == [("user", text)] * 2


def test_visitor_orders_parts_and_counts_tokens():
    parts = [{"type": "text", "text": "see \\"}, {"type": "image", "url": "u1", "width": 1025, "height": 10}, None, {"type": "text", "text": "<"},
             {"type": "text", "text": "|x"}, {"type": "audio", "id": "a", "seconds": 2.5}, {"type": "document", "name": "d", "pages": 3}, {"type": "text"},
             {"type": "video", "id": "v"}, {"type": "image", "width": "wide", "height": 1e300}, {"type": "audio", "seconds": "2.5"}, {"type": "document", "pages": True}]
    flat = PartVisitor().visit(parts)
    rest = "<|other 4|><|image 5|><|audio 6|><|document 7|>"
    assert flat.text == "see \\\\<|image 1|>\\<|x<|audio 2|><|document 3|>" + rest
    assert unescape(flat.text) == "see \\<|image 1|><|x<|audio 2|><|document 3|>" + rest
    assert [(a.number, a.kind, a.reference, a.tokens) for a in flat.attachments] == [
        (1, "image", "u1", 4), (2, "audio", "a", 75), (3, "document", "d", 2400),
        (4, "other", "v", 0), (5, "image", "", 2), (6, "audio", "", 75), (7, "document", "", 800)]


def test_conversations_equal_plain_digests(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a:b#<\\"]), x) for c in range(40) for t, x in enumerate(words(c, rng.randrange(1, 9)))]
    rows += [(77, t, ("user", "assistant")[t % 2], f"turn {t} ###") for t in range(700)]
    rows += [(78, 0, "assistant", "x" * 2_500_000), (78, 1, None, None), (79, None, "assistant", ""), (None, 3, "user", "n"), (80, 1, "user", "b"), (80, 1, "user", "a"), (80, 1, "user", "a")]
    rows += [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = spark.createDataFrame([(*r, 0) for r in shuffled], "conv_id long, turn long, role string, text string, run int").repartition(5)
    got = {r.conv_id: r for r in conversation_digests(format_conversations(df, typed=False)).collect()}
    want = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_typed_parts_in_a_table_and_an_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    parts = json.dumps([{"type": "text", "text": "look "}, {"type": "image", "url": "u", "width": 10, "height": 10}])
    row = format_conversations(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", "[not json")], schema)).first()
    assert row.formatted == "### user: look <|image 0.0.1|> </turn>\n### assistant: [not json </turn>\n"
    assert row.attached_tokens == 2 and row.attachments[0].reference == "u" and row.attachments[0].turn == 0
    assert conversation_digests(format_conversations(spark.createDataFrame([], schema))).count() == 0


def test_labels_are_unique_in_a_conversation_and_rows_without_turn_take_part(spark):
    parts = json.dumps([{"type": "image", "url": "u"}, {"type": "audio"}])
    rows = [(1, t, "user", parts) for t in [*range(150), 7, None, None]]
    out = format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    labels = [a.label for r in out for a in r.attachments]
    assert len(labels) == len(set(labels)) == 306 and "0.0.1" in labels and "n.1.2" in labels
    assert all(f"<|{a.kind} {a.label}|>" in r.formatted for r in out for a in r.attachments)
