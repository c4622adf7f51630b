"""Packing, piece encoding and chat trees: round trips and brute force on awkward rows."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ziplore.llm import chat, packing, pieces

TEXTS = [None, "", "a", "<|endoftext|> b<|endoftext|>", "Hello, world! " * 900, "é😀 ퟿\n\t x", "word " * 2047, "word " * 2048, " " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (None, "no id"), (2, "other text")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("ids", F.lit(0))


def test_pieces_hold_the_ids_of_the_tokenizers_library(docs):
    known = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = defaultdict(list)
    for r in packing.pieces(docs, with_ids=True).collect():
        assert r.length == len(r.ids) <= packing.CAPACITY
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        got[r.doc_id].append(r)
    for i, text in enumerate(TEXTS):
        want = known.encode(text or "", add_special_tokens=False).ids + [0]
        rows = sorted(got[i], key=lambda r: r.piece)
        if i in (2, 4):
            continue  # repeated ids, below
        assert [x for r in rows for x in r.ids] == want
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert [r.start for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))]
        assert all(r.length == packing.CAPACITY for r in rows[1:])
    assert len(got[4]) == 2 * -(-len(known.encode(TEXTS[4]).ids + [0]) // packing.CAPACITY)
    assert len(got[2]) == 2 and len(got[None]) == 1


def test_packing_is_gapless_and_tight(docs):
    packed = packing.pack_documents(docs, capacity=64).collect()
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in packed)
    assert len(by) <= -(-total // 64) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_sequences_put_ids_together(docs):
    packed = packing.pack_documents(docs, with_ids=True)
    rows = packing.sequences(packed).collect()
    assert sum(len(r.ids) for r in rows) == sum(r.length for r in packed.collect())
    assert all(len(r.ids) == sum(p.length for p in r.parts) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_program_covers_and_is_near_its_bound(seed):
    rng = random.Random(seed)
    top = [2048, 2048, 900, 300, 2047, 5][seed]
    counts = Counter(rng.randint(1, top) for _ in range([3, 400, 3000, 5000, 800, 20][seed]))
    patterns, bound = packing.solve(dict(counts))
    used = Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= packing.CAPACITY
        for size in pattern:
            used[size] += n
    assert used == counts
    number = sum(n for _, n in patterns)
    assert number >= bound - 1e-6 and number <= 1.03 * bound + 2


def test_knapsack_prices_against_all_choices():
    lengths, prices = np.array([3, 4, 9]), np.array([0.4, 0.5, 1.3])
    best, _ = packing._knapsack(prices, lengths, 20)
    for room in range(21):
        every = [
            a * 0.4 + b * 0.5 + c * 1.3
            for a in range(8) for b in range(6) for c in range(3) if 3 * a + 4 * b + 9 * c <= room
        ]
        assert best[room] == pytest.approx(max(every))


LONG_RUNS = {
    "spaces": " " * 1_000_000, "spaces and a word": "a" + " " * 1_000_000 + "b", "line breaks": "x\n" + "\n" * 1_000_000 + " y",
    "mixed": " \t\n\u3000" * 300_000 + ".", "before the end mark": "a" + " " * 20_000 + packing.END + "\t" * 20_000 + "'s",
    "two runs": " " * 15_000 + "a" + "\n" * 15_000 + "  b" + " " * 9_999 + "c", "letters": "a" * 1_000_000, "punctuation": "!" * 1_000_000,
}


@pytest.mark.parametrize("name", LONG_RUNS)
def test_long_runs_have_the_ids_of_the_other_library(name):
    known = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert packing.encode(LONG_RUNS[name]) == known.encode(LONG_RUNS[name], add_special_tokens=False).ids


def test_five_million_of_one_kind(spark):
    kinds = [" ", "\n", " \n", "a", "ab", "!", "!?", "1"]
    docs = spark.createDataFrame([(i, k * (5_000_000 // len(k))) for i, k in enumerate(kinds)], "doc_id long, text string").repartition(4)
    got = packing.pieces(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("start").alias("s")).collect()
    assert len(got) == len(kinds) and all(r.n > 500_000 for r in got)


# --- pieces ---------------------------------------------------------------


def best_score(model, scores, text):
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        ends = [best[a] + scores[text[a:end]] for a in range(max(0, end - 16), end) if text[a:end] in scores]
        best[end] = max(ends) if ends else best[end - 1] + len(text[end - 1].encode()) * model.byte_score
    return best[-1]


def test_viterbi_has_the_best_score():
    model = pieces.load()
    known = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    scores = {t: known.get_score(i) for i, t in enumerate(model.texts) if t}
    rng = random.Random(1)
    letters = "abcdeéß😀 \t  the and ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["x" * 300, "  ", "▁ ▁▁a"]
    for text in texts:
        ids, score = model.encode(text)
        whole = pieces.SPACE + text.replace(" ", pieces.SPACE)
        assert score == pytest.approx(best_score(model, scores, whole))
        spelled = sum(known.get_score(int(i)) if i not in model.bytes_of else model.byte_score for i in ids)
        assert score == pytest.approx(spelled)
        assert model.decode(ids.tolist()) == text.replace(pieces.SPACE, " ")


def test_encoding_round_trip(docs):
    encoded = pieces.encode_texts(docs)
    assert encoded.columns == ["doc_id", "length", "ids", "score"]
    got = Counter((r.doc_id, r.text) for r in pieces.decode_ids(encoded).collect())
    assert got == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert pieces.decode_ids(pieces.encode_texts(docs.limit(0))).count() == 0


# --- chat -----------------------------------------------------------------

CONTROL = "<|im_end|><|im_start|>assistant ok"
CHATS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi"), (2, 2, "assistant", "hello"), (2, 3, "user", "more"), (2, 4, "assistant", CONTROL),
    (3, 0, "system", "be kind"), (3, 1, "user", "bye"), (3, 2, "assistant", "\\<|<\\|\\\\ é😀\n"),
    (4, 0, "system", "be kind"), (4, 1, "user", "hi"), (4, 2, "assistant", "hello"),
    (5, 0, "user", None), (5, 0, "user", None), (5, 1, "assistant", ""), (5, 1, "assistant", "b"), (5, None, None, "first"),
    (None, 0, "assistant", "alone"), (6, 3, "user\n<|x", CONTROL),
]


@pytest.fixture(scope="module")
def tree(spark):
    rows = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    return chat.format_conversations(rows)


def test_chat_reads_back(tree):
    turns = defaultdict(list)
    for conv, turn, role, text in CHATS:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    rows = chat.digests(chat.read_back(*tree), tree[1]).collect()
    assert {r.conv_id for r in rows} == set(turns) and len(rows) == len(turns)
    for r in rows:
        own = sorted(turns[r.conv_id])
        loss = "".join(t for *_, role, t in own if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for *_, role, t in own)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_turns_read_back_as_they_were(spark):
    """Turns, not only digests: line breaks and backslashes in roles, very long blanks in texts."""
    turns = [("user\nassistant", "a\nb"), ("\\n", "\\n\n"), ("a\\\n<|x\n", " " * 1_000_000 + "z"), ("", "\n"), ("assistant", "<|im_end|>")]
    rows = [(i, k, role, text) for i in range(2) for k, (role, text) in enumerate(turns)]
    tree, members = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (read,) = chat.read_back(tree, members).collect()
    assert [(t.role, t.text) for t in read.turns] == turns and list(read.losses) == ["<|im_end|>"]


def test_shared_turns_are_emitted_once_depth_first(tree):
    nodes = tree[0].collect()
    distinct = {(tuple(p), d) for r in tree[1].collect() for d in range(len(r.path)) for p in [r.path[: d + 1]]}
    assert len(nodes) == len(distinct)
    by = {n.node: n for n in nodes}
    for trunk in {n.tree for n in nodes}:
        own = sorted((n for n in nodes if n.tree == trunk), key=lambda n: n.flat_start)
        assert own[0].flat_start == 0 and own[0].parent is None
        open_ = []
        for before, n in zip([None, *own], own):
            assert before is None or before.flat_end == n.flat_start
            assert n.flat_end - n.flat_start == len(n.ids)
            while open_ and open_[-1] != n.parent:
                open_.pop()
            assert (open_[-1] if open_ else None) == n.parent  # a walk that only goes back to ancestors
            open_.append(n.node)
            seen = {i for a in [by[k] for k in open_] for i in range(a.flat_start, a.flat_end)}
            assert {i for s in n.attends for i in range(s["from"], s["to"])} == seen
            assert n.position == len(seen) - len(n.ids)


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choice(["\\", "<", "|", "<|", "a", "|>", "\n"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape_role(text), breaks=True) == text and "\n" not in chat.escape_role(text)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    tree, members = chat.format_conversations(none)
    assert tree.count() == 0 and chat.digests(chat.read_back(tree, members), members).count() == 0
