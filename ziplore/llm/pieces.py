"""SentencePiece encoding and decoding with a given piece model.

An Aho-Corasick automaton over the pieces goes through the text once. At every
position the automaton's output links name all pieces that end there, and each
relaxes the best score of that position from the one where it starts. A
character that no piece covers falls back to its bytes, at a penalty below the
least piece score.

White space is written as ``▁`` with one in front of the text, as the model
asks. No piece of the model holds ``▁`` after another character (this is
checked when it is loaded), so no piece crosses into a word from the one before
and the best path of a text is that of its words in a row. Words repeat, so
their paths are kept per task, in a bounded table.

Defined results: a null or empty text has no ids and score 0; ties go to the
longer piece; repeated rows are encoded each; very long texts take memory in
proportion; an empty table gives an empty result. Columns of the input that
clash with those added are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
MODEL = "piece_bpe_32k.model"
#: How far below the least piece score a byte stands.
BYTE_PENALTY = 10.0
#: Words whose paths a task keeps.
KEPT_WORDS = 300_000
#: Longest word that is kept.
KEPT_LENGTH = 64

_models: dict = {}


class Pieces:
    """Pieces, scores and the automaton over them."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int]):
        import ahocorasick

        self.texts, self.byte_ids = pieces, byte_ids
        self.bytes_of = {i: b for b, i in enumerate(byte_ids)}
        self.automaton = ahocorasick.Automaton()
        least = 0.0
        for i, (piece, score) in enumerate(zip(pieces, scores)):
            if piece:
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"piece {piece!r} crosses words")
                self.automaton.add_word(piece, (len(piece), score, i))
                least = min(least, score)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.byte_score = least - BYTE_PENALTY
        self.letters = {piece for piece in pieces if len(piece) == 1}
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[byte_ids] = True
        self.kept: dict[str, tuple[bytes, float]] = {}

    def best_path(self, word: str) -> tuple[list[int], float]:
        """Ids and score of the best segmentation: one pass, relaxing over all pieces ending at each place."""
        n = len(word)
        if self.letters.issuperset(word):
            # A piece ends at every place, so no place is left to bytes.
            best, sizes, last = [0.0] + [-1e300] * n, [0] * (n + 1), [0] * (n + 1)
            for end, (size, score, i) in self.automaton.iter(word):
                end += 1
                total = best[end - size] + score
                if total > best[end]:
                    best[end], sizes[end], last[end] = total, size, i
            ids, end = [], n
            while end:
                ids.append(last[end])
                end -= sizes[end]
            ids.reverse()
            return ids, best[n]
        best, came = [0.0] + [None] * n, [None] * (n + 1)
        # Matches come in order of their ends, so every start is settled.
        at = 0
        for end, (size, score, i) in self.automaton.iter(word) if len(self.automaton) else ():
            end += 1
            while at + 1 < end:
                at += 1
                self._bytes(word, at, best, came)
            total = best[end - size] + score
            if best[end] is None or total > best[end]:
                best[end], came[end] = total, (size, i)
        while at < n:
            at += 1
            self._bytes(word, at, best, came)
        ids, end = [], n
        while end:
            size, i = came[end]
            if i < 0:
                ids.extend(self.byte_ids[b] for b in reversed(word[end - 1].encode("utf-8", "replace")))
            else:
                ids.append(i)
            end -= size
        return ids[::-1], best[n]

    def _bytes(self, word: str, end: int, best: list, came: list) -> None:
        """Bytes of the last character, where no piece ends."""
        if best[end] is None:
            size = len(word[end - 1].encode("utf-8", "replace"))
            best[end], came[end] = best[end - 1] + size * self.byte_score, (1, -1)

    def encode(self, text: str | None) -> tuple[np.ndarray, float]:
        if not text:
            return np.zeros(0, np.int32), 0.0
        ids: list[bytes] = []
        total, kept = 0.0, self.kept
        for word in _WORD.findall(SPACE + text.replace(" ", SPACE)):
            hit = kept.get(word)
            if hit is None:
                path, score = self.best_path(word)
                hit = array("i", path).tobytes(), score
                if len(word) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = hit
            ids.append(hit[0])
            total += hit[1]
        return np.frombuffer(b"".join(ids), np.int32), total

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no valid text become replacement characters."""
        if not len(ids):
            return ""
        if not self.is_byte[np.asarray(ids)].any():
            return "".join(map(self.texts.__getitem__, ids)).removeprefix(SPACE).replace(SPACE, " ")
        out, pending = [], bytearray()
        for i in ids:
            byte = self.bytes_of.get(i)
            if byte is not None:
                pending.append(byte)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.texts[i])
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        text = "".join(out)
        return text.removeprefix(SPACE).replace(SPACE, " ")


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def load(path: str | None = None) -> Pieces:
    """The model's pieces; control, unknown and unused ones take no part."""
    if path not in _models:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        size = len(model)
        plain = [
            not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)) for i in range(size)
        ]
        by_name = {model.id_to_piece(i): i for i in range(size) if model.is_byte(i)}
        _models[path] = Pieces(
            [model.id_to_piece(i) if plain[i] else "" for i in range(size)],
            [model.get_score(i) for i in range(size)],
            [by_name[f"<0x{b:02X}>"] for b in range(256)],
        )
    return _models[path]


#: Texts that are encoded or decoded together.
SLICE = 500


def _replaced(batch: pa.RecordBatch, names: list[str], more: dict[str, pa.Array]) -> pa.RecordBatch:
    held = [batch.column(batch.schema.get_field_index(n)) for n in names]
    return pa.RecordBatch.from_arrays([*held, *more.values()], names=[*names, *more])


def encode_texts(docs: DataFrame, path: str | None = None, text: str = "text", decoded: str | None = None) -> DataFrame:
    """Replace the text by ``ids`` and the ``score`` of the best segmentation.

    ``decoded`` names a column for the text that the ids decode to, made in the
    same pass.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "ids", "score", decoded)]
    names = [f.name for f in kept]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            found = [model.encode(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            sizes = np.cumsum([0, *(len(ids) for ids, _ in found)])
            ids = pa.array(np.concatenate([ids for ids, _ in found]))
            more = {
                "ids": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), ids),
                "score": pa.array([score for _, score in found], pa.float64()),
            }
            if decoded:
                more[decoded] = pa.array([model.decode(ids.tolist()) for ids, _ in found], pa.string())
            yield _replaced(batch, names, more)

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "ids array<int>", "score double"]
    if decoded:
        fields.append(f"`{decoded}` string")
    return docs.select(*names, text).mapInArrow(encode, ", ".join(fields))


def decode_ids(encoded: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Add the text that ``ids`` stand for."""
    kept = [f for f in encoded.schema.fields if f.name != text]
    names = [f.name for f in kept]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            lists = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            texts = pa.array([model.decode(ids or []) for ids in lists], pa.string())
            yield _replaced(batch, names, {text: texts})

    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"]
    return encoded.select(*names).mapInArrow(decode, ", ".join(fields))
