"""Vector bin packing of token sequences under simultaneous limits.

A sequence has limits on tokens, segments and loss-bearing tokens.  Each task packs the examples of
its own partition with a bounded buffer, one open sequence at a time: of the buffered examples that
fit, the one with the largest dot product of its demand and the sequence's remaining capacity (each
as a share of the limit) is placed.  When none fits whole, one is cut at the space that is left, so
that sequences fill up; the last sequence of a task is cut at powers of two, which need no padding.
Sequence ids carry the partition number, so no task depends on another and a lost task can be redone
alone.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded
from .wordhash import batches_of_text

END_OF_TEXT = 1
_TRAILING = b".,;:!?%*&$#|()-"


class WordIds:
    """Token ids (little-endian 32 bit) of texts, through a bounded cache of words.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in a
    row.  A word of Latin-1 letters and trailing punctuation is split there too, which the tokenizer
    also does.  The unknown letter stems of a batch are encoded in one call: each is one word to the
    tokenizer, so its ids end at the next id whose token ends a word.  All else is encoded by itself.
    """

    def __init__(self, tokenizer, limit: int = 600_000) -> None:
        self.tokenizer, self.limit = tokenizer, limit
        self.forms: dict[bytes, bytes] = {}
        vocabulary = tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_stems(self, stems: list[bytes]) -> None:
        for a in range(0, len(stems), 5000):
            part = stems[a : a + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            if len(ends) == len(part):
                self.forms.update(zip(part, [raw[b:e] for b, e in zip([0, *ends], ends)]))
            else:
                self.forms.update((stem, self._encode(stem.decode())) for stem in part)

    def _learn(self, words: set[bytes]) -> None:
        stems = [word for word in words if word.isalpha()]
        split, plain = [], []
        for word in words.difference(stems):
            core = word.rstrip(_TRAILING)
            if core.isalpha() or (letters := core.decode()).isalpha() and max(letters) < "\u0100":
                split.append((word, core, word[len(core) :]))
            else:
                plain.append(word)
        stems += {core for _, core, _ in split}.difference(self.forms, stems)
        self._learn_stems(stems)
        tails = {tail: self._encode(tail.decode()) if tail else b"" for tail in {tail for *_, tail in split}}
        forms = self.forms
        for word, core, tail in split:
            forms[word] = forms[core] + tails[tail]
        for word in plain:
            forms[word] = self._encode(word.decode())

    def shrink(self, least: int = 100_000) -> None:
        """Give a large cache's memory back at the end of a task; the worker may serve other work next."""
        if len(self.forms) > least:
            self.forms.clear()

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        # The tokenizer lower-cases too; only its special tokens' strings are read before that.
        rows = [(text if b"<|" in text else text.lower()).split() for text in texts]
        needed = set().union(*rows)
        unknown = needed.difference(self.forms)
        if unknown:
            if len(self.forms) + len(unknown) > self.limit:
                self.forms.clear()
                unknown = needed
            # Learning makes many small objects and no cycles, which the collector would search for again and again.
            collecting = gc.isenabled()
            gc.disable()
            try:
                self._learn(unknown)
            finally:
                if collecting:
                    gc.enable()
        find = self.forms.__getitem__
        return [b"".join(map(find, row)) for row in rows]


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _words[path] = WordIds(Tokenizer.from_file(path))
    return _words[path]


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 2048
    loss_tokens: int = 2048


@dataclass
class Piece:
    """Part of an example; its first ``silent`` tokens bear no loss."""

    example: int | None
    ids: bytes
    start: int
    total: int
    silent: int

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return self.tokens - min(self.silent, self.tokens)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.example, self.ids[: 4 * n], self.start, self.total, min(self.silent, n)),
            Piece(self.example, self.ids[4 * n :], self.start + n, self.total, max(0, self.silent - n)),
        )


class Packer:
    """Packs a stream of pieces.  At least ``room`` pieces wait, and enough to use up one of the limits twice, before a sequence is filled."""

    def __init__(self, limits: Limits, room: int = 192) -> None:
        self.limits, self.room = limits, room
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        #: Demands that wait, each once, and the pieces that have them.
        self.demand = np.zeros((256, 3))
        self.held: list[list[Piece]] = []
        self.place: dict[tuple[int, int], int] = {}
        self.waiting = self.tokens = self.loss = 0

    def _enough(self) -> bool:
        limits = self.limits
        return self.waiting >= self.room and (self.tokens >= 2 * limits.tokens or self.waiting >= 2 * limits.segments or self.loss >= 2 * limits.loss_tokens)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece.tokens > self.limits.tokens or piece.loss > self.limits.loss_tokens:
            head, piece = piece.cut(min(self.limits.tokens, piece.silent + self.limits.loss_tokens))
            yield [head]
        if piece.tokens:
            self._wait(piece)
        while self._enough():
            yield self._fill()

    def _wait(self, piece: Piece) -> None:
        key = (piece.tokens, piece.loss)
        self.waiting, self.tokens, self.loss = self.waiting + 1, self.tokens + key[0], self.loss + key[1]
        if key not in self.place:
            self.place[key] = len(self.held)
            if len(self.held) == len(self.demand):
                self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
            self.demand[len(self.held)] = (key[0], 1, key[1])
            self.held.append([])
        self.held[self.place[key]].append(piece)

    def _take(self, i: int) -> Piece:
        piece = self.held[i].pop()
        key = (piece.tokens, piece.loss)
        self.waiting, self.tokens, self.loss = self.waiting - 1, self.tokens - key[0], self.loss - key[1]
        if not self.held[i]:
            del self.place[key]
            last = self.held.pop()
            if i < len(self.held):
                self.held[i], self.demand[i] = last, self.demand[len(self.held)]
                self.place[last[0].tokens, last[0].loss] = i
        return piece

    def _fill(self) -> list[Piece]:
        left, chosen = self.caps.copy(), []
        weight = 1 / self.caps**2
        while self.held:
            demand = self.demand[: len(self.held)]
            gain = np.where((demand <= left).all(axis=1), demand @ (left * weight), -1.0)
            best = int(gain.argmax())
            if gain[best] < 0:
                break
            times = 1
            if len(self.held) == 1:
                # one demand waits: it is the best until it no longer fits
                own = demand[0]
                times = min(len(self.held[0]), int((left[own > 0] // own[own > 0]).min()))
            left -= demand[best] * times
            chosen += [self._take(best) for _ in range(times)]
        if self.held and left[1] >= 1 and left[0] > 0:
            longest = int(self.demand[: len(self.held), 0].argmax())
            piece = self.held[longest][-1]
            space = int(min(left[0], piece.silent + left[2]))
            if 0 < space < piece.tokens:
                head, tail = self._take(longest).cut(space)
                chosen.append(head)
                self._wait(tail)
        return chosen

    def rest(self) -> Iterator[list[Piece]]:
        while self.held:
            filled = self._fill()
            if self.held or sum(p.tokens for p in filled) == self.limits.tokens:
                yield filled
            else:
                yield from powers_of_two(filled)


def powers_of_two(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Splits one sequence at the binary digits of its length, the largest first."""
    left = sum(p.tokens for p in pieces)
    todo = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        part: list[Piece] = []
        while size:
            piece = todo.pop()
            if piece.tokens > size:
                piece, tail = piece.cut(size)
                todo.append(tail)
            part.append(piece)
            size -= piece.tokens
        yield part


_FIELDS = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()),
]
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _rows(sequences: list[list[Piece]], first: int, with_ids: bool) -> pa.RecordBatch:
    rows = []
    for n, pieces in enumerate(sequences):
        offset = 0
        for p in pieces:
            rows.append((p.example, p.start, p.tokens, crc32(p.ids), p.total, first + n, offset, p.loss))
            offset += p.tokens
    arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(_FIELDS), _FIELDS)]
    names = [n for n, _ in _FIELDS]
    if with_ids:
        arrays.append(pa.array([np.frombuffer(p.ids, "<u4").astype(np.int32) for s in sequences for p in s], pa.list_(pa.int32())))
        names.append("ids")
    return pa.record_batch(arrays, names=names)


def instruction_examples(conversations: DataFrame) -> DataFrame:
    """``doc_id`` (the conv_id), ``prompt`` and ``text`` of each assistant turn: the text of the turn before it, and its own.

    Turns meet by conversation and number, so that no conversation is gathered.  Of rows that repeat a turn
    one stays as a prompt; turns without number or conversation, and first turns, have no prompt.
    """
    key = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    turns = conversations.select(*key, F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    before = turns.groupBy("conv_id", (F.col("turn") + 1).alias("turn")).agg(F.min("text").alias("prompt"))
    return turns.where("role = 'assistant'").join(before, ["conv_id", "turn"], "left").select(F.col("conv_id").alias("doc_id"), "prompt", "text")


def pack_documents(
    docs: DataFrame, tokenizer_path: str, limits: Limits = Limits(), silent: str | None = None, prompt: str | None = None, with_ids: bool = False
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]``.

    A document's ids are its tokenizer ids and then ``END_OF_TEXT``; pieces of a document tile it, and
    pieces of a sequence tile the sequence from 0.  ``prompt`` names a column of text whose ids come first
    and bear no loss (see :func:`instruction_examples`), ``silent`` one with the number of leading tokens that
    bear none; without either all tokens do.

    Null and empty texts count as empty: one token.  Very long texts are cut into full sequences.
    Rows with a repeated or null doc_id are packed as examples of their own.  An empty table gives no
    rows.  Other columns are ignored.  Which pieces share a sequence depends on how the table is
    partitioned; the ids that a document has do not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = word_ids(tokenizer_path), Packer(limits)
        end = np.array([END_OF_TEXT], "<u4").tobytes()
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        done: list[list[Piece]] = []
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for a, b in batches_of_text(batch.column(1), 2 << 20):
                silents = batch.column(2).slice(a, b - a).to_pylist()
                encoded = words.of([t or b"" for t in texts.slice(a, b - a).to_pylist()])
                if prompt:
                    asked = words.of([t or b"" for t in batch.column(3).slice(a, b - a).cast(pa.large_binary()).to_pylist()])
                    silents = [max(quiet or 0, len(ids) // 4) for quiet, ids in zip(silents, asked)]
                    encoded = [first + second for first, second in zip(asked, encoded)]
                for example, ids, quiet in zip(batch.column(0).slice(a, b - a).to_pylist(), encoded, silents):
                    ids += end
                    done += packer.add(Piece(example, ids, 0, len(ids) // 4, max(0, quiet or 0)))
                if done:
                    yield _rows(done, sequence, with_ids)
                    sequence += len(done)
                    done = []
        done = list(packer.rest())
        if done:
            yield _rows(done, sequence, with_ids)
        words.shrink()

    quiet = F.col(silent).cast("long") if silent else F.lit(0).cast("long")
    rows = bounded(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), quiet.alias("silent"), *([F.col(prompt).cast("string").alias("prompt")] if prompt else [])
    )
    return rows.mapInArrow(run, _DDL + (", ids array<int>" if with_ids else ""))
