"""Vector bin packing of token sequences with a dot-product heuristic.

Every example has a demand vector (tokens, segments, loss-bearing tokens); every
sequence has a capacity vector.  Each step places the waiting example whose demand
has the largest dot product with the sequence's free capacity, so an example fills
the dimension that has most room.  A long example is dealt into full sequences that
take its prompt and its answer in proportion, so that no sequence runs out of one
dimension early; a gap too large to pad is filled by cutting one waiting example.
Each task packs what it reads (no shuffle), with a bounded number of waiting examples,
so memory does not grow with the table.

Null text counts as empty (its end id alone); repeated rows are packed each; ties go to
the example that came first.  A very long text is read alone and cut freely.  An empty
table gives no rows; columns other than doc_id, text and the prompt's are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm import shared
from evidra.llm.tokens import MEMO, encoder, ids_crc32


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold, and how packing trades padding against cuts."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 1792
    waiting: int = 2048  #: examples a task keeps waiting at most
    pad: int = 4  #: a gap of so many tokens is padded rather than filled by a cut


GONE = 1e18  #: the size of a place whose example is taken


@dataclass(frozen=True)
class Held:
    """What a task holds at once: bytes of text that are encoded together, and words whose ids it remembers."""

    text_bytes: int = 8_000_000
    words: int = MEMO
    trim: bool = False  #: whether memory that a batch took is given back before the next


@dataclass
class Piece:
    doc: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    prompt: int  #: tokens of the example that bear no loss, counted from its start

    def loss(self, length: int | None = None) -> int:
        end = self.start + (len(self.ids) if length is None else length)
        return max(0, end - max(self.start, self.prompt))

    def cut(self, length: int) -> tuple[Piece, Piece]:
        head = Piece(self.doc, self.start, self.ids[:length], self.doc_tokens, self.prompt)
        return head, Piece(self.doc, self.start + length, self.ids[length:], self.doc_tokens, self.prompt)

    def fits_loss(self, room: int) -> int:
        """How many leading tokens hold at most ``room`` loss-bearing ones."""
        return min(len(self.ids), max(0, self.prompt - self.start) + room)


class Packer:
    """Places pieces; ``add`` and ``finish`` yield closed sequences as lists of pieces."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.items: list[Piece | None] = []
        self.size = np.zeros((3, limits.waiting + 1))  # tokens, segments, loss-bearing tokens
        self.live = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        whole = self.limits.tokens
        bears = piece.loss()
        free, tail = len(piece.ids) - bears, None
        while free + bears >= whole:
            take = min(bears, self.limits.loss_tokens, max(whole - free, round(whole * bears / (free + bears))))
            if whole - take > free or (0 < take < whole and self.limits.segments < 2):
                break
            if tail is None:
                piece, tail = piece.cut(free)
            head, piece = piece.cut(whole - take)
            part, tail = tail.cut(take)
            free, bears = free - whole + take, bears - take
            yield [p for p in (head, part) if len(p.ids)]
        for p in (piece, tail):
            if p is not None and len(p.ids):
                self._wait(p)
        while self.live > self.limits.waiting:
            for _ in range(max(1, self.limits.waiting // 64)):
                yield self._fill()

    def finish(self) -> Iterator[list[Piece]]:
        while self.live:
            yield self._fill()

    def _wait(self, piece: Piece) -> None:
        if len(self.items) == self.size.shape[1]:
            self._compact()
        self.size[:, len(self.items)] = (len(piece.ids), 1, piece.loss())
        self.items.append(piece)
        self.live += 1

    def _compact(self) -> None:
        keep = [i for i, p in enumerate(self.items) if p is not None]
        self.size[:, : len(keep)] = self.size[:, keep]
        self.items = [self.items[i] for i in keep]
        if len(self.items) == self.size.shape[1]:
            self.size = np.concatenate([self.size, np.zeros_like(self.size)], axis=1)

    def _take(self, i: int) -> Piece:
        piece, self.items[i] = self.items[i], None
        self.size[:, i] = GONE
        self.live -= 1
        return piece

    def _fill(self) -> list[Piece]:
        if self.live and len(self.items) > 2 * self.live:
            self._compact()
        caps = (self.limits.tokens, self.limits.segments, self.limits.loss_tokens)
        free, placed = list(caps), []
        while free[0] > 0 and free[1] > 0 and self.live:
            tokens, segments, loss = self.size[:, : len(self.items)]
            fits = (tokens <= free[0]) & (segments <= free[1]) & (loss <= free[2])
            dot = tokens * (free[0] / caps[0] ** 2) + segments * (free[1] / caps[1] ** 2) + loss * (free[2] / caps[2] ** 2)
            i = int(np.argmax(np.where(fits, dot, -1.0)))
            if not fits[i]:
                break
            free = [f - int(x) for f, x in zip(free, self.size[:, i], strict=True)]
            placed.append(self._take(i))
        if self.live and free[0] > self.limits.pad and free[1] > 0:
            tokens = self.size[0, : len(self.items)]
            i = int(np.argmax(np.where(tokens < GONE, tokens, -1)))
            length = min(free[0], self.items[i].fits_loss(free[2]))
            if 0 < length:
                piece = self._take(i)
                head, rest = piece.cut(min(length, len(piece.ids)))
                placed.append(head)
                if len(rest.ids):
                    self._wait(rest)
        return placed


#: Share of an example that is instruction where the table does not say which part is: plain documents have no roles.
PROMPT = 0.25
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(vocab: str, limits: Limits, share: float, with_ids: bool, held: Held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(vocab), Packer(limits)
        enc.memo = held.words
        first, made, rows = shared.task_partition() << 33, 0, []

        def put(pieces: list[Piece]) -> None:
            nonlocal made
            at = 0
            for p in pieces:
                row = (p.doc, p.start, len(p.ids), ids_crc32(p.ids), p.doc_tokens, first + made, at)
                rows.append((*row, p.ids.astype("<u4").tobytes()) if with_ids else row)
                at += len(p.ids)
            made += 1

        def batch_of() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            columns = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_pydict({n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=False)})
            rows.clear()
            return out

        for batch in shared.small_batches(batches, 2048, "text", held.text_bytes):
            docs = batch.column("doc_id").to_pylist()
            ids, at = enc.flat(batch.column("text"))
            heads = np.diff(enc.flat(batch.column("prompt"), end=False)[1]) if "prompt" in batch.schema.names else (np.diff(at) * share).astype(int)
            for doc, i, j, head in zip(docs, at[:-1].tolist(), at[1:].tolist(), heads.tolist(), strict=True):
                for pieces in packer.add(Piece(doc, 0, ids[i:j].copy(), j - i, min(head, j - i - 1))):
                    put(pieces)
            if len(rows) >= 4096:
                yield batch_of()
            if held.trim:
                shared.give_back()
        for pieces in packer.finish():
            put(pieces)
            if len(rows) >= 4096:
                yield batch_of()
        if rows:
            yield batch_of()
        enc.forget()

    return run


def pack(docs: DataFrame, vocab: str, limits: Limits = Limits(), prompt: str | float = PROMPT, with_ids: bool = False, held: Held = Held()) -> DataFrame:
    """One row per piece of each example of ``docs`` (doc_id, text).

    ``prompt`` names a column with the leading part of the text that bears no loss, or is
    the share of each example's tokens, counted from its start, that does.
    ``held`` trades a task's memory against its speed; the pieces do not depend on it.
    ``with_ids`` adds the piece's token ids as packed little-endian 32-bit integers.
    ``sequence_id`` carries the task's number in its upper bits, so ids are unique
    and a repeated task makes the same ones.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if isinstance(prompt, str):
        columns.append(F.col(prompt).cast("string").alias("prompt"))
    run = _pack(vocab, limits, 0.0 if isinstance(prompt, str) else prompt, with_ids, held)
    return docs.select(*columns).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))
