"""Packing documents into fixed-length token sequences by the sum-of-squares rule.

Every Spark task packs the documents of its own input split, so nothing is shuffled: the token
ids stay where they were made. A task keeps one integer per fill level (the number of partially
filled windows at that level) and the ids of the windows that are still open.

Defined cases: a null or empty text is the end id alone; a document longer than a window fills
whole windows and only its rest is placed; repeated rows are packed as often as they occur; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
#: Text that the vocabulary file of ``tokenizers`` maps to one id of its own.
END_OF_TEXT = "<|endoftext|>"


class Tokenizer:
    """Ids of the byte-level vocabulary file, as the ``tokenizers`` library gives them.

    ``tiktoken`` reads the same vocabulary as ranks about six times faster; a text that its
    pattern engine refuses goes through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding(
            "byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={END_OF_TEXT: len(table)}
        )
        self._vocabulary, self._plain = vocabulary, None
        #: Whether an id begins with a space.
        self.spaced = np.zeros(len(table) + 1, bool)
        self.spaced[[i for token, i in table.items() if token[:1] == b" "]] = True

    def exact(self, text: str) -> np.ndarray:
        if self._plain is None:
            from tokenizers import Tokenizer as Plain

            self._plain = Plain.from_file(self._vocabulary)
        return np.asarray(self._plain.encode(text, add_special_tokens=False).ids, "<u4")

    def ids(self, text: str) -> np.ndarray:
        try:
            return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        except (ValueError, RuntimeError):
            return self.exact(text)


@lru_cache(maxsize=2)
def tokenizer(name: str) -> Tokenizer:
    """``name``: vocabulary name of the installed public tokenizers."""
    import public_tokenizers as public

    return Tokenizer(public.path(f"{name}.json"), public.path(f"{name}.tiktoken"), public.PATTERN)


class Window:
    __slots__ = ("pieces", "fill")

    def __init__(self) -> None:
        self.pieces: list[tuple] = []
        self.fill = 0

    def add(self, piece: tuple) -> None:
        self.pieces.append(piece)
        self.fill += len(piece[2])


class SumOfSquares:
    """Online placement that keeps the squared counts of partially filled windows small.

    ``level[h]`` is the number of open windows filled up to h. A piece of size s goes to the
    level whose change of the sum of squares is smallest, an empty window being level 0; of
    equal changes the fullest window is taken. When more than ``max_open`` windows are open,
    :meth:`settle` cuts the emptiest into the gaps of the fullest, so memory stays bounded for
    any mix of lengths.
    """

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.level = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[Window]] = {}

    def place(self, piece: tuple) -> list[Window]:
        """Windows that are full now."""
        size, cap = len(piece[2]), self.capacity
        if size == cap:
            window = Window()
            window.add(piece)
            return [window]
        level = self.level
        leave = np.where(level[: cap - size + 1] > 0, 1 - 2 * level[: cap - size + 1], np.int64(1) << 60)
        leave[0] = 0
        enter = 2 * level[size:] + 1
        enter[-1] = 0
        change = leave + enter
        at = cap - size - int(np.argmin(change[::-1]))
        if at:
            window = self.open[at].pop()
            level[at] -= 1
        else:
            window = Window()
        window.add(piece)
        if window.fill == cap:
            return [window]
        self.open.setdefault(window.fill, []).append(window)
        level[window.fill] += 1
        return self.settle() if int(level.sum()) > self.max_open else []

    def settle(self, last: bool = False) -> list[Window]:
        """Cut the pieces of the emptiest open windows into the gaps of the fullest.

        At most one window stays partially filled; it is returned only at the end of the task.
        """
        windows = sorted((w for ws in self.open.values() for w in ws), key=lambda w: w.fill)
        self.open, self.level[:] = {}, 0
        full: list[Window] = []
        while len(windows) > 1:
            target, giver = windows[-1], windows[0]
            doc, start, ids, total = giver.pieces.pop()
            room = self.capacity - target.fill
            part = min(room, len(ids))
            target.add((doc, start, ids[:part], total))
            giver.fill -= len(ids)
            if part < len(ids):
                giver.add((doc, start + part, ids[part:], total))
            if target.fill == self.capacity:
                full.append(windows.pop())
            if not giver.fill:
                windows.pop(0)
        for rest in windows:
            if last or rest.fill == self.capacity:
                full.append(rest)
            else:
                self.open[rest.fill] = [rest]
                self.level[rest.fill] = 1
        return full


def pack_documents(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k",
    capacity: int = 2048,
    end_id: int = 1,
    max_open: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit numbers. A sequence is
    made by one task, so ``sequence_id`` is the task's number and a counter.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary)
        packer = SumOfSquares(capacity, max_open)
        made, base = 0, TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def write(windows: list[Window]) -> None:
            nonlocal made
            for window in windows:
                offset = 0
                for doc, start, ids, total in window.pieces:
                    rows.append((doc, start, len(ids), ids.tobytes(), total, base | made, offset))
                    offset += len(ids)
                made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
            )

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                ids = np.append(encode.ids(text), np.uint32(end_id)).astype("<u4", copy=False)
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    write(packer.place((doc, start, ids[start : start + capacity], len(ids))))
                if whole < len(ids):
                    write(packer.place((doc, whole, ids[whole:].copy(), len(ids))))
                if len(rows) >= 4096:
                    yield flush()
        write(packer.settle(last=True))
        yield flush()

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
    )
    return chosen.mapInArrow(pack, PIECES)


def ids_digest(ids: Column) -> Column:
    return F.crc32(ids).alias("ids_crc32")
