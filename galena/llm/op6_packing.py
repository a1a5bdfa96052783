"""Packing of tokenised documents into near-equal windows by multiway differencing.

A document's ids end with a separator. Full windows are cut from its front; what
remains is cut into short pieces. Pieces are gathered, task by task, into bounded
groups, and each group is partitioned into windows by the multiway differencing
method of Karmarkar and Karp: every piece starts as a partial partition; the two
partial partitions with the largest imbalance are merged again and again, the
heaviest windows of one with the lightest of the other. A group starts with as
many windows as its tokens need; the count rises whenever a window of the result
exceeds the capacity.

No shuffle, and each task holds one group: memory doesn't depend on the input.
Sequence ids are made from the task's partition, so a task that runs again gives
the same rows.

The ids are those of ``tokenizers``: where a text holds the literal ``<|endoftext|>``,
which the vocabulary file adds as a token, that is its one id (50256).

Defined cases: a null or empty text has the separator alone; a null id is passed
on; repeated rows are packed once each; a document of any length is cut; of pieces
of equal size the first that was read goes first; an empty table gives an empty
result; only ``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from galena.llm._base import release

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: White space of this length overflows the stack of the faster library.
LONG_SPACE = re.compile(r"\s{2048}")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that ``tokenizers`` gives for a byte-level BPE file, without a post-processor's special tokens.

    Tokens that the file adds to the vocabulary are found in the text first, as
    ``tokenizers`` does. The text in between is merged by ``tiktoken`` with the same
    vocabulary and pattern, which gives the same ids in a fifth of the time; a text
    with very long white space, which overflows its stack, by ``tokenizers``.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.added = {str(t.content): k for k, t in self.slow.get_added_tokens_decoder().items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        odd = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
        vocab = self.slow.get_vocab(with_added_tokens=False)
        ranks = {bytes(byte[c] for c in word): k for word, k in vocab.items() if word not in self.added and all(c in byte for c in word)}
        self.fast = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def __call__(self, text: str) -> np.ndarray:
        if len(text) >= 2048 and LONG_SPACE.search(text):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.split is None or not any(t in text for t in self.added):
            return np.array(self.fast(text), np.uint32)
        ids: list[int] = []
        for part in self.split(text):
            ids += [self.added[part]] if part in self.added else self.fast(part)
        return np.array(ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


SUM = itemgetter(0)


def difference(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Partition ``sizes`` into ``windows`` near-equal sums: (sum, indices) of each window.

    A partial partition is a list of (sum, indices as a nested pair), heaviest first,
    without its empty windows; sums are kept less their least.
    """
    heap = [(-size, k, [(size, k)]) for k, size in enumerate(sizes)]
    if windows == 1 or not heap:
        return [(sum(sizes), list(range(len(sizes))))] if heap else []
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - windows
        if over <= 0:
            merged = a + b
        else:
            free = len(a) - over  # these windows of a meet empty ones of b
            meet = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[free:], reversed(b[windows - len(a) :]), strict=True)]
            merged = a[:free] + meet + b[: windows - len(a)]
        merged.sort(key=SUM, reverse=True)
        if len(merged) == windows:
            least = merged[-1][0]
            merged = [(s - least, items) for s, items in merged] if least else merged
        heapq.heappush(heap, (-merged[0][0], tie, merged))
        tie += 1

    def flat(items) -> list[int]:
        out, stack = [], [items]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                out.append(x)
        return sorted(out)

    parts = [flat(items) for _, items in heap[0][2]]
    return [(sum(sizes[k] for k in p), p) for p in parts]


def partition(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, from what the tokens need upwards, of which differencing keeps each within ``capacity``."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(s <= capacity for s, _ in parts):
            return [p for _, p in parts]
        windows += 1


class _Packer:
    def __init__(self, capacity: int, piece: int, group: int, slack: int, first: int, with_ids: bool):
        self.capacity, self.piece, self.with_ids = capacity, piece, with_ids
        self.room = self.full = max(capacity, capacity * group - slack)
        self.next, self.pieces, self.rows = first, [], []

    def put(self, doc_id, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        row = (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset)
        self.rows.append((*row, ids.astype(np.int64).tolist()) if self.with_ids else row)

    def add(self, doc_id, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            self.put(doc_id, start, ids[start : start + self.capacity], len(ids), self.next, 0)
            self.next += 1
        rest, at = ids[whole:].copy(), 0
        while at < len(rest):
            n = min(self.piece, len(rest) - at, self.room)
            self.pieces.append((doc_id, whole + at, rest[at : at + n], len(ids)))
            at, self.room = at + n, self.room - n
            if not self.room:
                self.close()

    def close(self) -> None:
        """Partition the gathered pieces; neighbours of a document that meet in a window become one piece."""
        for part in partition([len(p[2]) for p in self.pieces], self.capacity) if self.pieces else []:
            offset, run = 0, []
            for k in [*part, None]:
                p = self.pieces[k] if k is not None else None
                if run and (p is None or k != run[-1] + 1 or self.pieces[run[-1]][1] + len(self.pieces[run[-1]][2]) != p[1]):
                    doc_id, start, _, total = self.pieces[run[0]]
                    ids = np.concatenate([self.pieces[x][2] for x in run])
                    self.put(doc_id, start, ids, total, self.next, offset)
                    offset, run = offset + len(ids), []
                run.append(k)
            self.next += 1
        self.pieces, self.room = [], self.full


def pack(
    docs: DataFrame, capacity: int = 1024, separator: int = 0, tokenizer: str | None = None, piece: int = 128, group: int = 256, slack: int = 1023, with_ids: bool = False
) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text).

    ``piece``: the longest piece of a document's remainder; ``group``: windows that
    are partitioned together; ``slack``: tokens that a group leaves free, so that
    near-equal windows stay within the capacity; ``with_ids`` adds the piece's ids.
    """
    fields = FIELDS + (", ids array<long>" if with_ids else "")
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer or tokenizer_file())
        packer = _Packer(capacity, piece, group, slack, TaskContext.get().partitionId() << 36, with_ids)
        end = np.array([separator], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("object"), batch["text"], strict=True):
                packer.add(None if pd.isna(doc_id) else int(doc_id), np.append(encode(text or ""), end))
                if len(packer.rows) >= 20_000:
                    yield pd.DataFrame(packer.rows, columns=names).astype({"doc_id": "Int64"})
                    packer.rows = []
        packer.close()
        yield pd.DataFrame(packer.rows, columns=names).astype({"doc_id": "Int64"})
        release()

    return docs.select("doc_id", "text").mapInPandas(run, fields)
