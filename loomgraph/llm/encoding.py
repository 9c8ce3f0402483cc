"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Content-defined chunk reuse: a rolling hash over the last code points picks chunk ends by content, so equal passages of
different documents fall into equal chunks, and each chunk is encoded once per Python worker and then looked up. Chunk
ends are moved to word ends (a character followed by a space), where the vocabulary's word pattern always starts a new
match, so that such joins are exact. In stretches without a word end the cut is hard and the join is repaired: matching
restarts a word before the cut and goes on until it meets a match end of the right chunk, and that stretch is encoded
again; from a common match end on, both agree exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 16
#: One word end in so many ends a chunk, on average.
EVERY = 48
#: Code points without a word end after which a cut is hard.
LONGEST = 4096
#: Chunks a worker remembers; bounds its memory, never the result.
REMEMBERED = 100_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
# The white space code points.
_SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_IS_SPACE = np.zeros(0x3002, dtype=bool)
_IS_SPACE[_SPACES] = True


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class ChunkEncoder:
    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(pattern)
        self.known: dict[str, np.ndarray] = {}

    def chunk(self, text: str) -> np.ndarray:
        ids = self.known.get(text)
        if ids is None:
            ids = np.asarray(self.encoding.encode_ordinary(text), dtype=np.int32)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[text] = ids
        return ids

    def cuts(self, text: str) -> tuple[list[int], list[int]]:
        """Exact chunk ends (at word ends, picked by the hash), and hard ones in stretches without any."""
        n = len(text)
        if n <= WINDOW:
            return [], []
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.flatnonzero(codes[WINDOW:] == 32) + WINDOW
        at = at[~_IS_SPACE[np.minimum(codes[at - 1], 0x3001)]]
        wide = codes.astype(np.uint64)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(WINDOW, 0, -1):
            h = h * _BASE + wide[at - k]
        exact = at[(h >> np.uint64(40)) % np.uint64(EVERY) == 0]
        hard: list[int] = []
        edges = np.concatenate(([0], at, [n]))
        for k in np.flatnonzero(np.diff(edges) > LONGEST):
            hard.extend(range(int(edges[k]) + LONGEST, int(edges[k + 1]), LONGEST))
        return exact.tolist(), hard

    def _repaired(self, text: str, hard: list[int]) -> list[np.ndarray]:
        """A stretch with hard cuts: words that both chunks agree on are encoded by chunk, the rest around each cut again."""
        ends = [0, *hard, len(text)]
        found: list[int] = []  # true match ends up to the current cut
        for lo, hi in zip(ends, ends[1:]):
            own = [m.end() for m in self.words.finditer(text, lo, hi)]
            if not found:
                found = own
                continue
            back = found[-3] if len(found) >= 3 else 0
            found = [e for e in found if e <= back]
            mine, met = set(own), None
            for m in self.words.finditer(text, back):
                found.append(m.end())
                if m.end() >= hi or (m.end() > lo and m.end() in mine):
                    met = m.end()
                    break
            if met is not None:
                found.extend(e for e in own if e > met)
        out, lo = [], 0
        for e in found:  # a piece must not end in white space: the pattern looks ahead from there
            if e - lo >= LONGEST and not text[e - 1].isspace() or e == found[-1]:
                out.append(self.chunk(text[lo:e]))
                lo = e
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text; none for a null or empty one."""
        if not text:
            return np.empty(0, dtype=np.int32)
        exact, hard = self.cuts(text)
        parts, lo = [], 0
        for hi in [*exact, len(text)]:
            inside = [c - lo for c in hard if lo < c < hi]
            if inside:
                parts.extend(self._repaired(text[lo:hi], inside))
            else:
                parts.append(self.chunk(text[lo:hi]))
            lo = hi
        return np.concatenate(parts) if len(parts) > 1 else parts[0]


_ENCODERS: dict[tuple[str, str], ChunkEncoder] = {}


def encoder(path: str, pattern: str | None = None) -> ChunkEncoder:
    """One encoder per Python process."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = ChunkEncoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_corpus(documents: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Rows (doc_id, ids array<int>), one per row of `documents`, without special tokens.

    Null and empty texts have an empty list; strings that look like special tokens are ordinary text. Texts of any
    length are encoded whole. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            ids = [e.encode(t) for t in b.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in ids], out=ends[1:])
            flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def corpus_sizes(documents: DataFrame, path: str, pattern: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens bigint) of the documents that are neither null nor empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in batches:
            sizes = [len(e.encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").where(F.col("text") != "").mapInArrow(run, "doc_id bigint, n_tokens bigint")
