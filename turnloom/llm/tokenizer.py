"""Byte-level BPE as a streaming transducer with bounded lookahead.

Merging by rank gives a unique token sequence for each text, in which every two
neighbours are *stable*: merging their joined bytes alone gives the same two
again; and a sequence of stable neighbours is that of its text. So the last
token of each prefix follows from those of the shorter prefixes: it is the one
token ending there which is stable after the last token of what lies before it.

The transducer reads bytes, keeps for each position of a short window the last
token of the prefix that ends there, and emits a token once it is settled. A
token ends at most ``reach`` bytes after it starts, ``reach`` being the length
of the longest token of the merge list. All that comes later therefore starts
from one of the last ``reach`` positions; where the ways back from these have
met, nothing can change any more. This is the lookahead that suffices: the
window is trimmed whenever it has grown to a few times the reach, so memory
doesn't depend on the length of a text, nor time on more than its length.

Texts are cut into words by the vocabulary's own pattern first, lazily; words
that come again are looked up. Decoding feeds token bytes to an incremental
UTF-8 decoder.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: the pattern that cuts a text into words for the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where the public vocabulary lies, unless a query is given another path.
VOCABULARY = os.environ.get("TURNLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Words and token pairs remembered per worker before starting afresh.
REMEMBERED = 200_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Token bytes to id, of a rank file: base64 and number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Encoder and decoder of one vocabulary; cheap to call, built once per worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.words = regex.compile(pattern)
        self.stable: dict[tuple[int, int], bool] = {}
        self.known: dict[str, list[int]] = {}
        # tokens that the merges never produce from their own bytes take no part
        usable = {t for t in ranks if len(t) == 1 or self.merged(t) == [ranks[t]]}
        self.reach = max(map(len, usable), default=1)
        # usable tokens by their last byte, then the one before it and so on
        self.backward: dict = {}
        for token in usable:
            node = self.backward
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = ranks[token]

    def merged(self, text: bytes) -> list[int]:
        """Plain merging by rank: for short strings, to learn from."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def is_stable(self, left: int, right: int) -> bool:
        """Do these two, joined, come out of the merges as themselves?"""
        pair = (left, right)
        answer = self.stable.get(pair)
        if answer is None:
            if len(self.stable) >= REMEMBERED:
                self.stable.clear()
            answer = self.stable[pair] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return answer

    def settled(self, start: list[int], low: int) -> int:
        """The last position that all ways back from the last ``reach`` ones go through.

        ``start[i]`` is where the token that ends at position ``low + i`` starts.
        """
        top = low + len(start) - 1
        heads = set(range(max(low, top - self.reach + 1), top + 1))
        while len(heads) > 1:
            far = max(heads)
            heads.discard(far)
            if far <= low:
                return low
            heads.add(start[far - low])
        return heads.pop()

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of a word's bytes, each given out once it is settled."""
        reach, backward, is_stable = self.reach, self.backward, self.is_stable
        window = bytearray()  # bytes since position `low`
        low, last, start = 0, [-1], [0]  # of the prefixes that end at low, low + 1, ...
        for byte in data:
            window.append(byte)
            i = len(window)
            node, at = backward, i
            while at and (node := node.get(window[at - 1])) is not None:
                at -= 1
                token = node.get(-1)
                if token is not None and (last[at] < 0 or is_stable(last[at], token)):
                    last.append(token)
                    start.append(low + at)
                    break
            else:
                raise ValueError("the vocabulary has no token for a byte")
            if i >= 8 * reach and i % reach == 0:
                yield from self._emit(last, start, low, goal := self.settled(start, low))
                drop = goal - low
                del window[:drop], last[:drop], start[:drop]
                low = goal
        yield from self._emit(last, start, low, low + len(last) - 1)

    @staticmethod
    def _emit(last: list[int], start: list[int], low: int, end: int) -> list[int]:
        out = []
        while end > low:
            out.append(last[end - low])
            end = start[end - low]
        return out[::-1]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one. Special tokens in it are ordinary text."""
        if not text:
            return []
        known, out = self.known, []
        for match in self.words.finditer(text):
            word = match.group()
            ids = known.get(word)
            if ids is None:
                raw = word.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(raw)
                ids = [whole] if whole is not None and len(raw) == 1 else list(self.stream(raw))
                if len(raw) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[word] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int] | None) -> str:
        """The text of ids, token by token; bytes that are no UTF-8 become U+FFFD."""
        step = codecs.getincrementaldecoder("utf-8")("replace").decode
        return "".join([step(self.bytes_of[i]) for i in ids or ()]) + step(b"", True)


_BUILT: dict[str, Transducer] = {}


def _built(digest: str, shared) -> Transducer:
    """This worker's transducer for a broadcast rank table, named by the digest of its file."""
    if digest not in _BUILT:
        _BUILT.clear()
        _BUILT[digest] = Transducer(shared.value)
    return _BUILT[digest]


def encode_texts(rows: DataFrame, key: str, text: str, path: str = VOCABULARY, check: bool = False) -> DataFrame:
    """``(key, ids)`` of every row, and with ``check`` also ``same``: whether decoding gives the text back.

    The rank table (one vocabulary, of a size fixed by its file) is read by the
    driver and broadcast; executors need no file. No shuffle: rows stay in
    their partitions. Null and empty texts have an empty list; a null key is
    kept; repeated rows stay repeated. Other columns are ignored.
    """
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _built(digest, shared)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = batch.column(1).to_pylist()
                ids = [coder.encode(t) for t in texts]
                columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
                if check:
                    columns.append(pa.array([coder.decode(i) == (t or "") for i, t in zip(ids, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=["k", "ids", "same"][: len(columns)])

    schema = f"`{key}` {kind}, ids array<int>" + ", same boolean" * check
    return rows.select(key, text).mapInArrow(run, schema)
