"""Byte-level BPE encoding and decoding with a public vocabulary.

A text is split into pieces by the vocabulary's own pattern, here computed with
numpy over code points instead of a regular-expression engine. A piece is encoded
by a priority queue of merge ranks over a doubly linked list of symbols: the
lowest rank is popped, entries whose symbols have changed since are skipped, and
the new neighbours are pushed. Each distinct piece of a slice is encoded once and
kept in a bounded cache of the worker. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lean, lists, mix, pieces, powers, text_of

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pieces that a worker remembers, of some 30 bytes each; beyond it forgets all and begins anew. No result depends on it.
_CACHE = 3_000_000

# -------- vocabulary


class Vocabulary:
    """Byte strings by id and ids by byte string; an id is its string's merge rank."""

    def __init__(self, path: str):
        self.ids: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, rank = line.split()
                self.ids[base64.b64decode(token)] = int(rank)
        self.strings = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.strings[rank] = token
        self.pair = {t: r for t, r in self.ids.items() if len(t) == 2}
        self.forget()

    def forget(self) -> None:
        """Empty the cache: hashes of pieces in order, and where the ids of each lie in ``flat``."""
        self.hashes, self.starts, self.lengths = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ids = self.ids
        if (whole := ids.get(piece)) is not None:
            return [whole]
        n = len(piece)
        bits = n.bit_length()  # a queue entry is one integer: rank, first byte, length
        low = (1 << bits) - 1
        get, push, pop = ids.get, heapq.heappush, heapq.heappop
        text = [piece[i : i + 1] for i in range(n)]  # symbol that begins at i; None once merged away
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair
        heap = [(pair[x] << bits | i) << bits | 2 for i in range(n - 1) if (x := piece[i : i + 2]) in pair]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i = entry >> bits & low
            left = text[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(text[j]) != entry & low:
                continue  # stale: one of the two has grown since
            left += text[j]
            text[i], text[j] = left, None
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                if (rank := get(x := left + text[j])) is not None:
                    push(heap, (rank << bits | i) << bits | len(x))
            j = before[i]
            if j >= 0 and (rank := get(x := text[j] + left)) is not None:
                push(heap, (rank << bits | j) << bits | len(x))
        return [ids[x] for x in text if x is not None]

    def slots(self, h: np.ndarray, piece) -> np.ndarray:
        """Places in the cache of the pieces with the hashes ``h``, in order; piece(k) gives the bytes of the k-th."""
        if len(self.hashes) > _CACHE:
            self.forget()
        at = np.searchsorted(self.hashes, h)
        found = np.zeros(len(h), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == h[inside]
        new = np.flatnonzero(~found)
        if len(new):
            merge, out, sizes = self.merge, [], []
            for k in new.tolist():
                x = merge(piece(k))
                sizes.append(len(x))
                out += x
            while self.used + len(out) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(out)] = out
            sizes = np.array(sizes, np.int64)
            begin = self.used + np.cumsum(sizes) - sizes
            self.used += len(out)
            where = at[new]
            self.hashes, self.starts, self.lengths = (np.insert(x, where, y) for x, y in ((self.hashes, h[new]), (self.starts, begin), (self.lengths, sizes)))
            at = np.searchsorted(self.hashes, h)
        return at

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


# -------- pieces

OTHER, LETTER, NUMBER, SPACE = range(4)
_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of every code point, as the pattern has them."""
    if not _classes:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                out[c] = LETTER
            elif kind == "N":
                out[c] = NUMBER
        for c in [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
            out[c] = SPACE
        _classes.append(out)
    return _classes[0]


def split(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """First code point of each piece. edges: where texts begin, and the end.

    The pattern: contractions 's 't 're 've 'm 'll 'd; runs of letters, of numbers
    or of other signs, each with one space before it if there is one; white space,
    of which the last sign goes alone if something follows.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    last = np.empty(n, bool)  # the run ends here and the text goes on with something else
    last[:-1] = begin[1:] & ~edge[1:-1]
    last[-1] = False
    tail = space & last
    begin |= tail  # the last white space of a run parts from the others
    joined = np.flatnonzero(tail & (codes == 0x20)) + 1
    begin[joined] = False  # and if it is a space, what follows goes with it
    # contractions: a lone quote that begins a piece, before letters
    quote = np.flatnonzero((codes[:-1] == 0x27) & begin[:-1] & (kind[1:] == LETTER) & ~edge[1:-1]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        pad = np.append(codes, [0, 0])
        stop = np.append(edge, [True, True])
        one, two = pad[quote + 1], np.where(stop[quote + 2], 0, pad[quote + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        hit = short | long
        at, size = quote[hit], np.where(short, 1, 2)[hit]
        begin[at + 1] = False
        ends = at + 1 + size
        begin[ends[ends < n]] = True
        ends = ends[ends < n]
        # a space right after the contraction may have been joined with what follows; it begins a piece anyway
    return np.flatnonzero(begin)


def _encode(col: pa.Array, v: Vocabulary) -> list[np.ndarray]:
    """Ids of each text of a slice."""
    texts = [x or "" for x in col.to_pylist()]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(x) for x in texts], np.int64)
    edges = np.append(0, np.cumsum(sizes))
    first = split(codes, edges)
    if not len(first):
        return [np.zeros(0, np.int32) for _ in texts]
    n = len(codes)
    p, inverse = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    ends = np.append(first[1:], n)
    h = mix((total[ends] - total[first]) * inverse[first] ^ ((ends - first).astype(np.uint64) << np.uint64(48)))
    uniq, at, inv = np.unique(h, return_index=True, return_inverse=True)
    text = "".join(texts)
    begins, stops = first[at].tolist(), ends[at].tolist()
    place = v.slots(uniq, lambda k: text[begins[k] : stops[k]].encode("utf-8", "surrogatepass"))
    starts, lengths, flat = v.starts[place], v.lengths[place], v.flat
    reps = lengths[inv]
    to = np.cumsum(reps)
    out = flat[np.repeat(starts[inv] - (to - reps), reps) + np.arange(to[-1])]
    cut = np.append(0, to)[np.searchsorted(first, edges)]
    return [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _encoder(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a, b in pieces(batch.column(at)):
                part = batch.slice(a, b - a)
                texts = part.column(at)
                ids = _encode(texts, v)
                valid = texts.is_valid().to_numpy(zero_copy_only=False)
                raw = texts.to_pylist()
                same = [x is not None and v.decode(y.tolist()) == x.encode("utf-8", "surrogatepass") for x, y in zip(raw, ids, strict=True)]
                rest = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                tokens = lists(ids, pa.int32())
                if not valid.all():
                    tokens = pa.ListArray.from_arrays(tokens.offsets, tokens.values, mask=pa.array(~valid))
                sizes = pa.array([len(x) for x in ids], pa.int32(), mask=~valid)
                yield pa.RecordBatch.from_arrays([*rest, tokens, sizes, pa.array(same, pa.bool_(), mask=~valid)], names=[*names, "token_ids", "n_tokens", "round_trips"])

    return encode


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, token_ids, n_tokens, round_trips) for each row.

    ``round_trips``: the decoded ids are the text's bytes. An empty text has no
    tokens; a null text has null in all three. Texts are whole, however long; equal
    rows give equal rows; extra columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), text_of().alias("text"))
    return rows.mapInArrow(lean(_encoder(path)), "doc_id long, source string, token_ids array<int>, n_tokens int, round_trips boolean")


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``tokens`` (doc_id, token_ids) as (doc_id, text). Null ids give a null text, ids that aren't UTF-8 the replacement sign; an unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else v.decode(x).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("token_ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
