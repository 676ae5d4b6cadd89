"""Language-model scoring by a hierarchical Pitman-Yor model of words.

The restaurant of a context of two words has that of the last one as its parent,
which has the root; the root's parent spells the word by the frequencies of bytes,
so that a word never seen has a probability too. Seatings are sampled by Gibbs, one
customer after the other, customers leaving the parents too (``seating``); predictive
probabilities, of each customer given all others, are averaged over the samples. Words are parted as ``common.words``
has it and counted with case; they are known by 64-bit hashes.

Every occurrence of a word goes once, with its context and its document, to the
partition of the context's last word. There subtrees are sampled given the root,
and occurrences are scored where they lie; only a sum for each document comes
back. The root is spread by words: partitions send it how many customers they have
of each word and get the word's probability without their own, to which they add
them as they change. That is done twice: from plain counts of words, and after
BURN_IN sweeps, when the root is seated anew and discounts and strengths are drawn
from their conditionals.

The longer contexts of a last word that fills more than a share of 1 / HOT of a
partition are divided among several; so are the occurrences of such a pair of words.
Those partitions hold one restaurant of the word together: after BURN_IN sweeps each
learns what the others have of each of its dishes, and of customers and tables in all,
as it learns the root's probabilities. So neither a frequent word nor a frequent pair of words makes a large
task, and none is scored by a part of its customers only.

Words are read, messages made and subtrees sampled and scored by ``kernel``, one customer
strictly after the other; only the root, and a model for other documents, are made by numpy
(``_Held``), where a large restaurant's customers move in several chains (``seating``).
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import seating
from millrace.llm.common import EXACT, SPACE, TMP, mix, pieces, shared_path, text_of, utf8, words, written
from millrace.llm.kernel import Kernel
from millrace.llm.seating import Hyper, Subtrees

BEGIN, END = np.uint64(1), np.uint64(2)  # before a text, twice, and after it; the latter is spelled as an empty word
BURN_IN, SAMPLES = 3, 4
#: Customers of one subtree that wait for one another; also of a part of a dish in a restaurant.
CAP = 512
#: A partition's worth of words is so many times what makes a word hot, so at most that many a partition are sent to tasks.
HOT = 16
#: Words that are sent by their number among these, the most frequent ones.
COMMON = 60_000
LEAST = -600.0
#: Words of a partition, of some 100 bytes each at its peak; to be raised with the memory of executors.
PART_WORDS = 1_000_000
_HALF = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
_MULT = mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)

# -------- words


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word, and of each text's end: the two words before it and itself; and how many each text has."""
    k = words(col, EXACT)
    sizes = np.diff(k.first)
    to = np.cumsum(sizes + 3)
    start = to - sizes - 3
    s = np.full(int(to[-1]) if len(to) else 0, BEGIN, np.uint64)
    own = np.ones(len(s), bool)
    own[start] = own[start + 1] = False
    at = np.flatnonzero(own)
    own[to - 1] = False
    s[to - 1] = END
    s[own] = k.hash
    return s[at - 2], s[at - 1], s[at], sizes + 1


def _key(*parts: np.ndarray) -> np.ndarray:
    return mix(reduce(lambda x, y: x + y, (x * m for x, m in zip(parts, _MULT, strict=False))) ^ np.uint64(len(parts)))


def _owner(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) % np.uint64(n)).astype(np.int64)


def _same(k: int) -> int:
    return k


def _lean() -> None:
    """Let a worker give freed arrays back to the system: idle workers count too."""
    with suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each byte occurs in texts, and after them the number of texts."""
    total = np.zeros(257, np.int64)
    for batch in batches:
        for a, b in pieces(batch.column(0)):
            data, _ = utf8(batch.column(0).slice(a, b - a))
            total[:256] += np.bincount(data, minlength=256)
        total[256] += batch.num_rows
    yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["n"])


def byte_logs(total: np.ndarray) -> list[float]:
    """Log probabilities of each byte of a word and, at 0, of its end; each counts once more than it occurs."""
    n = total[:256].astype(np.float64)
    n[0] += n[SPACE].sum() + total[256]
    n[SPACE] = 0
    return np.log((n + 1) / (n + 1).sum()).tolist()


def spelled_log(texts: pa.Array, logs: list[float]) -> np.ndarray:
    """Log probability of the spelling of each of the words; what is below LEAST counts as that, so that no probability is 0."""
    sizes = [x.encode("utf-8", "surrogatepass") for x in texts.to_pylist()]
    flat = np.array(logs)[np.frombuffer(b"".join(sizes), np.uint8)]
    ends = np.cumsum([len(x) for x in sizes]).astype(np.int64)
    total = np.append(0.0, np.cumsum(flat))
    return np.maximum(total[ends] - total[np.append(0, ends[:-1])] + logs[0], LEAST) if len(sizes) else np.zeros(0)


def _pack(x: tuple) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, 5))


def _unpack(raw: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8 if not len(x) or x.max() < 1 << 8 else np.uint16 if x.max() < 1 << 16 else np.uint32 if x.max() < 1 << 32 else np.uint64)


def _thin(x: np.ndarray) -> tuple[str, bytes]:
    """Unsigned integers as few bytes as they need, all first bytes before all second ones, as this compresses better."""
    x = _narrow(x)
    return x.dtype.char, x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _thick(x: tuple[str, bytes]) -> np.ndarray:
    kind = np.dtype(x[0])
    return np.ascontiguousarray(np.frombuffer(x[1], np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _steps(h: np.ndarray) -> tuple[str, bytes]:
    """Ascending hashes."""
    return _thin(np.diff(h, prepend=np.uint64(0)))


def _hashes(x: tuple[str, bytes]) -> np.ndarray:
    return np.cumsum(_thick(x), dtype=np.uint64)


def _floats_sent(x: np.ndarray) -> tuple[str, bytes]:
    return _thin(x.astype(np.float32).view(np.uint32))


def _floats(x: tuple[str, bytes]) -> np.ndarray:
    return _thick(x).astype(np.uint32).view(np.float32)


def _distinct(x: np.ndarray) -> np.ndarray:
    """As numpy's unique, by sorting, which for hashes is several times as fast."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _numbers(common: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ascending words ``known`` are among ``common``, and the numbers that those have there."""
    at = np.minimum(np.searchsorted(common, known), len(common) - 1) if len(common) else np.zeros(len(known), np.int64)
    often = common[at] == known if len(common) else np.zeros(len(known), bool)
    return often, at[often]


def _named(common: np.ndarray, known: np.ndarray) -> tuple[tuple[str, bytes], tuple[str, bytes]]:
    """Ascending words: steps between the hashes of the rare ones, and between the numbers of the others."""
    often, number = _numbers(common, known)
    return _steps(known[~often]), _thin(np.diff(number, prepend=0))


def _words_named(common: np.ndarray, rare: tuple[str, bytes], number: tuple[str, bytes]) -> np.ndarray:
    """The ascending words of :func:`_named`."""
    return np.sort(np.concatenate([common[np.cumsum(_thick(number), dtype=np.int64)], _hashes(rare)]))


def _sent(source: int, common: np.ndarray, a: np.ndarray, c: np.ndarray, doc: np.ndarray, lasts: np.ndarray, many: np.ndarray) -> bytes:
    """A message of occurrences: ``many`` of each of ``lasts``, documents ascending in each."""
    known, x = np.unique(np.concatenate([a, c, lasts]), return_inverse=True)
    x, m = x.ravel(), len(a)
    return _pack(("words", source, *_named(common, known), _thin(x[:m]), _thin(x[m : 2 * m]), doc.dtype.char, _thin(np.diff(doc, prepend=doc.dtype.type(0))), _thin(x[2 * m :]), _thin(many)))


class _Words:
    """A message of occurrences as it comes: words before the last one, words after it and documents of each; words of both; last words and how often they are."""

    def __init__(self, x: tuple, common: np.ndarray):
        _, self.source, rare, number, a, c, kind, doc, lasts, many = x
        self.known = _words_named(common, rare, number)
        self.a, self.c, self.many = _thick(a), _thick(c), _thick(many)
        self.doc = np.cumsum(_thick(doc).astype(kind), dtype=kind)
        self.lasts = self.known[_thick(lasts)]


class _Hot:
    """The words of more than ``piece`` occurrences, which lie in several partitions, with their counts: sorted hashes, at most HOT a partition and BEGIN."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, piece: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total, self.piece = hashes[order], counts[order], max(1, total), piece

    def count(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0)


# -------- subtrees


class _Dishes:
    """The words of a partition, and how often each occurs: its customers at the root before any is seated."""

    def __init__(self, rows: Iterator[tuple[int, bytes]], common: np.ndarray):
        self.common, known, counts = common, [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, raw in rows:
            x = _unpack(raw)
            if x[0] == "words":
                x = _Words(x, common)
                n = np.bincount(x.c, minlength=len(x.known))
                known.append(x.known[n > 0])
                counts.append(n[n > 0])
        self.words, of = np.unique(np.concatenate(known), return_inverse=True)
        self.counts = np.bincount(of, np.concatenate(counts), minlength=len(self.words)).astype(np.int64)

    def ask(self, p: int, n: int) -> Iterator[tuple[int, bytes]]:
        to = _owner(self.words, n)
        for q in np.unique(to).tolist():
            yield q, _pack(("ask", p, *_named(self.common, self.words[to == q]), _thin(self.counts[to == q])))
        _lean()


class _Held:
    """What a partition holds: the subtrees of some last context words, and the occurrences that they are made of."""

    def __init__(self, rows: Iterator[tuple[int, bytes]], held_hot):
        _lean()
        self.hot, common = held_hot.value
        self.docs, blobs, self.replies, self.others = [], [], {}, {}
        for _, raw in rows:
            x = _unpack(raw)
            if x[0] == "docs":
                self.docs.append(raw)
            elif x[0] == "words":
                blobs.append(_Words(x, common))
            else:
                (self.others if x[0] == "others" else self.replies)[x[1]] = x[2:]
        blobs.sort(key=lambda x: x.source)
        self.sources = [(x.source, x.doc) for x in blobs]
        none = np.zeros(0, np.uint64)
        self.known = known = _distinct(np.concatenate([none, *(x.known for x in blobs)]))
        total = sum(len(x.a) for x in blobs)
        a, c, tree = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
        self.tree_word, place = np.unique(np.concatenate([none, *(x.lasts for x in blobs)]), return_inverse=True)
        at = run = 0
        for x in blobs:
            to, m = np.searchsorted(known, x.known).astype(np.int32), len(x.a)
            a[at : at + m], c[at : at + m] = to[x.a], to[x.c]
            tree[at : at + m] = np.repeat(place[run : run + len(x.lasts)], x.many)
            at, run = at + m, run + len(x.lasts)
        blobs.clear()
        # contexts of two words, entries, dishes of one word, dishes
        wide = lambda x, y: x.astype(np.int64) << 32 | y
        pairs, leaf = np.unique(wide(tree, a), return_inverse=True)
        del a, tree
        leaf = leaf.astype(np.int32)
        self.tree_of_leaf, self.first_word = pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int64)
        grams, self.gram, self.n = np.unique(wide(leaf, c), return_inverse=True, return_counts=True)
        del c, leaf
        self.gram = self.gram.astype(np.int32)
        self.same = self.same2 = None
        many = -(-self.n // CAP)
        if len(many) and many.max() > 1:
            grams = self._divide(grams, many)
        self.leaf, self.dish_word = grams >> 32, grams & 0xFFFFFFFF
        twos, self.two = np.unique(wide(self.tree_of_leaf[self.leaf], self.dish_word), return_inverse=True)
        size = np.bincount(self.two, self.n, minlength=len(twos)).astype(np.int64)
        if len(size) and size.max() > CAP:
            twos = self._divide2(twos, size)
        self.tree2 = twos >> 32
        self.dishes, self.dish = np.unique(twos & 0xFFFFFFFF, return_inverse=True)

    def _divide(self, grams: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Entries of more than CAP customers come in parts, as equal as can be."""
        at = np.flatnonzero(many[self.gram] > 1)
        at = at[np.argsort(self.gram[at], kind="stable")]
        of = self.gram[at]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        self.gram = (np.cumsum(many) - many).astype(np.int32)[self.gram]
        self.gram[at] += (rank * many[of] // self.n[of]).astype(np.int32)
        self.n, self.same = np.bincount(self.gram, minlength=int(many.sum())), np.repeat(np.arange(len(many)), many)
        return np.repeat(grams, many)

    def _divide2(self, twos: np.ndarray, size: np.ndarray) -> np.ndarray:
        """So do dishes of restaurants of one word; an entry stays in one part."""
        parts = -(-size // CAP)
        order = np.argsort(self.two, kind="stable")
        before = np.cumsum(self.n[order]) - self.n[order]
        before -= (np.cumsum(size) - size)[self.two[order]]
        part = np.empty(len(order), np.int64)
        part[order] = before * parts[self.two[order]] // size[self.two[order]]
        names, self.two = np.unique(self.two.astype(np.int64) << 32 | part, return_inverse=True)
        self.same2 = names >> 32
        return twos[self.same2]

    def words_of(self) -> np.ndarray:
        return self.known[self.dishes]

    def subtrees(self) -> Subtrees:
        return Subtrees(self.n, self.leaf, self.two, self.dish, self.tree_of_leaf, self.same, self.same2, CAP)

    def divided(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subtrees that lie in other partitions too; their dishes, by the first ``two`` of each, of which of those subtrees they are, their keys, and the partition of the root that each goes by."""
        trees = np.flatnonzero(self.hot.count(self.tree_word) > self.hot.piece)
        there = np.full(len(self.tree_word), -1)
        there[trees] = np.arange(len(trees))
        first = np.flatnonzero(there[self.tree2] >= 0)
        if self.same2 is not None:
            first = first[np.append(True, np.diff(self.same2[first]) > 0)[: len(first)]]
        key = _key(self.tree_word[self.tree2[first]], self.known[self.dishes[self.dish[first]]])
        return trees, first, there[self.tree2[first]], key, _owner(key, n)

    def rooted(self, n: int, total: float, d0: float) -> Subtrees:
        """Subtrees at their first seating, with the root's replies."""
        s, to = self.subtrees(), _owner(self.words_of(), n)
        fixed = np.zeros(len(to))
        for q, (x,) in self.replies.items():
            fixed[to == q] = _floats(x)
        s.root(np.exp(-np.abs(fixed)), ~np.signbit(fixed), total, d0)
        if self.others:
            trees, first, _, key, to = self.divided(n)
            far, totals = np.zeros((3, len(key)), np.int64), np.zeros((2, len(trees)), np.int64)
            for q, (dishes, sums) in self.others.items():
                far[:, to == q] = [_thick(x) for x in dishes]
                totals += [_thick(x).astype(np.int64) for x in sums]
            at = np.zeros(len(s.dish), np.int64) - 1
            at[first] = np.arange(len(first))
            if self.same2 is not None:  # each part of a dish is told the same
                at = at[np.searchsorted(self.same2, self.same2)]
            twos = np.flatnonzero(at >= 0)
            s.join(trees, totals, twos, far[:, at[twos]])
        return s

    def scores(self, p: np.ndarray, n: int) -> Iterator[tuple[int, bytes]]:
        """To the partition of each chunk's documents: the documents and sums of log probabilities, each sum exact to some 6e-8 of its size."""
        for raw in self.docs:
            source = _unpack(raw)[1]
            yield source % n, raw
        log, at = np.log(p), 0
        for source, doc in self.sources:
            total = np.bincount(doc, log[self.gram[at : at + len(doc)]])
            at += len(doc)
            have = np.flatnonzero(total)
            yield source % n, _pack(("sums", source, _thin(np.diff(have, prepend=0)), _floats_sent(total[have])))

    def model(self, s: Subtrees, more3: np.ndarray, share3: np.ndarray, more2: np.ndarray, share2: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(kind, keys, weighted values, weights): 10 + words of a gram and what it has beyond its parent's share, words of a context and that share."""
        name = lambda x: self.known[x]
        first, last = name(self.first_word), self.tree_word[self.tree_of_leaf]
        c3, c2 = s.C3.astype(np.float64), s.C2.astype(np.float64)
        yield 13, _key(first[self.leaf], last[self.leaf], name(self.dish_word)), more3 * c3[self.leaf], c3[self.leaf] * 0
        yield 2, _key(first, last), share3 * c3, c3
        # a restaurant in several partitions: each adds its own customers and tables to those of all
        own = s.own2.astype(np.float64)
        yield 12, _key(self.tree_word[s.tree2], name(self.dishes[self.dish])), more2 * c2[s.tree2], c2[s.tree2] * 0
        yield 1, _key(self.tree_word), share2 * own, own


# -------- root


def _counted(rows: Iterator[tuple[int, bytes]], share: float, total: int, common: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of a root partition, those of more than a share of all occurrences, with their counts, and so many common ones."""
    base = [(_hashes(x[1]), _floats(x[2]), _thick(x[3])) for x in (_unpack(raw) for _, raw in rows)]
    h, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in base)]), return_inverse=True)
    n = np.bincount(of, np.concatenate([np.zeros(0), *(x[2] for x in base)]), minlength=len(h)).astype(np.int64)
    at = n > share * total
    return len(h), h[at], n[at], h[np.argsort(-n, kind="stable")[:common]]


def _root(rows: Iterator[tuple[int, bytes]], common: np.ndarray, shares: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Words, probabilities of their spellings, customers, and who asked for which with how many of its own. ``shares`` gets the other messages."""
    base, asks, later = [], [], {}
    for _, raw in rows:
        x = _unpack(raw)
        if x[0] == "share":
            if shares is not None:
                shares.append(x[1:])
        elif x[0] == "more":
            later[x[1]] = _thick(x[2])
        elif x[0] == "ask":
            asks.append((x[1], _words_named(common, x[2], x[3]), _thick(x[4])))
        else:
            base.append((_hashes(x[1]), _floats(x[2])))
    h, first = np.unique(np.concatenate([np.zeros(0, np.uint64), *(x[0] for x in base)]), return_index=True)
    p = np.exp(np.concatenate([np.zeros(0, np.float32), *(x[1] for x in base)])[first].astype(np.float64))
    asks.sort(key=lambda x: x[0])
    asks = [(who, np.searchsorted(h, x), later.get(who, t)) for who, x, t in asks]
    c = np.zeros(len(h))
    for _, at, t in asks:
        c[at] += t
    return h, p, c, asks


def _others(q: int, shares: list) -> Iterator[tuple[int, bytes]]:
    """To each partition that has a part of a restaurant: customers and tables that the others have of each of its dishes, and of all.

    Before they heard of one another each part opened a table for each of its dishes;
    of those only that of the first part stays.
    """
    shares = sorted(shares, key=lambda x: x[0])
    if not shares:
        return
    keys, trees = (np.concatenate(x) for x in zip(*((np.frombuffer(x[3], np.uint64), np.frombuffer(x[1], np.uint64)[_thick(x[2])]) for x in shares), strict=True))
    c, t = (np.concatenate([_thick(x[k]) for x in shares]).astype(np.int64) for k in (4, 5))
    _, first, at = np.unique(keys, return_index=True, return_inverse=True)
    mine = np.zeros(len(keys), np.int64)
    mine[first] = 1
    t += mine - 1
    names, tree = np.unique(trees, return_inverse=True)
    by_dish, by_tree = (np.stack([np.bincount(x, y).astype(np.int64) for y in (c, t)]) for x in (at, tree))
    i = 0
    for who, words, of, key, _, _ in shares:
        words, j = np.frombuffer(words, np.uint64), i + len(key) // 8
        own = np.stack([np.bincount(_thick(of), x[i:j], minlength=len(words)).astype(np.int64) for x in (c, t)])
        to = np.minimum(np.searchsorted(names, words), len(names) - 1)
        total = np.where(names[to] == words, by_tree[:, to], 0) - own
        far = by_dish[:, at[i:j]] - [c[i:j], t[i:j]]
        yield who, _pack(("others", q, [_thin(x) for x in (*far, mine[i:j])], [_thin(x) for x in total]))
        i = j


def _counts(raw: bytes) -> list[np.ndarray]:
    """As seating.Subtrees.counts, which the kernel sends as keys and times."""
    found = [[np.frombuffer(x, np.int64) for x in pair] for pair in _unpack(raw)]
    return [np.stack([key >> 32, key & 0xFFFFFFFF, times], 1) for key, times in found]


class _Fit:
    """Occurrences by partition, with the root's replies, discounts and strengths."""

    def __init__(self, docs: DataFrame, part_words: int = PART_WORDS):
        rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
        texts = rows.select("text").filter("text is not null")
        total = sum((np.array(x["n"]) for x in texts.mapInArrow(_bytes_of, "n array<long>").toLocalIterator()), np.zeros(257, np.int64))
        self.logs = byte_logs(total)
        many = int(total[:256][SPACE].sum() + total[256])  # words, or few less
        self.n = n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // part_words))
        self.kernel = Kernel(docs.sparkSession, ints=(n, max(CAP, part_words // HOT), CAP, BURN_IN, SAMPLES), logs=self.logs)
        self.words = self.kernel.of_rows("base", texts).partitionBy(n, _same)
        found = self.words.mapPartitions(lambda part: [_counted(part, 1 / (HOT * n), many, COMMON // n)]).collect()  # fewer than HOT n + COMMON words in all
        self.kinds = max(1, sum(x[0] for x in found))
        hashes, counts = (np.concatenate([x[k] for x in found]) for k in (1, 2))
        ends = counts[hashes == END].sum()
        hot = docs.sparkSession.sparkContext.broadcast((_Hot(np.append(hashes, BEGIN), np.append(counts, ends), many, max(CAP, part_words // HOT)), np.sort(np.concatenate([x[3] for x in found]))))
        self.hot = hot
        self.kernel = self.kernel.told(common=hot.value[1], hot=hot.value[0].hashes, hot_count=hot.value[0].counts, hot_total=float(hot.value[0].total))
        self.rows = self.kernel.of_rows("occurrences", rows).partitionBy(n, _same)
        self.asks, _ = self._told(self.kernel.of_messages("dishes", self.rows))
        self.hyper = Hyper((0.5, 0.7, 0.8), (1.0, 1.0, 1.0))  # drawn below
        self.reply(self.asks)
        asks, got = self._told(self._sampled("again"))
        # numbers of dishes by customers and tables, at most CAP, and of restaurants by either, at most a partition's worth: small, however large the corpus
        seats = [reduce(seating.add_counts, x, np.zeros((0, 3), np.int64)) for x in zip(*map(_counts, got), strict=True)] or [np.zeros((0, 3), np.int64)] * 4
        rng = np.random.default_rng(11)
        drawn = [seating.draw_hyper(seats[2 * k], seats[2 * k + 1], self.hyper.s[k + 1], rng) for k in range(2)]
        self.hyper = Hyper((self.hyper.d[0], *(x[0] for x in drawn)), (self.hyper.s[0], *(x[1] for x in drawn)))
        self.reply(self.asks.union(asks))

    def _told(self, out: RDD) -> tuple[RDD, list[bytes]]:
        """Messages by partition, and those to the driver, one small one of each partition."""
        sent = out.map(lambda x: (x[0], x[1]) if x[0] >= 0 else (0, b"!" + x[1])).partitionBy(self.n, _same)
        told = sent.filter(lambda x: x[1][:1] == b"!").map(lambda x: x[1][1:]).collect()
        return sent.filter(lambda x: x[1][:1] != b"!"), told

    def _sampled(self, what: str) -> RDD:
        """Each partition's subtrees sampled; "again": to the root and the driver; "final": the documents' sums."""
        return self.kernel.told(total=self.total, d=self.hyper.d, s=self.hyper.s).of_messages(what, self.rows.union(self.replies))

    def reply(self, asks: RDD) -> None:
        both, hot = self.words.union(asks), self.hot

        def counted(part: Iterator) -> Iterator:
            _, _, c, _ = _root(part, hot.value[1])
            yield np.array([c.sum(), (c == 1).sum(), (c == 2).sum()])

        customers, once, twice = both.mapPartitions(counted).fold(np.zeros(3), lambda x, y: x + y)
        d = float(np.clip(once / (once + 2 * twice) if once + twice else 0.5, 0.05, 0.95))
        s = self.hyper.s[0]
        self.hyper = self.hyper._replace(d=(d, *self.hyper.d[1:]))
        self.total = total = s + customers
        tables = self.kinds  # of all words; a second table of a word is rare, as its spelling is improbable
        self.backoff = backoff = (s + d * tables) / total

        def seated(q: int, part: Iterator):
            shares = []
            h, p, c, asks = _root(part, hot.value[1], shares)
            return shares, h, p, c, asks, seating.seat(c, p, np.full(len(c), float(tables - 1)), d, s, np.random.default_rng([q, 77]))

        def answers(q: int, part: Iterator) -> Iterator:
            shares, _, p, c, asks, t = seated(q, part)
            yield from _others(q, shares)
            for who, at, own in asks:
                left = c[at] - own
                x = np.maximum(left - d * np.minimum(t[at], left), 0) / total + backoff * p[at]
                x = np.abs(np.log(x))  # positive for words that nobody else has
                yield who, _pack(("root", q, _floats_sent(np.where(left > 0, -x, x))))

        def model(q: int, part: Iterator) -> Iterator:
            _, h, p, c, _, t = seated(q, part)
            have = c > 0
            yield 11, _key(h[have]), (np.maximum(c - d * t, 0) / total + backoff * p)[have], np.zeros(int(have.sum()))

        self.replies = both.mapPartitionsWithIndex(answers).partitionBy(self.n, _same)
        self.root_model = both.mapPartitionsWithIndex(model)

    def sums(self) -> RDD:
        """Messages to the partitions of the documents: they themselves, and sums of log probabilities."""
        return self._sampled("final")

    def final(self, use: Callable) -> RDD:
        """For a model, use(partition, what it holds, its subtrees, means over the samples of Subtrees.sweep and all but the first of Subtrees.predict) of each partition."""
        n, hyper, total, hot = self.n, self.hyper, self.total, self.hot  # by numpy: the kernel makes no model

        def run(p: int, part: Iterator) -> Iterator:
            held = _Held(part, hot)
            s = held.rooted(n, total, hyper.d[0])
            if not len(s.n):
                yield from use(p, held, s, None)
                return
            rng, mean = np.random.default_rng([p, 2]), None
            for k in range(BURN_IN + SAMPLES):
                away = s.sweep(hyper, rng, k >= BURN_IN)
                if k >= BURN_IN:
                    now = [away, *s.predict(hyper)[1:]]
                    mean = [x / SAMPLES for x in now] if mean is None else [x + y / SAMPLES for x, y in zip(mean, now, strict=True)]
            yield from use(p, held, s, mean)
            del held, s, mean
            _lean()

        return self.rows.union(self.replies).mapPartitionsWithIndex(run)


_SCORES = "doc_id long, n_symbols long, log_prob double, perplexity double"


def _summed(part: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    docs, sums = {}, {}
    for _, raw in part:
        x = _unpack(raw)
        if x[0] == "docs":
            docs[x[1]] = x[2:]
        else:
            sums.setdefault(x[1], []).append(x[2:])
    for source, (ids, sizes) in docs.items():
        total = np.zeros(len(ids))
        for at, x in sums.get(source, []):
            total[np.cumsum(_thick(at), dtype=np.int64)] += _floats(x)
        for i, m, x in zip(ids, (_thick(sizes) if isinstance(sizes, tuple) else sizes).tolist(), total.tolist(), strict=True):
            yield (i, m, x, float(np.exp(-x / m))) if m else (i, None, None, None)


def perplexities(docs: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """As :func:`score`, of ``docs`` under the model trained on all of them, each word by its probability given all other words of the corpus.

    So a text doesn't vouch for itself: one that occurs once is scored by what
    others have of it, one that occurs twice by its copy. Occurrences move once for
    both training and scoring.
    """
    fit = _Fit(docs, part_words)
    out = fit.sums().partitionBy(fit.n, _same).mapPartitions(_summed)
    return docs.sparkSession.createDataFrame(out, _SCORES, verifySchema=False)


# -------- a model for other documents

_MODEL = "kind int, g long, p double, w double"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            kind, g, p, w = pickle.loads(raw.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), kind, np.int32)), pa.array(g.view(np.int64)), pa.array(p), pa.array(w)], names=["kind", "g", "p", "w"])


def train(docs: DataFrame, part_words: int = PART_WORDS) -> str:
    """Count, sample and write the model; returns its place in the shared folder. The restaurants of one context are one there, weighted by their customers."""
    spark = docs.sparkSession
    fit, place = _Fit(docs, part_words), shared_path(spark, "lm")
    parts = fit.final(lambda p, held, s, found: () if found is None else held.model(s, *found[1:])).union(fit.root_model).map(lambda x: (bytearray(pickle.dumps(x, 5)),))
    rows = spark.createDataFrame(parts, "x binary", verifySchema=False).mapInArrow(_rows, _MODEL)
    rows.groupBy("kind", "g").agg(F.sum("p").alias("p"), F.sum("w").alias("w")).write.parquet(place + "/model")
    spark.createDataFrame([(fit.logs, float(fit.backoff))], "logs array<double>, backoff double").coalesce(1).write.parquet(place + "/spelling")
    return place


def _exploder(logs: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(u, keys, f): the words of each text, and the log probabilities of their spellings."""
        for batch in batches:
            for i, j in pieces(batch.column(1)):
                part = batch.slice(i, j - i)
                a, b, c, sizes = tokens(part.column(1))
                k = words(part.column(1), EXACT)
                _, at, of = np.unique(k.hash, return_index=True, return_inverse=True)
                spelled = spelled_log(pa.array([*(k.data[k.start[x] : k.end[x]].tobytes().decode("utf-8", "surrogatepass") for x in at), ""], pa.string()), logs)
                f = np.full(len(c), spelled[-1])
                own = np.ones(len(c), bool)
                own[np.cumsum(sizes) - 1] = False
                f[own] = spelled[of]
                keys = {13: _key(a, b, c), 2: _key(a, b), 12: _key(b, c), 1: _key(b), 11: _key(c)}
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), *(pa.array(v.view(np.int64)) for v in keys.values()), pa.array(f)], names=["u", *(f"k{x}" for x in keys), "f"])

    return run


def score(docs: DataFrame, place: str) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) of each row under the model at ``place``; perplexity is by word, with the end of the text.

    A null text has null in all three. An empty text is an end and no more. Equal
    texts get equal scores; texts are whole, however long; what the model has never
    seen is scored by shorter contexts and in the end by its spelling. Extra columns
    are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    spelling = spark.read.parquet(place + "/spelling").first()
    model = spark.read.parquet(place + "/model")
    rows = written(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("u", F.monotonically_increasing_id()), "to-score")
    flat = rows.filter("text is not null").select("u", "text").mapInArrow(_exploder(list(spelling["logs"])), "u long, k13 long, k2 long, k12 long, k1 long, k11 long, f double")
    for k in (13, 2, 12, 1, 11):
        own = model.filter(F.col("kind") == k).select(F.col("g").alias(f"{TMP}g{k}"), F.col("p").alias(f"p{k}"), F.col("w").alias(f"w{k}"))
        flat = flat.join(own, F.col(f"k{k}") == F.col(f"{TMP}g{k}"), "left")
    p = F.coalesce("p11", F.exp("f") * F.lit(spelling["backoff"]))
    for gram, context in ((12, 1), (13, 2)):
        share = F.coalesce(F.col(f"p{context}") / F.col(f"w{context}"), F.lit(1.0))
        p = F.coalesce(F.col(f"p{gram}") / F.col(f"w{context}"), F.lit(0.0)) + share * p
    sums = flat.groupBy("u").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum(F.log(p)).alias("log_prob"))
    return rows.select("doc_id", "u").join(sums, "u", "left").select("doc_id", "n_symbols", "log_prob", F.exp(-F.col("log_prob") / F.col("n_symbols")).alias("perplexity"))
