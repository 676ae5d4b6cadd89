"""Repeated passages by suffix arrays.

A shard is some megabytes of a scan partition. Its words become integers, with a
separator of its own after each document, and its suffixes are sorted by
Larsson-Sadakane refinement: ranks of h words are doubled to 2h, and only groups
that still hold more than one suffix are sorted again. Kasai's common prefixes,
computed for many stretches of the shard in step, then show which runs of
MIN_WORDS words occur in more than one document of the shard.

Between shards, anchors come first: words that begin the least hashed run of
ANCHOR words within a window chosen so that every repeated passage of MIN_WORDS
words has the same anchor in all its copies. Anchors of a single shard are done
with. Around the others every run of MIN_WORDS words is given its fingerprint;
each shard's fingerprints are a sorted run, and the runs of a key range are
merged by binary search of each in the whole.

Work and shuffles are linear in the text: no shard is compared with another one
as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import EXACT, Words, key_columns, lists, mix, ngrams, one_each, pieces, text_of, windows, words, written

MIN_WORDS = 50
ANCHOR = 16
SHARD_BYTES = 16 << 20
_LANES = 4096

# -------- one shard


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and the rank of each, of a string whose suffixes all differ (its last symbol occurs once).

    Symbols are integers from 0. The first sort is by two symbols.
    """
    n = len(symbols)
    if n < 2:
        return np.arange(n), np.arange(n)
    wide = np.int64(int(symbols.max()) + 2)
    key = symbols.astype(np.int64) * wide
    key[:-1] += symbols[1:] + 1
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    rank = np.empty(n, np.int64)  # a group is named by the place of its first suffix
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    end = np.append(new[1:], True)
    places = np.flatnonzero(~(new & end))  # those of groups of more than one
    h = 2
    while len(places):
        sub = sa[places]
        follow = sub + h
        second = np.where(follow < n, rank[np.minimum(follow, n - 1)] + 1, 0)
        group = rank[sub]
        order = np.argsort(group * np.int64(n + 1) + second, kind="stable")
        sub, group, second = sub[order], group[order], second[order]
        sa[places] = sub
        new = np.ones(len(sub), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        rank[sub] = places[np.maximum.accumulate(np.where(new, np.arange(len(sub)), 0))]
        end = np.append(new[1:], True)
        places = places[~(new & end)]
        h *= 2
    return sa, rank


def common_prefixes(symbols: np.ndarray, sa: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """lcp[i]: symbols that the suffixes sa[i - 1] and sa[i] share from their beginning; lcp[0] = 0.

    Kasai's walk, done for up to _LANES stretches of the string at once: each step
    either compares one more symbol or goes on to the next suffix of the stretch.
    """
    n = len(symbols)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    step = max(64, -(-n // _LANES))
    i = np.arange(0, n, step)
    stop = np.minimum(i + step, n)
    h = np.zeros(len(i), np.int64)
    padded = np.append(symbols, -1)
    before = np.append(-1, sa)  # before[rank] is the suffix above
    while len(i):
        j = before[rank[i]]
        a, b = i + h, j + h
        more = (j >= 0) & (a < n) & (b < n)
        more &= padded[np.minimum(a, n)] == padded[np.where(more, b, n)]
        h += more
        done = ~more
        lcp[rank[i[done]]] = h[done]
        i = i + done
        h = np.where(done, np.maximum(h - 1, 0), h)
        live = i < stop
        if not live.all():
            i, stop, h = i[live], stop[live], h[live]
    return lcp


def repeated_in_shard(hashes: list[np.ndarray], least: int, names: list | None = None) -> list[np.ndarray]:
    """Of each document the first words of its runs of ``least`` words that another document of the shard has too.

    Documents of equal names are one.
    """
    counts = np.array([len(x) for x in hashes], np.int64)
    if not counts.sum():
        return [np.zeros(0, np.int64) for _ in hashes]
    ends = np.cumsum(counts + 1)
    n = int(ends[-1])
    is_word = np.ones(n, bool)
    is_word[ends - 1] = False
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    symbols = np.empty(n, np.int64)
    symbols[is_word] = inverse + len(counts)
    symbols[~is_word] = np.arange(len(counts))
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    sa, rank = suffix_array(symbols)
    near = common_prefixes(symbols, sa, rank) >= least
    group = np.cumsum(~near) - 1  # suffixes with the same first words
    first = np.flatnonzero(~near)
    of = (doc if names is None else np.unique(np.array(names), return_inverse=True)[1][doc])[sa]
    several = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    hit = np.sort(sa[several[group]])
    cut = np.searchsorted(hit, np.append(0, ends))
    start = ends - counts - 1
    return [hit[a:b] - s for a, b, s in zip(cut[:-1].tolist(), cut[1:].tolist(), start.tolist(), strict=True)]


def spans(starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted first words of runs of ``least`` words as maximal stretches: first words, ends."""
    if not len(starts):
        return starts, starts
    new = np.flatnonzero(np.append(True, starts[1:] > starts[:-1] + least))
    return starts[new], np.append(starts[new[1:] - 1], starts[-1]) + least


def _slide(x: np.ndarray, w: int, how) -> np.ndarray:
    """how over each run of w items."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = how(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, least: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the runs of ``size`` words that are the least of some ``least - size + 1`` successive ones of a document."""
    grams, w = ngrams(h, size), least - size + 1
    if len(grams) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    lows = _slide(grams, w, np.minimum)
    none = np.zeros(w - 1, np.uint64)
    best = _slide(np.concatenate([none, lows, none]), w, np.maximum)
    at = np.flatnonzero(best == grams)
    return at, grams[at]


# -------- all shards

_SHARD = "doc_id long, u long, shard long, n_words long, f1 long, f2 long, a array<int>, b array<int>, at array<int>, h array<long>"


def _sharder(least: int, size: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number = TaskContext.get().partitionId() << 24, 0
        rows: list[tuple] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, number
            hashes = [x[2] for x in rows]
            found = [spans(x, least) for x in repeated_in_shard(hashes, least, [x[1] for x in rows])]
            marks = [anchors(x, least, size) for x in hashes]
            with np.errstate(over="ignore"):
                prints = [(int(windows(x, len(x))[0] >> np.uint64(1)), int(placed_sum(x) >> np.uint64(1))) if len(x) else (0, 0) for x in hashes]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in rows], pa.int64()),
                    pa.array([x[1] for x in rows], pa.int64()),
                    pa.array([base + number] * len(rows), pa.int64()),
                    pa.array([len(x) for x in hashes], pa.int64()),
                    pa.array([x for x, _ in prints], pa.int64()),
                    pa.array([x for _, x in prints], pa.int64()),
                    lists([x.astype(np.int32) for x, _ in found], pa.int32()),
                    lists([x.astype(np.int32) for _, x in found], pa.int32()),
                    lists([x.astype(np.int32) for x, _ in marks], pa.int32()),
                    lists([x.view(np.int64) for _, x in marks], pa.int64()),
                ],
                names=[x.split()[0] for x in _SHARD.split(", ")],
            )
            rows.clear()
            held, number = 0, number + 1
            return out

        for batch in batches:
            for a, b in pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                k: Words = words(part.column(2), EXACT)
                ids, us = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows += [(i, u, k.hash[x:y].copy()) for i, u, x, y in zip(ids, us, k.first[:-1].tolist(), k.first[1:].tolist(), strict=True)]
                held += len(k.data)
                if held >= shard_bytes:
                    yield shard()
        if rows:
            yield shard()

    return run


def placed_sum(h: np.ndarray) -> np.uint64:
    """A second fingerprint of a whole document: its places matter."""
    return mix(h + np.arange(len(h), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)


def _fingerprinter(least: int, size: int):
    """Rows (u, shard, text, marks): the fingerprints of all runs of ``least`` words that hold a marked anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = least - size
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                k = words(part.column(2), EXACT)
                marks, shards, us = part.column(3), part.column(1).to_numpy(), part.column(0).to_numpy()
                us_, ps, fs, ss = [], [], [], []
                for i in range(b - a):
                    h = k.hash[k.first[i] : k.first[i + 1]]
                    m = len(h) - least + 1
                    if m <= 0:
                        continue
                    at = marks[i].values.to_numpy()
                    cover = np.zeros(m + 1, np.int64)
                    np.add.at(cover, np.clip(at - reach, 0, m), 1)
                    np.add.at(cover, np.clip(at + 1, 0, m), -1)
                    p = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                    fs.append(windows(h, least)[p].view(np.int64))
                    ps.append(p)
                    us_.append(np.full(len(p), us[i]))
                    ss.append(np.full(len(p), shards[i]))
                if not ps:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(fs)), pa.array(np.concatenate(us_)), pa.array(np.concatenate(ps).astype(np.int32)), pa.array(np.concatenate(ss))], names=["f", "u", "p", "shard"]
                )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (f, u, p, shard) of one key range: those whose f some other shard has too."""
    held = list(batches)
    if not held:
        return
    f, u, p, shard = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(4))
    held.clear()
    every = np.sort(f)
    order = np.lexsort((f, shard))
    f, u, p, shard = f[order], u[order], p[order], shard[order]
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
    keep = np.zeros(len(f), bool)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(f)], strict=True):
        own = f[a:b]  # a sorted run: its own occurrences against all
        here = np.searchsorted(own, own, "right") - np.searchsorted(own, own, "left")
        keep[a:b] = np.searchsorted(every, own, "right") - np.searchsorted(every, own, "left") > here
    yield pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(p[keep])], names=["u", "p"])


def _joiner(least: int):
    """Rows (doc_id, n_words, whole, a, b, ps): maximal stretches (doc_id, start_word, end_word, n_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, firsts, ends = [], [], []
            for doc_id, n, whole, a, b, ps in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if whole:
                    pairs = [(0, n)]
                else:
                    more = spans(np.unique(np.array(ps or [], np.int64)), least)
                    pairs = []
                    for x, y in sorted([*zip(a or [], b or [], strict=True), *zip(more[0].tolist(), more[1].tolist(), strict=True)]):
                        if pairs and x <= pairs[-1][1]:
                            pairs[-1] = (pairs[-1][0], max(y, pairs[-1][1]))
                        else:
                            pairs.append((x, y))
                ids += [doc_id] * len(pairs)
                firsts += [x for x, _ in pairs]
                ends += [y for _, y in pairs]
            sizes = [y - x for x, y in zip(firsts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(firsts, pa.int64()), pa.array(ends, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "start_word", "end_word", "n_words"])

    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): maximal stretches of which every run of ``min_words`` words occurs in another document.

    Words are parted by ASCII white space and count with case and signs; they are
    numbered from 0 and end_word isn't included. Stretches that overlap or touch are one.
    What a document repeats only within itself doesn't count. Null and empty texts
    and those of fewer words have no stretch. Rows that agree in doc_id and text are
    one document; a null doc_id is reported as null. Extra columns are ignored; an
    empty table gives an empty result.
    """
    if not 0 < anchor <= min_words:
        raise ValueError("anchor must be from 1 to min_words")
    rows = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), key_columns()[0].alias("u"), text_of().alias("text"))
    made = rows.mapInArrow(_sharder(min_words, anchor, shard_bytes), _SHARD).filter(F.col("n_words") >= min_words)
    # documents with the same words: one stands for all of them between shards
    same = Window.partitionBy("n_words", "f1", "f2")
    made = made.withColumn("rep", F.min("u").over(same)).withColumn("whole", F.max("u").over(same) != F.col("rep"))
    made = written(made, "shards")
    one = one_each(made, "u")
    marks = one.filter("u = rep").select("u", "shard", F.explode(F.arrays_zip("at", "h")).alias("x")).select("u", "shard", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    key = Window.partitionBy("h")
    far = marks.withColumn("far", F.min("shard").over(key) != F.max("shard").over(key)).filter("far")
    wanted = far.groupBy("u").agg(F.min("shard").alias("shard"), F.collect_list("at").alias("marks"))
    texts = rows.select("u", "text").join(wanted, "u")
    prints = texts.select("u", "shard", "text", "marks").mapInArrow(_fingerprinter(min_words, anchor), "f long, u long, p int, shard long")
    hits = prints.repartition("f").mapInArrow(_merge, "u long, p int").groupBy("u").agg(F.collect_list("p").alias("ps"))
    out = one.select("doc_id", "u", "n_words", "whole", "a", "b").join(hits, "u", "left").filter(F.col("whole") | (F.size("a") > 0) | F.col("ps").isNotNull())
    return out.select("doc_id", "n_words", "whole", "a", "b", "ps").mapInArrow(_joiner(min_words), "doc_id long, start_word long, end_word long, n_words long")
