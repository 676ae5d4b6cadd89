"""BM25 full-text search over text columns: natural-language and boolean modes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.sources.store import passing_path

K1, B = 1.2, 0.75
LEAST, MOST = 3, 84
STOP = sorted(set("a about an are as at be by com de en for from how i in is it la of on or that the this to was what when where who will with und www".split()))
_LETTERS = "0-9A-Za-z\x80-\U0010ffff"
#: Stop words are sent along with tasks; a table of more than so many is refused.
MOST_STOP_WORDS = 100_000


def _pattern(blend: str) -> str:
    return r"[0-9A-Za-z\x{80}-\x{10FFFF}" + "".join(rf"\x{{{ord(c):x}}}" for c in blend) + "]+"


def raw_tokens(text: Column, blend: str = "") -> Column:
    """Runs of ASCII letters, digits and all signs beyond ASCII. A sign of ``blend`` is a letter too, and such a run is followed by its parts between them."""
    found = F.regexp_extract_all(text, F.lit(_pattern(blend)), F.lit(0))
    if not blend:
        return found
    cut = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in blend) + "]"
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(cut), F.concat(F.array(t), F.filter(F.split(t, cut), lambda x: x != ""))).otherwise(F.array(t))))


def tokens(text: Column, stop: Sequence[str] = STOP, blend: str = "") -> Column:
    """Lower-case tokens of 3 to 84 characters without stop words."""
    low = F.transform(F.filter(raw_tokens(text, blend), lambda t: F.length(t).between(LEAST, MOST)), lambda t: F.lower(t))
    return F.filter(low, lambda t: ~t.isin(list(stop))) if stop else low


def query_tokens(query: str, stop: Sequence[str] = STOP, blend: str = "") -> list[str]:
    """As :func:`tokens`, of a query."""
    out = []
    for run in re.findall(f"[{_LETTERS}{re.escape(blend)}]+", query):
        parts = [x for x in re.split(f"[{re.escape(blend)}]", run) if x] if blend else []
        out += [run, *parts] if blend and any(c in run for c in blend) else [run]
    return [t.lower() for t in out if LEAST <= len(t) <= MOST and t.lower() not in set(stop)]


def stop_words(table: DataFrame, column: str) -> list[str]:
    """The stop words of a table; null ones are left out."""
    rows = table.select(F.lower(F.col(column)).alias("w")).filter("w is not null").distinct().limit(MOST_STOP_WORDS + 1).collect()
    if len(rows) > MOST_STOP_WORDS:
        raise ValueError(f"more than {MOST_STOP_WORDS} stop words")
    return sorted(r["w"] for r in rows)


class Term(NamedTuple):
    """sign: +, - or nothing; words: one, or those of a phrase; prefix: the word is a beginning."""

    sign: str
    words: tuple[str, ...]
    prefix: bool = False
    phrase: bool = False


def parse(query: str, stop: Sequence[str] = STOP, blend: str = "") -> list[Term]:
    """Terms of a boolean query.

    Blanks may stand between a sign and its term. A word is a run of letters, digits
    and ``*``, so that ``+multi-model`` is ``+multi -model``; it is neither held
    against stop words nor lengths, while a phrase is cut as the text is and is
    required unless it is excluded. What is left of a phrase of stop words is nothing.
    """
    out, at = [], 0
    scan = re.compile(rf' *([+-]?) *(?:"([^"]*)"?|[^{_LETTERS}*]*([{_LETTERS}*]+))')
    while m := scan.match(query, at):
        at = m.end()
        sign, phrase, word = m.groups()
        if phrase is not None:
            kept = query_tokens(phrase, stop, blend)
            if kept:
                out.append(Term(sign or "+", tuple(kept), phrase=True))
        elif word.rstrip("*") or not word.endswith("*"):
            prefix = word.endswith("*")
            word = word[:-1] if prefix else word
            out.append(Term(sign, (word.lower(),), prefix))
    return out


def _in_order(kept: Column, words: Sequence[str]) -> Column:
    """Whether the words follow each other in the array, which is computed once, not for each place."""
    k, want = len(words), F.array(*map(F.lit, words))
    found = lambda ts: F.exists(F.sequence(F.lit(1), F.greatest(F.size(ts) - k + 1, F.lit(1))), lambda i: F.slice(ts, i, F.lit(k)) == want)
    return F.exists(F.array(kept), found)


def postings(df: DataFrame, key: str, cols: Sequence[str], stop: Sequence[str] = STOP, blend: str = "") -> DataFrame:
    """(key, term, tf, doc_len): how often each term is in each row, and how many tokens the row has."""
    docs = df.select(key, tokens(F.concat_ws(" ", *cols), stop, blend).alias("ts"))
    return docs.select(key, F.size("ts").alias("doc_len"), F.explode("ts").alias("term")).groupBy(key, "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def _counted(text: Column, words: Sequence[tuple[str, bool]], stop: Sequence[str], blend: str) -> Column:
    """(n, f0, f1, ...): tokens of the text, and those that are each of the words, by one walk over the text."""
    none = F.struct(F.lit(0).alias("n"), *(F.lit(0).alias(f"f{i}") for i in range(len(words))))

    def step(acc: Column, t: Column) -> Column:
        low = F.lower(t)
        ok = F.length(t).between(LEAST, MOST) & (~low.isin(list(stop)) if stop else F.lit(True))
        hit = lambda w, prefix: low.startswith(w) if prefix else low == F.lit(w)
        counts = [(acc[f"f{i}"] + F.when(ok & hit(*w), 1).otherwise(0)).alias(f"f{i}") for i, w in enumerate(words)]
        return F.struct((acc["n"] + F.when(ok, 1).otherwise(0)).alias("n"), *counts)

    return F.aggregate(raw_tokens(text, blend), none, step)


def fts_search(df: DataFrame, key: str, cols: Sequence[str], query: str, mode: str = "natural", stop: Sequence[str] = STOP, blend: str = "", k1: float = K1, b: float = B) -> DataFrame:
    """(key, score) of the rows that match.

    Null columns are skipped. The corpus is all of ``df``. A query without terms
    gives no rows; a term that is named twice scores twice. Excluded terms and
    phrases exclude wherever they stand in the query. ``x*`` counts documents, so its
    weight is never negative. The texts are walked once, here: the numbers of the
    corpus are observed while rows with a hit, a few numbers each, are written to the
    shared folder.
    """
    terms = parse(query, stop, blend) if mode == "boolean" else [Term("", (t,)) for t in query_tokens(query, stop, blend)]
    scored = [(w, t.prefix, t.sign) for t in terms if t.sign != "-" for w in t.words]
    banned = [(t.words[0], t.prefix) for t in terms if t.sign == "-" and not t.phrase]
    phrases = [t for t in terms if t.phrase]
    if not scored:
        return df.select(key, F.lit(0.0).alias("score")).limit(0)
    words = list(dict.fromkeys([(w, p) for w, p, _ in scored] + banned))
    place = {w: f"f{i}" for i, w in enumerate(words)}
    text = F.concat_ws(" ", *cols)
    rows = df.select(F.col(key), _counted(text, words, stop, blend).alias("c"), *(_in_order(tokens(text, stop, blend), t.words).alias(f"p{i}") for i, t in enumerate(phrases)))
    rows = rows.select(key, "c.*", *(f"p{i}" for i in range(len(phrases))))
    stats = Observation()
    seen = rows.observe(stats, F.count(F.lit(1)).alias("N"), F.sum("n").alias("W"), *(F.count_if(F.col(f) > 0).alias("d" + f) for f in place.values()))
    need, some = F.lit(True), F.lit(False)
    for w, prefix, sign in scored:
        some = some | (F.col(place[w, prefix]) > 0)
        if sign == "+":
            need = need & (F.col(place[w, prefix]) > 0)
    for w in banned:
        need = need & (F.col(place[w]) == 0)
    for i, t in enumerate(phrases):
        need = need & (F.col(f"p{i}") if t.sign == "+" else ~F.col(f"p{i}"))
    path = passing_path(df.sparkSession, "hits")
    kept = seen.filter(need & some).select(key, "n", *place.values())
    kept.write.parquet(path)
    s = stats.get
    average = (s["W"] or 0) / s["N"] if s["N"] else 1.0
    norm = F.lit(k1 * (1 - b)) + F.lit(k1 * b / (average or 1.0)) * F.col("n")
    score = F.lit(0.0)
    for w, prefix, _ in scored:
        f, d = F.col(place[w, prefix]).cast("double"), s["d" + place[w, prefix]]
        score = score + F.when(f > 0, f * F.log(F.lit((s["N"] - d + 0.5) / (d + 0.5) + 1)) * (k1 + 1) / (f + norm)).otherwise(0.0)
    return df.sparkSession.read.schema(kept.schema).parquet(path).select(key, score.alias("score"))
