"""The ten operators on small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import zstandard

from millrace.llm import bpe, exact, lm, media, mixing, near, quality, suffix, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _mr_u1 long, keep string, root long"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 60, 150]))] for _ in range(n)]
    out = [" ".join(x) for x in base]
    for x in base[: n // 2]:  # near copies of all degrees
        y = list(x)
        for _ in range(rng.randrange(0, max(1, len(y) // 8) + 1)):
            y[rng.randrange(len(y))] = rng.choice(vocabulary)
        out.append(" ".join(y))
    return out


@pytest.fixture(scope="module")
def rows():
    texts = [*_texts(), "", "", None, None, "one", "one", "   ", "it's  a\n\ttest — naïve 漢字 12'll", "long " * 30_000]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 3}" if i % 5 else None, 1, 7, "x", 9) for i, t in enumerate(texts)]
    return [*out, out[0], out[0], (None, "null id " * 40, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark, rows):
    return spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for df in (
        mixing.mixed(none), mixing.mixed_rows(none), bpe.encode(none), near.near_duplicates(none), near.drop_near(none), exact.exact_duplicates(none), exact.drop_exact(none),
        quality.classify(none, labels), suffix.repeated_passages(none), lm.perplexities(none), warc.archive(pages), urls.filter_urls(pages, labels), media.fingerprints(media.render(vectors)),
    ):
        assert df.collect() == []


def test_near_groups_are_those_of_brute_force(docs, rows):
    def shingles(t):
        w = [x for y in t.lower().split() for x in (y if y == "漢字" else [y])]
        return {tuple(w[i : i + near.SHINGLE]) for i in range(len(w) - near.SHINGLE + 1)} or {tuple(w)}

    have = [(i, shingles(t)) for i, t in {(r[0], r[1]) for r in rows if r[1] and r[1].split()}]
    parent = list(range(len(have)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(have)):
        for b in range(a):
            x, y = have[a][1], have[b][1]
            if len(x & y) >= near.THRESHOLD * len(x | y):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for k, (i, _) in enumerate(have):
        groups[find(k)].append(i)
    want = {i: min(g) for g in groups.values() if len(g) > 1 for i in g}
    got = {r["doc_id"]: r["group_doc_id"] for r in near.near_duplicates(docs).collect()}
    assert got == want
    left = near.drop_near(docs)
    assert left.columns == docs.columns
    assert left.count() == len({(r[0], r[1]) for r in rows if r[1] and r[1].split()}) - sum(len(g) - 1 for g in groups.values()) + sum(1 for r in rows if not (r[1] and r[1].split()))


@pytest.mark.parametrize("block", [1 << 12, 16])
def test_exact_groups(docs, rows, block):
    by = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by[r[1]].append(r[0])
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    want = {(i, low(g), len(g), i == low(g)) for g in by.values() for i in set(g)} | {(r[0], r[0], 1, True) for r in rows if r[1] is None}
    assert {tuple(r) for r in exact.exact_duplicates(docs, block).collect()} == want
    left = exact.drop_exact(docs, block)
    assert left.columns == docs.columns and left.count() == len(by) + sum(r[1] is None for r in rows)


def test_bpe_agrees_with_the_public_encoder_and_decodes(docs, rows):
    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.encode(docs)
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    for r in out.collect():
        if r["doc_id"] is not None:
            t = by_id[r["doc_id"]]
            assert (r["token_ids"] is None) == (t is None)
            assert t is None or (r["token_ids"] == enc.encode_ordinary(t) and r["round_trips"] and r["n_tokens"] == len(r["token_ids"]))
    assert {(r[0], r[1]) for r in bpe.decode(out).collect()} == {(r[0], r[1]) for r in rows}


def test_mixing_keeps_the_budget_and_every_column(docs, rows):
    total = sum(len(r[1].split()) for r in rows if r[1])
    out = mixing.mixed(docs, budget_permille=500).collect()
    assert [r["virtual_finish"] for r in out] == sorted(r["virtual_finish"] for r in out)
    assert out[-1]["running_tokens"] == sum(r["n_tokens"] for r in out) <= total // 2
    assert mixing.mixed_rows(docs, budget_permille=1000).count() == len(rows)
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_repeated_passages_are_those_of_brute_force(docs, spark):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(70)]
    texts = [" ".join([*(f"a{rng.random()}" for _ in range(20)), *(passage[: 50 + 5 * (i % 4)] if i % 2 else []), *(f"b{rng.random()}" for _ in range(9))]) for i in range(24)]
    df = spark.createDataFrame(list(enumerate([*texts, None, "", " ".join(passage * 2)])), "doc_id long, text string").repartition(5)
    where = defaultdict(set)
    words = {r[0]: (r[1] or "").split() for r in df.collect()}
    for i, w in words.items():
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    covered = lambda i, w: {k + j for k in range(len(w) - 49) if len(where[tuple(w[k : k + 50])]) > 1 for j in range(50)}
    want = {(i, x) for i, w in words.items() for x in covered(i, w)}
    got = {(r["doc_id"], x) for r in suffix.repeated_passages(df, shard_bytes=2000).collect() for x in range(r["start_word"], r["end_word"])}
    assert got == want and want
    assert suffix.repeated_passages(docs).count() > 0


def test_quality_learns_and_keeps_columns(spark, docs, rows):
    good = spark.createDataFrame([(i, ("fine prose reads well " if i % 2 else "$$ buy now @@ ") + f"x{i % 7}", "en", "s") for i in range(400)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    held = quality.classify(good, labels).filter("doc_id >= 200").collect()
    assert np.mean([r["keep"] == bool(r["doc_id"] % 2) for r in held]) > 0.95
    out = quality.classify(docs, _labels(spark, rows))
    assert out.count() == len(rows) and out.filter("p_quality is null").isEmpty()
    assert quality.drop_rejected(docs, _labels(spark, rows)).columns == docs.columns


def test_warc_gives_back_what_it_took(spark, tmp_path):
    rng = random.Random(2)
    long = [" ".join(rng.choice(["alpha", "beta", "gamma", f"n{rng.randrange(999)}"]) for _ in range(3000)) for _ in range(60)]  # over 1 MB: the dictionary is trained
    pages = [(1, "http://a.b/%0A\n", "<p>ü</p>"), (2, None, None), (None, "u", ""), (1, "http://a.b/%0A\n", "<p>ü</p>"), *((i, f"http://h/{i}%20c", x) for i, x in enumerate(long, 10))]
    rows = [(i, u, None if h is None else bytearray(h.encode()), 1, "x") for i, u, h in pages] + [(99, "http://raw/", bytearray(b"\xff\xfe\x00 not UTF-8"), 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary, offset int, digest string").repartition(3)
    folder = "file://" + str(tmp_path / "w")
    index = warc.write(df, folder).collect()
    back = [(r[0], r[1], r[2]) for r in warc.read(spark, folder).collect()]
    assert sorted(back, key=repr) == sorted(((r[0], r[1], r[2]) for r in rows), key=repr) and len(index) == len(rows)
    r = index[-1]
    assert warc.read_one(f"{folder}/{r['file']}", r["offset"], r["length"])["page_id"] == r["page_id"]


def test_warc_dictionary_is_trained_and_addresses_stay(spark):
    rng = random.Random(3)
    records = [warc.record(i, f"http://h/{i}%20c", " ".join(rng.choice(["alpha", "beta", f"n{rng.randrange(99)}"]) for _ in range(400)).encode()) for i in range(300)]
    assert b"WARC-Target-URI: http://h/7%20c\r\n" in records[7]
    raw = warc.build_dictionary(records)
    assert zstandard.ZstdCompressionDict(raw).dict_id() > 0  # a raw prefix has no number
    data, places = warc.pack(records)
    assert [(a, n) for a, n, _ in warc.unpack(data)] == places and [x for *_, x in warc.unpack(data)] == records
    assert [x for *_, x in warc.unpack(warc.pack(records[:1])[0])] == records[:1]
    foreign = b"WARC/1.0\r\nwarc-type: response\r\nContent-Length: 3\r\nWARC-Truncated: length\r\n\r\nabc\r\n\r\n"
    assert warc.parse(foreign) == {"page_id": None, "url": None, "html": b"abc", "record_id": None, "digest": None}


def test_urls_without_host_are_not_kept(spark):
    pages = spark.createDataFrame([(1, "http://a.example.com/1"), (2, None), (3, "nonsense"), (4, "http://A.example.com./2")], "page_id long, url string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, labels).collect()}
    assert got[1]["host"] == got[4]["host"] == "a.example.com" and got[1]["domain"] == "example.com"
    assert (got[1]["n_labelled"], got[1]["n_good"]) == (2, 1) and not got[2]["keep"] and not got[3]["keep"]


def test_fingerprints_of_a_shifted_clip_agree_and_bad_files_are_null(spark):
    rng = np.random.default_rng(1)
    x = media._notes(rng.normal(size=(4, 64))).ravel()
    t, h = media.fingerprint(x)
    t2, h2 = media.fingerprint(x[media.HOP * 10 :])
    assert len({*zip(t - 10, h, strict=True)} & {*zip(t2, h2, strict=True)}) > 0.9 * len(h2)
    assert np.allclose(media.read_wav(media.to_wav(x))[0], np.clip(x, -1, 1), atol=1e-4)
    df = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(media.to_wav(np.zeros(0)))), (4, bytearray(media.to_wav(x)))], "media_id long, wav binary")
    got = {r["media_id"]: r for r in media.fingerprints(df).collect()}
    assert got[1]["fingerprint"] is None and got[2]["rate"] is None and got[3]["fingerprint"] == [] and len(got[4]["fingerprint"]) == len(h)


def test_lm_tells_the_order_of_words(spark):
    rng = random.Random(3)
    say = lambda: " ".join(f"{rng.choice('abc')}some {rng.choice('abc')}thing followed every {rng.choice('abc')}body home" for _ in range(8))
    texts = [say() for _ in range(200)]
    salad = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:20]]
    place = lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    both = spark.createDataFrame(list(enumerate(texts[:20] + salad)), "doc_id long, text string")
    got = {r["doc_id"]: r["perplexity"] for r in lm.score(both, place).collect()}
    assert all(got[i + 20] > 10 * got[i] for i in range(20))


def test_lm_scores_every_row_with_and_without_a_model_at_hand(docs, rows):
    own = {(r[0], r[1]): r["log_prob"] for r in lm.perplexities(docs).collect()}
    other = {(r[0], r[1]): r["log_prob"] for r in lm.score(docs, lm.train(docs)).collect()}
    assert own.keys() == other.keys() and lm.perplexities(docs).count() == len(rows)
    for k, v in own.items():
        assert (v is None) == (other[k] is None) and (v is None or (v < 0 and other[k] < 0))


def test_urls_name_their_document_last_in_the_path(spark):
    pages = spark.createDataFrame([(1, "http://h.com/2024/05/123"), (2, "http://10.0.0.1/5"), (3, "http://q.com/7?x=/8"), (4, "http://f.com/9.html#/8")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i in (123, 5, 7, 9)), 0) for i in (2024, 123, 5, 1, 7, 8, 9)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["n_labelled"], r["n_good"]) for r in urls.filter_urls(pages, labels).collect()}
    assert got == {k: (1, 1) for k in (1, 2, 3, 4)}


def test_urls_against_a_second_reading_by_hand(spark):
    """Beta-binomial shrinkage of repeated, labelled and unlabelled pages, in plain Python; other columns clash with working names."""
    rng = random.Random(4)
    hosts = ["a.shop.co.uk", "b.shop.co.uk", "x.com", "y.x.com", "news.com.sg", "10.0.0.1", "localhost"]
    pages = [(i, f"http://{rng.choice(hosts)}:80/{'p/' * rng.randrange(3)}{rng.randrange(60)}.html?q=/9#/8", "h", 1.0) for i in range(300)]
    pages += pages[:20] + [(1000, "http://u@X.com./" + "long/" * 5000 + "3", "h", 1.0), (1001, "", "h", 1.0)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, host string, s double").repartition(3)
    got = {(r["page_id"]): r for r in urls.filter_urls(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good = {i: q for i, q, _ in labels}
    tries = defaultdict(lambda: [0, 0])
    for _, u, *_ in pages:
        if u:
            host = u.split("://")[1].split("/")[0].split("@")[-1].split(":")[0].rstrip(".").lower()
            last = [x for x in u.split("?")[0].replace(".html", "").split("/")[3:] if x.isdigit()][-1]
            tries[host][0] += int(last) in good
            tries[host][1] += good.get(int(last), 0)
    names = {"a.shop.co.uk": ("shop.co.uk", "co.uk"), "b.shop.co.uk": ("shop.co.uk", "co.uk"), "x.com": ("x.com", "com"), "y.x.com": ("x.com", "com"), "news.com.sg": ("news.com.sg", "com.sg"), "10.0.0.1": ("10.0.0.1",) * 2, "localhost": ("localhost",) * 2}

    def level(rows):  # name: (n, k, parent's mean) -> strength
        q = sum(n * (k / n - m) ** 2 for n, k, m in rows.values() if n)
        a, b = sum(m * (1 - m) for n, _, m in rows.values() if n), sum(m * (1 - m) * (n - 1) for n, _, m in rows.values() if n)
        rho = (q - a) / b if b > 0 else 0
        return 1000.0 if rho <= 0 else min(1000.0, max(1.0, 1 / rho - 1)) if rho < 1 else 1.0

    total = [sum(x[i] for x in tries.values()) for i in (0, 1)]
    mean, means = (total[1] + 1) / (total[0] + 2), {}
    for depth in (1, 0, None):
        rows = defaultdict(lambda: [0, 0, 0.0])
        for h, (n, k) in tries.items():
            key = h if depth is None else names[h][depth]
            parent = mean if depth == 1 else means[names[h][1 if depth == 0 else 0], 1 if depth == 0 else 0]
            rows[key] = [rows[key][0] + n, rows[key][1] + k, parent]
        s = level(rows)
        for key, (n, k, m) in rows.items():
            means[key, depth] = (k + s * m) / (n + s)
    for r in got.values():
        if r["host"]:
            assert (r["domain"], r["suffix"]) == names[r["host"]] and [r["n_labelled"], r["n_good"]] == tries[r["host"]]
            assert r["posterior_mean"] == pytest.approx(means[r["host"], None], abs=1e-5)
    assert got[1000]["host"] == "x.com" and got[1001]["host"] is None and not got[1001]["keep"]


def test_url_suffix_rules_in_the_usual_format(spark, tmp_path):
    path = tmp_path / "list"
    path.write_text("// comment\n\ncom\nck\n*.ck\n!www.ck\nco.uk\na.b.co.uk\n", encoding="utf-8")
    rules = urls.suffix_rules(str(path))
    hosts = ["x.y.com", "x.y.ck", "z.x.y.ck", "www.ck", "p.www.ck", "q.co.uk", "r.a.b.co.uk", "com"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = [tuple(r) for r in df.select(urls.suffix_of(df["h"], rules), urls.domain_of(df["h"], rules)).collect()]
    assert got == [("com", "y.com"), ("y.ck", "x.y.ck"), ("y.ck", "x.y.ck"), ("ck", "www.ck"), ("ck", "www.ck"), ("co.uk", "q.co.uk"), ("a.b.co.uk", "r.a.b.co.uk"), ("com", "com")]


def test_fingerprints_are_those_of_brute_force(spark):
    """A plain transform of each frame by its definition, and peaks paired one by one; long files, NaN, repeats and clashing names."""
    rng = np.random.default_rng(5)
    vectors = [(1, [float(x) for x in rng.normal(size=64)]), (2, [float("nan"), None, 1.0]), (1, None), (3, [])]
    rows = spark.createDataFrame([*vectors, vectors[0]], "vec_id long, embedding array<double>").repartition(2)
    wavs = media.render(rows)
    out = media.fingerprints(wavs.selectExpr("*", "1 as rate", "2 as samples", "3 as fingerprint")).collect()
    assert sorted((r["media_id"], r["samples"]) for r in out if r["samples"] is not None) == [(1, 8000), (1, 8000), (2, 8000), (3, 0)] and len(out) == 5
    angle = np.exp(-2j * np.pi * np.outer(np.arange(media.FRAME), np.arange(media.FRAME // 2 + 1)) / media.FRAME)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / (media.FRAME - 1))
    for w, r in zip(sorted(wavs.collect(), key=lambda r: (r[0], r[1] is None)), sorted(out, key=lambda r: (r[0], r[1] is None)), strict=True):
        if w["wav"] is None:
            continue
        x, _ = media.read_wav(bytes(w["wav"]))
        found, at = [], 0
        while len(x) and (at == 0 or at + media.FRAME - media.HOP < len(x)):
            piece = np.append(x[at : at + media.FRAME], np.zeros(max(0, at + media.FRAME - len(x))))
            m = np.round(np.abs((piece * hann) @ angle) / (media.FRAME / 4), 9)
            local = [k for k in range(1, media.FRAME // 2) if m[k] > m[k - 1] and m[k] >= m[k + 1] and m[k] > 1e-4]
            found.append(sorted(local, key=lambda k: (-m[k], k))[: media.PEAKS])
            at += media.HOP
        want = sorted((t, f << 15 | found[t + d][0] << 6 | d) for t, fs in enumerate(found) for f in fs for d in media.AFTER if t + d < len(found) and found[t + d])
        assert [tuple(y) for y in r["fingerprint"]] == want
    x = media._notes(rng.normal(size=(200, 64))).ravel()  # several blocks
    t, h = media.fingerprint(x)
    t2, h2 = media.fingerprint(media.sample_blocks(media.to_wav(x))[1])
    t3, h3 = media.fingerprint(media.read_wav(media.to_wav(x))[0])
    assert np.array_equal(t2, t3) and np.array_equal(h2, h3) and len(t) > 0


def _machine(seed=3):
    rng = np.random.default_rng(seed)
    size, heads = quality.SIZE, 2
    return quality.Model(rng.normal(size=heads), rng.normal(size=(size, heads)).astype(np.float32), rng.normal(size=(size, heads * quality.RANK)).astype(np.float32))


def test_quality_scores_are_those_of_all_pairs():
    texts = pa.array(["the cat sat", "", None, "$$ a a b 12", "x"])
    rows, feats, vals = quality.features(texts, pa.array(["s"] * 5), pa.array([None] * 5, pa.string()))
    m = _machine()
    got = quality.raw_scores(m, rows, feats, vals, 5)
    for i in range(5):
        f, x = feats[rows == i], vals[rows == i].astype(float)
        for head in range(2):
            v = m.v[f][:, head * quality.RANK : (head + 1) * quality.RANK].astype(float)
            pairs = sum(float(v[a] @ v[b]) * x[a] * x[b] for a in range(len(f)) for b in range(a))
            assert got[i, head] == pytest.approx(m.w0[head] + float(m.w[f, head] @ x) + pairs, rel=1e-4, abs=1e-3)


def test_quality_hashes_whole_names_and_bounds_what_it_trains_on(spark):
    names = ["common-crawl-2019", "common-crawl-2024", "abcdefgh-1", "abcdefgh-2", None, "\0", ""]
    assert len(set(quality._meta(pa.array(names), 0).tolist())) == len(names)
    rows = [(1, f"text {i}", "en", "s") for i in range(3000)] + [(2, "same words", "en", "s")] * 500 + [(i, f"w{i} " * 200, "en", "s") for i in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(2, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    few = quality._training_rows(docs, labels, 100, 1 << 30)
    assert few.select("h1", "h2").distinct().count() <= 100
    few = quality._training_rows(docs, labels, 8000, 2000).select("h1", "h2", "text").distinct().collect()
    assert 0 < sum(len(r["text"]) for r in few) <= 2000
    two = [tuple(r) for r in quality._training_rows(docs, labels, 8000, 1 << 30).filter("doc_id = 2").select("good", "toxic").distinct().collect()]
    assert two == [(0, 1)]


def test_words_of_scripts_without_spaces():
    from millrace.llm.common import words

    texts = ["漢字かな test", "a\u00a0b\u3000c", "ไทย", "plain words", "é à"]
    k = words(pa.array(texts))
    got = [[k.data[a:b].tobytes().decode() for a, b, d in zip(k.start, k.end, k.doc, strict=True) if d == i] for i in range(5)]
    assert got == [["漢", "字", "か", "な", "test"], ["a", "b", "c"], ["ไ", "ท", "ย"], ["plain", "words"], ["é", "à"]]


def test_workers_give_freed_memory_back():
    """Blocks below the size that the system maps apart, freed but for the last: they go back when the work is done, and rows pass as they are."""
    from millrace.llm.common import lean

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 >> 20  # noqa: E731, SIM115
    kept, sizes = [], []

    def run(rows):
        blocks = [bytearray(b"x" * 100_000) for _ in range(3000)]
        kept.append(blocks[-1])
        sizes.append(held())
        del blocks
        yield from rows

    assert list(lean(run)(iter(range(5)))) == list(range(5))
    assert held() < sizes[0] - 200


def test_tables_written_on_the_way_go(spark, docs, rows):
    """Stages leave only what their result is read from, and the result can be read after that, more than once."""
    from pathlib import Path

    from millrace.llm.common import passing_path, settled, written

    folder = Path(passing_path(spark, "x").removeprefix("file:")).parent

    def left(make):
        before = set(folder.iterdir())
        out = make()
        have = out.count()
        assert have == out.count() > 0
        return {x.name.rsplit("-", 1)[0] for x in set(folder.iterdir()) - before}

    assert left(lambda: near.drop_near(docs)) == {"groups", "again", "dropped"}
    assert left(lambda: exact.drop_exact(docs)) == {"kept"}
    assert left(lambda: mixing.mixed_rows(docs)) == {"chosen"}
    assert left(lambda: near.near_duplicates(docs)) == {"groups"}

    def inner():
        a = settled(lambda: written(spark.range(5).toDF("v"), "one"), "two")
        return written(a, "three").filter("v > 1")

    assert left(lambda: settled(inner, "four")) == {"four"}

    def fails():
        written(spark.range(5).toDF("v"), "five")
        raise ValueError("x")

    before = set(folder.iterdir())
    with pytest.raises(ValueError):
        settled(fails, "six")
    assert set(folder.iterdir()) == before
