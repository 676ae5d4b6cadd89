"""URL filter by empirical-Bayes host reputation.

A labelled page is a trial: good quality or not. Outcomes are counted by host,
registered domain and suffix. Each level has a beta prior around its parent's
posterior mean, whose strength is estimated by the method of moments from how
far the children of that level scatter beyond binomial noise. A host with few
labels leans on its domain, a domain on its suffix, a suffix on all pages. A page
is kept if a lower bound of its host's posterior is above a threshold: the mean
less 1.645 standard deviations, the normal approximation of the 5 % quantile.

Everything but the final join works on per-host sums, and that join carries only
page_id and url.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import written

#: A page's document is named by the last number of its path.
PATH = r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
DOC_OF_PATH = r"(?s)^.*/([0-9]{1,18})(?:[/.]|$)"
Z = 1.6448536269514722  # one-sided 95 %
THRESHOLD = 0.6
_MIN_STRENGTH, _MAX_STRENGTH = 1.0, 1000.0
_SECOND = {
    "ac": "ae at cn cr cy id il in ir jp ke kr ma me mw mz ng nz pa pr rs rw se th tj tz ug uk za zm zw",
    "co": "ae ag ao at bb bw ck cm cr gg gy hu id il im in ir it je jp ke kr ls ma me mu mw mz na ni nz om pl pn pt pw rs rw ss st sz th tj tt tz ug uk us uz ve vi za zm zw",
    "com": "af ag ai al am an ar au aw az ba bb bd bh bi bm bn bo br bs by bz ci cm cn co cu cv cw cy de dm do dz ec ee eg es et fj fr ge gh gi gl gn gp gr gt gu gy hk hn hr ht im iq jm jo kg kh ki km kp kw ky kz la lb lc lk lr lv ly mg mk ml mm mo ms mt mu mv mw mx my na nf ng ni nr om pa pe pf ph pk pl pr ps pt py qa re ro rs ru rw sa sb sc sd se sg sh sl sn so ss st sv sy tj tm tn to tr tt tw ua ug uy uz vc ve vi vn vu ws ye zm",
    "edu": "ar au bd bo br cn co cu do ec eg es ge gh gr gt hk hn jm jo kw lb lk ly mm mo mt mx my ni np om pe ph pk pl pr ps pt py qa ro ru sa sg sv tr tt tw ua uy ve vn za",
    "gov": "ar au bd br cn co eg gh gr hk ie il in it jo kw lb lk ly mm mo my ng np om ph pk pl ps pt qa ru sa sg sl th tr tt tw ua uk ve vn za zm zw",
    "net": "ae ar au az bd br cn co do ec eg ge gr hk id il in jo ke kw lb lk ly mo mt mx my ng ni np nz om pe ph pk pl ps pt py qa ru sa sg sv th tr tt tw ua uk uy ve vn za",
    "org": "ae ar au az bd br cn co do ec eg es ge gr hk id il in jo ke kw lb lk ly mo mt mx my ng ni np nz om pe ph pk pl ps pt py qa ro rs ru sa sg sv tr tt tw ua uk uy ve vn za",
    "go": "ci cr id jp ke kr th tz ug",
    "gob": "ar bo cl do ec es gt hn mx ni pa pe sv ve",
    "ne": "jp ke kr tz ug",
    "or": "at cr id jp ke kr th tz ug",
    "ltd": "uk",
    "me": "uk ke tz",
    "plc": "uk",
    "sch": "ae id jo lk ly ng qa sa uk",
    "gv": "at",
    "nom": "br co es fr pl ro",
    "id": "au",
    "asn": "au fr",
    "gouv": "ci fr ht ml sn",
    "ad": "jp",
    "ed": "ao ci cr jp",
    "gr": "jp",
    "lg": "jp",
}
#: Suffixes of more than one label under which names are registered; a full list in the usual format is read by :func:`suffix_rules`.
SUFFIXES: tuple[str, ...] = tuple(sorted(f"{a}.{b}" for a, all_ in _SECOND.items() for b in all_.split()))
_DIGITS = 9


def host_of(url: Column) -> Column:
    """Lower-case host without user, port, trailing dot or a leading ``www.``; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(F.regexp_replace(host, r"\.+$", ""), r"^www\.", "")
    return F.when(host != "", host)


def _is_address(host: Column) -> Column:
    return host.rlike(r"^[0-9.]+$|^\[")


def suffix_rules(path: str) -> tuple[str, ...]:
    """The rules of a file in the format of the public suffix list: comments, blank lines, ``*.`` for any label, ``!`` for exceptions."""
    with open(path, encoding="utf-8") as f:
        return tuple(sorted({x.split()[0].lower().lstrip(".") for x in f if x.strip() and not x.startswith("//")}))


def _one_of(x: Column, names: Sequence[str]) -> Column:
    return F.array_contains(F.split(F.lit(" ".join(names)), " "), x)  # one constant, however many names


def suffix_of(host: Column, rules: Sequence[str] = SUFFIXES) -> Column:
    """The longest tail of the host that a rule names, or else its last label; an address is its own."""
    plain = [r for r in rules if r[0] not in "*!"]
    open_, not_ = [r[2:] for r in rules if r.startswith("*.")], [r[1:] for r in rules if r.startswith("!")]
    out, labels = F.substring_index(host, ".", -1), F.size(F.split(host, r"\."))
    for n in range(2, 2 + max((r.count(".") for r in rules), default=0)):  # longer tails win
        tail, rest = F.substring_index(host, ".", -n), F.substring_index(host, ".", 1 - n)
        own = [r for r in plain if r.count(".") == n - 1]
        wild = [r for r in open_ if r.count(".") == n - 2]
        hit = _one_of(tail, own)
        if wild:
            hit = hit | (_one_of(rest, wild) & ~_one_of(tail, not_))
        if own or wild:
            out = F.when((labels >= n) & hit, tail).otherwise(out)
    return F.when(_is_address(host), host).otherwise(out)


def domain_of(host: Column, rules: Sequence[str] = SUFFIXES) -> Column:
    """The suffix with the label before it; a host that is itself a suffix is its own domain."""
    suffix = suffix_of(host, rules)
    labels, n = F.split(host, r"\."), F.size(F.split(suffix, r"\."))
    return F.when(suffix == host, host).otherwise(F.array_join(F.slice(labels, F.greatest(F.size(labels) - n, F.lit(1)), n + 1), "."))


def _level(sums: DataFrame) -> DataFrame:
    """``sums`` (..., pm, n, k) with the strength s of the level's prior and m, the posterior mean; pm is the parent's mean.

    Moments: with weights n, the scatter of k/n about the parent's mean is
    E sum n (k/n - pm)^2 = sum pm(1-pm) (1 + (n-1) rho), so rho follows, and s = 1/rho - 1.
    """
    v = F.col("pm") * (1 - F.col("pm"))
    scatter = F.sum(F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("pm"), F.lit(2.0))))
    own = sums.agg(
        F.round(F.coalesce(scatter, F.lit(0.0)), _DIGITS).alias("q"),
        F.round(F.coalesce(F.sum(F.when(F.col("n") > 0, v)), F.lit(0.0)), _DIGITS).alias("a"),
        F.round(F.coalesce(F.sum(F.when(F.col("n") > 0, v * (F.col("n") - 1))), F.lit(0.0)), _DIGITS).alias("b"),
    )
    rho = F.when(F.col("b") > 0, (F.col("q") - F.col("a")) / F.col("b"))
    s = F.when(rho <= 0, F.lit(_MAX_STRENGTH)).when(rho >= 1, F.lit(_MIN_STRENGTH)).otherwise(1 / rho - 1)
    s = F.least(F.greatest(F.coalesce(s, F.lit(_MAX_STRENGTH)), F.lit(_MIN_STRENGTH)), F.lit(_MAX_STRENGTH))
    strength = own.select(F.round(s, 6).alias("s"))
    out = sums.crossJoin(F.broadcast(strength))  # one row
    return out.withColumn("m", F.round((F.col("k") + F.col("s") * F.col("pm")) / (F.col("n") + F.col("s")), _DIGITS))


def reputations(pages: DataFrame, labels: DataFrame, rules: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n_labelled, n_good, posterior_mean, lower_bound) for every host of ``pages``."""
    host = host_of(F.col("url").cast("string"))
    hosts = pages.select(host.alias("host"), F.regexp_extract(F.regexp_extract(F.col("url").cast("string"), PATH, 1), DOC_OF_PATH, 1).alias("d"))
    hosts = hosts.filter("host is not null").select("host", F.when(F.col("d") != "", F.col("d")).cast("long").alias("doc_id"))
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("long").alias("good"))
    tries = hosts.join(known, "doc_id", "left").groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    tries = written(tries.select("host", domain_of(F.col("host"), rules).alias("domain"), suffix_of(F.col("host"), rules).alias("suffix"), "n", "k"), "hosts")
    by_domain = written(tries.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    # Laplace's rule for all pages
    overall = by_suffix.agg(F.round((F.coalesce(F.sum("k"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2), _DIGITS).alias("pm"))
    by_suffix = written(by_suffix.crossJoin(F.broadcast(overall)), "suffixes")  # one row
    suffixes = _level(by_suffix).select("suffix", F.col("m").alias("pm"))
    domains = _level(written(by_domain.join(suffixes, "suffix"), "domains")).select("domain", F.col("m").alias("pm"))
    out = _level(written(tries.join(domains, "domain"), "hosts"))
    a, b = F.col("k") + F.col("s") * F.col("pm"), F.col("n") - F.col("k") + F.col("s") * (1 - F.col("pm"))
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return out.select(
        "host", "domain", "suffix", F.col("n").alias("n_labelled"), F.col("k").alias("n_good"), F.round("m", 6).alias("posterior_mean"), F.round(a / (a + b) - Z * deviation, 6).alias("lower_bound")
    )


def filter_urls(pages: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rules: Sequence[str] = SUFFIXES) -> DataFrame:
    """Each page with its host's reputation and ``keep``: lower_bound >= threshold.

    A null or hostless url has null in the host's columns and isn't kept. A page
    whose path names no labelled document is no trial. A document with several
    labels counts by its worst. Equal rows are as many trials. An empty url has no
    host, a long one is read whole. Extra columns are ignored, whatever their names; without any label every host has the overall mean 1/2; an empty table
    gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url")).withColumn("host", host_of(F.col("url")))
    out = rows.join(reputations(pages, labels, rules), "host", "left")
    keep = F.coalesce(F.col("lower_bound") >= threshold, F.lit(False))
    return out.select("page_id", "url", "host", "domain", "suffix", "n_labelled", "n_good", "posterior_mean", "lower_bound", keep.alias("keep"))


def _sql_level(name: str, source: str) -> str:
    return f"""
        {name}_q AS (
          SELECT round(coalesce(sum(CASE WHEN n > 0 THEN n * pow(k / n - pm, 2) END), 0), {_DIGITS}) AS q,
                 round(coalesce(sum(CASE WHEN n > 0 THEN pm * (1 - pm) END), 0), {_DIGITS}) AS a,
                 round(coalesce(sum(CASE WHEN n > 0 THEN pm * (1 - pm) * (n - 1) END), 0), {_DIGITS}) AS b
          FROM {source}),
        {name}_s AS (
          SELECT round(least(greatest(coalesce(CASE WHEN b <= 0 THEN NULL WHEN (q - a) / b <= 0 THEN {_MAX_STRENGTH} WHEN (q - a) / b >= 1 THEN {_MIN_STRENGTH}
                 ELSE 1 / ((q - a) / b) - 1 END, {_MAX_STRENGTH}), {_MIN_STRENGTH}), {_MAX_STRENGTH}), 6) AS s FROM {name}_q),
        {name} AS (SELECT x.*, s, round((k + s * pm) / (n + s), {_DIGITS}) AS m FROM {source} x, {name}_s)"""


SQL = f"""
        WITH u AS (
          SELECT page_id, url, CASE WHEN instr(url, '://') > 1 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        v AS (SELECT page_id, url, rest, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS place FROM u),
        h AS (
          SELECT page_id, url, CASE WHEN starts_with(name, 'www.') THEN nullif(substr(name, 5), '') ELSE nullif(name, '') END AS host,
                 list_filter(list_transform(string_split(path, '/')[2:], lambda s: split_part(s, '.', 1)),
                             lambda s: length(s) BETWEEN 1 AND 18 AND translate(s, '0123456789', '') = '')[-1]::BIGINT AS doc_id
          FROM (SELECT page_id, url, rtrim(split_part(string_split(lower(place), '@')[-1], ':', 1), '.') AS name,
                       split_part(split_part(substr(rest, length(place) + 1), '?', 1), '#', 1) AS path FROM v)),
        g AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
        c AS (SELECT host, count(good)::DOUBLE AS n, coalesce(sum(good), 0)::DOUBLE AS k FROM h LEFT JOIN g USING (doc_id) WHERE host IS NOT NULL GROUP BY host),
        l AS (SELECT *, string_split(host, '.') AS p, translate(host, '0123456789.', '') = '' OR starts_with(host, '[') AS ip FROM c),
        l2 AS (SELECT *, len(p) > 1 AND array_to_string(p[-2:], '.') IN (SELECT unnest({list(SUFFIXES)!r})) AS two FROM l),
        t AS (
          SELECT host, n, k, CASE WHEN ip THEN host WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
                 CASE WHEN ip THEN host WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain
          FROM l2),
        d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM t GROUP BY domain, suffix),
        s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d0 GROUP BY suffix),
        s1 AS (SELECT s0.*, (SELECT round((coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2), {_DIGITS}) FROM s0) AS pm FROM s0),
        {_sql_level('s2', 's1')},
        d1 AS (SELECT d0.*, s2.m AS pm FROM d0 JOIN s2 USING (suffix)),
        {_sql_level('d2', 'd1')},
        h1 AS (SELECT t.*, d2.m AS pm FROM t JOIN d2 USING (domain)),
        {_sql_level('h2', 'h1')},
        b AS (SELECT *, k + s * pm AS aa, n - k + s * (1 - pm) AS bb FROM h2),
        r AS (
          SELECT host, domain, suffix, n::BIGINT AS n_labelled, k::BIGINT AS n_good, round(m, 6) AS posterior_mean,
                 round(aa / (aa + bb) - {Z} * sqrt(aa * bb / ((aa + bb) * (aa + bb) * (aa + bb + 1))), 6) AS lower_bound
          FROM b)
        SELECT page_id, url, h.host, domain, suffix, n_labelled, n_good, posterior_mean, lower_bound, coalesce(lower_bound >= {THRESHOLD}, false) AS keep
        FROM h LEFT JOIN r ON h.host = r.host"""
