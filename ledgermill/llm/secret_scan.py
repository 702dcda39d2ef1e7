"""Secrets in texts: fixed patterns, and a randomness test battery for the rest.

The base kinds are assignments to secret-like names, access keys and long hex
strings. Every other long run of encoded characters is a candidate. Its
encoding is inferred, the one with the fewest symbols that has them all; a chi-squared test of its alphabet, a runs test and a
serial correlation test must all be compatible with random symbols. How
unlikely ordinary text is to look as uniform and as mixed gives a p-value.
Short runs have little evidence, above all over 32 symbols of one case, where
about 90 characters are enough, so p-values compete within their length band:
Benjamini-Hochberg over all candidates of a band of the whole corpus holds the
share of false discoveries below ``FDR``.

Everything is Column expressions. Positions are code points. Candidates leave
their rows for the tests; p-values are counted in bins of a tenth of a power
of ten, so the thresholds need one small grouped table.

Edge cases: a null text is empty and has no spans. Repeated rows are each
searched. Candidates that touch a base span are not added again. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settle
from ..session import cut_lineage


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed values ---------------------------------------------------------------
NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
# a run is taken to its end, so the least length may stand in the pattern
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: encoding, pattern, symbols in order, how far ordinary text is from uniform (1: uniform)
ENCODINGS = (
    ("decimal", "^[0-9]+$", "0123456789", 1.1),
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.6),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 2.1),
    ("base32 lower", "^[a-z2-7]+=*$", "abcdefghijklmnopqrstuvwxyz234567", 2.1),
    ("base36", "^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", 2.3),
    ("base36 upper", "^[A-Z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 2.3),
    ("base58", "^[1-9A-HJ-NP-Za-km-z]+$", "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", 3.8),
    ("base62", "^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 4.1),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 4.2),
)
FDR = 0.01
#: A test result this many standard deviations from random symbols rules them out.
GATE = 3.3
#: Changes between lower case, upper case, digits and signs per character of ordinary text.
TEXT_CHANGES = 0.2
BINS_PER_POWER, BINS = 10, 300
# ----------------------------------------------------------------------------


def _running(values: Column) -> Column:
    """Running sums of an array, in as many passes as its size has bits."""
    passes = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.size(values) + F.lit(0.0))), F.lit(0)).cast("int"))

    def step(sums, k):
        by = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(
            sums, lambda x, i: x + F.when(i >= by, F.coalesce(F.get(sums, i - by), F.lit(0))).otherwise(F.lit(0))
        )

    return F.when(F.size(values) > 0, F.aggregate(passes, values, step)).otherwise(values)


def _find(rows: DataFrame, kind: str, pattern: str) -> DataFrame:
    """Add ``kind``: start, end and text of the leftmost matches that do not overlap."""
    rows = settle(rows, m=F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size("m") > 0
    gaps = F.when(some, F.transform(F.split("text", pattern, -1), F.length))
    rows = settle(rows, gaps=gaps)
    before = F.transform(
        "m", lambda x, i: F.coalesce(F.get("gaps", i) + F.when(i > 0, F.length(F.get("m", i - 1))).otherwise(0), F.lit(0))
    )
    rows = settle(rows, starts=F.when(some, _running(before)).otherwise(F.array().cast("array<int>")))
    spans = F.transform(
        "m",
        lambda x, i: F.struct(
            F.get("starts", i).alias("start"), (F.get("starts", i) + F.length(x)).alias("end"), x.alias("s")
        ),
    )
    if kind == "assign":
        values = F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(2)))
        rows = settle(rows, values=values)
        spans = F.filter(spans, lambda x, i: F.length(F.get("values", i)) >= ASSIGN_LEAST)
        rows = settle(rows, **{kind: spans}).drop("values")
    else:
        rows = settle(rows, **{kind: spans})
    return rows.drop("m", "gaps", "starts")


def _phi(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))


def battery(candidates: DataFrame) -> DataFrame:
    """Add ``encoding, band, p, random`` to rows with a string ``s``."""
    which = F.lit(ENCODINGS[-1][0])
    for name, pattern, _, _ in reversed(ENCODINGS[:-1]):
        which = F.when(F.col("s").rlike(pattern), F.lit(name)).otherwise(which)
    rows = candidates.withColumn("encoding", which)
    pick = lambda values: F.element_at(
        F.create_map(*[F.lit(x) for e, v in zip(ENCODINGS, values) for x in (e[0], v)]), F.col("encoding")
    )
    alphabet = pick([e[2] for e in ENCODINGS])
    plain = F.when(F.col("encoding") == "hex", F.lower("s")).otherwise(F.translate("s", "-_", "+/"))
    rows = settle(
        rows,
        alphabet=alphabet, a=F.length(alphabet).cast("double"), kappa=pick([e[3] for e in ENCODINGS]),
        chars=F.filter(F.split(plain, ""), lambda c: (c != "") & (c != "=")),
        classes=F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
            "s", "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s"), ""),
    )
    rows = settle(
        rows,
        x=F.transform("chars", lambda c: (F.call_function("locate", c, F.col("alphabet")) - 1).cast("double")),
    )
    rows = settle(
        rows,
        n=F.size("x").cast("double"),
        mean=F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size("x"), F.lit(1)),
        counts=F.transform(
            F.sequence(F.lit(0), F.col("a").cast("int") - 1), lambda k: F.size(F.filter("x", lambda v: v == k)).cast("double")
        ),
        high=F.transform("x", lambda v: v >= F.col("a") / 2),
        changes=F.size(F.filter("classes", lambda c, i: (i > 0) & (c != F.get("classes", i - 1)))).cast("double"),
    )
    n, a = F.col("n"), F.col("a")
    rows = settle(
        rows,
        chi=F.aggregate("counts", F.lit(0.0), lambda s, c: s + c * c) * a / F.greatest(n, F.lit(1.0)) - n,
        runs=1.0 + F.size(F.filter("high", lambda h, i: (i > 0) & (h != F.get("high", i - 1)))),
        n1=F.size(F.filter("high", lambda h: h)).cast("double"),
        top=F.aggregate(
            F.filter(F.transform("x", lambda v, i: F.struct(v.alias("v"), F.get("x", i - 1).alias("w"))), lambda p: p["w"].isNotNull()),
            F.lit(0.0), lambda s, p: s + (p["v"] - F.col("mean")) * (p["w"] - F.col("mean")),
        ),
        low=F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mean")) * (v - F.col("mean"))),
    )
    n1, n2, k, df = F.col("n1"), n - F.col("n1"), F.col("kappa"), a - 1
    share = F.lit(2.0) / (9 * df)
    z_alphabet = (F.cbrt(F.greatest(F.col("chi"), F.lit(0.0)) / df) - (1 - share)) / F.sqrt(share)
    mean_runs = 1 + 2 * n1 * n2 / n
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = F.when(var_runs > 0, (F.col("runs") - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(99.0))
    z_serial = F.when(F.col("low") > 0, F.col("top") / F.col("low") * F.sqrt(n)).otherwise(F.lit(99.0))
    # against ordinary text: too uniform, and too many changes of the kind of character
    z_text = (F.col("chi") - (df + (n - 1) * (k - 1))) / F.sqrt(2 * df * k * k + 4 * n * k * (k - 1))
    expected = TEXT_CHANGES * n
    z_mixed = (expected - F.col("changes")) / F.sqrt(expected)
    p = _phi((z_text + z_mixed) / F.sqrt(F.lit(2.0)))
    fits = (z_alphabet < GATE) & (F.abs(z_runs) < GATE) & (F.abs(z_serial) < GATE) & (n > 2)
    return rows.select(
        *candidates.columns, "encoding",
        F.floor(F.log2(F.length("s").cast("double"))).cast("int").alias("band"),
        p.alias("p"),
        F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * BINS_PER_POWER), F.lit(BINS)).cast("int").alias("bin"),
        F.coalesce(fits, F.lit(False)).alias("random"),
    )


def discoveries(tested: DataFrame, fdr: float = FDR) -> dict[int, int]:
    """Least p-value bin of each length band at which the false-discovery bound holds.

    The grouped table has at most ``BINS + 1`` rows for each power of two of
    the lengths. A candidate that fails a test counts in its band with p = 1.
    """
    bins = tested.groupBy("band", F.when(F.col("random"), F.col("bin")).otherwise(0).alias("bin")).count().collect()
    least = {}
    for band in {r["band"] for r in bins}:
        own = sorted(((r["bin"], r["count"]) for r in bins if r["band"] == band), reverse=True)
        total, above = sum(c for _, c in own), 0
        for b, count in own:
            above += count
            # all of a bin count as its largest p
            if b > 0 and 10 ** (-b / BINS_PER_POWER) <= fdr * above / total:
                least[band] = b
    return least


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """``doc_id, spans``: an array of ``start, rank, end, kind``, in order, per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for kind, pattern in zip(KINDS, (ASSIGN, ACCESS, HEX, CANDIDATE)):
        rows = _find(rows, kind, pattern)
    def named(rank: int, kind: str) -> Column:
        return F.transform(
            kind,
            lambda x: F.struct(
                x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        )

    base = [named(r, kind) for r, kind in enumerate(KINDS[:3])]
    rows = rows.select(
        F.monotonically_increasing_id().alias("place"), "doc_id", F.array_sort(F.concat(*base)).alias("base"),
        F.col("random").alias("candidates"),
    )
    found = cut_lineage(rows, "spans")
    alone = found.select("place", "base", F.explode("candidates").alias("c")).filter(
        ~F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (F.col("c.start") < b["end"]))
    )
    tested = cut_lineage(battery(alone.select("place", "c.start", "c.end", "c.s")).drop("s"), "tested")
    least = discoveries(tested, fdr)
    passes = F.lit(False)
    for band, b in sorted(least.items()):
        passes = passes | ((F.col("band") == band) & (F.col("bin") >= b))
    more = tested.filter(F.col("random") & passes).groupBy("place").agg(
        F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end", F.lit(KINDS[3]).alias("kind"))).alias("more")
    )
    return found.join(more, "place", "left").select(
        "doc_id", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans")
    )
