"""Secret scan: three fixed kinds, then a battery of randomness tests over long tokens. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Kind: pattern, group whose length counts, least length. Fixed values.
KINDS = {
    "assign": ("((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]{16,}", 0, 16),  # a maximal run of 16 or more is what the runs of any length leave
}
#: What may be a secret besides: tokens of 20 or more characters of the base64 alphabets.
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
ALPHABETS = {
    "hex": ("0123456789abcdef", 16),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 64),
}
#: Lower ends of the length bands within which false discoveries are held.
BANDS = (20, 28, 40, 64, 128)
BINS_PER_DECADE, MOST_DECADES = 8, 40


def found(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>> of all leftmost non-overlapping matches, in code points.

    Spark gives matches without positions; the pieces between matches have the lengths that are missing.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    some = F.aggregate(pairs, zero, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), some).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)"))


def kind_spans(text: Column, kind: str) -> Column:
    pattern, group, least = KINDS[kind]
    long_enough = (lambda m: F.length(F.regexp_extract(m["hit"], pattern, group)) >= least) if group else (lambda m: F.length(m["hit"]) >= least)
    return F.transform(F.filter(found(text, pattern), long_enough), lambda m: F.struct(m["start"].alias("start"), F.lit(list(KINDS).index(kind)).alias("order"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def normal_tail(z: Column) -> Column:
    """P(Z > z) by a rational approximation (error below 1e-7; Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(hit: Column) -> Column:
    """struct<encoding, p>: p of "a uniformly random string of its encoding", the least of three tests times three.

    Uniformity: chi-squared over the alphabet (Wilson-Hilferty). Runs: of codes in the upper half of the alphabet
    (Wald-Wolfowitz, about the expected half). Serial correlation: lag 1 of the codes, times the root of the length.
    """
    bare = F.regexp_replace(hit, "=+$", "")
    encoding = F.when(bare.rlike("^[0-9a-fA-F]+$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    signs = F.when(encoding == "hex", F.lower(bare)).otherwise(bare)
    letters = F.when(encoding == "hex", ALPHABETS["hex"][0]).when(encoding == "base32", ALPHABETS["base32"][0]).otherwise(ALPHABETS["base64"][0])
    k = F.when(encoding == "hex", 16.0).when(encoding == "base32", 32.0).otherwise(64.0)
    codes = F.transform(F.split(signs, ""), lambda c: F.least(F.call_function("instr", letters, c).cast("double") - 1, k - 1))
    n = F.size(codes).cast("double")
    squares = F.aggregate(F.array_distinct(codes), F.lit(0.0), lambda acc, c: acc + F.pow(F.size(F.filter(codes, lambda x: x == c)).cast("double"), 2.0))
    chi, df = k / n * squares - n, k - 1
    p_chi = normal_tail((F.pow(F.greatest(chi, F.lit(0.0)) / df, 1 / 3.0) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
    pairs = F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    changes = F.size(F.filter(pairs, lambda x: (x["a"] >= k / 2) != (x["b"] >= k / 2))).cast("double")
    p_runs = 2 * normal_tail(F.abs(changes - (n - 1) / 2) / F.sqrt((n - 1) / 4))
    mid, var = (k - 1) / 2, (k * k - 1) / 12
    serial = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + (x["a"] - mid) * (x["b"] - mid)) / var / F.sqrt(n - 1)
    p_serial = 2 * normal_tail(F.abs(serial))
    return F.struct(encoding.alias("encoding"), F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("p"))


def band_of(n: Column) -> Column:
    out = F.lit(0)
    for i, b in enumerate(BANDS):
        out = F.when(n >= b, i).otherwise(out)
    return out


def thresholds(tokens: DataFrame, q: float) -> dict[tuple[str, int], int]:
    """For each encoding and length band, the last bin of p that Benjamini-Hochberg at q still rejects.

    p is counted in bins by its upper edge, which only makes the rule stricter. The histogram has at most
    encodings x bands x bins rows, whatever the input.
    """
    bins = tokens.groupBy("encoding", "band", "bin").count().collect()
    out = {}
    for key in {(r["encoding"], r["band"]) for r in bins}:
        own = sorted((-r["bin"], r["count"]) for r in bins if (r["encoding"], r["band"]) == key)
        m, k, last = sum(c for _, c in own), 0, None
        for b, c in own:
            k += c
            if 10.0 ** (b / BINS_PER_DECADE) <= q * k / m:
                last = -b
        if last is not None:
            out[key] = last
    return out


def secrets(docs: DataFrame, q: float = 0.05, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random: one row for each row of docs.

    Base spans are whole matches, kind:start:end in code points. Tokens of 20 or more characters with a letter and a
    digit are tested for randomness; those of which Benjamini-Hochberg (at q, within encoding and length band) rejects
    that they are random go, the others that lie in no base span are added as "random". Null or empty text: no span,
    and base_sha256 of the empty string. Null ids and repeated rows stay as they are; other columns are not read.
    """
    t = F.coalesce(docs[text], F.lit(""))
    held = docs.select(docs[doc_id].alias("doc_id"), t.alias("t"))
    token = F.filter(found(F.col("t"), TOKEN), lambda m: m["hit"].rlike("[0-9]") & m["hit"].rlike("[A-Za-z]"))
    parts = settle(held.select("doc_id", *[kind_spans(F.col("t"), k).alias(k) for k in KINDS], token.alias("tokens")), "spans")
    tested = F.transform("tokens", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), battery(m["hit"]).alias("test"), band_of(F.length(m["hit"])).alias("band")))
    p_bin = lambda p: F.least(F.lit(BINS_PER_DECADE * MOST_DECADES), F.floor(-F.log10(F.greatest(p, F.lit(10.0**-MOST_DECADES))) * BINS_PER_DECADE)).cast("int")
    binned = F.transform(tested, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["test"]["encoding"].alias("encoding"), m["band"].alias("band"), p_bin(m["test"]["p"]).alias("bin")))
    kept = settle(parts.select("doc_id", *KINDS, binned.alias("tokens")), "secrets")
    limits = thresholds(kept.select(F.explode("tokens").alias("m")).select("m.encoding", "m.band", "m.bin"), q)
    none = 10**6
    limit = lambda m: F.coalesce(*[F.when((m["encoding"] == e) & (m["band"] == b), v) for (e, b), v in sorted(limits.items())], F.lit(none))
    base = F.array_sort(F.concat(*KINDS))
    apart = lambda m: ~F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    random = F.transform(F.filter("tokens", lambda m: (m["bin"] < limit(m)) & apart(m)), lambda m: F.struct(m["start"].alias("start"), F.lit(len(KINDS)).alias("order"), m["end"].alias("end"), F.lit("random").alias("kind")))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    out = kept.withColumn("base", base).withColumn("random", random)
    return out.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", "random"))).alias("spans"), F.size("random").cast("long").alias("n_random"))
