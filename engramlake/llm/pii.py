"""PII by bootstrapped contextual extraction, in DataFrame functions alone.

Seed entities are what the base patterns find (e-mail and IP addresses, card and phone numbers) and
random-looking values that something is set to, as keys and passwords are.  They induce lexical
patterns: the two words before them, the words on both sides, the name they are assigned to.
Patterns and the identifier-like tokens that stand in them (instances) form a graph, on which
scores spread: a pattern is trusted as far as its instances are known, an instance as far as its
patterns are trusted.  Trusted patterns then mark further spans.

Base spans are reported as they are.  A random-looking value is only a seed: it is reported where a
trusted pattern marks it, unless its own format (a prefix such as AKIA) says what it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
# Equal to the base patterns, match for match, but linear in the text: a run of letters is entered at
# its start or where the last match ended, and possessive counts never give back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}  # a letter that each match has
BLANK = "\u0001"  # stands in for the letters of base spans while further tokens are looked for

# identifier-like tokens: numbers in groups, values in quotes that something is set to, and runs of
# six characters at least with a digit among them; none reaches over white space, quotes or brackets
_OUT = r"\s\"'=:(){}\[\]<>,;\x01"
TOKEN = (
    rf"(?<![^\s\"'=:(\[{{<,;])[+(]{{0,2}}[0-9]++(?:[\x20().-]{{1,2}}[0-9]++)++(?![\w@])"
    rf"|(?<=[=:][\x20\t]{{0,2}}[\"'])[^\s\"'\x01]{{6,}}+(?=[\"'])"
    rf"|(?<![^\s\"'=:(\[{{<,;])(?=[^{_OUT}]{{6}})(?=[^0-9{_OUT}]*+[0-9])[^{_OUT}]++"
)
# e-mail addresses that are spelled out; looked for where a text has an "at" in brackets
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z0-9-]++)++"
KEY = r"([\p{L}_][\p{L}\p{N}_.-]*+)[\"'\]]?\s{0,2}([:=])[=>]?\s{0,2}$"
# fixed values: formats that say what they are, and names of values that look random but aren't private
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{36,}|xox[abeprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|glpat-[0-9A-Za-z_-]{20,}|[rs]k_live_[0-9A-Za-z]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})$"
DIGESTS = r"(?i)(?:^|[_.-])(?:sha[0-9]*|md5|crc[0-9]*|hash|checksum|digest|commit|rev|revision|etag|uuid|guid|integrity|nonce|build|version|ref|tree|parent|blob|doi|isbn|href|src|url|class|id)$"
BLOCK = 128  # places whose running sums are taken at once
AROUND = 60  # letters in which the words around a span are looked for
SPANS = "array<struct<start:int,end:int,hit:string,left:string,right:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once, not wherever the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(column: str, pattern: str) -> Column:
    """All matches of a pattern: start, end (code points), hit, and the letters left and right of it.

    Linear in the text: places are running sums, and what stands around a match is taken from the
    gaps beside it, never from the text at an offset.  Written as SQL, which is one call to Spark
    instead of a hundred; ``element_at(transform(array(x), name -> ...), 1)`` computes x once."""

    def let(name: str, value: str, body: str) -> str:
        return f"element_at(transform(array({value}), {name} -> {body}), 1)"

    def around(side: str, pieces: list[str]) -> str:
        cut = [f"coalesce({side}({p}, {AROUND}), '')" for p in pieces]
        return f"{side}(concat({', '.join(cut)}), {AROUND})"

    def sums(sizes: str, at: str) -> str:
        """``at`` and what the entries before each one add to it."""
        return f"aggregate({sizes}, struct({at} AS at, cast(array() AS array<int>) AS out), (s, x) -> struct(s.at + x AS at, concat(s.out, array(s.at)) AS out), s -> s.out)"

    # sums are appended to short arrays only, since Spark copies an array to append to it: first those
    # of whole blocks, then those within each block
    part = f"slice(sizes, b + 1, {BLOCK})"
    whole = f"transform(blocks, b -> aggregate({part}, 0, (s, x) -> s + x))"
    before = let("blocks", f"sequence(0, size(sizes) - 1, {BLOCK})", f"flatten(zip_with(blocks, {sums(whole, '0')}, (b, at) -> {sums(part, 'at')}))")
    left = around("right", ["get(gaps, i - 1)", "get(hits, i - 1)", "get(gaps, i)"])
    right = around("left", ["get(gaps, i + 1)", "get(hits, i + 1)", "get(gaps, i + 2)"])
    start = "get(before, i) + length(get(gaps, i))"
    spans = f"transform(hits, (hit, i) -> struct({start} AS start, {start} + length(hit) AS end, hit AS hit, {left} AS left, {right} AS right))"
    sizes = "zip_with(slice(gaps, 1, size(hits)), hits, (g, h) -> length(g) + length(h))"
    found = let("gaps", f"split({column}, {_quoted(pattern)}, -1)", let("sizes", sizes, let("before", before, spans)))
    return F.expr(let("hits", f"regexp_extract_all({column}, {_quoted(pattern)}, 0)", f"CASE WHEN size(hits) = 0 THEN cast(array() AS {SPANS}) ELSE {found} END"))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def is_valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        number = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.length(number(p)) <= 3) & (F.coalesce(number(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & _luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def of_kind(column: str, kind: str) -> Column:
    """The base spans of one kind, as ``located`` gives them."""
    found = F.filter(located(column, PATTERNS[kind]), lambda x: is_valid(kind, x["hit"]))
    return F.when(F.contains(column, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(SPANS)) if kind in NEEDS else found


def base_spans(found: list[Column]) -> Column:
    """Structs of start, kind (its place in KINDS), end, hit, left and right, in that order, of the
    base spans of each kind."""

    def of(k: int, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["hit"].alias("hit"), x["left"].alias("left"), x["right"].alias("right")))

    return F.array_sort(F.concat(*[of(k, spans) for k, spans in enumerate(found)]))


def blanked(text: Column, found: list[Column]) -> Column:
    """The text with its base spans blanked out, letter for letter."""

    def without(kind: str, spans: Column) -> Callable[[Column], Column]:
        def over(t: Column) -> Column:
            hits, gaps = F.regexp_extract_all(t, F.lit(PATTERNS[kind]), F.lit(0)), F.split(t, PATTERNS[kind], -1)
            shown = F.transform(hits, lambda h: F.when(is_valid(kind, h), F.repeat(F.lit(BLANK), F.length(h))).otherwise(h))
            pieces = F.zip_with(gaps, shown, lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))
            return F.when(F.size(spans) > 0, F.array_join(F.flatten(pieces), "")).otherwise(t)

        return over

    for kind, spans in zip(KINDS, found):
        text = _let(text, without(kind, spans))
    return text


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _shape(words: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(words, "[0-9]", "0"), r"\x01+", "#"))


def contexts(left: Column, right: Column) -> Column:
    """The patterns in which a span stands, '' where there is none: the two words before it; one
    before and one after; the name and the sign by which it is assigned."""
    plain = F.regexp_replace(left, r"[\"'(\[{<]+$", "")
    before = F.regexp_extract(plain, r"(\S*\p{L}\S*)\s*$", 1)
    key = F.concat(F.lower(F.regexp_extract(plain, KEY, 1)), F.lit(" "), F.regexp_extract(plain, KEY, 2))
    return F.array(
        _shape(F.regexp_extract(plain, r"(\S+\s+\S+)\s*$", 1)),
        F.when(before != "", _shape(F.concat_ws(" _ ", before, F.nullif(F.regexp_extract(right, r"^[\"')\]}>.,;]*\s+(\S+)", 1), F.lit(""))))).otherwise(""),
        F.trim(key),
    )


def _random(hit: Column) -> Column:
    """Long, of at least ten different characters, and either hexadecimal or of all three kinds of characters."""
    hexadecimal = F.length(hit).between(32, 256) & hit.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & hit.rlike("[A-Fa-f]")
    mixed = F.length(hit).between(20, 256) & hit.rlike("^[A-Za-z0-9+/_=.~-]+$") & hit.rlike("[a-z]") & hit.rlike("[A-Z]") & hit.rlike("[0-9][^0-9]*[0-9]")
    return (hexadecimal | mixed) & (F.size(F.array_distinct(F.split(hit, ""))) >= 10)


def _may_be(hit: Column, private: Column) -> Column:
    """Which kinds a token's form allows, as a sum of powers of two."""
    digits = F.length(_digits(hit))
    forms = [
        hit.rlike(r"@|[\[({]at[\])}]"),
        hit.rlike(r"^[0-9A-Fa-f]{1,4}(?:(?:\.|\[\.\]|::?)[0-9A-Fa-f]{1,4}){3,}(?::[0-9]+)?$"),
        hit.rlike(r"^[0-9][0-9 .-]+$") & digits.between(12, 19),
        hit.rlike(r"^[+(]{0,2}[0-9][0-9().\x20-]+$") & digits.between(7, 15),
        private & ~hit.rlike(r"^[0-9.,]+$"),
    ]
    return sum((F.when(form, 1 << k).otherwise(0) for k, form in enumerate(forms)), F.lit(0))


def _instance(x: Column, start: Column, end: Column, hit: Column, kind: Column, sure: Column, may: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), F.xxhash64(hit).alias("instance"), kind.alias("kind"), sure.alias("sure"), may.alias("may"), contexts(x["left"], x["right"]).alias("contexts"))


def instances(base: Column, tokens: Column) -> Column:
    """The base spans as seeds, and the tokens outside them (kind null, or secret for a seed) without
    the marks at their ends."""

    def trimmed(x: Column) -> Column:
        head = F.length(F.regexp_extract(x["hit"], r"^[^\p{L}\p{N}+(]*+", 0))
        core = F.regexp_replace(F.substring(x["hit"], head + 1, F.length(x["hit"])), r"[^\p{L}\p{N}=)]++$", "")
        return F.struct((x["start"] + head).alias("start"), (x["start"] + head + F.length(core)).alias("end"), core.alias("hit"), x["left"].alias("left"), x["right"].alias("right"))

    def of(t: Column) -> Column:
        key = F.regexp_extract(F.regexp_replace(t["left"], r"[\"'(\[{<]+$", ""), KEY, 1)
        sure = t["hit"].rlike(FORMATS)
        private = ~key.rlike(DIGESTS)
        seed = sure | (_random(t["hit"]) & (key != "") & private)
        return _instance(t, t["start"], t["end"], t["hit"], F.when(seed, F.lit(SECRET)), sure, _may_be(t["hit"], private))

    free = F.filter(F.transform(tokens, trimmed), lambda t: t["end"] - t["start"] >= 6)
    known = F.transform(base, lambda b: _instance(b, b["start"], b["end"], b["hit"], b["kind"], F.lit(False), F.lit(0)))
    return F.concat(known, F.transform(free, of))


def pattern_scores(graph: DataFrame, rounds: int, trust: float, least_seeds: int) -> DataFrame:
    """pattern, score, seeds and k0, k1, ... (seeds of each kind) of the patterns that are trusted.

    ``graph(pattern, instance, kind)`` holds each pair once, with the instance's kind if it is a seed.
    A pattern's score is the known share of its instances, one unknown added; an instance that is no
    seed is known as far as the trusted patterns in which it stands reach it."""
    known = graph.groupBy("instance").agg(F.max("kind").alias("kind")).select("instance", F.col("kind").isNotNull().cast("double").alias("score"))
    by_kind = [F.count_if(F.col("kind") == k).alias(f"k{k}") for k in range(len(ALL_KINDS))]
    for n in range(rounds):
        scored = graph.join(known, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("score"), F.count("kind").alias("seeds"), *by_kind)
        patterns = stored(scored.filter((F.col("score") >= trust) & (F.col("seeds") >= least_seeds)), "patterns")
        if n + 1 < rounds:
            spread = graph.join(patterns.select("pattern", F.col("score").alias("trusted")), "pattern", "left").groupBy("instance")
            known = spread.agg(F.max("kind").alias("kind"), (1 - F.exp(F.sum(F.log(1 - 0.9 * F.coalesce("trusted", F.lit(0.0)))))).alias("reached"))
            known = stored(known.select("instance", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("reached")).alias("score")), "instances")
    return patterns


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, key, base (spans) and instances of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    made = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), text.alias("text"))
    made = made.select("*", *[of_kind("text", kind).alias(kind) for kind in KINDS])
    found = [F.col(kind) for kind in KINDS]
    made = made.select("doc_id", "key", base_spans(found).alias("base"), blanked(F.col("text"), found).alias("text"))
    spelled = F.contains("text", F.lit("at]")) | F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at}"))
    tokens = F.when(spelled, located("text", f"{SPELLED}|{TOKEN}")).otherwise(located("text", TOKEN))
    made = made.select("doc_id", "key", "base", tokens.alias("tokens"))
    plain = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end")))
    return made.select("doc_id", "key", plain.alias("base"), instances(F.col("base"), F.col("tokens")).alias("instances"))


def find_pii(docs: DataFrame, *, rounds: int = 3, trust: float = 0.6, least_seeds: int = 3) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, n_email, n_ip, n_card, n_phone (base spans),
    base_sha256, spans (base ones and those that the method adds), n_secret, n_found (of those it
    adds) and n_spans (all).

    A pattern is trusted whose score, the known share of its instances with one unknown added, is at
    least ``trust``, and which ``least_seeds`` different seeds support; it marks its instances with
    the kind that most of its seeds have, where their form allows that kind.  A null text is empty;
    repeated rows are rows of their own with equal results; other columns are ignored."""
    made = stored(marked(docs), "base-spans")

    # one row for each span and pattern
    pattern = F.when(F.col("context") != "", F.xxhash64("form", "context"))
    edges = made.select("key", F.explode("instances").alias("i")).select("key", "i.*").select("key", "start", "end", "instance", "kind", "sure", "may", F.posexplode("contexts").alias("form", "context"))
    edges = stored(edges.select("key", "start", "end", "instance", "kind", "sure", "may", pattern.alias("pattern")).filter("pattern is not null or sure"), "edges")

    # how often a pattern and an instance meet doesn't count, so copies of a document add nothing
    graph = stored(edges.filter("pattern is not null").groupBy("pattern", "instance").agg(F.max("kind").alias("kind")), "graph")
    patterns = pattern_scores(graph, rounds, trust, least_seeds)

    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"k{k}")).alias("n"), F.lit(k).alias("kind")) for k in range(len(ALL_KINDS))]))
    trusted = patterns.select("pattern", F.element_at(ranked, 1)["kind"].alias("as_kind"))
    new = edges.filter(f"kind is null or kind = {SECRET}")
    hits = new.join(trusted, "pattern").filter(F.col("may").bitwiseAND(F.expr("shiftleft(1, as_kind)")) > 0).select("key", "start", "end", "as_kind")
    hits = hits.union(new.filter("sure").select("key", "start", "end", F.lit(SECRET).alias("as_kind")))
    found = hits.groupBy("key", "start", "end").agg(F.min("as_kind").alias("as_kind"))
    found = found.groupBy("key").agg(F.collect_list(F.struct(F.col("start"), F.col("as_kind").alias("kind"), F.col("end"))).alias("found"))
    out = made.select("doc_id", "key", "base").join(found, "key", "left")
    extra = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    number = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    counts = [number(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", extra))).alias("spans"),
        number(extra, SECRET).alias("n_secret"),
        F.size(extra).cast("long").alias("n_found"),
        (F.size("base") + F.size(extra)).cast("long").alias("n_spans"),
    )
