"""Secrets in texts, and weak candidates that only count beside their other parts. SQL functions only.

Three kinds are secrets by their own form: assignments to telling names, access key ids and long
hexadecimal strings. Weak candidates are common in harmless texts; they are reported as ``linked`` only if a
complementary part of a credential stands in the same scope: the same block between blank lines, at most
``REACH`` characters away. Which part it takes depends on how weak the candidate is: a long token of
mixed letters and digits takes an access identifier, a named host or an address; a password-like name an
identifier or a named host; a vague name (key, auth, credential) an identifier, and its value must mix letters
and digits. Candidates and parts meet in an interval join over bins of that length; a
bin holds only the least and greatest place of its parts, so a block full of parts makes no pairs.
Candidates that overlap are one span, the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.tasks import stored

REACH = 300

# Kinds in the order in which spans at one place are listed.
ASSIGN, ACCESS, HEX, LINKED, _WEAK_TOKEN, _WEAK_PASS, _WEAK_NAME, _IDENTIFIER, _HOST, _ADDRESS, _BLANK = range(11)
NAMES = ["assign", "access", "hex", "linked"]

# The patterns of the three base kinds.
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
PATTERNS = {
    ASSIGN: r"(?i)(password|passwd|secret|token|api_?key)" + _VALUE + r"([A-Za-z0-9+/_.=-]+)",
    ACCESS: r"AKIA[A-Z0-9]{16,}",
    HEX: r"[0-9a-f]{24,}",
}
# Candidates and parts of this operator's own. A name may follow an underscore (DB_PASS).
_START = r"(?<![A-Za-z0-9])"
_MIXED = r"(?=[A-Za-z+/_.=-]*[0-9])(?=[0-9+/_.=-]*[A-Za-z])"
PARTS = {
    _WEAK_TOKEN: r"(?<![A-Za-z0-9/+_-])(?=[A-Za-z/+]*[0-9])(?=[A-Z0-9/+]*[a-z])(?=[a-z0-9/+]*[A-Z])[A-Za-z0-9/+]{32,}+={0,2}+(?![A-Za-z0-9/+=_-])",
    _WEAK_PASS: r"(?i)" + _START + r"(pass|pwd|passphrase)" + _VALUE + r"[A-Za-z0-9+/_.=-]{6,}",
    _WEAK_NAME: r"(?i)" + _START + r"(auth|key|credential)s?" + _VALUE + _MIXED + r"[A-Za-z0-9+/_.=-]{6,}",
    _IDENTIFIER: r"(?i)" + _START + r"(access_key_id|client_id|user_?name|user|login|account)" + _VALUE + r"[A-Za-z0-9+/_.@=-]{3,}",
    _HOST: r"(?i)" + _START + r"(host|endpoint|server)" + _VALUE + r"[A-Za-z0-9.:/-]{3,}",
    _ADDRESS: r"(?i)\b(https?|s3|jdbc:[a-z]+|postgres|mysql|redis|amqp)://[A-Za-z0-9._:@-]+",
    _BLANK: r"\n[ \t\r]*\n",
}
# What a part is, from the most telling on, and the least telling part that each kind of candidate takes.
_TELLING = {ACCESS: 0, _IDENTIFIER: 0, _HOST: 1, _ADDRESS: 2}
_TAKES = {_WEAK_TOKEN: 2, _WEAK_PASS: 1, _WEAK_NAME: 0}

_EMPTY = "array<struct<kind:int,i:int,gap:int,len:int>>"


def _found(text: str, kind: int, pattern: str, matches: str, keep: Column | None = None) -> Column:
    """Matches as (kind, number, characters since the match before, characters)."""
    gaps = F.split(text, pattern, -1)
    sizes = F.transform(matches, lambda m: F.length(m))
    zipped = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("g"), sizes.alias("l")),
        lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(p["g"]).alias("gap"), p["l"].alias("len")),
    )
    return F.when(F.size(matches) > 0, zipped).otherwise(F.array().cast(_EMPTY))


def _matches(docs: DataFrame, id: str, text: str) -> DataFrame:
    """row, id, ``found`` (matches of all kinds) and ``values`` (characters of assigned values)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    every = {**PATTERNS, **PARTS}
    always = [ASSIGN, ACCESS, HEX, *_TAKES]
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(every[k]), 0).alias(f"m{k}") for k in always])
    weak = sum(F.size(f"m{k}") for k in _TAKES) > 0
    none = F.array().cast("array<string>")
    rows = rows.select(
        "*",
        *[F.when(weak, F.regexp_extract_all("text", F.lit(every[k]), 0)).otherwise(none).alias(f"m{k}") for k in every if k not in always],
    )
    values = F.when(
        F.size(f"m{ASSIGN}") > 0,
        F.transform(F.regexp_extract_all("text", F.lit(every[ASSIGN]), 2), lambda v: F.length(v)),
    )
    return rows.select(
        "row", "id", F.flatten(F.array(*[_found("text", k, p, f"m{k}") for k, p in every.items()])).alias("found"), values.alias("values")
    )


def _spans(matches: DataFrame) -> DataFrame:
    """row, kind, begin, end (code points) of matches; assigned values of under 6 characters are dropped."""
    each = matches.where(F.size("found") > 0).select("row", "values", F.explode("found").alias("f")).select("row", "values", "f.*")
    before = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).withColumn("begin", F.col("end") - F.col("len"))
    short = (F.col("kind") == ASSIGN) & (F.get("values", F.col("i")) < 6)
    return each.where(~short).select("row", "kind", "begin", "end")


def _linked(spans: DataFrame, reach: int) -> DataFrame:
    """Weak candidates outside base spans, with a part in their block at most ``reach`` away."""
    order = Window.partitionBy("row").orderBy("begin", "kind")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        spans.withColumn("block", F.count(F.when(F.col("kind") == _BLANK, 1)).over(so_far))
        .withColumn("covered", F.max(F.when(F.col("kind") <= HEX, F.col("end"))).over(so_far))
        .withColumn(
            "next", F.min(F.when(F.col("kind") <= HEX, F.col("begin"))).over(order.rowsBetween(0, Window.unboundedFollowing))
        )
    )
    bin_of = lambda place: F.floor(place / reach)
    ranked = lambda table: F.element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), F.col("kind"))
    parts = (
        placed.where(F.col("kind").isin(*_TELLING))
        .select("row", "block", ranked(_TELLING).alias("telling"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("end").alias("at")), F.struct(F.lit(1).alias("side"), F.col("begin").alias("at")))).alias("p"))
        .groupBy("row", "block", "telling", "p.side", bin_of(F.col("p.at")).alias("bin"))
        .agg(F.min("p.at").alias("least"), F.max("p.at").alias("most"))
    )
    weak = placed.where(F.col("kind").isin(*_TAKES)).withColumn("takes", ranked(_TAKES))
    weak = weak.where((F.coalesce("covered", F.lit(0)) <= F.col("begin")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    probe = lambda side, bin, own: F.struct(F.lit(side).alias("side"), bin.alias("bin"), F.lit(own).alias("own"))
    begin_bin, end_bin = bin_of(F.col("begin")), bin_of(F.col("end"))
    probes = F.array(probe(0, begin_bin, True), probe(0, begin_bin - 1, False), probe(1, end_bin, True), probe(1, end_bin + 1, False))
    near = (
        F.when((F.col("side") == 0) & F.col("own"), F.col("least") <= F.col("begin"))
        .when(F.col("side") == 0, F.col("most") >= F.col("begin") - reach)
        .when(F.col("own"), F.col("most") >= F.col("end"))
        .otherwise(F.col("least") <= F.col("end") + reach)
    )
    met = weak.select("row", "block", "begin", "end", "takes", F.explode(probes).alias("p")).select("row", "block", "begin", "end", "takes", "p.*")
    hits = met.join(parts, ["row", "block", "side", "bin"]).where(near & (F.col("telling") <= F.col("takes")))
    hits = hits.select("row", "begin", "end").distinct()
    # Overlapping candidates are one, the longest; of equally long ones the first.
    before = F.max("end").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("begin") >= before, F.lit(True)).cast("int")
    longest = F.max(F.struct((F.col("end") - F.col("begin")).alias("length"), (-F.col("begin")).alias("first"))).alias("span")
    spans = hits.withColumn("fresh", fresh).withColumn("group", F.sum("fresh").over(Window.partitionBy("row").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("row", "group").agg(longest)
    begin = -F.col("span.first")
    return spans.select("row", F.lit(LINKED).alias("kind"), begin.alias("begin"), (begin + F.col("span.length")).alias("end"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """One row per document: ``id`` and ``spans``, an array of (begin, kind, end) in order.

    ``kind`` numbers NAMES; places are code points, the end exclusive. Null and empty texts have none.
    Base spans may overlap each other, linked ones neither them nor each other. Repeated rows and null ids are
    kept as they come; an empty table gives an empty one; other columns are not read.
    """
    matches = stored(_matches(docs, id, text), "matches")
    spans = stored(_spans(matches), "spans")
    every = spans.where(F.col("kind") <= HEX).unionByName(_linked(spans, reach))
    lists = every.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<begin:bigint,kind:int,end:bigint>>")
    joined = matches.select("row", "id").join(stored(lists, "lists"), "row", "left")
    return joined.select(F.col("id").alias(id), F.coalesce("spans", empty).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:begin:end``, comma-joined."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["begin"], s["end"])), ",")
