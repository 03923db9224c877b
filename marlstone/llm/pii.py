"""Personal data by patterns, and by contexts that the patterns' own finds induce.

Base spans are the leftmost non-overlapping matches of four patterns that pass a check.  They are the
seeds of a bootstrapped extraction, as are strings in the formats of credentials (kind ``secret``, reported
apart from the four).  What stands around a find makes its lexical patterns: the word before it, the two
words before it, the word after it, and the words on both sides.  Looser shapes (a number without country
code, an address spelt with "at", a run of letters and digits) are candidates.  Patterns and instances are
the two sides of a graph that is scored in rounds: an instance is as likely as its patterns make it, a
pattern as reliable as the instances that it extracts.  Candidates in reliable patterns are added to the
base spans.

Everything is built-in expressions and joins.  Match places come from ``split`` and
``regexp_extract_all`` with one pattern, which part a text into gaps and matches.  The patterns are
written so that a long run of one character class is read once.

Defined results: a null text is empty; a text without finds has zero counts, an empty ``spans`` and the
checksum of the empty string; counts are of base spans; texts of any length are read as a whole; repeated
rows each get the same row; an empty table gives no rows; columns beside ``doc_id`` and ``text`` are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

KINDS = ("email", "ip", "card", "phone")
#: A private character that stands for a single blank or hyphen between digits.
JOIN = "\ue000"
#: Java patterns of the base spans; \G goes on right after the match before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9{JOIN}]+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kind and pattern of credentials in well-known formats: cloud and code host keys, and hexadecimal strings with both digits and letters.
SECRET = "secret"
PATTERNS[SECRET] = r"(?<![A-Za-z0-9])(?:A(?:KIA|SIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|(?=[0-9a-f]{0,63}[a-f])(?=[0-9a-f]{0,63}[0-9])[0-9a-f]{16,64}+)(?![A-Za-z0-9])"
#: Looser shapes of what a base pattern of the kind may miss.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: at |\(at\)|\[at\])[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": rf"(?<![0-9{JOIN}])[0-9]{{4}}{JOIN}[0-9]{{4,6}}{JOIN}[0-9]{{4,5}}(?:{JOIN}[0-9]{{1,4}})?(?![0-9{JOIN}])",
    "phone": r"(?<![0-9+().-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3}[ .-][0-9]{3,4}(?![0-9.-])",
}
SHAPES[SECRET] = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,31}[0-9])(?=[0-9+/_-]{0,31}[A-Za-z])[A-Za-z0-9+/_-]{8,128}+(?![A-Za-z0-9+/_-])"
ALL_KINDS = (*KINDS, SECRET)
#: Characters beside a find that its patterns are taken from; rounds; support and reliability of a pattern.
CONTEXT, ROUNDS, SUPPORT, RELIABLE = 40, 3, 3, 0.6
CHUNK = 256
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often a lambda inside reads it."""
    return F.get(F.transform(F.array(value), use), 0)


def running(lengths: Column) -> Column:
    """Sums of all entries before each entry, in chunks so that long arrays stay linear."""

    def before(values: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("total"))
        return F.aggregate(values, start, lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["total"])).alias("out"), (acc["total"] + x).alias("total")), lambda acc: acc["out"])

    def chunked(values: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), F.lit(CHUNK))
        return F.transform(starts, lambda at: F.slice(values, at + 1, F.lit(CHUNK)))

    def summed(chunks: Column) -> Column:
        bases = before(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)))
        return let(bases, lambda b: F.flatten(F.transform(chunks, lambda c, i: let(F.element_at(b, i + 1), lambda base: F.transform(before(c), lambda x: x + base)))))

    return let(let(lengths, chunked), summed)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All leftmost non-overlapping matches with their places."""

    def placed(values: Column) -> Column:
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(values)), values, lambda g, v: F.length(g) + F.length(v))
        ends = let(lengths, lambda n: F.zip_with(running(n), n, lambda b, x: b + x))
        found = F.zip_with(ends, values, lambda e, v: F.struct(F.lit(kind).alias("kind"), (e - F.length(v)).cast("int").alias("start"), e.cast("int").alias("end"), v.alias("value")))
        return F.when(F.size(values) > 0, found).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)


def joined_digits(text: Column) -> Column:
    """The text with single blanks and hyphens between digits marked; places stay the same."""
    return F.regexp_replace(F.translate(text, JOIN, "x"), r"(?<=[0-9])[\x20-](?=[0-9])", JOIN)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind in ("email", SECRET):
        return F.lit(True)
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        digits = F.translate(value, JOIN, "")
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)


def base_spans(kind: str, text: Column) -> Column:
    subject = joined_digits(text) if kind == "card" else text
    found = F.filter(matches(subject, PATTERNS[kind], kind), lambda s: passes(kind, s["value"]))
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+")), SECRET: text.rlike(r"A[KS]IA|gh[opsu]_|xox|[0-9a-f]{16}")}
    return F.when(may[kind], found).otherwise(F.array().cast(SPAN))


def loose_spans(kind: str, text: Column, base: Column) -> Column:
    """Candidates of a kind that touch no base span."""
    subject = joined_digits(text) if kind == "card" else text
    may = {"email": text.rlike(r"\sat\s|\(at\)|\[at\]"), "ip": F.contains(text, F.lit(":")) & text.rlike("[0-9]"), SECRET: text.rlike("[=:\"'][ \"']*[A-Za-z0-9+/_-]{8}")}
    free = F.filter(matches(subject, SHAPES[kind], kind), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(may.get(kind, text.rlike(r"[0-9]{3}")), free).otherwise(F.array().cast(SPAN))


def patterns_around(text: Column, span: Column) -> Column:
    """The lexical patterns of a find: words close before and after it, in lower case."""
    before = F.substring(text, F.greatest(span["start"] - CONTEXT + 1, F.lit(1)), F.least(span["start"], F.lit(CONTEXT)))
    words = F.array(F.lower(F.regexp_extract(before, r"(?:([\p{L}_]+)[^\p{L}\p{N}_]{1,6})?([\p{L}_]+)[^\p{L}\p{N}_]{0,6}$", 1)), F.lower(F.regexp_extract(before, r"([\p{L}_]+)[^\p{L}\p{N}_]{0,6}$", 1)), F.lower(F.regexp_extract(F.substring(text, span["end"] + 1, F.lit(CONTEXT)), r"^[^\p{L}\p{N}_]{0,6}([\p{L}_]+)", 1)))

    def made(w: Column) -> Column:
        far, near, after = w[0], w[1], w[2]
        spelt_out = F.array(
            F.when(near != "", F.concat(near, F.lit(" _"))), F.when(after != "", F.concat(F.lit("_ "), after)),
            F.when((near != "") & (far != ""), F.concat(far, F.lit(" "), near, F.lit(" _"))), F.when((near != "") & (after != ""), F.concat(near, F.lit(" _ "), after)),
        )
        return F.array_compact(spelt_out)

    return let(words, made)


def finds(docs: DataFrame) -> DataFrame:
    """Base and loose spans of every text with the patterns around each."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    rows = rows.withColumn("base", F.concat(*(base_spans(k, F.col("text")) for k in KINDS)))
    secret = F.filter(base_spans(SECRET, F.col("text")), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("base", F.concat("base", secret))
    rows = rows.withColumn("loose", F.concat(*(loose_spans(k, F.col("text"), F.col("base")) for k in ALL_KINDS)))

    def placed(spans: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), patterns_around(F.col("text"), s).alias("patterns")))

    return rows.select("doc_id", "text_key", placed("base").alias("base"), placed("loose").alias("loose"))


def reliable_patterns(found: DataFrame) -> DataFrame:
    """Kind and text of the patterns that the graph of patterns and instances trusts."""
    seeds = found.select(F.explode("base").alias("s"), F.lit(1.0).alias("seed"))
    loose = found.select(F.explode("loose").alias("s"), F.lit(0.0).alias("seed"))
    spans = seeds.unionByName(loose).select(F.col("s.kind").alias("kind"), F.explode("s.patterns").alias("pattern"), F.xxhash64(F.lower("s.value")).alias("instance"), "seed")
    edges = spans.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"))
    enough = edges.groupBy("kind", "pattern").agg(F.sum("seed").alias("support"), F.sum(1 - F.col("seed")).alias("other")).where((F.col("support") >= SUPPORT) & (F.col("other") > 0)).select("kind", "pattern")
    edges = cut(edges.join(enough, ["kind", "pattern"]))
    scored = edges.withColumn("score", F.col("seed"))
    patterns = scored.groupBy("kind", "pattern").agg(F.avg("score").alias("trust"))
    for _ in range(ROUNDS - 1):
        instances = edges.join(patterns, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("seed").alias("seed"), (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score"))
        instances = instances.select("kind", "instance", F.greatest("seed", "score").alias("score"))
        patterns = edges.drop("seed").join(instances, ["kind", "instance"]).groupBy("kind", "pattern").agg(F.avg("score").alias("trust"))
    return patterns.where(F.col("trust") >= RELIABLE).select("kind", "pattern")


def spelt(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def all_spans(docs: DataFrame) -> DataFrame:
    """Base spans of every row, and those with what the method adds, by kind and start."""
    found = cut(finds(docs))
    patterns = reliable_patterns(found)
    loose = found.where(F.size("loose") > 0).select("doc_id", "text_key", F.explode("loose").alias("s")).distinct()
    added = loose.select("doc_id", "text_key", F.col("s.kind").alias("kind"), F.explode("s.patterns").alias("pattern"), "s").join(patterns, ["kind", "pattern"])
    added = added.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("t")).agg(F.collect_set("s").alias("added"))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    by_kind = [F.array_sort(of_kind(F.concat("base", "added"), k), lambda x, y: x["start"] - y["start"]) for k in ALL_KINDS]
    return joined.select("doc_id", "text_key", "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat(*by_kind)).alias("spans"))


def find_personal(docs: DataFrame) -> DataFrame:
    """Counts, checksum and text of the spans of every row; credentials have a column of their own."""
    counts = [F.size(of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    personal = lambda spans: F.filter(spans, lambda s: s["kind"] != SECRET)
    return all_spans(docs).select("doc_id", *counts, F.sha2(spelt(personal("base")), 256).alias("base_sha256"), spelt(personal("spans")).alias("spans"), spelt(of_kind(F.col("spans"), SECRET)).alias("secrets"))


def covered(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind; spans that overlap are replaced once."""
    ordered = F.array_sort(spans, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def replace(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.struct(F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(ordered, start, replace, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans of their texts replaced by their kinds; ``n_chars``, if it is a
    column, follows the text."""
    key, spans = fresh("text_key", docs.columns), fresh("spans", docs.columns)
    found = all_spans(docs).where(F.size("spans") > 0).select(F.col("text_key").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])  # spans depend on the text alone
    joined = docs.join(found, F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key), "left")
    none = F.col(spans).isNull()
    out = joined.withColumn("text", F.when(none, F.col("text")).otherwise(covered(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(none, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
