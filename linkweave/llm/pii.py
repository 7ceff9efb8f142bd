"""Personal data by bootstrapped contextual extraction. Native functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filled, let, row_key, written

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the plain forms, without their quadratic retries on long runs: a match starts
#: at the start of a run or where the last match ended (\G), and no run is given back.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A further kind, seeded by public forms of credentials and by assigned hexadecimal values; not a base kind.
ALL_KINDS = (*KINDS, "secret")
SECRET = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,200}|eyJ[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{10,2000}\.[A-Za-z0-9_-]{10,2000})(?![A-Za-z0-9])"
    r"|(?<=[=:]\x20?[\"']?)(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])"
)
_TOKEN = r"[\p{L}\p{N}@._%()/:+\[\]-]*"
#: A token with a digit, from a letter or digit to a letter or digit; a label and its colon before it are left out.
_NUMBERED = rf"(?!\p{{L}}++:)(?=[\p{{L}}@._%()/:+\[\]-]*+\p{{N}})[\p{{L}}\p{{N}}](?:{_TOKEN}[\p{{L}}\p{{N}}])?"
#: A token without digits but with a mark inside, such as jane.doe[at]host.
_MARKED = rf"(?!\p{{L}}++:)\p{{L}}++[@._%()/:+\[\]-]++\p{{L}}(?:{_TOKEN}[\p{{L}}\p{{N}}])?"
_AREA = r"(?:\(\p{N}++\)\x20?)?+"
#: What may be an identifier of some kind, whatever it starts with: up to nine numbered tokens in a row, or a marked token.
CANDIDATE = rf"(?<![\p{{L}}\p{{N}}])(?:\+?{_AREA}{_NUMBERED}(?:\x20{_AREA}{_NUMBERED}){{0,8}}|{_MARKED})"
#: The same without runs, for a run that a base span takes a part of.
SINGLE = rf"(?<![\p{{L}}\p{{N}}])(?:{_NUMBERED}|{_MARKED})"
_OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Matches whose lengths are added up at once.
BLOCK = 64
#: Code points of context on either side; longer words give their nearest part.
_AROUND = 64
_SPANS = "array<struct<s:int,e:int,m:string,left:string,right:string>>"
#: Distinct instances behind a pattern, the confidence that names a kind, what an unknown instance keeps of its best
#: pattern's confidence, the weight of the prior that a pattern says nothing, and the change at which scoring stops.
SUPPORT, CONFIDENCE, KEEP, PRIOR, CHANGE, ROUNDS = 5, 0.6, 0.9, 2.0, 0.01, 20


def found_spans(text: Column, pattern: str, valid=lambda m: F.lit(True)) -> Column:
    """Valid matches of a pattern as (s, e, m, left, right): code points, end exclusive, and what stands around.

    Lengths are added up within blocks of BLOCK matches and then over the blocks. An
    aggregate copies what it holds at each step, so none may hold all matches of a long text.
    """
    between = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.arrays_zip(between.alias("a"), matches.alias("m"), F.slice(between, 2, 1 << 30).alias("b"), F.slice(matches, 2, 1 << 30).alias("n"))
    none = F.array().cast(_SPANS)
    length = lambda x: F.length(x["a"]) + F.length(x["m"])

    def step(acc, x):
        start = acc["at"] + F.length(x["a"])
        end = start + F.length(x["m"])
        before = F.right(F.concat(acc["before"], x["a"]), F.lit(_AROUND))
        after = F.left(F.concat(x["b"], F.coalesce(x["n"], F.lit(""))), F.lit(_AROUND))
        span = F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), before.alias("left"), after.alias("right"))
        return F.struct(
            end.alias("at"),
            F.right(F.concat(before, x["m"]), F.lit(_AROUND)).alias("before"),
            F.when(valid(x["m"]), F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"),
        )

    def spans(p):
        blocks = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        block = lambda i: F.slice(p, i * BLOCK + 1, BLOCK)
        lengths = F.transform(blocks, lambda i: F.aggregate(block(i), F.lit(0), lambda n, x: n + length(x)))
        # A match has one code point at least, so that the pieces before a block hold its context.
        before = lambda i: F.array_join(F.transform(F.slice(p, F.greatest(F.lit(1), i * BLOCK + 1 - _AROUND), F.least(F.lit(_AROUND), i * BLOCK)), lambda x: F.concat(x["a"], x["m"])), "")

        def inside(i, each):
            start = F.aggregate(F.slice(each, 1, i), F.lit(0), lambda n, x: n + x)
            return F.aggregate(block(i), F.struct(start.alias("at"), before(i).alias("before"), none.alias("found")), step, lambda acc: acc["found"])

        return let(lengths, lambda each: F.flatten(F.transform(blocks, lambda i: inside(i, each))))

    # Texts without a match, most of them, aren't split.
    return F.when(text.rlike(pattern), let(F.filter(pieces, lambda x: x["m"].isNotNull()), spans)).otherwise(none)


def _luhn(digits: Column) -> Column:
    def weigh(total, i):
        d = F.substr(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), weigh) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(8, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """Leftmost non-overlapping matches of a kind; those that fail its test are dropped, without retries."""
    needs = {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, F.lit(True))
    return F.when(needs, found_spans(text, PATTERNS[kind], lambda m: _valid(kind, m))).otherwise(F.array().cast(_SPANS))


def seed_spans(text: Column, kind: str) -> Column:
    """The spans that seed a kind: the base spans, and for secrets those of known forms."""
    return found_spans(text, SECRET) if kind == "secret" else base_spans(text, kind)


def _digest(spans: Column) -> Column:
    """kind:start:end, by kind as listed and then start, comma-joined, of (k, s, e) with k the kind's place."""
    name = lambda k: F.element_at(F.array(*map(F.lit, ALL_KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x["k"]), x["s"], x["e"])), ",")


def _of_kind(spans: str | Column, kind: Column, *fields: str) -> Column:
    return F.transform(spans, lambda x: F.struct(kind.alias("k"), *[x[f].alias(f) for f in fields]))


def _instances(base: DataFrame) -> DataFrame:
    """One row for each span that is or may be an identifier: doc_id, key, kind (null: unknown), s, e, value, patterns.

    A run of tokens that overlaps a seed gives way to it; its other tokens are candidates by themselves.
    One pass over a document's spans in their order decides both.
    """
    fields = ("s", "e", "m", "left", "right")
    spans = [_of_kind(k, F.lit(i), *fields) for i, k in enumerate(ALL_KINDS)] + [_of_kind("candidates", F.lit(-1), *fields), _of_kind("singles", F.lit(-2), *fields)]
    rows = base.select("doc_id", "key", F.inline(F.concat(*spans)).alias("kind", "s", "e", "value", "left", "right"))
    # A run stands before its first token, which starts where it does.
    order = Window.partitionBy("doc_id", "key").orderBy("s", F.desc("e"), F.desc("kind"))
    # Both frames start at the first row, from either end: a frame up to the last row is read anew for each row.
    back = Window.partitionBy("doc_id", "key").orderBy(F.desc("s"), "e", "kind")
    before, behind = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (order, back))
    seed = F.col("kind") >= 0
    met = rows.select("*", F.max(F.when(seed, F.col("e"))).over(before).alias("until"), F.min(F.when(seed, F.col("s"))).over(behind).alias("next"))
    met = met.withColumn("free", ~seed & (F.coalesce("until", F.lit(0)) <= F.col("s")) & (F.coalesce("next", F.col("e")) >= F.col("e")))
    met = met.withColumn("run", F.max(F.when((F.col("kind") == -1) & F.col("free"), F.col("e"))).over(before))
    rows = met.where(seed | (F.col("free") & ((F.col("kind") == -1) | (F.coalesce("run", F.lit(0)) <= F.col("s")))))
    word = lambda c, p: F.lower(F.regexp_extract(c, p, 1))
    before, after = word("left", r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$"), word("right", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)")
    two = word("left", r"([\p{L}\p{N}]+[^\p{L}\p{N}]+[\p{L}\p{N}]+)[^\p{L}\p{N}]*$")
    marked = F.regexp_replace(word("left", r"([\p{L}\p{N}]+[^\p{L}\p{N}]*[^\p{L}\p{N}\x20\x09-\x0D][^\p{L}\p{N}]*)$"), r"[\x20\x09-\x0D]+", "")
    patterns = F.array(F.concat(F.lit("l "), before), F.concat(F.lit("2 "), F.regexp_replace(two, r"[^\p{L}\p{N}]+", " ")), F.concat(F.lit("m "), marked), F.concat(F.lit("r "), after))
    patterns = F.array_distinct(F.filter(patterns, lambda p: F.length(p) > 2))
    return rows.select("doc_id", "key", F.when(F.col("kind") >= 0, F.col("kind")).alias("kind"), "s", "e", F.lower(F.regexp_replace("value", r"[\x20-]", "")).alias("value"), patterns.alias("patterns"))


def score_graph(instances: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that name a kind, from the pattern and instance graph.

    Nodes are the distinct values and the contexts they stand in. A seed has score 1 for its kind
    and 0 for the others; an unknown value has KEEP times the confidence of its best pattern. A pattern's confidence in a
    kind is the sum of its values' scores over their number plus PRIOR. It starts where one pattern by itself
    would settle, S / (S + others + (1 - KEEP) * unknown + PRIOR), and grows as values that other patterns have
    made likely stand in it, round by round, until no confidence changes by CHANGE (ROUNDS at most, each
    of which takes the error down by a tenth at least). Patterns of fewer than SUPPORT distinct values are left out,
    and so are kinds of which a pattern has neither a seed nor a value that another pattern made likely.
    A value that seeds two kinds counts for the first. Without seeds or rows there is no pattern.
    """
    pairs = instances.select("kind", "value", F.explode("patterns").alias("pattern"))
    edges = written(pairs.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "graph")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"), (F.count("*") - F.count("kind")).alias("unknown"))
    sizes = written(sizes.where(F.col("n") >= SUPPORT), "sizes")
    seeds = written(edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("seeds")), "seeds")
    unknown = written(edges.where("kind is null").select("pattern", "value").join(sizes.select("pattern"), "pattern", "left_semi"), "unknown")
    scored = seeds.join(sizes, "pattern").select("pattern", "kind", (F.col("seeds") / (F.col("n") - KEEP * F.col("unknown") + PRIOR)).alias("confidence"))
    scored = written(scored, "scores")
    for _ in range(rounds):
        best = unknown.join(scored, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("best"))
        # What falls below a tenth of the limit doesn't spread.
        gained = unknown.join(best.where(F.col("best") >= CONFIDENCE / 10), "value").groupBy("pattern", "kind").agg(F.sum(KEEP * F.col("best")).alias("gained"))
        both = seeds.join(gained, ["pattern", "kind"], "full").join(sizes, "pattern")
        after = both.select("pattern", "kind", ((F.coalesce("seeds", F.lit(0.0)) + F.coalesce("gained", F.lit(0.0))) / (F.col("n") + PRIOR)).alias("confidence"))
        after = after.join(scored.select("pattern", "kind", F.col("confidence").alias("was")), ["pattern", "kind"], "left")
        after = written(after.select("pattern", "kind", F.greatest("confidence", F.coalesce("was", F.lit(0.0))).alias("confidence"), F.coalesce("was", F.lit(0.0)).alias("was")), "scores")
        scored = after.select("pattern", "kind", "confidence")
        if not after.where(F.col("confidence") - F.col("was") > CHANGE).take(1):
            break
    return scored.where(F.col("confidence") >= CONFIDENCE)


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """For every row of ``docs``: doc_id, ``base`` and ``spans``, arrays of (k, s, e).

    k is the place of the kind in ALL_KINDS, s and e are code points with the end exclusive.
    ``spans`` are the base spans, the seeds of secrets, and the unseen identifiers that stand in a context which
    confidently goes with a kind (of two kinds the likelier, of equals the first). A null text counts as empty, an empty one has no span, an empty table no rows.
    Rows that repeat a document get the same spans. Other columns are not read, whatever their names.
    """
    body = filled(text)
    rows = docs.select("doc_id", row_key(body).alias("key"), body.alias("text"))
    found = rows.select("doc_id", "key", "text", *[seed_spans(F.col("text"), k).alias(k) for k in ALL_KINDS])
    single = F.when(F.greatest(*[F.size(k) for k in ALL_KINDS]) > 0, found_spans(F.col("text"), SINGLE)).otherwise(F.array().cast(_SPANS))
    base = written(found.select("doc_id", "key", *ALL_KINDS, found_spans(F.col("text"), CANDIDATE).alias("candidates"), single.alias("singles")), "pii-base")
    instances = written(_instances(base), "instances")
    confident = score_graph(instances)
    unseen = instances.where("kind is null").select("doc_id", "key", "s", "e", F.explode("patterns").alias("pattern")).join(confident, "pattern")
    best = unseen.groupBy("doc_id", "key", "s", "e").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("m"))
    more = best.groupBy("doc_id", "key").agg(F.collect_set(F.struct((-F.col("m.k")).alias("k"), "s", "e")).alias("more"))
    more = more.select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "more")
    joined = base.join(more, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    plain = F.concat(*[_of_kind(k, F.lit(i), "s", "e") for i, k in enumerate(KINDS)])
    secrets = _of_kind("secret", F.lit(len(KINDS)), "s", "e")
    return joined.select("doc_id", plain.alias("base"), F.concat(plain, secrets, F.coalesce("more", F.array().cast("array<struct<k:int,s:int,e:int>>"))).alias("spans"))


def op2_pii(docs: DataFrame) -> DataFrame:
    """The contract's columns, and n_spans, the number of all spans."""
    found = extract(docs)
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
