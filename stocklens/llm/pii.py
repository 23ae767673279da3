"""Personal data: fixed patterns, and identifiers found by the contexts that known ones share (bootstrapping).

Four patterns find e-mail and IP addresses, card and phone numbers. What they match are the seeds; any other run of
digits, or of letters with digits, or with an ``@``, is a candidate for an identifier that they do not know.

1. **Contexts.** The words around a seed or candidate make lexical patterns: the two words before it, the word before and
   the word after, the two words after. Words are lower-cased and their digits are zeros; a context is at most
   ``CONTEXT`` characters long.
2. **Graph.** Patterns and the different texts (instances) they were seen around are the two sides of a graph, which all
   documents make together. A pattern is as sure of a kind as the share of that kind among its instances; a candidate is
   as sure as the surest of its patterns, and then counts that much for its other patterns. A pattern is trusted from
   ``LEAST_SURE`` thousandths and ``LEAST_SUPPORT`` instances on. This is repeated ``ROUNDS`` times, in whole thousandths,
   so that the order of sums does not matter.
3. **Discovery.** A candidate beside a trusted pattern gets its kind, unless it overlaps a seed.

Everything is a DataFrame function: no row goes through Python. Matches are not searched by place; their places follow
from the lengths of what is between them. Patterns are written without backtracking, so time grows with the text.

Null texts count as empty and have no span. Repeated rows give equal results, an empty table gives no rows, null ids stay
null. A candidate with equally sure patterns of two kinds takes the kind listed first. Other columns are not read.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from stocklens.llm.common import text, written

KINDS = ("email", "ip", "card", "phone")
#: What the kinds match. Possessive quantifiers and the look-behinds change no match, only the time;
#: ``\G`` lets a match begin where the one before ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no match of the kind's pattern.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BYTE = r"0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Seeds and candidates: e-mail addresses, also without a dot, the other kinds' patterns, then letters with digits.
CANDIDATE = "|".join([r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+", PATTERNS["ip"], PATTERNS["phone"], PATTERNS["card"], r"(?<![A-Za-z0-9])[A-Za-z]*+[0-9][A-Za-z0-9]*+(?:[-_./:]{1,2}+[A-Za-z0-9]++)*+"])
#: A candidate has an ``@``, or this many digits and letters; it is no longer than an identifier may be.
LEAST_DIGITS, LEAST_CHARACTERS, MOST_CHARACTERS = 4, 6, 64
CONTEXT = 80
LEAST_SURE, LEAST_SUPPORT, ROUNDS = 700, 5, 4
#: Places are summed up in pieces of so many matches.
PIECE = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        digit = F.substring(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def is_valid(kind: str, match: Column) -> Column:
    """Whether what the kind's pattern matched is one of the kind."""
    digits = _digits(match)
    match kind:
        case "ip":
            return match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
        case "card":
            return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
        case "phone":
            return F.length(digits).between(8, 15)
    return F.lit(True)


def kind_of(match: Column) -> Column:
    """The number of the kind that a whole text is a valid match of; else null."""
    out = F.when(F.lit(False), F.lit(0))
    for number, kind in enumerate(KINDS):
        out = out.when(match.rlike(f"^(?:{PATTERNS[kind]})$") & is_valid(kind, match), F.lit(number))
    return out


def located(df: DataFrame, column: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """For each name and its (pattern, condition), arrays ``<name>_found`` and ``<name>_parts``, what is between them, and
    ``<name>_length`` and ``<name>_start``, the code points of and before each match. Texts that fail the condition are not searched."""
    texts, nothing = F.col(column), F.array().cast("array<string>")
    for name, (pattern, hint) in patterns.items():
        df = df.withColumn(f"{name}_found", F.when(hint, F.regexp_extract_all(texts, F.lit(f"({pattern})"), F.lit(1))).otherwise(nothing))
    some = {name: F.size(f"{name}_found") > 0 for name in patterns}
    df = df.withColumns({f"{name}_parts": F.when(some[name], F.split(texts, pattern, -1)).otherwise(nothing) for name, (pattern, _) in patterns.items()})
    gaps = {name: F.transform(F.slice(f"{name}_parts", F.lit(1), F.size(f"{name}_found")), F.length) for name in patterns}
    df = df.withColumns({f"{name}_gap": gaps[name] for name in patterns} | {f"{name}_length": F.transform(f"{name}_found", F.length) for name in patterns})
    return df.withColumns({f"{name}_start": _starts(F.col(f"{name}_gap"), F.col(f"{name}_length")) for name in patterns}).drop(*(f"{name}_gap" for name in patterns))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often, and in whatever lambda, ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _starts(gaps: Column, lengths: Column) -> Column:
    """Where each match begins, from the lengths of the matches and of the gap before each.

    The lengths are cut into pieces of ``PIECE``; running sums are made of the pieces' sums, and then within each piece.
    """
    zero = F.lit(0).cast("bigint")

    def running(steps: Column, first: Column) -> Column:
        """``first`` and the sums from it on, one after each step."""
        return F.aggregate(steps, F.array(first), lambda sums, step: F.concat(sums, F.array(F.coalesce(F.element_at(sums, -1) + step, zero))))

    def pieces(steps: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor(F.size(steps) / PIECE).cast("int"))
        return F.transform(numbers, lambda k: F.slice(steps, k * PIECE + 1, F.lit(PIECE)))

    def before(parts: Column) -> Column:
        firsts = running(F.transform(parts, lambda part: F.aggregate(part, zero, lambda a, b: a + b)), zero)
        inside = F.zip_with(parts, firsts, lambda part, first: F.slice(running(part, F.coalesce(first, zero)), F.lit(1), F.size(part)))
        return F.flatten(F.filter(inside, lambda sums: sums.isNotNull()))

    steps = F.zip_with(gaps, lengths, lambda a, b: (a + b).cast("bigint"))
    return F.zip_with(_let(steps, lambda whole: _let(pieces(whole), before)), gaps, lambda a, b: a + b)


def _words(part: Column) -> Column:
    """Lower-case words, digits as zeros."""
    return F.filter(F.split(F.translate(F.lower(part), "123456789", "000000000"), r"\s+"), lambda w: w != "")


def _contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of an occurrence, from the text before and after it."""
    left, right = _words(F.right(before, F.lit(CONTEXT))), _words(F.left(after, F.lit(CONTEXT)))
    last, second, first, next_ = F.try_element_at(left, F.lit(-1)), F.try_element_at(left, F.lit(-2)), F.try_element_at(right, F.lit(1)), F.try_element_at(right, F.lit(2))
    made = F.array(F.concat_ws(" ", second, last, F.lit("_")), F.concat_ws(" ", last, F.lit("_"), first), F.concat_ws(" ", F.lit("_"), first, next_))
    return F.array_distinct(F.filter(made, lambda p: F.size(F.split(p, " ")) == 3))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, the seeds' spans and all occurrences of seeds and candidates, with their contexts; without texts."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text(text_col).alias("text"))
    texts = F.col("text")
    any_ = texts.contains("@") | texts.rlike(r"[0-9][^\s]*[0-9]")
    rows = located(rows, "text", {kind: (PATTERNS[kind], texts.rlike(HINTS[kind])) for kind in KINDS} | {"all": (CANDIDATE, any_)}).drop("text")

    def spans(kind: str, number: int) -> Column:
        whole = F.arrays_zip(F.col(f"{kind}_found").alias("found"), F.col(f"{kind}_start").alias("start"), F.col(f"{kind}_length").alias("length"))
        return F.transform(F.filter(whole, lambda m: is_valid(kind, m["found"])), lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), (m["start"] + m["length"]).alias("end")))

    found = F.arrays_zip(F.col("all_found").alias("found"), F.col("all_start").alias("start"), F.col("all_length").alias("length"), F.slice("all_parts", F.lit(1), F.size("all_found")).alias("before"), F.slice("all_parts", F.lit(2), F.size("all_found")).alias("after"))
    seen = F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), (m["start"] + m["length"]).alias("end"), m["found"].alias("instance"), kind_of(m["found"]).alias("seed"),
            _contexts(m["before"], m["after"]).alias("patterns"),
        ),
    )
    rows = rows.withColumn("base", F.concat(*(spans(kind, number) for number, kind in enumerate(KINDS)))).withColumn("seen", seen)
    held = "|".join([PATTERNS["email"], PATTERNS["ip"], PATTERNS["phone"], HINTS["card"]])

    def counts(m: Column) -> Column:
        name = m["instance"]
        shape = name.contains("@") | ((F.length(_digits(name)) >= LEAST_DIGITS) & (F.length(F.regexp_replace(name, "[^A-Za-z0-9]", "")) >= LEAST_CHARACTERS))
        return m["seed"].isNotNull() | ((F.length(name) <= MOST_CHARACTERS) & shape & ~name.rlike(held))

    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "base", F.filter("seen", counts).alias("seen"))


def trusted(edges: DataFrame, rounds: int = ROUNDS, least_sure: int = LEAST_SURE, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """pattern, kind and sure (in thousandths) of the patterns that the graph trusts.

    ``edges`` has each pattern and instance that were seen together once, with the seed's kind or null.
    """
    sums = [F.count_if(F.col("seed") == number).alias(f"seeds{number}") for number in range(len(KINDS))]
    patterns = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), *sums).filter(F.col("n") >= least_support), "patterns")
    open_ = written(edges.filter("seed is null").select("pattern", "instance"), "open")
    known = None
    for _ in range(rounds):
        sure, joined = [1000 * F.col(f"seeds{number}") for number in range(len(KINDS))], patterns
        if known is not None:
            more = open_.join(known, "instance").groupBy("pattern").agg(*(F.sum(F.when(F.col("kind") == number, F.col("sure")).otherwise(0)).alias(f"more{number}") for number in range(len(KINDS))))
            joined = patterns.join(more, "pattern", "left")
            sure = [s + F.coalesce(f"more{number}", F.lit(0)) for number, s in enumerate(sure)]
        best = F.greatest(*(F.struct(s.alias("sum"), F.lit(-number).alias("kind")) for number, s in enumerate(sure)))
        rated = joined.select("pattern", best.alias("best"), "n").select("pattern", (-F.col("best.kind")).alias("kind"), F.expr("best.sum div (n + 1)").alias("sure"), F.col("best.sum").alias("sum"))
        accepted = written(rated.filter((F.col("sure") >= least_sure) & (F.col("sum") >= 1000 * least_support)).select("pattern", "kind", "sure"), "trusted")
        best = F.max(F.struct("sure", (-F.col("kind")).alias("kind"))).alias("best")
        known = written(open_.join(accepted, "pattern").groupBy("instance").agg(best).select("instance", (-F.col("best.kind")).alias("kind"), F.col("best.sure").alias("sure")), "known")
    return accepted


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the spans (kind, start, end) of every document: ``base``, what the patterns match, and ``added``, what
    trusted contexts add; each sorted by kind and start."""
    rows = written(scanned(docs, id_col, text_col), "scanned")
    seen = rows.select("row", F.explode("seen").alias("m")).select("row", "m.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "seed").distinct()
    accepted = trusted(edges)
    beside = seen.filter("seed is null").select("row", "start", "end", F.explode("patterns").alias("pattern")).join(accepted, "pattern")
    best = F.max(F.struct("sure", (-F.col("kind")).alias("kind"))).alias("best")
    spans = beside.groupBy("row", "start", "end").agg(best).select("row", F.struct((-F.col("best.kind")).alias("kind"), "start", "end").alias("span"))
    added = spans.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    apart = F.filter("spans", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    nothing = F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return rows.join(added, "row", "left").select("doc_id", "base", F.coalesce(apart, nothing).alias("added"))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the patterns' kinds, digest of their spans, all spans of every document, and how many are added."""
    def times(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("bigint")

    counts = [times(number).alias(f"n_{kind}") for number, kind in enumerate(KINDS)]
    every = F.sort_array(F.concat("base", "added"))
    return find(docs, id_col, text_col).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
