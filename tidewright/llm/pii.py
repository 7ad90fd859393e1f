"""Personal data: base patterns, and the terms in their documents that would give a protected value away."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import stored, text_hash

# The four kinds and their patterns are fixed by the contract. Repetitions that can't give characters back are written
# as possessive, and a match begins where a run of its characters begins or where the last match ended; both leave the
# matches as they are and keep long runs linear.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}++"  # a term is any run of letters outside the base spans of its document
STRENGTH = 0.8  # a term reveals a value if PMI >= STRENGTH * information content
MOST_BROADCAST = 200_000  # terms (some 30 bytes each) sent to every task; more are joined by shuffle
CHUNK = 1000


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s,e,v>>: leftmost non-overlapping matches with code point positions, end exclusive.

    Positions are running sums of the lengths between and of the matches, in chunks, so many matches stay cheap.
    """
    none = F.array().cast("array<struct<s:int,e:int,v:string>>")
    whole = F.lit(pattern)
    both = F.zip_with(F.regexp_extract_all(text, whole, F.lit(0)), F.split(text, pattern, -1), lambda v, gap: F.struct(F.char_length(gap).alias("g"), F.char_length(v).alias("n"), v.alias("v")))

    def placed(pairs):
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda c: F.slice(pairs, c * CHUNK + 1, CHUNK))
        return _let(chunks, lambda cs: F.flatten(F.zip_with(cs, F.slice(starts(cs), F.lit(1), F.size(cs)), fold)))

    def starts(cs):
        sums = F.transform(cs, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["g"] + x["n"]))
        return F.aggregate(sums, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))

    def fold(chunk, start):
        zero = F.struct(start.alias("at"), none.alias("out"))

        def step(acc, x):
            s = acc["at"] + x["g"]
            return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e"), x["v"].alias("v")))).alias("out"))

        return F.aggregate(chunk, zero, step, lambda acc: acc["out"])

    found = _let(F.filter(both, lambda x: x["v"].isNotNull()), placed)
    return F.when(text.rlike(pattern), found).otherwise(none)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    backwards = F.split(F.reverse(_digits(v)), "")
    doubled = F.transform(backwards, lambda d, i: _let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: _let(F.ltrim(p, F.lit("0")), lambda q: (F.char_length(q) < 3) | ((F.char_length(q) == 3) & (q <= "255")))),
    "card": lambda v: F.char_length(_digits(v)).between(12, 19) & _luhn(v),
    "phone": lambda v: F.char_length(_digits(v)).between(9, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<s,k,e,v>> of the base kinds by start, then kind; k is the place of the kind in KINDS."""

    def part(k, kind):
        valid = F.filter(matches(text, PATTERNS[kind]), lambda m: VALID[kind](m["v"]))
        return F.transform(valid, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e"), m["v"].alias("v")))

    return F.array_sort(F.concat(*[part(k, kind) for k, kind in enumerate(KINDS[:4])]))


def _masked(text: Column, spans: Column) -> Column:
    """The text with every base span blanked; positions stay."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, p):
        s, e = F.greatest(p["s"], acc["at"]), F.greatest(p["e"], acc["at"])
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s - acc["at"]), F.repeat(F.lit(" "), e - s))
        return F.struct(e.alias("at"), piece.alias("out"))

    blanked = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(blanked)


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def revealing(found: DataFrame, held: DataFrame, values: DataFrame) -> DataFrame:
    """(k, value, term): terms whose co-occurrence gives a protected value away.

    p(value), p(term) and p(both) are shares of documents, over whole texts; a term reveals a value when
    log(p(both) / p(value) p(term)) >= STRENGTH * -log p(value) and two different texts show it. All counts are summed
    before they are shuffled. ``held`` has (th, values, terms) of the rows with a value that two different texts hold.
    """
    each = held.select("th", F.explode("values").alias("p"), "terms").select("th", "p.*", F.explode("terms").alias("term"))
    varied = (F.min("th.a") != F.max("th.a")) | (F.min("th.b") != F.max("th.b"))
    pairs = each.groupBy("k", "value", "term").agg(F.count(F.lit(1)).alias("both"), varied.alias("varied"))
    pairs = stored(pairs.where("varied").drop("varied"))
    asked = pairs.select("term").distinct()
    n_terms = asked.count()
    if not n_terms:
        return pairs.select("k", "value", "term")
    words = found.select(F.explode(_terms(F.col("masked"))).alias("term"))
    if n_terms <= MOST_BROADCAST:
        words = words.join(F.broadcast(asked), "term")
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = float(max(found.count(), 1))
    scored = pairs.join(values, ["k", "value"]).join(terms, "term")
    pmi = F.log(F.col("both") * n / (F.col("n_value") * F.col("n_term")))
    return scored.where(pmi >= STRENGTH * F.log(F.lit(n) / F.col("n_value"))).select("k", "value", "term")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text, base and spans of every row of ``docs``; both are array<struct<s,k,e>> by start and kind.

    base has the four base kinds; spans adds every mention, outside the base spans, of the terms that reveal one of the
    document's values. A null text is empty. Rows with equal doc_id and text share their result. Extra columns of
    ``docs`` are left out.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = own.select("doc_id", text_hash().alias("th"), "text", base_spans(F.col("text")).alias("spans"))
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("row")
    found = stored(spans.select("doc_id", row, "th", "spans", _masked(F.col("text"), F.col("spans")).alias("masked")))
    once = F.array_distinct(F.transform("spans", lambda p: F.struct(p["k"].alias("k"), p["v"].alias("value"))))
    each = found.select("row", "th", F.explode(once).alias("p")).select("row", "th", "p.*")
    varied = (F.min("th.a") != F.max("th.a")) | (F.min("th.b") != F.max("th.b"))
    values = stored(each.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n_value"), varied.alias("varied")).where("varied").drop("varied"))
    holders = stored(each.join(values.drop("n_value"), ["k", "value"]).groupBy("row", "th").agg(F.collect_set(F.struct("k", "value")).alias("values")))
    held = stored(found.where(F.size("spans") > 0).join(holders, ["row", "th"]).select("row", "th", "values", "masked"))
    told = stored(revealing(found, held.select("th", "values", _terms(F.col("masked")).alias("terms")), values))
    named = holders.select("row", "th", F.explode("values").alias("p")).select("row", "th", "p.*").join(told, ["k", "value"]).select("row", "th", "term").distinct()
    mentions = held.select("row", "th", F.explode(matches(F.col("masked"), TERM)).alias("m")).select("row", "th", F.lower("m.v").alias("term"), "m.s", "m.e")
    terms = mentions.join(named, ["row", "th", "term"]).groupBy("row", "th").agg(F.collect_set(F.struct("s", F.lit(4).alias("k"), "e")).alias("terms"))
    base = found.select("doc_id", "row", "th", F.transform("spans", lambda p: F.struct(p["s"].alias("s"), p["k"].alias("k"), p["e"].alias("e"))).alias("base"))
    return base.join(terms, ["row", "th"], "left").select("doc_id", "th", "base", F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "terms"))).alias("spans"))


def written(spans) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", F.get(names, p["k"]), p["s"].cast("string"), p["e"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every base span replaced by its kind in brackets and every revealing term by [term].

    A span that begins inside an earlier one is swallowed by it.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, p):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, p["s"] - acc["at"]), F.get(names, p["k"]))
        return F.when(p["s"] < acc["at"], F.struct(F.greatest(acc["at"], p["e"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(p["e"].alias("at"), piece.alias("out")))

    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row of ``docs``."""
    count = lambda k: F.size(F.filter("base", lambda p: p["k"] == k)).cast("bigint")
    return find(docs).select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])],
        F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
