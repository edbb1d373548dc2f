"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Pattern matches (email, ip, card, phone) are the protected entities. Terms near an entity are counted over the corpus:
of N documents n_c hold the entity, n_ct hold the term near it, and n_t hold the term anywhere, so that the term
discloses log(n_ct N / (n_c n_t)) of the log(N / n_c) bits that identify the entity. A term that discloses at least
``threshold`` of them, in at least ``least_contexts`` contexts that differ as text, is a span of kind ``term`` wherever
it stands in a document that holds the entity, and is generalised along with the entity.

Everything is DataFrame functions. A match's place comes from marking all matches in the text and adding up the lengths
of the pieces between the marks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, materialize, numbered, settled

KINDS = ("email", "ip", "card", "phone", "term")
#: A match may start where no run of its first class is under way, or where the match before ended. Possessive
#: repeats keep long runs linear; a card's run must have 14 to 19 digits in all.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Code points on either side of an entity that are its context.
CONTEXT = 160
TERM = r"[\p{L}][\p{L}\p{N}'-]+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)

    def weigh(i: Column) -> Column:
        d = F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weigh), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def _octets(value: Column) -> Column:
    def over(part: Column) -> Column:
        short = F.regexp_replace(part, "^0+", "")
        return (F.length(short) > 3) | (F.substring(F.lpad(short, 3, "0"), 1, 3).cast("int") > 255)

    return ~F.exists(F.split(value, r"\."), over)


CHECKS: dict[str, Callable[[Column], Column] | None] = {
    "email": None,
    "ip": _octets,
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
}
#: What a text must contain for a kind to occur at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}


def marked_spans(text: Column, pattern: Column | str, kind: int, check: Callable[[Column], Column] | None) -> Column:
    """Spans of the leftmost non-overlapping matches that pass the check; offsets in code points, end exclusive."""
    clean = F.when(text.contains(OPEN) | text.contains(CLOSE), F.translate(text, OPEN + CLOSE, OTHER + OTHER)).otherwise(text)
    marked = F.regexp_replace(clean, F.concat(F.lit("("), pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(")")), F.lit(f"{OPEN}$1{CLOSE}"))

    def spans(pieces: Column) -> Column:
        first = F.struct(F.length(F.element_at(pieces, 1)).alias("at"), F.array().cast(SPANS).alias("out"))

        def add(state: Column, piece: Column) -> Column:
            value = F.substring_index(piece, CLOSE, 1)
            at = state.getField("at")
            one = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(value)).alias("end"), value.alias("value"))
            longer = F.concat(state.getField("out"), F.array(one))
            kept = longer if check is None else F.when(check(value), longer).otherwise(state.getField("out"))
            return F.struct((at + F.length(piece) - 1).alias("at"), kept.alias("out"))

        return F.aggregate(F.slice(pieces, 2, F.size(pieces)), first, add, lambda state: state.getField("out"))

    pieces = F.split(marked, OPEN)
    return F.get(F.transform(F.array(pieces), spans), F.lit(0))


def base_spans(text: Column) -> Column:
    """All pattern spans of a text that isn't null, by start, then by kind."""
    none = F.array().cast(SPANS)
    found = []
    for i, kind in enumerate(KINDS[:4]):
        there = text.contains(NEEDS[kind]) if kind in NEEDS else F.lit(True)
        if kind in ("ip", "card"):
            there = there & text.rlike(PATTERNS[kind])
        found.append(F.when(there, marked_spans(text, PATTERNS[kind], i, CHECKS[kind])).otherwise(none))
    return F.sort_array(F.concat(*found))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s.getField("kind") + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s.getField("start"), s.getField("end"))), ",")


def disclosing_terms(holders: DataFrame, docs: DataFrame, threshold: float, least_contexts: int) -> DataFrame:
    """(entity, term) pairs over the threshold: holders (_text, _spans) hold entities, docs (text) is the corpus."""
    one = holders.select("_row", "_text", F.explode("_spans").alias("s")).select("_row", "_text", F.lower("s.value").alias("entity"), "s.start", "s.end")
    left = F.substring("_text", F.greatest(F.col("start") - (CONTEXT - 1), F.lit(1)), F.least(F.col("start"), F.lit(CONTEXT)))
    right = F.substring("_text", F.col("end") + 1, F.lit(CONTEXT))
    # Where the context ends inside the text its outer word may be cut, and isn't counted.
    left = F.when(F.col("start") > CONTEXT, F.regexp_replace(left, r"^\S+", "")).otherwise(left)
    right = F.when(F.col("end") + CONTEXT < F.length("_text"), F.regexp_replace(right, r"\S+\z", "")).otherwise(right)
    around = F.lower(F.concat_ws("\n", left, right))
    context = materialize(one.select("_row", "entity", around.alias("context")).distinct(), "contexts")
    counts = [F.countDistinct("_row").alias("n"), F.countDistinct("context").alias("contexts")]
    often = context.groupBy("entity").agg(*counts).filter(F.col("contexts") >= least_contexts).select("entity", F.col("n").alias("n_c"))
    words = context.select("_row", "entity", "context", F.explode(F.array_distinct(F.regexp_extract_all("context", F.lit(TERM), F.lit(0)))).alias("term"))
    # A term stands in at least the documents whose contexts hold it; this bound drops common words before the corpus is searched.
    least = words.groupBy("term").agg(F.countDistinct("_row").alias("least_t"))
    pairs = join_checked(words, materialize(often, "entities"), "entity").groupBy("entity", "n_c", "term").agg(*counts)
    pairs = pairs.filter(F.col("contexts") >= least_contexts).select("entity", "term", "n_c", F.col("n").alias("n_ct"))
    total = docs.count()

    def told(n_t: str) -> Column:
        gained = F.log(F.col("n_ct") * F.lit(float(total)) / (F.col("n_c") * F.col(n_t)))
        return gained >= threshold * F.log(F.lit(float(total)) / F.col("n_c"))

    pairs = materialize(pairs.join(least, "term").filter(told("least_t")).drop("least_t"), "pairs")
    if not pairs.limit(1).count():
        return pairs.select("entity", "term")
    every = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))
    terms = materialize(pairs.select("term").distinct(), "terms")
    known = join_checked(docs.select(F.explode(every).alias("term")), terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    return pairs.join(known, "term").filter(told("n_t")).select("entity", "term")


def term_spans(holders: DataFrame, flagged: DataFrame) -> DataFrame:
    """(_row, _spans, _terms): spans of the flagged terms in the documents that hold their entity, outside other spans."""
    entity = holders.select("_row", F.explode(F.array_distinct(F.transform("_spans", lambda s: F.lower(s.getField("value"))))).alias("entity"))
    terms = join_checked(entity, flagged, "entity").groupBy("_row").agg(F.array_sort(F.collect_set("term")).alias("_words"))
    rows = holders.join(terms, "_row")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}'-])(?:"), F.array_join("_words", "|"), F.lit(r")(?![\p{L}\p{N}'-])"))
    rows = rows.select("_row", "_spans", F.explode(F.array(marked_spans(F.col("_text"), pattern, KINDS.index("term"), None))).alias("_found"))
    free = lambda s: ~F.exists("_spans", lambda b: (b.getField("start") < s.getField("end")) & (s.getField("start") < b.getField("end")))
    return rows.select("_row", "_spans", F.filter("_found", free).alias("_terms"))


def _all_spans(found: DataFrame, docs: DataFrame, threshold: float, least_contexts: int) -> DataFrame:
    """(_row, _all): of the rows of ``found`` (_row, _text, _spans) with term spans, these and the spans in order."""
    holders = found.filter(F.size("_spans") > 0).select("_row", "_text", "_spans")

    def spans() -> DataFrame:
        flagged = materialize(disclosing_terms(holders, docs, threshold, least_contexts), "flagged")
        return term_spans(holders, flagged).select("_row", F.sort_array(F.concat("_spans", "_terms")).alias("_all"))

    return settled(docs.sparkSession, "all_spans", spans)


def find_personal_data(docs: DataFrame, threshold: float = 0.8, least_contexts: int = 3) -> DataFrame:
    """(doc_id, spans, all_spans): pattern spans, and these with the disclosing terms.

    Defined cases: a null text is empty and has no spans; copies and repeated rows have equal spans
    and are one context; spans that start together are ordered by kind; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id()).withColumn("_spans", F.explode(F.array(base_spans(text))))
    found = materialize(found.select("_row", "doc_id", F.when(F.size("_spans") > 0, F.col("text")).alias("_text"), "_spans"), "found")
    every = _all_spans(found, docs.select("text"), threshold, least_contexts)
    return join_checked(found, every, "_row", "left").select("doc_id", F.col("_spans").alias("spans"), F.coalesce("_all", "_spans").alias("all_spans"))


def sanitized(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones together) replaced by its kind in brackets."""
    tag = lambda s: F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s.getField("kind") + 1)

    def step(state: Column, s: Column) -> Column:
        at, out = state.getField("at"), state.getField("out")
        start, end = s.getField("start"), s.getField("end")
        apart = F.struct(end.alias("at"), F.concat(out, F.substring(text, at + 1, start - at), tag(s)).alias("out"))
        over = F.struct(F.greatest(at, end).alias("at"), out.alias("out"))
        return F.when(start >= at, apart).otherwise(over)

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    end = lambda state: F.concat(state.getField("out"), F.substring(text, state.getField("at") + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, first, step, end)).otherwise(text)


def sanitize_documents(docs: DataFrame, threshold: float = 0.8, least_contexts: int = 3) -> DataFrame:
    """The documents, all columns as they are, with personal data and disclosing terms generalised in the text.

    Defined cases: a null text stays null; an empty text and one without personal data stay as they are to the byte;
    spans that overlap become one tag, that of the first; copies are sanitised alike; very long texts are read whole;
    columns of any name are carried unchanged; an empty input gives an empty result.
    """
    text = F.col("own.text")
    spans = F.explode(F.array(base_spans(F.coalesce(text, F.lit("")))))
    whole = numbered(docs, "found", _spans=spans).withColumnRenamed("row", "_row")
    held = whole.select("_row", F.when(F.size("_spans") > 0, text).alias("_text"), "_spans")
    found = _all_spans(held, docs.select("text"), threshold, least_contexts)
    told = join_checked(whole, found, "_row", "left").withColumn("_all", F.coalesce("_all", "_spans"))
    return told.select(F.col("own").withField("text", sanitized(text, F.col("_all"))).alias("own")).select("own.*")
