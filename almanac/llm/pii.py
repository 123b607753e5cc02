"""Personal data: fixed patterns as seeds, and contexts learned from them.

Four kinds (email, ip, card, phone) are found by pattern and check.  Further identifiers are found by
bootstrapping: a *lexical pattern* is the key in front of a value (``token = "``, ``e-mail:``) or, in
running text, the one to three words before or after a token with digits (``passport number X1234567``),
an *instance* the value.  Seeds are values that hold a base span and long hexadecimal or mixed values.
Patterns are scored by the confidence of their instances, instances by the confidence of their
patterns, in a fixed number of rounds over the pattern-instance graph; the values behind trusted
patterns become spans of kind ``secret`` where no base span lies.

Everything runs on column functions.  A text is scanned once; what is kept per document is its spans
and key-value places.  The graph is counted over distinct edges with map-side aggregation.

Spans are ``kind:start:end`` in code points, end exclusive, by kind as listed and then by start.
Defined results: a null text is empty; a text without spans has counts 0 and empty span strings; rows
with equal id and text get equal results; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, materialise, text_of

#: The kinds in order, with their patterns.  Possessive forms and the look-behinds
#: match the same places as the plain patterns, without going back over long runs of characters;
#: chains of fewer than 16 digits are never cards.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Characters without which a kind can't occur; texts without them are not scanned for it.
HINT = {"email": "@", "ip": ".", "phone": "+"}
#: A key, an assignment mark, perhaps a quote, and a value of at least three characters.  Neither has a
#: greatest length; possessive forms keep long runs linear.
KEYED = r"(?<![A-Za-z0-9_-])[A-Za-z][A-Za-z0-9_-]*+\x20{0,2}+[=:]\x20{0,2}+[\x22\x27]?+[^\s\x22\x27,;=:]{3,}+"
#: What may be an identifier in running text: a base kind, or at least five characters with a digit.
PROSE = "|".join([*(f"(?:{KINDS[k]})" for k in ("email", "ip", "phone", "card")), r"(?:(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{5,}+)"])
#: The form of a base kind: where its check fails, words around it don't make it an identifier.
FORM = "^(?:" + "|".join(f"(?:{KINDS[k]})" for k in ("ip", "phone", "card")) + ")$"
#: How many words next to a value make a pattern at most.
WORDS = 3
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


#: Places that are folded at a time: a fold copies what it has at every step, so long lists go in stretches.
STRETCH = 128


def stretches(items: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of every ``STRETCH`` items in a row; none for an empty array."""
    first = F.sequence(F.lit(1), F.size(items), F.lit(STRETCH))
    return F.when(F.size(items) > 0, F.transform(first, lambda at: body(F.slice(items, at, STRETCH))))


def places(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches: array of (start, value), starts in code points.

    The pieces between the matches and the matches alternate, so starts are running lengths: within
    a stretch of matches first, then over the stretches.
    """
    empty = F.array().cast("array<struct<start:int,value:string>>")

    def moved(out: Column, by: Column) -> Column:
        return F.transform(out, lambda x: F.struct((x["start"] + by).alias("start"), x["value"].alias("value")))

    def within(pairs: Column) -> Column:
        step = lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), x["value"].alias("value")))).alias("out"),
        )
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step)

    def joined(parts: Column) -> Column:
        step = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(moved(x["out"], acc["at"]))).alias("out"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,value:string>>>").alias("out"))
        return F.aggregate(parts, start, step, lambda acc: F.flatten(acc["out"]))

    def starts(values: Column) -> Column:
        pairs = lambda gaps: F.transform(values, lambda x, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), x.alias("value")))
        # Pieces are cut only where there are matches.
        return F.when(F.size(values) > 0, joined(let(let(F.split(text, pattern, -1), pairs), lambda p: stretches(p, within)))).otherwise(empty)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), starts)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(empty) if hint else found


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    chars = F.transform(F.split(F.reverse(number), ""), lambda c: c.cast("int"))

    def part(c: Column, i: Column) -> Column:
        twice = c * 2
        return F.when(i % 2 == 0, c).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(chars, part), F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The check a match must pass."""
    if kind == "ip":
        return value.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        d = digits(value)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array of (start, end) of one kind, in order."""
    ok = F.filter(places(text, KINDS[kind], HINT.get(kind)), lambda x: valid(kind, x["value"]))
    return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))


def keyed_values(text: Column) -> Column:
    """array of (pattern, value, start, end) of key-value places; pattern is the key in lower case with its mark."""
    found = F.when(text.rlike("[=:]"), places(text, KEYED)).otherwise(F.array().cast("array<struct<start:int,value:string>>"))
    head = lambda x: F.regexp_extract(x["value"], r"^[^=:]*+[=:]\x20*+[\x22\x27]?+", 0)
    parts = F.transform(found, lambda x: F.struct(head(x).alias("head"), x["value"].alias("all"), x["start"].alias("at")))
    return F.transform(parts, lambda x: F.struct(
        F.lower(F.regexp_replace(x["head"], r"\x20+", " ")).alias("pattern"),
        F.substr(x["all"], F.length(x["head"]) + 1).alias("value"),
        (x["at"] + F.length(x["head"])).alias("start"),
        (x["at"] + F.length(x["all"])).alias("end"),
    ))


def prose_values(text: Column) -> Column:
    """array of (patterns, value, start, end) of places in running text; patterns are the words before and after.

    Words are runs of letters in lower case and never reach over another such place.
    """
    empty = F.array().cast("array<struct<patterns:array<string>,value:string,start:int,end:int>>")
    words = lambda gap: F.filter(F.split(F.lower(gap), r"[^\p{L}]+"), lambda w: w != "")
    ends = lambda w: F.struct(F.slice(w, 1, WORDS).alias("first"), F.slice(F.reverse(w), 1, WORDS).alias("last"))
    sides = F.transform(F.split(text, PROSE, -1), lambda gap: let(words(gap), ends))

    def patterns(mark: str, near: Column, turn) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(near)), lambda n: F.concat(F.lit(mark), F.array_join(turn(F.slice(near, F.lit(1), n)), " ")))

    def around(gaps: Column) -> Column:
        def place(x: Column, i: Column) -> Column:
            before, after = F.get(gaps, i)["last"], F.get(gaps, i + 1)["first"]
            none = F.array().cast("array<string>")
            return F.struct(
                F.concat(
                    F.when(F.size(before) > 0, patterns("before ", before, F.reverse)).otherwise(none),
                    F.when(F.size(after) > 0, patterns("after ", after, lambda w: w)).otherwise(none),
                ).alias("patterns"),
                x["value"].alias("value"),
                x["start"].alias("start"),
                (x["start"] + F.length(x["value"])).alias("end"),
            )

        return F.transform(places(text, PROSE), place)

    return F.when(text.rlike("[0-9@]"), let(sides, around)).otherwise(empty)


def _crosses(span: Column, others: Column) -> Column:
    """Whether a span shares a place with any of ``others``, which are in order and apart from each other.

    Of those that start before the span's end, found by halving, only the last can reach over its start.
    """
    bits = F.length(F.bin(F.size(others)))
    powers = F.transform(F.sequence(bits - 1, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    before = F.aggregate(powers, F.lit(0), lambda at, p: F.when(F.get(others, at + p - 1)["start"] < span["end"], at + p).otherwise(at))
    return F.coalesce(F.get(others, before - 1)["end"] > span["start"], F.lit(False))


def is_seed_value(value: Column) -> Column:
    """Long values of hexadecimal digits, or of letters and digits mixed, are identifiers by their form."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.contains(" ")
    return (value.rlike("^[0-9a-fA-F]{32,}$") & mixed) | (mixed & (F.length(value) >= 20))


def score_graph(edges: DataFrame, rounds: int = 3, weight: float = 2.0) -> DataFrame:
    """Confidence of every pattern of a pattern-instance graph.

    ``edges`` has distinct (pattern, value) with ``seed`` in 0..1.  A pattern's confidence is the sum of its
    instances' confidences over their number plus ``weight`` (so few instances never reach trust); an
    instance's is the highest of its patterns and 1 for seeds.  A value shared by very many patterns, or
    a pattern with very many values, is summed map-side; scores alone travel back.
    """
    edges = edges.select("pattern", "value", F.col("seed").cast("double").alias("conf"))
    per_pattern = None
    for i in range(rounds):
        per_pattern = edges.groupBy("pattern").agg((F.sum("conf") / (F.count(F.lit(1)) + F.lit(weight))).alias("trust"), F.count(F.lit(1)).alias("instances"))
        if i == rounds - 1:
            break
        scored = edges.join(per_pattern.select("pattern", "trust"), "pattern")
        best = scored.groupBy("value").agg(F.max("trust").alias("reach"))
        edges = materialise(edges.join(best, "value").select("pattern", "value", F.greatest("conf", "reach").alias("conf")), "graph")
    return per_pattern


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trust: float = 0.6, rounds: int = 3, prose_trust: float = 0.8) -> DataFrame:
    """Per row: doc_id, text_hash, the base spans by kind (arrays of start, end), and ``learned`` (start, end) spans.

    Words around a value say less than a key, so they are trusted from ``prose_trust`` on.
    """
    text = text_of(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"), F.xxhash64(text).alias("_h"))
    base = base.select("doc_id", "_h", *[base_spans(F.col("_t"), k).alias(k) for k in KINDS], keyed_values(F.col("_t")).alias("_keyed"), prose_values(F.col("_t")).alias("_prose"))
    # A value behind a key is the key's, whatever its characters.
    prose = F.filter("_prose", lambda x: ~_crosses(x, F.col("_keyed")))
    keyed = F.transform("_keyed", lambda x: F.struct(F.array(x["pattern"]).alias("patterns"), x["value"].alias("value"), x["start"].alias("start"), x["end"].alias("end")))
    on_base = lambda x: reduce(or_, [_crosses(x, F.col(k)) for k in KINDS])
    marked = F.transform(F.concat(keyed, prose), lambda x: F.struct(*[x[c].alias(c) for c in ("patterns", "value", "start", "end")], on_base(x).alias("crosses")))
    base = materialise(base.select("doc_id", "_h", *KINDS, marked.alias("_places")), "spans")
    places_ = base.where(F.size("_places") > 0).select("doc_id", "_h", F.explode("_places").alias("k"))
    places_ = places_.select("doc_id", "_h", "k", F.col("k.crosses").alias("crosses"), F.explode("k.patterns").alias("pattern"))
    edges = places_.groupBy("pattern", F.xxhash64("k.value").alias("value")).agg(F.max(F.col("crosses") | is_seed_value(F.col("k.value"))).alias("seed"))
    scored = score_graph(materialise(edges, "graph"), rounds).where(F.col("trust") >= trust)
    trusted = scored.where((F.col("trust") >= prose_trust) | F.col("pattern").rlike("[=:]"))
    trusted = materialise(trusted.select(F.col("pattern").alias("_p")), "patterns")
    refuted = ~F.col("pattern").rlike("[=:]") & F.col("k.value").rlike(FORM)
    new = places_.where(~F.col("crosses") & ~refuted).join(trusted, F.col("pattern") == F.col("_p"), "left_semi")
    new = new.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.struct("k.start", "k.end"))).alias("learned"))
    new = new.withColumnsRenamed({"doc_id": "_id", "_h": "_hh"})
    out = base.join(new, base.doc_id.eqNullSafe(new._id) & (base._h == new._hh), "left")
    return out.select("doc_id", F.col("_h").alias("text_hash"), *KINDS, F.coalesce("learned", F.array().cast("array<struct<start:int,end:int>>")).alias("learned"))


def _text_of_spans(kinds: dict[str, str]) -> Column:
    def part(column: str, kind: str) -> Column:
        return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*[part(c, k) for c, k in kinds.items()]), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and span strings of :func:`find`'s result."""
    base = _text_of_spans({k: k for k in KINDS})
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        _text_of_spans({**{k: k for k in KINDS}, "learned": "secret"}).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input with every span of its texts replaced by its kind in brackets; a null text stays null.

    Overlapping spans are one, named after the first.  Rows are matched by id and text, so that equal
    ids with different texts keep their own spans.
    """
    found = find(docs, id_col, text_col, **options)

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("secret" if kind == "learned" else kind).alias("kind")))

    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.array_sort(F.concat(*[tagged(k) for k in [*KINDS, "learned"]])).alias("_spans"))
    found = found.where(F.size("_spans") > 0).dropDuplicates(["_id", "_th"])
    text = F.col(text_col)
    out = docs.join(found, docs[id_col].eqNullSafe(found._id) & (F.xxhash64(text_of(text_col)) == found._th), "left")

    def reach(acc: Column, x: Column) -> Column:
        top = F.greatest(acc["at"], F.array_max(F.transform(x, lambda y: y["end"])))
        return F.struct(F.concat(acc["out"], F.array(F.struct(x.alias("spans"), acc["at"].alias("lo"), top.alias("hi")))).alias("out"), top.alias("at"))

    def rewritten(part: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            fresh = x["start"] >= acc["at"]
            piece = F.concat(F.substr(acc["text"], acc["at"] - part["lo"] + 1, x["start"] - acc["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
            return F.struct(F.when(fresh, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"), acc["text"].alias("text"))

        own = F.substr(text, part["lo"] + 1, part["hi"] - part["lo"])
        return F.aggregate(part["spans"], F.struct(F.lit("").alias("out"), part["lo"].alias("at"), own.alias("text")), step, lambda acc: acc["out"])

    # A stretch of spans rewrites the text between the end of what came before it and its own last end.
    none = F.array().cast("array<struct<spans:array<struct<start:int,end:int,kind:string>>,lo:int,hi:int>>")
    parts = F.aggregate(stretches(F.col("_spans"), lambda x: x), F.struct(none.alias("out"), F.lit(0).alias("at")), reach)
    tail = lambda acc: F.concat(F.array_join(F.transform(acc["out"], rewritten), ""), F.substr(text, acc["at"] + 1))
    cut = let(parts, tail)
    clean = F.when(F.col("_spans").isNull(), text).otherwise(cut)
    return out.select(*[clean.alias(c) if c == text_col else docs[c] for c in docs.columns])
