"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Only column expressions. For each kind the matches and the pieces of text between them come from
one pattern each; a span starts at the summed lengths of what precedes it. The sums are taken in
blocks, then over the blocks' totals, so many matches take time in proportion (the totals alone
cost the square of a ``BLOCK``-th of the matches, in additions). Patterns use possessive repeats
and look-behinds so that they take time linear in the text and no stack, and find what their plain
forms find. Of an account number the pattern only takes the head and looks at what may
follow; the span is the longest run of whole words whose checksum holds, so a word, a number or
another account number after it does no harm. Offsets are code points, ends exclusive.

Context are the ``CONTEXT`` code points before a match and those after it, other matches included.
Base kinds (email, ip, card, phone) are accepted by their pattern and validator alone; context
only raises their score. Added kinds (iban, ssn, secret) need a checksum or a context word.

Defined results: a null text is empty and has no spans; repeated rows give repeated rows; null ids
are passed through; ``spans_of`` reads only id and text, ``redact`` keeps every other column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points before and after a match in which context words count.
CONTEXT = 40
#: Code points that a match of any kind takes at least, so a few of them reach over any context.
SHORTEST = 4
#: Code points of the longest account number.
LONGEST = 42
BLOCK = 256
THRESHOLD = 0.5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten."""
    d = _digits(m)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        x = F.substr(d, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(0), add)
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(False)


def octets(m: Column) -> Column:
    """Four numbers of at most 255, leading zeros allowed."""
    return m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]|)(?:\.(?=.)|$)){4}$")


def phone_digits(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


def mod97(m: Column) -> Column:
    """An account number of 15 to 34 characters whose ISO 7064 remainder is 1."""
    s = F.upper(F.replace(m, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(s, 5, 34), F.substring(s, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), acc * 100 + letter).otherwise(acc * 10 + F.ascii(c) - 48) % 97

    return F.length(s).between(15, 34) & (F.aggregate(F.split(turned, "(?!^|$)"), F.lit(0), add) == 1)


def account_number(m: Column) -> Column:
    """The longest run of whole words at the start of ``m`` that is an account number, or null."""
    words = F.split(m, " ")
    n = F.size(words)
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(words, F.lit(1), n - i), " "))
    return F.get(F.filter(starts, lambda x: ~x.rlike("[a-z]") & mod97(x)), F.lit(0))


def social_number(m: Column) -> Column:
    return ~m.rlike("^(?:000|666|9)|-00-|0000$")


def anything(m: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float  # of a valid match without context
    context: str  # pattern over the lower-cased text before a match, and over that after it
    needs: str = ""  # a character that every match has
    head: int = 0  # where over 0, a match takes only so many characters, and what follows is looked at as group 1
    cut: Callable[[Column], Column] | None = None  # what of the group is the span, or null


#: The kinds in the order of the results.
KINDS = [
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", anything, 0.9, "mail|contact|write", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.7, "address|host|server|ip", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){12,}+", luhn, 0.8, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", phone_digits, 0.7, "phone|call|tel|mobile|fax", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", anything, 0.8, "iban|account|bank", head=4, cut=account_number),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", social_number, 0.3, "ssn|social|tax", "-"),
    Kind("secret", r"(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])", anything, 0.3, "token|secret|passw|api.?key|credential"),
]
BASE = [k.name for k in KINDS[:4]]
SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"
_PIECE = "array<struct<n:bigint,head:string,tail:string>>"


def _taken(kind: Kind, m: Column) -> Column:
    """What the pattern takes of the text for a match."""
    return F.left(m, F.lit(kind.head)) if kind.head else m


def _reach(kind: Kind) -> int:
    """Code points after what a match takes in which its context lies."""
    return CONTEXT + LONGEST * bool(kind.cut)


def _measured(kind: Kind, pieces: Column) -> Column:
    """Of each piece its length, and as much of its ends as any context needs."""
    ends = lambda p: F.struct(F.length(p).cast("bigint").alias("n"), F.left(p, F.lit(_reach(kind))).alias("head"), F.right(p, F.lit(CONTEXT)).alias("tail"))
    return F.transform(pieces, ends)


def _last(x: Column) -> Column:
    return F.get(x, F.size(x) - 1)


def _blocks(kind: Kind, matches: Column, pieces: Column) -> Column:
    """For each BLOCK matches where the piece before each begins, from the block's beginning, and where the block ends."""
    zero = F.array(F.lit(0).cast("bigint"))

    def block(b: Column) -> Column:
        within = F.sequence(b * BLOCK, F.least(F.size(matches), (b + 1) * BLOCK) - 1)
        return F.aggregate(within, zero, lambda acc, j: F.concat(acc, F.array(_last(acc) + F.get(pieces, j)["n"] + F.length(_taken(kind, F.get(matches, j))))))

    numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    return F.when(F.size(matches) > 0, F.transform(numbers, block)).otherwise(F.array().cast("array<array<bigint>>"))


def _begins(blocks: Column) -> Column:
    """Where each block begins in the text."""
    zero = F.array(F.lit(0).cast("bigint"))
    return F.aggregate(blocks, zero, lambda acc, x: F.concat(acc, F.array(_last(acc) + _last(x))))


def _spans(kind: Kind, matches: Column, pieces: Column, blocks: Column, begins: Column) -> Column:
    """The accepted spans of a kind."""
    n = F.size(matches)

    def start(j: Column) -> Column:
        b = F.floor(j / BLOCK).cast("int")
        return F.get(begins, b) + F.get(F.get(blocks, b), j % BLOCK) + F.get(pieces, j)["n"]

    def before(j: Column) -> Column:
        own = F.get(pieces, j)["tail"]
        since = F.sequence(F.greatest(j - CONTEXT // SHORTEST, F.lit(0)), j)
        joined = F.aggregate(since, F.lit(""), lambda acc, k: F.right(F.concat(acc, F.get(pieces, k)["tail"], F.when(k < j, _taken(kind, F.get(matches, k))).otherwise("")), F.lit(CONTEXT)))
        return F.when((j == 0) | (F.length(own) >= CONTEXT), own).otherwise(joined)

    def after(j: Column, m: Column) -> Column:
        own = F.get(pieces, j + 1)["head"]
        until = F.sequence(j + 1, F.least(n, j + 1 + _reach(kind) // SHORTEST))
        joined = F.aggregate(until, F.lit(""), lambda acc, k: F.left(F.concat(acc, F.get(pieces, k)["head"], F.when(k < n, _taken(kind, F.get(matches, k))).otherwise("")), F.lit(_reach(kind))))
        text = F.when((j + 1 == n) | (F.length(own) >= _reach(kind)), own).otherwise(joined)
        return F.substr(text, F.length(m) - kind.head + 1, F.lit(CONTEXT)) if kind.cut else text

    def span(o: Column) -> Column:
        near = F.lower(before(o["j"])).rlike(kind.context) | F.lower(after(o["j"], o["m"])).rlike(kind.context)
        score = F.when(near, F.least(F.lit(kind.score + 0.3), F.lit(1.0))).otherwise(F.lit(kind.score))
        begin = start(o["j"])
        return F.struct(F.lit(kind.name).alias("kind"), begin.alias("start"), (begin + F.length(o["m"])).cast("bigint").alias("end"), score.alias("score"))

    proposed = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct(j.alias("j"), (kind.cut or (lambda m: m))(F.get(matches, j)).alias("m")))
    valid = F.filter(proposed, lambda o: o["m"].isNotNull() & kind.valid(o["m"]))
    accepted = F.filter(F.transform(valid, span), lambda s: s["score"] >= THRESHOLD)
    return F.when(n > 0, accepted).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_spans(df: DataFrame, text_col: str = "text", out: str = "__pii_spans") -> DataFrame:
    """Every column of ``df`` and the spans found in whole texts, by kind as listed, then start."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in df.columns]
    matches = [F.regexp_extract_all(text, F.lit(k.pattern), F.lit(int(k.head > 0))) for k in KINDS]
    matches = [F.when(F.contains(text, F.lit(k.needs)), m).otherwise(F.array().cast("array<string>")) if k.needs else m for k, m in zip(KINDS, matches, strict=True)]
    kinds = range(len(KINDS))
    column = lambda name, i: F.col(f"__pii_{name}{i}")
    step = df.select(*keep, *[m.alias(f"__pii_m{i}") for i, m in enumerate(matches)])
    pieces = [F.when(F.size(column("m", i)) > 0, _measured(k, F.split(text, k.pattern, -1))).otherwise(F.array().cast(_PIECE)) for i, k in enumerate(KINDS)]
    step = step.select("*", *[p.alias(f"__pii_p{i}") for i, p in enumerate(pieces)])
    step = step.select("*", *[_blocks(k, column("m", i), column("p", i)).alias(f"__pii_b{i}") for i, k in enumerate(KINDS)])
    step = step.select("*", *[_begins(column("b", i)).alias(f"__pii_o{i}") for i in kinds])
    spans = F.flatten(F.array(*[_spans(k, *(column(c, i) for c in "mpbo")) for i, k in enumerate(KINDS)]))
    return step.select(*keep, spans.cast(f"array<{SPAN}>").alias(out))


def spelt(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by its first span's kind, as in ``<EMAIL>``."""
    in_order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    runs = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] > s["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(in_order, runs, merge)
    empty = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<string>").alias("out"))

    def cut(acc: Column, s: Column) -> Column:
        before = F.substr(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(before, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("out"))

    done = F.aggregate(merged, empty, cut, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["pos"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars``, where there is one, counted anew."""
    marked = with_spans(docs)
    changed = {"text": redacted(F.col("text"), F.col("__pii_spans"))}
    out = marked.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def spans_of(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_spans(narrow, out="spans").select(F.col("id").alias(id_col), "spans")
