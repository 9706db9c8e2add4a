"""Personal data: patterns propose, checksums confirm, context words adjust.

DataFrame functions only; no Python runs on the executors.  A pattern's matches
and the pieces between them (``split``) give the spans: a start is the length of
all that stands before it.  Patterns start only where a run of their characters
starts, and hold on to what they took, so scanning is linear in the text; a
repeated group that gave back would also take Java's stack for each repeat.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import fresh, text_of

LOCAL = "[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """``hint`` is a cheap necessary condition; ``valid`` decides on a match; ``sure`` is the score without context."""

    name: str
    pattern: str
    hint: str
    sure: float
    words: tuple[str, ...]
    base: bool = True
    check: str = ""
    options: dict = field(default_factory=dict)


KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, ("mail", "contact", "write", "address")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, ("ip", "host", "server", "address", "login"), check="ip"),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", "", 0.7, ("card", "visa", "credit", "payment", "pay"), check="luhn"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", 0.6, ("phone", "call", "tel", "mobile", "fax"), check="phone"),
    # beyond the base kinds
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.9, ("iban", "account", "bank", "transfer"), base=False, check="mod97"),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", "-", 0.4, ("ssn", "social", "security"), base=False),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number in international form leaves 1 (ISO 7064)."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[A-Z]"), (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(add(r, c))) == 1


def _valid(kind: Kind, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind.check == "ip":
        # at most 255 whatever the leading zeros
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind.check == "luhn":
        return luhn(digits)
    if kind.check == "phone":
        return F.length(digits).between(8, 15)
    if kind.check == "mod97":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running_sums(n: Column, chunk: int = 256) -> Column:
    """What stands before each of an array's numbers.  An array that grows in an
    aggregate is copied at each step, so it is summed in chunks, and the chunks' totals in turn."""
    zero = F.array(F.lit(0).cast("long"))
    sums = lambda a, f: F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + f(x))))
    at = F.sequence(F.lit(0), F.ceil(F.size(n) / chunk).cast("int") - 1)
    parts = F.transform(at, lambda k: sums(F.slice(n, k * chunk + 1, chunk), lambda x: x))

    def placed(own: Column) -> Column:
        before = F.slice(sums(own, lambda c: F.element_at(c, -1)), 1, F.size(own))
        return F.flatten(F.zip_with(own, before, lambda c, o: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: x + o)))

    return F.when(F.size(n) > 0, let(parts, placed)).otherwise(F.array().cast("array<bigint>"))


def _confirmed(kind: Kind, match: Column) -> Column:
    """The match, or for an account number what is left of it without up to two
    last groups, whichever comes first to pass its check; else null."""
    if kind.check != "mod97":
        return F.when(_valid(kind, match), match)
    less = [F.regexp_replace(match, f"(?: [A-Z0-9]{{1,4}}){{{k}}}$", "") for k in range(3)]
    return F.coalesce(*[F.when((F.length(x) >= 15) & _valid(kind, x), x) for x in less])


def _cut(kind: Kind, text: Column) -> Column:
    """The pieces between matches, one more than there are, and the matches."""
    return F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("found"))


def _confirmed_spans(kind: Kind, cut: Column, reach: int, least_score: float) -> Column:
    """array<struct<kind, start, end, score, match>> of the matches, null where one is not confirmed.

    Context is what stands up to ``reach`` characters around a match and up to its neighbours."""
    m = F.size(cut["found"])
    lead, after = F.slice(cut["pieces"], 1, m), F.slice(cut["pieces"], 2, m)
    steps = F.zip_with(lead, cut["found"], lambda p, x: (F.length(p) + F.length(x)).cast("long"))
    near = "(?i)(?:" + "|".join(kind.words) + ")"

    def one(x: Column) -> Column:
        start = x["at"] + F.length(x["lead"])
        score = F.lit(kind.sure) + F.when(F.right(x["lead"], F.lit(reach)).rlike(near), 0.3).when(F.left(x["after"], F.lit(reach)).rlike(near), 0.15).otherwise(0.0)
        span = lambda v: F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(v)).alias("end"), F.least(score, F.lit(1.0)).alias("score"), v.alias("match"))
        kept = F.lit(True) if kind.base else score >= least_score
        return let(_confirmed(kind, x["match"]), lambda v: F.when(v.isNotNull() & kept, span(v)))

    return F.transform(F.arrays_zip(running_sums(steps).alias("at"), lead.alias("lead"), cut["found"].alias("match"), after.alias("after")), one)


def _may(kind: Kind, text: Column) -> Column:
    """Most texts have nothing of the kind: a search for one character, or one scan, settles that."""
    return (text.contains(kind.hint) if kind.hint and kind.hint != "." else F.lit(True)) & text.rlike(kind.pattern)


def _spans(kind: Kind, text: Column, reach: int, least_score: float) -> Column:
    spans = let(_cut(kind, text), lambda c: F.filter(_confirmed_spans(kind, c, reach, least_score), lambda s: s.isNotNull()))
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double,match:string>>")
    return F.when(_may(kind, text), spans).otherwise(empty)


def _replaced(kind: Kind, cut: Column, reach: int, least_score: float) -> Column:
    """The text with the confirmed spans of one kind replaced."""

    def piece(x: Column) -> Column:
        # what an account number's match has beyond the confirmed part stays
        rest = F.substr(x["match"], (x["span"]["end"] - x["span"]["start"] + 1).cast("int"))
        return F.concat(x["lead"], F.when(x["span"].isNull(), x["match"]).otherwise(F.concat(F.lit(f"<{kind.name}>"), rest)))

    lead, spans = F.slice(cut["pieces"], 1, F.size(cut["found"])), _confirmed_spans(kind, cut, reach, least_score)
    rows = F.arrays_zip(lead.alias("lead"), cut["found"].alias("match"), spans.alias("span"))
    return F.concat(F.array_join(F.transform(rows, piece), ""), F.element_at(cut["pieces"], -1))


def find_pii(docs: DataFrame, reach: int = 32, least_score: float = 0.6) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``pii``: array<struct<kind, start, end,
    score, match>>, by kind in the order of ``KINDS``, then start.

    start and end count code points, end exclusive.  Base kinds are kept at any
    score; the further ones (iban, ssn) only at ``least_score`` or more, which a
    context word within ``reach`` characters can lift them to.  A null or empty
    text has no spans; a long text takes time in proportion to its length and
    matches.  Every row of ``docs`` gives one row, repeated ones too; a column
    ``pii`` of ``docs`` is replaced.
    """
    text = fresh(docs, "_text")
    parts = {fresh(docs, f"_{k.name}"): _spans(k, F.col(text), reach, least_score) for k in KINDS}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "pii"]
    out = docs.withColumn(text, text_of()).select(*keep, *[p.alias(n) for n, p in parts.items()])
    return out.select(*keep, F.concat(*[F.col(n) for n in parts]).alias("pii"))


def redact(docs: DataFrame, reach: int = 32, least_score: float = 0.6) -> DataFrame:
    """``docs`` with personal data replaced by ``<kind>`` in ``text``.

    The kinds are replaced one after another, as ``find_pii`` finds them in what
    the ones before left; so of overlapping spans the kind listed first goes.
    A null text stays null, and a text without spans stays as it is; ``n_chars``,
    if there, is counted anew.  All other columns stay, whatever their names,
    and every row gives one row.
    """
    out, text = docs, F.col("text")
    for kind in KINDS:
        clean = let(_cut(kind, text), lambda c: _replaced(kind, c, reach, least_score))  # noqa: B023
        out = out.withColumn("text", F.when(text.isNotNull() & _may(kind, text), clean).otherwise(text))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the spans of ``find_pii``."""
    text_of_span = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("pii", lambda s: s["kind"].isin(*[k.name for k in KINDS if k.base]))
    count = lambda name: F.size(F.filter("pii", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *[count(k.name) for k in KINDS if k.base],
        F.sha2(F.array_join(F.transform(base, text_of_span), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("pii", text_of_span), ",").alias("spans"),
    )
