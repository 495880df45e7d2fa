"""Personal data by regular expressions, checksums and context, in DataFrame functions only.

Expressions propose spans: e-mail and IP addresses, card and phone numbers (the base kinds), account numbers (iban),
identity numbers (id), and keys and tokens (secret). Validators confirm them: parts of IP addresses up to 255, Luhn for cards, 9 to 15 digits
for phones, mod-97 for accounts, letters and digits for secrets. Each span has a score by its kind, and words near it that name such data raise the
score; identity numbers, which no checksum confirms, are reported only with such words. Near are 40 characters on each side, of which no more are
looked at than two matches of the kind and what stands between them.

The base expressions are written so that they take linear time: they start a run of characters only where it
begins, or where the last match ended, and never give characters back; the matches are those of the plain ones.
A document's matches are the parts between which it is split, so that offsets (of code points) are sums of lengths.

Cases: null and empty texts have no spans. Repeated rows and other columns don't matter: each row is seen alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed, with the score before context.
KINDS = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "id": 0.3, "secret": 0.7}
BASE = ("email", "ip", "card", "phone")
#: Words that name such data.
CONTEXT = {
    "email": r"mail|contact|write to",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|visa|master|credit|debit|payment",
    "phone": r"phone|mobile|tel\b|call|fax|whatsapp",
    "iban": r"iban|bank|account|konto|transfer",
    "id": r"\bssn\b|social security|tax id|identity|passport",
    "secret": r"key|token|secret|passw|private|credential",
}
NEAR, GAIN, LEAST = 40, 0.2, 0.5
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?+[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:(?i:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd)['\"]?+\x20{0,3}+[=:]\x20{0,3}+['\"]?+[A-Za-z0-9_+/.=-]{12,}+|AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)",
}
#: What a text must contain for the expression to be tried at all.
NEEDS = {"email": "@", "phone": "+", "ip": "."}
SPAN = "array<struct<start:long,kind_no:int,kind:string,end:long,score:double>>"


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def parts_ok(x: Column) -> Column:
    value = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(x, r"\."), lambda p: F.coalesce(value(p).try_cast("long") <= 255, F.lit(False)))


def luhn(x: Column) -> Column:
    def worth(c: Column, k: Column) -> Column:
        v = c.cast("int") * (k % 2 + 1)
        return F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.transform(F.split(F.reverse(digits(x)), ""), worth), F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(x: Column) -> Column:
    plain = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(plain, 5, 1000), F.substring(plain, 1, 4))

    def step(r: Column, c: Column) -> Column:
        v = F.when(c <= "9", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97

    return (F.length(plain).between(15, 34)) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda x: F.lit(True),
    "ip": parts_ok,
    "card": luhn,
    "phone": lambda x: F.length(digits(x)).between(9, 15),
    "iban": mod97,
    "id": lambda x: F.lit(True),
    "secret": lambda x: F.regexp_like(x, F.lit("[0-9]")) & F.regexp_like(x, F.lit("[A-Za-z]")),
}


def running(lengths: Column) -> Column:
    """The sums of an array of longs up to each place: in each round every sum takes in that of twice as many places."""
    rounds = F.when(F.size(lengths) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths).cast("double"))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))

    def grow(sums: Column, k: Column) -> Column:
        far = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: F.when(i >= far, x + F.get(sums, i - far)).otherwise(x))

    return F.aggregate(rounds, lengths, grow)


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of a kind, with their scores. Each step takes time in proportion to the text, or to the
    matches times the logarithm of their number."""
    number = list(KINDS).index(kind)
    start_of = lambda x, n: F.substring(x, 1, n)
    end_of = lambda x, n: F.when(F.length(x) > n, F.substring(x, -n, n)).otherwise(x)

    def confirmed(part: Column) -> Column:
        """part: matches m, the parts s that end before each (one more), and the sums of their lengths."""
        def span(m: Column, k: Column) -> Column:
            start = F.get(part.sums, k) - F.length(m)
            before = F.concat(F.coalesce(F.concat(end_of(F.get(part.s, k - 1), NEAR), F.get(part.m, k - 1)), F.lit("")), end_of(F.get(part.s, k), NEAR))
            after = F.concat(start_of(F.get(part.s, k + 1), NEAR), F.coalesce(F.concat(F.get(part.m, k + 1), start_of(F.get(part.s, k + 2), NEAR)), F.lit("")))
            near = F.lower(F.concat(end_of(before, NEAR), m, start_of(after, NEAR)))
            score = F.lit(KINDS[kind]) + F.when(F.regexp_like(near, F.lit(CONTEXT[kind])), F.lit(GAIN)).otherwise(F.lit(0.0))
            end = start + F.length(m)
            found = F.struct(start.cast("long").alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), end.cast("long").alias("end"), F.least(score, F.lit(1.0)).alias("score"))
            return F.when(VALID[kind](m), found)

        return F.filter(F.transform(part.m, span), lambda x: x.isNotNull()).cast(SPAN)

    matches = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    # bound by one-element arrays, so that each value is computed once
    once = F.transform(F.array(F.struct(matches.alias("m"), F.split(text, PATTERNS[kind], -1).alias("s"))), lambda x: F.struct(x.m.alias("m"), x.s.alias("s"), running(F.zip_with(x.s, x.m, lambda s, m: (F.length(s) + F.coalesce(F.length(m), F.lit(0))).cast("long"))).alias("sums")))
    out = F.flatten(F.transform(once, confirmed))
    needs = NEEDS.get(kind)
    return F.when(F.contains(text, F.lit(needs)), out).otherwise(F.array().cast(SPAN)) if needs else out


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")


def found(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column for each kind, of its spans (start, kind_no, kind, end, score)."""
    text = F.coalesce(docs[text_col], F.lit(""))
    some = docs.withColumn("__text", text)
    # two projections: each kind is computed once, then filtered
    some = some.withColumns({f"__{k}": spans_of(F.col("__text"), k) for k in KINDS})
    return some.withColumn("__id", F.filter("__id", lambda x: x.score >= LEAST)).drop("__text")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, a count for each base kind, base_sha256, spans, scores and n_spans (all kinds) of each row."""
    given = found(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), "text")
    given = given.withColumns({"base": F.array_sort(F.concat(*[f"__{k}" for k in BASE])), "all": F.array_sort(F.concat(*[f"__{k}" for k in KINDS]))})
    scores = F.array_join(F.transform("all", lambda x: F.format_string("%.1f", x.score)), ",")
    return given.select("doc_id", *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in BASE], F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), scores.alias("scores"), F.size("all").cast("long").alias("n_spans"))
