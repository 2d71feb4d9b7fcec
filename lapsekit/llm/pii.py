"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Column expressions only. A pattern's spans come from cutting the text at its
matches: running lengths of the pieces and matches give the positions, and the
pieces and matches just before and after one its neighbouring words. All
patterns use possessive repeats and start only where a run of their characters
starts, so they are linear on any text, and so is what follows the cutting.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lapsekit.llm.arrays import let, sums_before

#: Code points before a span, and after it as far as the next match of its kind, in which context words count.
CONTEXT = 40
#: Score from which a span of a kind without a base rule is reported.
THRESHOLD = 0.6
CONTEXT_GAIN = 0.3


# Tests that a match has to pass, as SQL of the match ``m``.
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_IP = r"m RLIKE r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$'"
_CARD = f"length({_DIGITS}) BETWEEN 13 AND 19 AND luhn_check({_DIGITS})"
_PHONE = f"length({_DIGITS}) BETWEEN 9 AND 15"
_PLAIN = "replace(m, ' ', '')"
# Mod 97 of the rearranged account, letters as 10 to 35, digit group by digit group.
_IBAN = (
    f"length({_PLAIN}) BETWEEN 15 AND 34 AND aggregate(split(concat(substr({_PLAIN}, 5), left({_PLAIN}, 4)), ''), 0,"
    " (rest, c) -> CAST(if(ascii(c) < 58, rest * 10 + ascii(c) - 48, rest * 100 + ascii(c) - 55) % 97 AS int)) = 1"
)
# Weights 3, 7, 1 over nine digits.
_ROUTING = "m <> '000000000' AND aggregate(sequence(1, 9), 0, (t, i) -> t + element_at(array(1, 3, 7), i % 3 + 1) * int(substr(m, i, 1))) % 10 = 0"
# Letters and digits, and many different ones of them: not a word, a name or a plain number.
_RANDOM = "m RLIKE '[0-9]' AND m RLIKE '[A-Za-z]' AND size(array_distinct(split(m, ''))) >= 10"
_ANY = "true"


@dataclass(frozen=True)
class Kind:
    """A pattern, the test its matches have to pass, and how they are scored. No text holds an apostrophe."""

    name: str
    pattern: str
    valid: str
    prior: float
    words: str
    #: Characters without which the pattern can't match: texts without them are skipped.
    needs: str = field(default="[0-9]")
    base: bool = False


# Kinds in the order in which they are listed.
KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        _ANY, 0.8, r"mail|contact|write to", needs="@", base=True,
    ),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _IP, 0.6, r"\bip\b|address|host|server", base=True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _CARD, 0.7, r"card|visa|credit|payment", base=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _PHONE, 0.6, r"phone|call|tel|mobile|fax", needs=r"\+[0-9]", base=True),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
        _IBAN, 0.7, r"iban|account|bank", needs="[A-Z]{2}[0-9]{2}",
    ),
    Kind(
        "ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        _ANY, 0.4, r"\bssn\b|social security", needs="[0-9]-[0-9]",
    ),
    Kind(
        "secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+(?![A-Za-z0-9])",
        _RANDOM, 0.4, r"token|secret|passw|\bpwd\b|api.?key|access.?key|private.?key|credential|bearer", needs="[A-Za-z0-9+/_-]{20}",
    ),
    Kind(
        "known_key", r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abp]-[0-9A-Za-z-]{20,}+)(?![A-Za-z0-9_])",
        _ANY, 0.8, r"token|key|secret", needs="AKIA|gh[opsu]_|xox[abp]-",
    ),
    Kind("routing", r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])", _ROUTING, 0.4, r"routing|\baba\b|bank", needs="[0-9]{9}"),
)
BASE_KINDS = tuple(kind.name for kind in KINDS if kind.base)

_SPAN = "array<struct<kind:string,start:bigint,end:bigint,text:string,score:double>>"
#: A match and the piece before it have three characters together at least, so these reach back over the context.
BACK = CONTEXT // 3 + 1


def _spans(text: str, kind: Kind) -> str:
    """SQL of the confirmed and scored spans of one kind in the text, by start."""
    cut = f"named_struct('pieces', split({text}, r'{kind.pattern}', -1), 'matches', regexp_extract_all({text}, r'{kind.pattern}', 0))"
    lengths = "zip_with(cut.pieces, cut.matches, (p, m) -> bigint(length(p) + coalesce(length(m), 0)))"
    placed = "transform(cut.matches, (m, i) -> named_struct('text', m, 'i', i, 'start', get(before, i) + length(get(cut.pieces, i))))"
    confirmed = f"filter({placed}, found -> {let('found.text', 'm', kind.valid)})"
    first = f"greatest(found.i - {BACK}, 0)"
    earlier = (
        f"zip_with(slice(cut.pieces, {first} + 1, found.i - {first}), slice(cut.matches, {first} + 1, found.i - {first}),"
        f" (p, m) -> concat(right(p, {CONTEXT}), right(m, {CONTEXT})))"
    )
    ahead = f"right(concat(array_join({earlier}, ''), right(get(cut.pieces, found.i), {CONTEXT})), {CONTEXT})"
    near = f"concat_ws(' ', {ahead}, left(coalesce(get(cut.pieces, found.i + 1), ''), {CONTEXT}))"
    score = f"round(least({kind.prior}D + if({near} RLIKE r'(?i){kind.words}', {CONTEXT_GAIN}D, 0D), 1D), 2)"
    scored = (
        f"transform({confirmed}, found -> named_struct('kind', '{kind.name}', 'start', found.start,"
        f" 'end', found.start + length(found.text), 'text', found.text, 'score', {score}))"
    )
    spans = let(cut, "cut", let(sums_before(lengths), "before", scored))
    if not kind.base:
        spans = f"filter({spans}, span -> span.score >= {THRESHOLD}D)"
    return f"if({text} RLIKE r'{kind.needs}', CAST({spans} AS {_SPAN}), CAST(array() AS {_SPAN}))"


def find_pii(df: DataFrame, text: str = "text", into: str = "pii", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``df`` with ``into``: array of (kind, start, end, text, score), by kind as listed, then start.

    Start and end are code points, end exclusive. Matches of one kind don't
    overlap; those of different kinds may. A null or empty text has no span.
    Repeated rows stay repeated. A column of ``df`` named as ``into`` is replaced.
    """
    source = f"coalesce(`{text}`, '')"
    return df.withColumn(into, F.expr(f"concat({', '.join(_spans(source, kind) for kind in kinds)})"))


def _listed(spans: Column) -> Column:
    text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def pii_digest(df: DataFrame) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans and their scores as text, and their number.

    Rows are as those of ``find_pii``: null and empty texts have no span,
    repeated rows stay repeated, an empty table gives no row.
    """
    found = find_pii(df.select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, BASE_KINDS),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: s["score"].cast("string")), ",").alias("scores"),
        F.size("pii").cast("bigint").alias("n_spans"),
    )
