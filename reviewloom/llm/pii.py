"""Personal data in texts by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs and
their spelt forms, schemes, plus signs, digits and the cues of identifiers.  A
parser grows each anchor to the left and right as far as its grammar goes and
validates what it holds.  Parsers never go back over what they have taken, so a
text costs time in proportion to its length.

Base kinds, whose grammar is fixed; of one kind no two overlap, the leftmost
counts, and a match that fails its check is dropped together with its place:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip    four numbers of at most 255 with full stops between
* card  16 to 19 digits, single blanks or hyphens between, that pass Luhn's check
* phone a plus sign and 8 to 15 digits among blanks, brackets, stops and hyphens

What the expansion adds to them, never in the place of a base span of its kind:

* card    whole groups inside a longer row of digits that make up a card alone
* email   spelt forms, name [at] host [dot] tld
* account IBANs by country length and remainder 97, with their cue or without;
          numbers after a cue such as "account no"; US social security numbers
* url     addresses that carry a user's name or password before the host
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.llm.arrow import slices
from reviewloom.staging import table

KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = KINDS[:4]
# Cues of numbered identifiers, in lower case; fixed values.
ACCOUNT_CUES = ("account number", "account no", "acct", "kontonummer", "numéro de compte", "número de cuenta")
SSN_CUES = ("ssn", "social security number")
SPELT_AT = ("[at]", "(at)", "{at}")
# Lengths of IBANs by country (ISO 13616); fixed values.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_NUMBER = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"[ ().0-9-]++")
_SPELT_HOST = re.compile(r" ?[A-Za-z0-9-]++(?:(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?|\.)[A-Za-z0-9-]++)*(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?|\.)[A-Za-z]{2,}+(?![A-Za-z0-9-])", re.IGNORECASE)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9])+")
_AFTER_CUE = re.compile(r"[ .:#=]{0,4}")
_ACCOUNT = re.compile(r"[0-9](?:[ -]?[0-9]){5,16}(?![0-9])")
_SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_AUTHORITY = re.compile(r"[^\s/?#@\"'<>]++@[A-Za-z0-9.-]++(?::[0-9]++)?[^\s\"'<>]*+")

Span = tuple[str, int, int, bool]  # kind, start, end, whether it is a base span


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(text: str) -> bool:
    """Whether letters and digits without blanks are an IBAN of a known country."""
    return len(text) == IBAN_LENGTHS.get(text[:2]) and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def anchors():  # type: ignore[no-untyped-def]
    """The automaton; a hit's value is the anchor's type and length."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("at", "@"), ("plus", "+"), ("digit", "0123456789"), ("spelt", SPELT_AT), ("scheme", ("://",)), ("iban", ("iban",)), ("account", ACCOUNT_CUES), ("ssn", SSN_CUES)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


class Scan:
    """The spans of one text."""

    def __init__(self, text: str):
        self.text, self.spans, self.extra = text, [], []
        self.taken = dict.fromkeys(KINDS, 0)  # up to where each kind's base parser has been

    def local_part(self, end: int, low: int) -> int:
        """Where the run of a mail name's characters that ends here begins, not before ``low``."""
        while end > low and self.text[end - 1] in _LOCAL:
            end -= 1
        return end

    def at(self, k: int, after: int) -> None:
        low = self.taken["email"]
        if k >= low and (start := self.local_part(k, low)) < k and (host := _HOST.match(self.text, after)):
            self.spans.append(("email", start, host.end(), True))
            self.taken["email"] = host.end()

    def spelt(self, k: int, after: int) -> None:
        end = k - 1 if k and self.text[k - 1] == " " else k
        if (start := self.local_part(end, 0 if end < 256 else end - 256)) < end and (host := _SPELT_HOST.match(self.text, after)):
            self.extra.append(("email", start, host.end(), False))

    def plus(self, k: int, after: int) -> None:
        if self.text[after : after + 1] in _DIGITS and (run := _PHONE.match(self.text, after + 1)):
            tail = run[0].rstrip(" ().-")
            if len(tail) > 1:
                digits = 1 + sum(c in _DIGITS for c in tail)
                if 8 <= digits <= 15:
                    self.spans.append(("phone", k, after + 1 + len(tail), True))

    def digit(self, k: int, after: int) -> None:
        if k >= self.taken["ip"]:
            quad = _QUAD.match(self.text, k)
            if quad and all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in quad.groups()):
                self.spans.append(("ip", k, quad.end(), True))
            self.taken["ip"] = quad.end() if quad else _NUMBER.match(self.text, k).end()
        if k >= self.taken["card"]:
            row = _CARD.match(self.text, k)
            self.taken["card"] = row.end() if row else after
            if row:
                self.card(k, row[0])
            if k > 1:
                self.iban(k - 2, 0)

    def card(self, k: int, row: str) -> None:
        digits = row.replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19:
            if luhn(digits):
                self.spans.append(("card", k, k + len(row), True))
        elif len(digits) > 19:
            groups = [(m.start(), m.end()) for m in _NUMBER.finditer(row)]
            first = 0
            while first < len(groups):
                n, last = 0, first
                while last < len(groups) and n < 16:
                    n += groups[last][1] - groups[last][0]
                    last += 1
                start, end = groups[first][0], groups[last - 1][1]
                if 16 <= n <= 19 and luhn("".join(c for c in row[start:end] if c in _DIGITS)):
                    self.extra.append(("card", k + start, k + end, False))
                    first = last
                else:
                    first += 1

    def iban(self, k: int, after: int) -> None:
        """With the cue (``after`` it) or at two capitals before a digit."""
        at = _AFTER_CUE.match(self.text, after).end() if after else k
        if not after and at and self.text[at - 1].isalnum():
            return
        if (size := IBAN_LENGTHS.get(self.text[at : at + 2])) and (row := _IBAN.match(self.text, at, at + 2 * size)):
            end, n = at, 0
            while n < size and end < row.end():
                n += self.text[end] != " "
                end += 1
            if iban(self.text[at:end].replace(" ", "")) and not self.text[end : end + 1].isalnum():
                self.extra.append(("account", at, end, False))

    def account(self, k: int, after: int) -> None:
        at = _AFTER_CUE.match(self.text, after).end()
        if row := _ACCOUNT.match(self.text, at):
            self.extra.append(("account", at, row.end(), False))

    def ssn(self, k: int, after: int) -> None:
        at = _AFTER_CUE.match(self.text, after).end()
        if (k == 0 or not self.text[k - 1].isalnum()) and (row := _SSN.match(self.text, at)):
            self.extra.append(("account", at, row.end(), False))

    def scheme(self, k: int, after: int) -> None:
        start = k
        while start > max(0, k - 16) and self.text[start - 1].isascii() and self.text[start - 1].isalpha():
            start -= 1
        if start < k and after >= self.taken["url"] and (rest := _AUTHORITY.match(self.text, after)):
            self.extra.append(("url", start, rest.end(), False))
            self.taken["url"] = rest.end()

    def found(self) -> list[Span]:
        """All spans by kind, then place; added ones only where no span of their kind is."""
        order = {kind: k for k, kind in enumerate(KINDS)}
        kept = sorted(self.spans, key=lambda s: (order[s[0]], s[1]))
        if not self.extra:
            return kept
        kept = sorted(kept + self.extra, key=lambda s: (order[s[0]], s[1], not s[3], -s[2]))
        out: list[Span] = []
        nearest = [None] * len(kept)  # the next base span of the kind at or after each place
        upcoming: dict[str, int] = {}
        for k in range(len(kept) - 1, -1, -1):
            nearest[k] = upcoming.get(kept[k][0])
            if kept[k][3]:
                upcoming[kept[k][0]] = kept[k][1]
        for span, base in zip(kept, nearest):
            clear = not out or out[-1][0] != span[0] or out[-1][2] <= span[1]
            if span[3] or clear and (base is None or span[2] <= base):
                out.append(span)
        return out


def find_spans(text: str, lowered: str, automaton) -> list[Span]:  # type: ignore[no-untyped-def]
    """The spans of ``text`` in code points; ``lowered`` is the text with A-Z in lower case."""
    scan = Scan(text)
    parsers = {kind: getattr(scan, kind) for kind in ("at", "plus", "digit", "spelt", "scheme", "iban", "account", "ssn")}
    for last, (kind, size) in automaton.iter(lowered):
        parsers[kind](last + 1 - size, last + 1)
    return scan.found()


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, spans (kind, start, end, base; code points, end exclusive), redacted.

    ``redacted`` is the text with each span, or spans that overlap, replaced by
    the first one's kind in angle brackets.  Nulls: a null text is an empty one
    without spans; a null id stays.  Of added spans of one kind that overlap the
    first, then the longer counts.  Repeated rows give repeated results; an
    empty table gives an empty one; other columns are not read, whatever they
    are called.  Texts are scanned whole, one at a time.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch, texts in slices(batches, "text"):
            found, clean = [], []
            for data in texts:
                text = data.decode()
                spans = find_spans(text, data.lower().decode(), automaton)  # bytes.lower: A-Z only
                found.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans])
                clean.append(redacted(text, spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(clean, pa.string())], names=["id", "spans", "redacted"])

    own = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {own}, spans array<struct<kind:string,start:long,end:long,base:boolean>>, redacted string").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[Span]) -> str:
    out, upto = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= upto:
            out += [text[upto:start], f"<{kind}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]]) if spans else text


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of every document's base spans, and all its spans as text."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    rows = personal_data(table(spark, sf_dir, "documents")).select("doc_id", "spans")
    return rows.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
