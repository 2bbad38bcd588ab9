"""Personal data in texts: an Aho-Corasick automaton finds anchors, local parsers expand them to spans and validate those."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended, without

#: Kinds in the order in which spans are listed; the first four are the base, the others are the method's own.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "login", "iban", "account")

LOCAL = r"A-Za-z0-9._%+-"
#: Latin letters beyond ASCII, which the wide form of an address may hold.
WIDE = "À-ÖØ-öø-ɏ"
USER = r"[A-Za-z0-9._~%!$&'()*+,;=-]"

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HU": 28, "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "SI": 19, "SK": 24,
}
IBAN_CUES = ("IBAN", "Iban", "iban")
ACCOUNT_CUES = tuple(form for cue in ("account", "acct", "passport", "ssn", "konto", "compte", "cuenta") for form in (cue, cue.capitalize(), cue.upper()))

#: What SQL and the tests match over whole texts; group 1 is what stands before a span. The scan itself starts at anchors only.
PATTERNS = {
    "email": rf"()[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"()[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"()[0-9](?:[\x20-]?[0-9])+",
    "phone": r"()\+[0-9][\x20().0-9-]+[0-9]",
    "address": rf"()[{WIDE}{LOCAL}]+@[A-Za-z0-9{WIDE}-]+(?:\.[A-Za-z0-9{WIDE}-]+)+",
    "login": rf"([A-Za-z0-9+.-]://){USER}+(?::{USER}*)?@",
    "iban": rf"((?:{'|'.join(IBAN_CUES)})[:\x20]{{0,2}})(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items()) + ")",
    "account": rf"((?:{'|'.join(ACCOUNT_CUES)})(?:\x20(?:number|no|nr))?[.:#]?\x20?)[0-9](?:[\x20-]?[0-9])+",
}

# The local parsers: each is tried at one place and keeps what it has read, so that no text is read twice over.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_WIDE_DOMAIN = re.compile(rf"@[A-Za-z0-9{WIDE}-]++(?:\.[A-Za-z0-9{WIDE}-]++)++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOGIN = re.compile(rf"://({USER}++(?::{USER}*+)?@)")
_IBAN = re.compile(PATTERNS["iban"])
_ACCOUNT = re.compile(PATTERNS["account"])
_NARROW = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_BEYOND = re.compile(f"[{WIDE}]")


@cache
def anchors() -> ahocorasick.Automaton:
    """At-signs, plus signs, digits, scheme marks and identifier cues."""
    a = ahocorasick.Automaton()
    for kind, cues in (("@", "@"), ("+", "+"), ("0", "0123456789"), (":", ("://",)), ("i", IBAN_CUES), ("a", ACCOUNT_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _part(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) < 4 and int(short or 0) <= 255


def valid(kind: str, span: str) -> bool:
    """Whether a span that has a kind's form is one: sums, ranges and counts of digits."""
    if kind == "ip":
        return all(map(_part, span.split(".")))
    if kind == "iban":
        s = span.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind in ("card", "phone", "account"):
        digits = "".join(c for c in span if "0" <= c <= "9")
        low, high = {"card": (13, 19), "phone": (9, 15), "account": (8, 17)}[kind]
        return low <= len(digits) <= high and (kind != "card" or luhn(digits))
    return True


class _Scan:
    """One text: how far each kind has been read, and the spans found so far."""

    def __init__(self, text: str):
        self.text, self.to, self.found = text, dict.fromkeys((*KINDS, "run"), 0), {k: [] for k in KINDS}

    def take(self, kind: str, start: int, end: int, read: int | None = None) -> None:
        self.to[kind] = end if read is None else read
        if valid(kind, self.text[start:end]):
            self.found[kind].append((start, end))

    def mail(self, kind: str, at: int, domain: re.Pattern, wide: bool) -> None:
        if not (m := domain.match(self.text, at)):
            return
        start, least, text = at, self.to[kind], self.text
        while start > least and ((c := text[start - 1]) in _NARROW or wide and _BEYOND.match(c)):
            start -= 1
        if start < at:
            self.take(kind, start, m.end())

    def digit(self, at: int) -> None:
        if at >= self.to["ip"]:
            if m := _IP.match(self.text, at):
                self.take("ip", at, m.end())
            else:
                self.to["ip"] = _DIGITS.match(self.text, at).end()
        if at >= self.to["card"]:
            m = _CARD.match(self.text, at)
            if m:
                self.take("card", at, m.end())

    def spans(self) -> dict[str, list[tuple[int, int]]]:
        text, to = self.text, self.to
        for last, (kind, size) in anchors().iter(text):
            at = last - size + 1
            if kind == "0":
                if at >= to["ip"] or at >= to["card"]:
                    self.digit(at)
            elif kind == "@":
                self.mail("email", at, _DOMAIN, False)
                self.mail("address", at, _WIDE_DOMAIN, True)
            elif kind == "+":
                if m := _PHONE.match(text, at):
                    self.take("phone", at, m.end())
            elif kind == ":":
                if at and at > to["login"] and text[at - 1] in _SCHEME and (m := _LOGIN.match(text, at)):
                    self.take("login", m.start(1), m.end())
            else:
                name, pattern = ("iban", _IBAN) if kind == "i" else ("account", _ACCOUNT)
                if at >= to[name] and (m := pattern.match(text, at)):
                    self.take(name, m.end(1), m.end())
        narrow = set(self.found["email"])
        self.found["address"] = [s for s in self.found["address"] if s not in narrow]
        return self.found


def spans_of(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, as code points from start to end (exclusive), rising."""
    return _Scan(text or "").spans()


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _scan(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    rows = [spans_of(t) for t in batch.column("__text").to_pylist()]
    return {"spans": pa.array([[{"kind": k, "start": s, "end": e} for k in KINDS for s, e in r[k]] for r in rows], pa.list_(SPAN))}


def private_spans(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Where texts hold personal data: e-mail and network addresses, card, phone, bank and account numbers, log-ins.

    Returns ``carry`` (all columns but the text by default) with spans: kind, start and end in code points, by kind as in
    KINDS, then start. Spans of one kind do not overlap; those of different kinds may. Input columns called ``spans`` are
    replaced. Null and empty texts have no spans; very long texts are read whole, each place a bounded number of times;
    rows are judged one by one, so repeated rows repeat. An empty table gives no rows. Nothing is shuffled.
    """
    base = without(docs, ["spans"])
    cols = [c for c in (base.columns if carry is None else carry) if carry is not None or c != text_col]
    rows = base.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text_col}`").alias("__text"))
    return appended(rows, ["__text"], "spans array<struct<kind string, start long, end long>>", _scan)


def listed(spans) -> F.Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of their list and the list of all spans; without spans zeros and empty lists."""
    of = {f"n_{k}": F.size(F.array_remove(F.transform("spans", lambda s: s["kind"] == F.lit(k)), False)).cast("long") for k in BASE}  # noqa: B023  built at once
    own = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spanned.withColumns(of | {"base_sha256": F.sha2(listed(own), 256)}).withColumn("spans", listed(F.col("spans")))


def oracle_sql() -> str:
    """The same in SQL: matches over whole texts, their places from the texts between them."""
    number = {k: i for i, k in enumerate(KINDS)}
    rule = {
        "ip": "len(list_filter(string_split(s, '.'), lambda p: length(ltrim(p, '0')) > 3 or cast('0' || right(p, 3) as integer) > 255)) = 0",
        "card": "length(d) between 13 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 or d[-i] = '0'"
        " then cast(d[-i] as integer) else (2 * cast(d[-i] as integer) - 1) % 9 + 1 end)) % 10 = 0",
        "phone": "length(d) between 9 and 15",
        "account": "length(d) between 8 and 17",
        "iban": "list_reduce(list_transform(string_split(regexp_replace(s, ' ', '', 'g')[5:] || regexp_replace(s, ' ', '', 'g')[:4], ''),"
        " lambda c: case when c <= '9' then cast(c as integer) else ascii(c) - 55 end), lambda a, c: (a * (case when c > 9 then 100 else 10 end) + c) % 97) = 1",
    }
    parts = []
    for k, p in PATTERNS.items():
        p = p.replace("'", "''")
        parts.append(rf"""select rid, {number[k]} as k, '{k}' as kind, unnest(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
    start := cast(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda m: length(m))), 0) + length(ps[i]) as bigint),
    s := substr(ms[i], length(ps[i]) + 1)))) as u
  from (select rid, regexp_extract_all(x, '{p}') as ms, regexp_extract_all(x, '{p}', 1) as ps, regexp_split_to_array(x, '{p}') as gs from t)""")
    checks = " and ".join(f"case when kind = '{k}' then {r} else true end" for k, r in rule.items())
    base = ", ".join(f"'{k}'" for k in BASE)
    return rf"""
with t as (select doc_id, coalesce(text, '') as x, row_number() over () as rid from documents),
a as ({" union all ".join(parts)}),
b as (select rid, k, kind, u.start as start, u.s as s, u.start + length(u.s) as stop, regexp_replace(u.s, '[^0-9]', '', 'g') as d from a),
v as (select * from b where {checks}),
f as (select * from v where not (kind = 'address' and exists (select 1 from v w where w.kind = 'email' and w.rid = v.rid and w.start = v.start and w.stop = v.stop))),
g as (select rid, {", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE)},
  string_agg(kind || ':' || start || ':' || stop, ',' order by k, start) filter (where kind in ({base})) as own,
  string_agg(kind || ':' || start || ':' || stop, ',' order by k, start) as spans from f group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(own, '')) as base_sha256, coalesce(spans, '') as spans
from t left join g using (rid)"""
