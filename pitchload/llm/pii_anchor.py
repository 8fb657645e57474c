"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus-signs, digits, `://` and cue words
(IBAN, account, token ...). A local parser for each kind expands an anchor to both sides, checks the
boundaries and validates the match, so the text around is never searched by patterns.

Base kinds are email, ip, card and phone, each the leftmost non-overlapping matches of its pattern:
    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), parts at most 255
    card   [0-9]([\\x20-]?[0-9])+, 13 to 19 digits passing Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 9 to 15 digits
A match that fails its check is dropped and the search goes on behind it. The anchors add:
    address  scheme://user:password@host, from the scheme to the end of the host
    account  an IBAN (mod 97), or the identifier that follows a cue and a `:`, `=`, `#` or blank and
             has at least six characters, a digit among them. An identifier with a letter may hold
             `_ . / + =` (keys, tokens in parts), one without holds digits and hyphens only, so that
             amounts and dates don't count. Identifiers and schemes may have any length.

Every parser reads a character a bounded number of times, so very long texts and very long runs take
time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("address", "account")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# cue words (in lower or upper case or capitalised, not inside a longer word)
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta", "token", "passport", "ssn")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")

_domain = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_digits = re.compile(r"[0-9]+")
_ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_user = re.compile(r"[^\s/?#@:]+:[^\s/?#@]*@[A-Za-z0-9.-]+(?::[0-9]+)?")
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_lead = re.compile(r"(?:[\x20\t]*(?:number|no|nr|id)\b\.?)?[\x20\t]*[:=#]?[\x20\t]*[\"']?", re.I)
_parts = re.compile(r"[A-Za-z0-9_-](?:[A-Za-z0-9_./+=-]*[A-Za-z0-9_=-])?")
_number = re.compile(r"[0-9-]+(?![A-Za-z0-9_-])")
_letter = re.compile(r"[A-Za-z]")
LEAST = 6       # characters of an identifier


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("@", "@"), ("+", "+"), ("0", "0123456789"), (":", ["://"])):
        for w in words:
            a.add_word(w, (kind, 1 if kind != ":" else 3))
    for cue in CUES:
        for w in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(w, ("cue", len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind in the order of KINDS and then by start."""
    out: dict[str, list] = {k: [] for k in KINDS}
    end = dict.fromkeys(("email", "ip", "card", "phone", "address"), 0)   # where each kind may match again
    digits_end = 0
    searched = 0        # an identifier without a digit was read up to here
    for at, (kind, n) in _AUTOMATON.iter(text):
        if kind == "0":
            if at >= end["card"] and (m := _card.match(text, at)):
                end["card"] = m.end()
                d = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out["card"].append(("card", at, m.end()))
            if at >= end["ip"] and at >= digits_end:
                if m := _ip.match(text, at):
                    end["ip"] = m.end()
                    if all(map(_small, m[0].split("."))):
                        out["ip"].append(("ip", at, m.end()))
                else:                               # no later digit of the run can start one either
                    digits_end = _digits.match(text, at).end()
        elif kind == "@":
            i, low = at, end["email"]
            while i > low and text[i - 1] in LOCAL:
                i -= 1
            if i < at and (m := _domain.match(text, at + 1)):
                out["email"].append(("email", i, m.end()))
                end["email"] = m.end()
        elif kind == "+":
            if at >= end["phone"] and (m := _phone.match(text, at)):
                end["phone"] = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(("phone", at, m.end()))
        elif kind == ":":
            i = at - n + 1
            while i > end["address"] and text[i - 1] in SCHEME:
                i -= 1
            if i < at - n + 1 and (m := _user.match(text, at + 1)):
                out["address"].append(("address", i, m.end()))
                end["address"] = m.end()
        else:
            a, b = at - n + 1, at + 1
            if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
                continue
            if b < searched:
                continue
            span, searched = _account(text, b)
            if span:
                out["account"].append(("account", *span))
    return [s for k in KINDS for s in out[k]]


def _account(text: str, b: int) -> tuple[tuple[int, int] | None, int]:
    """The identifier behind a cue that ends at b, and the place up to which no later cue can have one."""
    at = _lead.match(text, b).end()
    if whole := _iban.match(text, at):
        for stop in range(whole.end(), whole.start() + 14, -1):
            if text[stop - 1] != " " and (stop == len(text) or not text[stop].isalnum()) and iban_ok(text[whole.start():stop]):
                return (at, stop), stop
    m = _parts.match(text, at)
    if not m:
        return None, b
    if not _letter.search(m[0]):
        m = _number.match(text, at)
        return (m.span() if m and len(m[0]) >= LEAST and _digits.search(m[0]) else None), b
    inner = at + len(m[0].rstrip("=_-"))
    return (m.span() if len(m[0]) >= LEAST and _digits.search(m[0]) else None), inner


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlapping ones merged, replaced by the first span's kind in brackets."""
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += (text[done:a], f"[{kind.upper()}]")
        done = b
    return "".join(out) + text[done:]


def _found(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        spans = find(t) if isinstance(t, str) else []
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k in BASE)
        rows.append((*(sum(k == kind for k, _, _ in spans) for kind in BASE), hashlib.sha256(base.encode()).hexdigest(),
                     ",".join(f"{k}:{a}:{b}" for k, a, b in spans), redact(t, spans) if spans else t))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted"])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find_personal_data(docs: DataFrame) -> DataFrame:
    """`docs` with a struct column `pii` (see FOUND) for the column `text`.

    Positions are code points, ends exclusive. A null text counts as empty and stays null in `redacted`;
    a text without spans gives an empty string of spans and is its own redaction. Rows are judged one
    by one, so repeated rows give repeated results and an empty table an empty one. A column `pii` of
    the input is replaced.
    """
    return docs.withColumn("pii", F.pandas_udf(_found, FOUND)("text"))


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with personal data in `text` replaced by its kind in brackets; `n_chars`, if there is
    such a column, is the new text's length (unchanged where the text is null)."""
    out = docs.withColumn("text", F.pandas_udf(_found, FOUND)("text")["redacted"])
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(n))
    return out
