"""Personal data by anchor expansion.

Aho-Corasick finds anchors (at-signs, plus signs, digits, schemes, cues of identifiers and secrets).
A local parser grows each anchor to the whole span and validates it. An address grows to the left
over the characters of a name and to the right over those of a host; numbers grow over the zone of
characters that their kind may hold, out of which the spans are cut. No span of a kind reaches beyond
its zone, so the spans are those of a search over the whole text. Every parser goes over a character
a fixed number of times at most, whatever the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from tidewarden.llm.common import ship

ship(__name__)

# The patterns of the contract, and the characters that each may hold.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
NAME, HOST = EMAIL.split("@")
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ZONES = {
    "ip": r"[0-9.]",
    "card": r"[0-9\x20-]",
    "phone": r"[\x20().0-9+-]",
}
# A match that begins inside a run of digits would begin with the run: only its first digit is tried.
PATTERNS = {"ip": "(?<![0-9])" + IP, "card": CARD, "phone": PHONE}
KINDS = ("email", "ip", "card", "phone")
CUES = ("account", "acct", "iban", "passport", "user id", "customer id")
SECRETS = ("token", "secret", "password", "api key", "api_key", "apikey")
# What may stand between a cue and its identifier; a sign or a word for "number" makes it certain.
LEAD = r"(?P<sure>\s*(?:no|number|nr)\b\.?)?\s*(?P<sign>[:#=]\s*)?"
PRINTED = r"[A-Za-z]{2}[0-9]{2}(?:\x20[A-Za-z0-9]{4})+(?:\x20[A-Za-z0-9]{1,3})?(?![A-Za-z0-9])"  # groups of an IBAN
TOKEN = r"[A-Za-z0-9][A-Za-z0-9-]*"
LONGEST = 34  # characters of an account's identifier
SECRET = r"\s*[:=]\s*[\"']?(?P<value>[A-Za-z0-9_./+=~-]{8,})"
URL = r"[^\s<>\"']+"

SCHEMA = """doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint,
base_sha256 string, spans string"""


def luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[-1::-2])
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def valid(kind: str, span: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in span.split("."))
    digits = re.sub("[^0-9]", "", span)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def iban(text: str) -> bool:
    """Whether letters and digits, spaces apart, are an IBAN by their remainder."""
    word = text.replace(" ", "").upper()
    return 15 <= len(word) <= LONGEST and int("".join(str(int(c, 36)) for c in word[4:] + word[:4])) % 97 == 1


class Finder:
    """Built once in each task."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        anchors = {"@": ("email",), "+": ("phone",), "://": ("url",)}
        anchors |= {str(d): ("ip", "card") for d in range(10)} | {cue: ("account",) for cue in CUES}
        anchors |= {cue: ("secret",) for cue in SECRETS}
        for text, kinds in anchors.items():
            self.anchors.add_word(text, kinds)
        self.anchors.make_automaton()
        self.patterns = {k: re.compile(p) for k, p in PATTERNS.items()}
        self.right = {k: re.compile(f"{c}*") for k, c in ZONES.items()}
        self.inside = {k: re.compile(c) for k, c in ZONES.items()}
        self.name, self.host = re.compile(NAME.removesuffix("+")), re.compile(HOST)
        self.lead, self.printed, self.token, self.secret = map(re.compile, (LEAD, PRINTED, TOKEN, SECRET))
        self.url, self.scheme = re.compile(URL), re.compile("[A-Za-z][A-Za-z0-9+.-]*")

    def email(self, text: str, at: int, least: int) -> tuple[int, int] | None:
        """The address around an at-sign, beginning at `least` or later."""
        start = at
        while start > least and self.name.match(text, start - 1):
            start -= 1
        host = self.host.match(text, at + 1)
        return (start, host.end()) if host and start < at else None

    def account(self, text: str, at: int) -> tuple[int, int] | None:
        """The identifier after a cue: an IBAN in printed groups, or a whole token with a digit.
        Without a sign or a word for "number" before it, it needs five digits."""
        lead = self.lead.match(text, at)
        if lead.end() == at:  # the cue is the beginning of a longer word
            return None
        groups = self.printed.match(text, lead.end())
        if groups and iban(groups[0]):
            return groups.span()
        token = self.token.match(text, lead.end())
        if not token or not 5 <= len(token[0]) <= LONGEST:
            return None
        digits = sum(c.isdigit() for c in token[0])
        return token.span() if digits >= (1 if lead["sign"] or lead["sure"] else 5) else None

    def spans(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Kind -> spans in code points, end exclusive, by start."""
        found = {kind: [] for kind in (*KINDS, "account", "url", "secret")}
        done = dict.fromkeys(found, 0)
        low = "".join(c.lower() if c.isascii() else c for c in text) if not text.isascii() else text.lower()
        for end, kinds in self.anchors.iter(low):
            for kind in kinds:
                if end < done[kind]:
                    continue
                if kind == "email":
                    if span := self.email(text, end, done[kind]):
                        found[kind].append(span)
                        done[kind] = span[1]
                elif kind in KINDS:
                    start, inside = end, self.inside[kind]
                    while start > done[kind] and inside.match(text, start - 1):
                        start -= 1
                    done[kind] = stop = self.right[kind].match(text, end).end()
                    for m in self.patterns[kind].finditer(text, start, stop):
                        if valid(kind, m[0]):
                            found[kind].append(m.span())
                elif kind == "account":
                    if span := self.account(text, end + 1):
                        found[kind].append(span)
                        done[kind] = span[1]
                elif kind == "secret":
                    m = self.secret.match(text, end + 1)
                    if m:  # where the whole value has no digit or no letter, no later part has
                        done[kind] = m.end()
                        if any(c.isdigit() for c in m["value"]) and any(c.isalpha() for c in m["value"]):
                            found[kind].append(m.span("value"))
                else:
                    start = end - 2
                    while start > done[kind] and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "+.-"):
                        start -= 1
                    m = self.url.match(text, end + 1) if self.scheme.match(text, start, end - 2) else None
                    if m:
                        found[kind].append((start, m.end()))
                        done[kind] = m.end()
        return found


def find_pii(documents: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, and all spans.

    A null text counts as empty. Documents without spans have zero counts, the digest of the empty
    string and an empty `spans`. Repeated rows give repeated rows, a null doc_id stays null, an
    empty table gives no rows; columns besides doc_id and text are not read.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = finder.spans(text or "")
                parts = {k: [f"{k}:{a}:{b}" for a, b in v] for k, v in spans.items()}
                base = ",".join(x for k in KINDS for x in parts[k])
                every = ",".join(x for v in parts.values() for x in v)
                rows.append((*(len(parts[k]) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), every))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy(object) if len(batch) else [])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return documents.select("doc_id", "text").mapInPandas(scan, SCHEMA)
