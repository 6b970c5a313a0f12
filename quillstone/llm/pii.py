"""Personal data by anchor expansion.

One Aho-Corasick automaton walks over a text and reports anchors: at-signs, schemes and identifier cues (a plus before
a digit, digits that touch or are set apart by one space, hyphen or dot, and words that announce an account).  From an
anchor a local parser expands to both sides as far as the kind's characters go and validates what it has found.  The
parsers are deterministic and look at each stretch of text once for each kind.

Kinds: email, ip, card and phone (the base kinds, defined as leftmost non-overlapping matches of the patterns below,
failing matches dropped without a retry), and more: url (a scheme, then anything but white space, quotes and brackets,
without closing punctuation), account (an announcing word, then an IBAN with right check digits, or 8 to 17 digits, or a
social security number of 3-2-4 digits), ipv6 (a valid address of at least two groups), mac (six pairs of hexadecimal
digits with one separator) and secret (the value that an announcing word and : or = give, of at least 8 characters with
a digit among them; keys that tell themselves by how they begin; the first line of a private key).

Cases: a null or empty text has no spans; very long texts are taken whole, and a parser passes over what it has looked at
whether it holds or not, so the time grows with the length whatever the characters are; offsets count code points, the
end is exclusive; repeated rows are answered row by row; an empty table gives no rows; columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import by_rows, sha256, table

KINDS = ("email", "ip", "card", "phone", "url", "account", "ipv6", "mac", "secret")
BASE = KINDS[:4]

# The words that announce an account, and the schemes.
CUES = ("account", "account number", "acct", "iban", "ssn", "social security number", "konto", "kontonummer", "compte", "cuenta")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
SECRETS = ("token", "secret", "password", "passwd", "passphrase", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "credential")
KEYS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk-", "sk_live_", "-----BEGIN ")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`(){}\[\]]+")
_AFTER_CUE = re.compile(r"[ \t]*+(?:number|no\.?|nr\.?)?+[ \t]*+[:#=]?+[ \t]*+(?=[A-Z0-9])")  # never goes back: white space may be long
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9]){7,16}(?![0-9])")
_VALUE = re.compile(r"""[\w-]{0,20}["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?([^\s"'`,;<>]{8,})""")
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[ops]_[A-Za-z0-9]{30,}|github_pat_\w{22,}|xox[bp]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|sk_live_\w{16,}|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")
_MAC = re.compile(r"[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![0-9A-Za-z:-])")
_RUN = re.compile(r"[0-9A-Fa-f:]*+")
_HEX = "0123456789abcdefABCDEF"
_DIGITS = "0123456789"


def automaton():
    import ahocorasick

    found: dict[str, set] = {"@": {"email"}}
    for d in _DIGITS:
        found.setdefault(f"+{d}", set()).add("phone")
        for e in _DIGITS:
            found.setdefault(f"{d}.{e}", set()).add("ip")
            for gap in ("", " ", "-"):
                found.setdefault(f"{d}{gap}{e}", set()).add("card")
    for h in _HEX:
        found.setdefault(f"{h}:", set()).update(("ipv6", "mac"))
        found.setdefault(f"{h}-", set()).add("mac")
    found.setdefault("::", set()).add("ipv6")
    for w in KEYS:
        found.setdefault(w, set()).add("secret")
    for words, kind in ((SCHEMES, "url"), (CUES, "account"), (SECRETS, "secret")):
        for w in words:
            for form in (w, w.upper(), w.capitalize()):
                found.setdefault(form, set()).add(kind)
    out = ahocorasick.Automaton()
    for anchor, kinds in found.items():
        out.add_word(anchor, (len(anchor), sorted(kinds)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _email(text: str, at: int, after: int):
    left = at
    while left > after and text[left - 1] in _LOCAL:
        left -= 1
    m = _DOMAIN.match(text, at + 1) if left < at else None
    return m and (left, m.end(), True)


def _ip(text: str, at: int, after: int):
    while at > after and text[at - 1] in _DIGITS:
        at -= 1
    m = _IP.match(text, at)
    return m and (at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")))


def _card(text: str, at: int, after: int):
    m = _CARD.match(text, at)
    if not m:
        return None
    digits = m[0].replace(" ", "").replace("-", "")
    return at, m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str, at: int, after: int):
    m = _PHONE.match(text, at)
    return m and (at, m.end(), 8 <= sum(c in _DIGITS for c in m[0]) <= 15)


def _url(text: str, at: int, after: int):
    m = _URL.match(text, at)
    end = at + len(m[0].rstrip(".,;:!?"))
    return at, end, end > text.index(":", at) + 3 or text.startswith("mailto:", at) and end > at + 7


def _account(text: str, at: int, after: int):
    if at and text[at - 1].isalnum():
        return None
    start = at
    while start < len(text) and (text[start].isalpha() or text[start] == " " and text[start + 1 : start + 2].islower()) and start < at + 32:
        start += 1  # over the announcing words
    m = _AFTER_CUE.match(text, start)
    if not m:
        return None
    for shape in (_IBAN, _SSN, _NUMBER):
        if x := shape.match(text, m.end()):
            ok = shape is not _IBAN or iban(x[0])
            return x.start(), x.end(), ok
    return None


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ipv6(text: str, at: int, after: int):
    while at > after and text[at - 1] in _HEX + ":":
        at -= 1
    end = _RUN.match(text, at).end()
    # the run is an address or none of it is, so what fails is passed over, too, and no run is walked twice
    if not 3 <= end - at <= 39 or at and text[at - 1].isalnum() or text[end : end + 1].isascii() and text[end : end + 1].isalnum():
        return at, end, False
    try:
        ipaddress.IPv6Address(text[at:end])
    except ValueError:
        return at, end, False
    return at, end, sum(map(bool, text[at:end].split(":"))) > 1


def _mac(text: str, at: int, after: int):
    start = at - 1
    m = _MAC.match(text, start) if start >= after else None
    return m and (start, m.end(), start == 0 or not (text[start - 1].isalnum() or text[start - 1] in ":-"))


def _secret(text: str, at: int, after: int):
    if m := _KEY.match(text, at):
        return at, m.end(), not at or not text[at - 1].isalnum()
    for word in SECRETS:
        if text[at : at + len(word)].lower() == word and (m := _VALUE.match(text, at + len(word))):
            return m.start(1), m.end(1), any(c in _DIGITS for c in m[1])
    return None


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "url": _url, "account": _account, "ipv6": _ipv6, "mac": _mac, "secret": _secret}


def spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """For each kind the (start, end) of what was found and is valid, from left to right."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    reached = dict.fromkeys(KINDS, 0)
    for last, (length, kinds) in anchors.iter(text):
        at = last - length + 1
        for kind in kinds:
            if at >= reached[kind] and (got := _PARSERS[kind](text, at, reached[kind])):
                reached[kind] = got[1]
                if got[2]:
                    found[kind].append(got[:2])
    return found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and spans of each kind (as struct arrays) and the digests of the base ones; no shuffle."""

    def make():
        anchors = automaton()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [spans(t or "", anchors) for t in batch.column(1).to_pylist()]
            text = [[f"{k}:{a}:{b}" for k in KINDS for a, b in r[k]] for r in rows]
            base = [sum(len(r[k]) for k in BASE) for r in rows]
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    *(pa.array([len(r[k]) for r in rows], pa.int64()) for k in KINDS),
                    pa.array([sha256(",".join(t[:n]).encode()) for t, n in zip(text, base, strict=True)]),
                    pa.array([",".join(t) for t in text], pa.string()),
                ],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

        return step

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return by_rows(docs.select("doc_id", "text"), make, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, anchors, mark: str = "[{kind}]") -> str:
    """The text with every found span, longest first where kinds overlap, replaced by its kind."""
    every = sorted(((a, b, k) for k, x in spans(text, anchors).items() for a, b in x), key=lambda s: (s[0], -s[1]))
    out, at = [], 0
    for a, b, kind in every:
        if a >= at:
            out += [text[at:a], mark.format(kind=kind)]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
