"""What a credential looks like: shapes of values and the places that name one."""

from __future__ import annotations

import base64
import binascii
import re
from functools import lru_cache
from typing import NamedTuple

# Parts of names that stand for a credential, in the languages of the corpus.
_CUES = (
    "password passwd passphrase passwort kennwort pass pwd pw clave contrasena senha secret token tok key apikey cred creds credential "
    "credentials auth bearer login pin seed sig signature signing signer license licence identity sk priv private dsn material conn "
    "mot passe motdepasse hmac salt pem code k1 k2"
).split()
# Parts of names whose values are public, derived, encrypted or mere pointers.
_PUBLIC = (
    "etag checksum digest hash sha integrity icon image img logo request trace span uuid guid commit rev revision build url uri href "
    "font page model asset table lut verify public pub sealed encrypted masked name ref file path fingerprint version quote "
    "pattern count len ttl data body payload type field header label prefix format"
).split()
CUES, PUBLIC = frozenset(_CUES), frozenset(_PUBLIC)

# Forms that hold no value: references, masks and empty values. Words that stand for a value are told by the number of their owners.
_PLACEHOLDER = re.compile(
    r"(?i)^(?:.*(?:vault:|\$\{|\{\{|%\(|<[\w -]+>|\*{3}|x{4}|\.{3}).*|(.)\1*|\W*|none|null|true|false|undefined)$"
)
_FRAME = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
KEY_BEGIN, KEY_END = re.compile("-----BEGIN " + _FRAME), re.compile("-----END " + _FRAME)
# One line or literal of a key without its END: base64 or a header, with comment marks, quotes and joins around it.
_KEY_LINE = re.compile(r"(?:\\[nr]|[\s\"'`+,.\\*#/;()-])*(?:(?:Version|Comment|Proc-Type|DEK-Info|Hash|Charset|MessageID)\s?:[^\n\"'`\\]*|=?[A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]{2,}={1,2}|=[A-Za-z0-9+/]{4})(?=\\[nr]|[\s\"'`]|\Z)(?:\\[nr])*")
_KEY_PIECE = re.compile(r"(?<![A-Za-z0-9+/=\\])=?[A-Za-z0-9+/]{2,}={0,2}|(?<=\\[nr])=?[A-Za-z0-9+/]{2,}={0,2}")
_MARK, _CODE = re.compile(r"[+/]+"), re.compile(r"[(){}\[\]_]")
_KEY_HEADER = re.compile(r"(?:Version|Comment|Proc-Type|DEK-Info|Hash|Charset|MessageID)\s?:[^\n\"'`\\]*")
TOKEN = re.compile(
    r"(?<![\w/+.-])(?:"
    r"eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{16,}"
    r"|(?:AKIA|ASIA)[0-9A-Z]{16}"
    r"|xox[a-z]-[0-9A-Za-z-]{16,}"
    r"|(?=[\w.-]*[A-Z])(?=[\w.-]*\d)[A-Za-z][A-Za-z0-9]{1,7}(?:[_-][a-z]{2,6})?[._-][A-Za-z0-9]{18,}(?:[._-][A-Za-z0-9_-]{18,})?"
    r"|AIza[\w-]{30,}"
    r")(?![\w/+-])"
)
_LITERAL = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_STRING = re.compile(_LITERAL)
_JOINED = re.compile(rf"(?:{_LITERAL})(?:\s*(?:\+|\.|\\\n)?\s*(?:{_LITERAL}))*")
_ASSIGN = re.compile(r"(?<![\w.-])(?:(?![A-Za-z_])[\w.-])*+(?P<name>[A-Za-z_][\w.-]*+)[\"']?\s*(?::\s*[&\w<>' ]{1,24}?\s*)?(?::=|=>|=|:)\s*(?P<call>[\w.]*+\(\s*)?")
_BARE = re.compile(r"[^\s\"'`,;(){}<>|&][^\s\"'`,;(){}<>]*")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@\"'`]*:(?P<v>[^\s@\"'`/]{3,})@")
_FLAG = re.compile(r"(?:--?(?:password|passwd|pass|pwd|token|secret|api-?key|auth|key)(?:\s+|=)|(?<=\s)-u\s+[\w.-]+:|(?<=\s)-p\s*)(?P<v>[^\s\"'`;|]{6,})")
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token|ApiKey)\s+(?P<v>[\w.~+/=-]{8,})")
_CALL = re.compile(r"\b(?:open_session|login|log_in|logIn|sign_?in|signIn|connect|authenticate|authorize|set_password|setPassword|credentials|dial|bind)\s*\((?P<args>[^()]*)\)", re.S)
_HEXCALL = re.compile(r"\b(?:decode_hex|from_?hex|fromhex|unhex(?:lify)?|hex_decode|hexdec|DecodeString|b64decode|decode_base64|atob)\s*\(\s*(?:" + _LITERAL + ")")
_COMMENT = re.compile(r"^\s*(?:\d+:\s*)?(?://|#|--|\*|/\*|;)|^[A-Z][\w ]+ [`\w]")
_COMMENT_CUE = re.compile(r"(?i)\b(?:key|pw|pwd|pass|password|passwd|tok|token|secret|login|log in|creds?|staging|auth|rotate)\b")
_COMMENT_PUBLIC = re.compile(r"(?i)\b(?:commit|built from|digest|checksum|sha\d*|etag|revision|hash|version|toolkit)\b")
_WORD = re.compile(r"[A-Za-z]+|\d+")
_END, _OPEN = re.compile(r"[,;}]|$"), re.compile(r"[({;]")
# What a line must hold for a rule to find something on it: a name before = or :, or one of these.
_NAME = re.compile(r"(?<![\w.-])(?:(?![A-Za-z_])[\w.-])*+([A-Za-z_][\w.-]*+)[\"']?[^\S\n]*+[:=]")
_PLACES = tuple(
    re.compile(p)
    for p in (
        r"://[^\s:/@\"'`]*:[^\s@\"'`/]{3,}@", r"--?(?:password|passwd|pass|pwd|token|secret|api-?key|auth|key)[\s=]|-u\s|-p", r"(?:Bearer|Basic|Token|ApiKey)\s",
        r"[\"'`]\s*(?:\+|\.|\\\n)?\s*[\"'`]",
    )
)
# every token and hexadecimal key holds such a run, with a digit in it or right before it unless it begins in one of these ways
_LONG, _ISSUED = re.compile(r"[A-Za-z0-9_-]{16,}"), ("eyJ", "AKIA", "ASIA", "xox", "AIza")
_COMMENT_LINE = re.compile(r"(?m)^(?:\s*(?:\d+:\s*)?(?://|#|--|\*|/\*|;)|[A-Z][\w ]+ [`\w])[^\n]*")
_DIGIT = re.compile(r"\d")
# an unquoted member chain, as in code
_MEMBER = re.compile(r"[A-Za-z_$]+\d?(?:[.:\[\]]+[A-Za-z_$]+)+[:\[\]]*")


class Hit(NamedTuple):
    start: int  # offset in the text of the value's first character
    spans: tuple  # (start, end) of each piece of the value
    value: str
    kind: str


def parts(name: str) -> list[str]:
    """Words of an identifier in lower case."""
    spaced = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return [p for p in re.split(r"[^A-Za-z0-9]+", spaced.lower()) if p]


def is_placeholder(value: str) -> bool:
    return bool(_PLACEHOLDER.match(value))


def is_structured(value: str) -> bool:
    """A value whose form alone is that of an issued token."""
    m = TOKEN.match(value)
    return bool(m) and m.end() == len(value)


def is_random(value: str) -> bool:
    """Long hexadecimal or mixed-case text without words: keys and digests alike."""
    if re.fullmatch(r"[0-9a-fA-F]{32,}", value):
        return True
    return len(value) >= 20 and bool(re.fullmatch(r"[\w+/=.~-]+", value)) and bool(re.search(r"\d", value)) and bool(re.search(r"[a-z]", value)) and bool(re.search(r"[A-Z]", value))


def is_password(value: str) -> bool:
    """Something a person or a generator would set as a password: a mix of classes without blanks."""
    if len(value) < 6 or re.search(r"\s", value) or re.fullmatch(r"[\d.,:_-]+|[\w-]+\.(?:[a-z]{1,4})|[a-z_]+\(.*", value):
        return False
    if re.match(r"(?:https?|ftp|file)://|/|\./|[\w-]+/[\w-]+/|\{|\[|sha\d+[:-]|data:|ENC\[|W/", value):
        return False
    classes = [bool(re.search(c, value)) for c in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w.:/-]")]
    letters = classes[0] or classes[1]
    if re.fullmatch(r"[A-Z_]+\d{0,2}|[a-z_.-]+\d{0,2}|[A-Za-z]+", value):
        return len(value) >= 12 and classes[0] and classes[1] and len(_WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value))) > 4
    return letters and sum(classes) >= 2


def is_value(value: str, named: bool) -> bool:
    if is_placeholder(value):
        return False
    if is_structured(value):
        return True
    return named and (is_random(value) or is_password(value))


def _basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False


@lru_cache(100_000)
def _role(name: str) -> tuple[bool, bool]:
    """Whether a name stands for a credential, and whether for something public."""
    words = set(parts(name))
    public = bool(words & PUBLIC) and not words & {"license", "password", "passwd"}
    return bool(words & CUES) and not public, public


def hot_lines(text: str) -> list[int]:
    """Start offsets of the lines on which a rule of ``_line_hits`` can find something: no other line has a hit."""
    at = {m.start(1) for m in _NAME.finditer(text) if _role(m[1])[0]}
    for pattern in _PLACES:
        at.update(m.start() for m in pattern.finditer(text))
    for m in _LONG.finditer(text):
        if _DIGIT.search(text, max(0, m.start() - 16), m.end()) or m.group().lstrip("_-").startswith(_ISSUED):
            at.add(m.start())
    at.update(c.start() for m in _COMMENT_LINE.finditer(text) if (c := _COMMENT_CUE.search(text, m.start(), m.end())))
    return sorted({text.rfind("\n", 0, k) + 1 for k in at})


def _literals(text: str, at: int, stop: int) -> tuple[tuple, str] | None:
    """Spans and joined content of the string literals that start at ``at``."""
    m = _JOINED.match(text, at, stop)
    if not m:
        return None
    spans = tuple((s.start() + 1, s.end() - 1) for s in _STRING.finditer(text, m.start(), m.end()))
    spans = tuple(s for s in spans if s[1] > s[0])
    return (spans, "".join(text[a:b] for a, b in spans)) if spans else None


def _line_hits(text: str, start: int, end: int) -> list[Hit]:
    line = text[start:end]
    hits: list[Hit] = []

    def add(spans: tuple, value: str, kind: str) -> None:
        hits.append(Hit(spans[0][0], spans, value, kind))

    public_places: list[tuple[int, int]] = []  # where a public name tells what follows
    full = start + len(line.rstrip())
    for m in _ASSIGN.finditer(line):
        named, public = _role(m["name"])
        at = start + m.end()
        found = _literals(text, at, len(text) if text[at : at + 1] in "\"'`" and text[end - 1 : end] in '+\\"' else end)
        if public:
            public_places.append((start + m.start(), max(found[0][-1][1] if found else at, _END.search(line, m.end()).start() + start)))
        if found:
            spans, value = found
            if not public and (is_value(value, named) or (named or m["call"]) and not is_placeholder(value) and re.fullmatch(r"[0-9a-fA-F]{32,}", value)):
                add(spans, value, "named" if named else "form")
        elif named and not m["call"] and not _OPEN.search(line, m.end()):
            b = _BARE.match(text, at, end)
            if b and b.end() >= full and is_value(b.group(), True) and not (text[at - 1].isspace() and _MEMBER.fullmatch(b.group())):
                add((b.span(),), b.group(), "named")
    for pattern, kind in ((_URL, "url"), (_FLAG, "flag"), (_HEADER, "header")):
        for m in pattern.finditer(line):
            value = m["v"].rstrip("\"'`") if kind != "url" else m["v"]
            fits = is_value(value, True) or (kind == "header" and _basic(value))
            if fits and not is_placeholder(value):
                add(((start + m.start("v"), start + m.start("v") + len(value)),), value, kind)
    for m in TOKEN.finditer(line):
        if not is_placeholder(m.group()) and not any(a <= start + m.start() < b for a, b in public_places):
            add(((start + m.start(), start + m.end()),), m.group(), "form")
    if _COMMENT.match(line) and _COMMENT_CUE.search(line) and not _COMMENT_PUBLIC.search(line):
        for m in re.finditer(r"[^\s`\"',;()]{6,}", line):
            value = m.group().rstrip(".:")
            cut = re.match(r"(?i)(?:\w*(?:tok|token|key|pw|pwd|pass|password|secret))[=:]", value)
            shift = cut.end() if cut else 0
            value = value[shift:]
            strong = is_structured(value) or re.fullmatch(r"[0-9a-f]{32,}", value) or (is_password(value) and re.search(r"\d", value) and not re.fullmatch(r"[A-Za-z_]+\d?\.\w+|[A-Z_0-9]+", value))
            if strong and not is_placeholder(value) and not value.startswith(("http", "//")):
                at = start + m.start() + shift
                add(((at, at + len(value)),), value, "comment")
    return hits


def private_keys(text: str) -> list[tuple[int, int, tuple]]:
    """Start, end and base64 pieces of every private key, whatever stands between its lines.

    A key goes to its END frame if no other BEGIN is before it, else as far as its lines look like those of a key.
    """
    out, begins = [], list(KEY_BEGIN.finditer(text))
    for k, m in enumerate(begins):
        limit = begins[k + 1].start() if k + 1 < len(begins) else len(text)
        last = KEY_END.search(text, m.end(), limit)
        stop, end = (last.start(), last.end()) if last else (m.end(), m.end())
        while not last and (line := _KEY_LINE.match(text, stop, limit)):
            stop = end = line.end()
        headers = [h.span() for h in _KEY_HEADER.finditer(text, m.end(), stop)]
        pieces = [p.span() for p in _KEY_PIECE.finditer(text, m.end(), stop) if not any(a <= p.start() < b for a, b in headers) and not _MARK.fullmatch(p.group())]
        # code between two frames, as of a test for them, is no key: its words are short and it has brackets
        least = 16 if _CODE.search(text, m.end(), stop) else 2
        if sum(b - a for a, b in pieces if b - a >= least) >= 40:
            out.append((m.start(), end, tuple(pieces)))
    return out


def credentials(text: str | None) -> list[Hit]:
    """Candidate credentials of a source text, each place once, in order. Empty and null texts have none."""
    if not text:
        return []
    hits: list[Hit] = []
    keys = []
    if "PRIVATE KEY" in text:
        for start, end, spans in private_keys(text):
            hits.append(Hit(start, spans, "".join(text[a:b] for a, b in spans), "private key"))
            keys.append((start, end))
    lines = hot_lines(text)
    for start in lines:
        end = text.find("\n", start)
        end = len(text) if end < 0 else end
        hits += _line_hits(text, start, end)
    if "(" in text:
        for m in _CALL.finditer(text):
            strings = [s for s in _STRING.finditer(text, m.start("args"), m.end("args"))]
            if len(strings) > 1 and is_value(strings[-1].group()[1:-1], True):
                a, b = strings[-1].start() + 1, strings[-1].end() - 1
                hits.append(Hit(a, ((a, b),), text[a:b], "call"))
    kept, used = [], set()
    for hit in sorted(hits, key=lambda h: (h.start, -len(h.value))):
        inside = hit.kind != "private key" and any(a <= hit.start < b for a, b in keys)
        if not inside and hit.start not in used and not (kept and hit.start < kept[-1].spans[-1][1]):
            used.add(hit.start)
            kept.append(hit)
    return kept


def shape(value: str) -> str | None:
    """The form of a value that an issuer may have given it: its fixed prefix and the alphabet of what follows, or the
    alphabets and lengths of three or more groups.

    Random text without prefix or groups has none (digests and pieces of data look the same), nor have short values.
    """
    if len(value) < 16 or not re.fullmatch(r"[A-Za-z0-9_+/=~.-]+", value) or sum(map(str.isdigit, value)) < 2:
        return None
    kind = lambda s: "x" if re.fullmatch(r"[0-9a-f]+", s) else "a" if s.isalnum() else "s"
    m = re.match(r"([A-Za-z][A-Za-z0-9]{0,7}(?:[_.-][a-z]{2,6})?[_.-])([A-Za-z0-9_-]{12,})$", value)
    if m and re.search(r"\d", m[2]) and not re.search(r"[_-]", m[2]):
        return m[1] + kind(m[2])
    groups = re.split(r"[-.]", value)
    return "-".join(f"{kind(g)}{len(g)}" for g in groups) if 2 < len(groups) < 7 and len(value) >= 24 else None


_RUN = re.compile(r"(?<![\w+/=~.-])[A-Za-z0-9_-]{16,}(?![\w+/=~.-])")
_PUBLIC_BEFORE = re.compile(r"([A-Za-z_][\w-]*)[\"']?\s*[:=]\s*[\"'`]?$")


class Literal(NamedTuple):
    """One literal of a text as the index keeps it."""

    start: int
    value: str
    shape: str | None
    role: str  # named: a place that names a credential; public: one that names something else; open: neither
    pieces: int


def literals(text: str | None) -> list[Literal]:
    """All literals of a text: string contents and runs without blanks, each with its role. Null and empty texts have none."""
    if not text:
        return []
    hits = credentials(text)
    out = [Literal(h.start, h.value, None if h.kind == "private key" else shape(h.value), "named", len(h.spans) if h.kind != "private key" else -1) for h in hits]
    known = {h.start for h in hits}
    for m in _STRING.finditer(text):
        value = m.group()[1:-1]
        if len(value) >= 6 and m.start() + 1 not in known and not re.search(r"\s", value):
            out.append(Literal(m.start() + 1, value, shape(value), _role_before(text, m.start() + 1), 1))
            known.add(m.start() + 1)
    for m in _RUN.finditer(text):
        if m.start() not in known and (s := shape(m.group())):
            out.append(Literal(m.start(), m.group(), s, _role_before(text, m.start()), 1))
    return out


def _role_before(text: str, at: int) -> str:
    m = _PUBLIC_BEFORE.search(text, text.rfind("\n", 0, at) + 1 if at - text.rfind("\n", 0, at) < 100 else at - 100, at)
    return "public" if m and _role(m[1])[1] else "open"


def masked(value: str) -> str:
    """What stands in place of a value: zeros for digits of a hexadecimal value, which still decode."""
    return "0" * len(value) if re.fullmatch(r"[0-9a-fA-F]{32,}", value) else "REDACTED"
