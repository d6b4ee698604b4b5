"""Problem 6: credentials embedded in source code and configuration, found and redacted."""

from __future__ import annotations

import base64
import json
import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.automaton import automaton

#: Lower-case keywords of the prefilter: a text without any of them holds none of the formats below.
KEYWORDS = tuple(
    "pass pwd _pw .pw -pw secret token api_key apikey api-key api.key access_key accesskey access.key license_key license.key private key cred credential "
    "login authenticate auth_ authoriz bearer basic passwort kennwort mot_de_passe mot.de.passe contrase akia asia xox ghp_ gho_ ghs_ ghu_ github_pat_ glpat- npm_ pypi- "
    "sk_live rk_live sk_test sk- aiza eyj pk-srv -----begin :// sig= signature= signing".split()
) + ('" + "', "' + '", "root /", "admin /", "user /", "postgres /", "deploy /", "guest /", "svc_", "svc-", "root: ", "admin: ")

#: Issuer formats, fixed values of their issuers.
ISSUERS = {
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "slack": r"(?<![A-Za-z0-9])xox[abeprs]-[0-9A-Za-z-]{15,}",
    "github": r"(?<![A-Za-z0-9])(?:gh[opsur]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})",
    "gitlab": r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}",
    "npm": r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "payment": r"(?<![A-Za-z0-9])[srp]k_live_[A-Za-z0-9]{16,}",
    "google": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "service": r"(?<![A-Za-z0-9])pk-srv-[A-Za-z0-9]{20,}",
    "web_token": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
_ISSUER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in ISSUERS.items()))
_URL = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*://([^\s:/@\"'`<>]*):([^\s@/\"'`<>]+)@[\w.\[]")
_SIGNED = re.compile(r"[?&](?:sig|signature|access_token|api_key|token|key)=([A-Za-z0-9%+/_=-]{16,})")
_FLAG = re.compile(r"(?:--(?:password|passwd|pass|pwd|token|secret|api-key)[= ]|(?<=\s)-p(?=\S*\d))([^\s\"'`;|&<>$]{4,})|(?:\s-u|--user)[ =][\w.\-]+:([^\s\"'`]{4,})")
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9+/_=.~-]{12,})")
_COMMENT = re.compile(r"(?:\b(?:login|creds?|credentials?|account|access)\b[^/\n:=]{0,20}[:=]?\s+[\w.\-@]+\s*[/:]\s+|\b(?:password|passwd|pwd|passphrase|secret|token)\s+(?:is|was)\s+)(\S{5,})", re.I)
_KEY_NAME = r"[\w.\-]*(?:pass(?:word|wd|phrase|wort|code)?|pwd|kennwort|mot[_.\-]?de[_.\-]?passe|contrase\w*|(?<![a-z])pw|secret(?:[_.\-]?key)?|(?:api|access|license|signing|private|auth|encryption|account)[_.\-]?key|token|credentials?)"
_ASSIGN = re.compile(
    rf"(?P<key>(?<![\w.\-]){_KEY_NAME})\d*(?P<q>[\"']?)[ \t]*(?P<op>:=|=>|=(?!=)|:|\"?>|\s(?:value)=)[ \t]*(?P<val>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`|[^\s\"'`,;<>(){{}}][^\n\"'`]*)?",
    re.I,
)
_CALL = re.compile(r"\.(?:set_?|with_?|add_?)?(?:password|passwd|secret|token|credentials?|api_?key|login|authenticate|auth)\(\s*(\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`)(?:\s*,\s*(\"[^\"\n]*\"|'[^'\n]*'|`[^`\n]*`))?\s*\)", re.I)
_JOINED = re.compile(r"(\"[A-Za-z0-9+/_=.\-]{6,}\"|'[A-Za-z0-9+/_=.\-]{6,}')((?:\s*(?:\+|\.\.?|\|\|)?\s*(?:\"[A-Za-z0-9+/_=.\-]{6,}\"|'[A-Za-z0-9+/_=.\-]{6,}'))+)")
_BLOCK = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----([\s\S]*?)(?:-----END \1-----|\Z)")
#: A comment that names an account and, after a slash or colon, what lets it in.
_ACCOUNT = re.compile(r"(?:^|[\s(])(?:root|admin(?:istrator)?|sa|svc[_\-]\w+|\w*user|postgres|mysql|oracle|deploy|guest|operator)\s*(?:/|:)\s+(\S{5,})", re.I)
#: Values that stand for another: references, interpolations and stretches of one filler, each as a whole.
_REFERENCE = re.compile(
    r"(?:<.*>|\{\{.*\}\}|\{\w*\}|.*(?:\$\{|\{\{|\$\(|#\{).*|\$[A-Za-z_]\w*|%\(\w+\)s|%\w|%\w+%|(?:env|vault|ssm|secrets?|secretsmanager|file|keyring)[:(/].*|ref\+.*|op://.*|arn:.*"
    r"|(?:process|os|sys|self|this|config|settings|env|environ)(?:\.\w+)+(?:\(.*\)|\[.*\])?|\S*\s.*|[xX]{3,}|(.)\1*)",
    re.S,
)
#: Words a template is made of; a value of nothing but these stands for no credential.
_TEMPLATE = frozenset(
    "a an and api access add any at auth be by change changed changeit changeme default deploy do dummy empty enter example fake false fill field fixme for from get goes "
    "hash here hidden id in input insert is it key label login me missing mock must my name new nil no none not null of on or pass passwd password passphrase placeholder please "
    "private production prompt put pwd redacted removed replace replaced required sample secret set some string tbd text that the this to todo token true type undefined unset update use user "
    "username value vault with you your".split()
)
_FILLER = frozenset("changeme dummy example fake placeholder redacted todo".split())
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def _template(value: str) -> bool:
    words = [w.lower() for w in _WORD.findall(value)]
    count = [w for w in words if w.isdigit()]
    if not words or any(w not in _TEMPLATE for w in words if not w.isdigit()):
        return False
    return not count or bool(_FILLER & set(words)) and all(w in "01234567890" for w in count)


def usable(value: str) -> bool:
    """Whether a value could grant access as it stands: as a whole no reference, template, filler or mask of this module."""
    return len(value) >= 5 and len(set(value)) > 3 and not _REFERENCE.fullmatch(value) and not _template(value) and mask(value) != value


def _secret_word(value: str) -> bool:
    """Whether a bare (unquoted) value or a joined one reads as random: digits or marks among letters, not a plain identifier."""
    kinds = sum(bool(re.search(p, value)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w]"))
    return kinds >= 2 and bool(re.search(r"[\d!#%&*+~^?@$=/]", value))


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def _crc_holds(token: str) -> bool:
    """The last six characters of a token with a checksum are the CRC-32 of the rest behind its prefix, in base 62."""
    body = token.rsplit("_", 1)[-1]
    n = 0
    for c in body[-6:]:
        n = n * 62 + _BASE62.find(c) if c in _BASE62 else -1 << 40
    return len(body) > 6 and n == zlib.crc32(body[:-6].encode())


def _json_holds(part: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4))), dict)
    except ValueError:
        return False


def _der_holds(block: str) -> bool:
    """The body decodes to one DER sequence of just its length, or to the container of an OpenSSH key."""
    body = re.sub(r"-----[^-\n]*-----|\\[nrt]|[\"'] *\+ *[\"']|[\"'\s]|^[\w-]+:.*$", "", block, flags=re.M)
    try:
        der = base64.b64decode(body, validate=True)
    except ValueError:
        return False
    if der[:15] == b"openssh-key-v1\0":
        return True
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    k = der[1] & 0x7F
    return len(der) == 2 + k + int.from_bytes(der[2 : 2 + k], "big")


def proof(value: str, kind: str) -> str:
    """How far a found value bears itself out: ``checksum``, ``structure``, or ``format`` where neither holds or there is
    none. It only adds: a token whose checksum fails is still one that a reader must not see."""
    token = "".join(re.findall(r"[\"']?([^\"']*)[\"']?", re.sub(r"[\"'] *\+ *[\"']", "", value)))
    if token[:3] in ("ghp", "gho", "ghs", "ghu", "ghr") or token[:4] == "npm_":
        return "checksum" if _crc_holds(token) else "format"
    if token[:3] == "eyJ" and token.count(".") == 2:
        return "structure" if _json_holds(token.split(".")[0]) and _json_holds(token.split(".")[1]) else "format"
    if kind == "private_key":
        return "structure" if _der_holds(value) else "format"
    if kind == "header":
        try:
            return "structure" if re.fullmatch(rb"[^\s:]+:\S+", base64.b64decode(value, validate=True)) else "format"
        except ValueError:
            return "format"
    return "format"


def _is_structured(value: str) -> bool:
    """Issuer formats outrank the template rules unless they are an issuer's own example or a mask; a checksum or a
    decoded structure outranks those too."""
    m = _ISSUER.fullmatch(value)
    return bool(m) and (_shown(value) or proof(value, m.lastgroup or "") != "format")


def _shown(value: str) -> bool:
    return len(set(value)) > 6 and not re.search(r"EXAMPLE|x{6,}", value)


def _password_word(key: str, value: str) -> bool:
    """A long word of letters only, behind the name of a password: a passphrase, unless it names itself."""
    return bool(re.search(r"(?i)(?:pass(?:word|wd|phrase|wort|code)?|pwd|kennwort|(?<![a-z])pw)$", key)) and len(value) >= 16 and value.isalpha() and value.islower() and not re.search(r"pass|word|secret|token|field|label|input|example", value)


def _uuid_or_digest(value: str) -> bool:
    return bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|sha\d+[-:][0-9a-fA-F]+|md5[-:].*|data:.*", value))


def _segments(text: str, low: str) -> list[tuple[int, int, set[int]]]:
    """The lines that hold a keyword, each with its keywords; a line that ends in ``+`` goes on with the next one."""
    out: list[tuple[int, int, set[int]]] = []
    end = -1
    for at, i in automaton(KEYWORDS).iter(low):
        if at < end:
            out[-1][2].add(i)
            continue
        start = text.rfind("\n", 0, at) + 1
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        while stop < len(text) and text[start:stop].rstrip()[-1:] == "+":
            more = text.find("\n", stop + 1)
            stop = len(text) if more < 0 else more
        out.append((start, stop, {i}))
        end = stop
    return out


_INDEX = {w: i for i, w in enumerate(KEYWORDS)}
_ids = lambda *words: frozenset(_INDEX[w] for w in words)
_FORMATS = _ids("akia", "asia", "xox", "ghp_", "gho_", "ghs_", "ghu_", "github_pat_", "glpat-", "npm_", "sk_live", "rk_live", "aiza", "eyj", "pk-srv")
_URLS, _BEGIN = _ids("://"), _ids("-----begin")
_SIGS = _ids("sig=", "signature=", "token", "api_key", "api-key", "://")
_FLAGS = _ids("pass", "token", "secret", "pwd", "api-key")
_HEADERS = _ids("bearer", "basic", "token")
_NOTES = _ids("login", "cred", "pass", "pwd", "secret", "token", "authoriz", "authenticate")
_ACCOUNTS = _ids("root /", "admin /", "user /", "postgres /", "deploy /", "guest /", "svc_", "svc-", "root: ", "admin: ")
_IN_COMMENT = re.compile(r"//|#|/\*|^\s*\*|--|<!--|\"\"\"")
_NAMES = _ids("pass", "pwd", "_pw", ".pw", "-pw", "secret", "token", "api_key", "apikey", "api-key", "api.key", "access_key", "accesskey", "access.key", "license_key", "license.key", "credential", "auth_", "passwort", "kennwort", "mot_de_passe", "mot.de.passe", "contrase", "signing")
_JOINS = _ids('" + "', "' + '")


def _kept(value: str) -> bool:
    return usable(value) and not _uuid_or_digest(value)


def _random_like(value: str) -> bool:
    """No run of nine letters is left once lower-case words are taken out: joined literals of ordinary words are none."""
    rest = re.sub(r"[A-Z]?[a-z]{3,}(?![a-z])", "", value)
    return entropy(value) > 3.2 and bool(re.search(r"\d", value)) and bool(re.search(r"[A-Za-z]", value)) and len(rest) >= len(value) // 3


def find(text: str | None, config: bool = False) -> list[tuple[int, int, str]]:
    """Sorted, disjoint (start, end, kind) of the credentials of a text, in characters; [] for null and empty.

    The automaton picks the lines that hold a keyword; only those meet the expressions of their keywords. A key block is
    followed to its end, over all its lines.
    """
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # a character that grows in lower case: keep places aligned
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[tuple[int, int, str]] = []
    for start, stop, words in _segments(text, low):
        line = text[start:stop]
        if line.strip() in ("pass", "pass;"):
            continue
        own: list[tuple[int, int, str]] = []
        if words & _BEGIN:
            for m in _BLOCK.finditer(text, start):
                if m.start() >= stop:
                    break
                body = re.sub(r"[^A-Za-z0-9+/]", "", re.sub(r"\\[nrt]", "", m.group(2)))
                if len(body) >= 32 and mask(body) != body:
                    spans.append((m.start(), m.end(), "private_key"))
        if words & _FORMATS:
            for m in _ISSUER.finditer(line):
                if _is_structured(m.group()):
                    own.append((m.start(), m.end(), m.lastgroup or "issuer"))
        if words & _URLS:
            for m in _URL.finditer(line):
                if usable(m.group(2)) and m.group(2).lower() not in ("password", "pass", "secret"):
                    own.append((*m.span(2), "url_login"))
            if " -u" in line or "--user" in line:
                own += [(*m.span(2), "command") for m in _FLAG.finditer(line) if m.group(2) and usable(m.group(2))]
        if words & _SIGS:
            own += [(*m.span(1), "signed_url") for m in _SIGNED.finditer(line) if usable(m.group(1)) and entropy(m.group(1)) > 3]
        if words & _FLAGS and "-" in line:
            own += [(*m.span(1), "command") for m in _FLAG.finditer(line) if m.group(1) and usable(m.group(1)) and re.search(r"[\dA-Z!#%*+~^?]", m.group(1))]
        if words & _HEADERS:
            own += [(*m.span(1), "header") for m in _HEADER.finditer(line) if usable(m.group(1)) and entropy(m.group(1)) > 2.8 and _secret_word(m.group(1))]
        if words & _NOTES:
            for m in _COMMENT.finditer(line):
                v = m.group(1).rstrip(".,;)*/")
                if _IN_COMMENT.search(line[: m.start() + 1]) and usable(v) and _secret_word(v):
                    own.append((m.start(1), m.start(1) + len(v), "comment"))
            for m in _CALL.finditer(line):
                g = 2 if m.group(2) else 1
                v = m.group(g)[1:-1]
                if usable(v) and _secret_word(v):
                    own.append((m.start(g) + 1, m.end(g) - 1, "call"))
        if words & _ACCOUNTS:
            for m in _ACCOUNT.finditer(line):
                v = m.group(1).rstrip(".,;)*/")
                if _IN_COMMENT.search(line[: m.start() + 1]) and usable(v) and _secret_word(v):
                    own.append((m.start(1), m.start(1) + len(v), "comment"))
        if words & _NAMES:
            for m in _ASSIGN.finditer(line):
                raw = m.group("val")
                if not raw or not config and raw[0] not in "\"'`":
                    continue  # in a program an unquoted value is a name
                quoted = raw[0] in "\"'`"
                at = m.start("val") + quoted
                value = raw[1:-1] if quoted else re.sub(r"\s+#.*$", "", raw.split("</")[0]).rstrip(" \t\r,")
                if _is_structured(value) or _kept(value) and (_secret_word(value) or entropy(value) > 3.5 and len(value) >= 20 or quoted and _password_word(m.group("key"), value)):
                    own.append((at, at + len(value), "assigned"))
        if words & _JOINS:
            for m in _JOINED.finditer(line):
                value = "".join(re.findall(r"[\"']([^\"']*)[\"']", m.group()))
                if _is_structured(value) or len(value) >= 20 and _kept(value) and _random_like(value):
                    own.append((m.start() + 1, m.end() - 1, "joined"))
        spans += [(s + start, e + start, k) for s, e, k in own]
    spans.sort(key=lambda s: (s[0], -s[1]))
    out: list[tuple[int, int, str]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
        elif s[1] > out[-1][1] and out[-1][2] != "private_key":
            out[-1] = (out[-1][0], s[1], out[-1][2])
    return out


#: Marks a mask may use, the safest first: none of them ends a string or starts a reference.
_SAFE = "_-.+=~^!@*:/,;?|"


@lru_cache(maxsize=4096)
def _letter(c: str) -> str:
    """The mask of a letter, digit or mark of any script: of the same kind and width, from the same block of 128."""
    if c.isascii():
        return "x" if c.islower() else "X" if c.isupper() else "0" if c.isdigit() else ""
    if unicodedata.category(c) == "Nd":
        return chr(ord(c) - unicodedata.decimal(c))
    if c.isspace():
        return c
    kind, block = unicodedata.category(c), ord(c) & ~0x7F
    return next(chr(k) for k in range(block, block + 128) if unicodedata.category(chr(k)) == kind)


def mask(value: str) -> str:
    """A placeholder of the same length and alphabet: letters by x or X of their case (in other scripts the first letter
    of that kind), digits by 0, marks all by one mark the value holds (``_`` where none of those is safe)."""
    one = next((c for c in _SAFE if c in value), "_")
    return "".join(c if c.isspace() else _letter(c) or one for c in value)


_WORDS = re.compile(r"-----(?:BEGIN|END)[A-Z0-9 ]*-----|\\[nrt\"'\\]|[\"'] *\+ *[\"']|[\"']\s*[\"']")


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span masked, every character of it (see mask), so that length and lines stay; escapes, the marks
    of a key block and the quotes of joined strings stay too, as they belong to the code and not to the value."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e, _ in spans:
        out.append(text[at:s])
        part, p = text[s:e], 0
        for m in _WORDS.finditer(part):
            out.append(mask(part[p : m.start()]))
            out.append(m.group())
            p = m.end()
        out.append(mask(part[p:]))
        at = e
    out.append(text[at:])
    return "".join(out)


def scan(files: DataFrame, *, key: str = "file_id", text: bool = False) -> DataFrame:
    """(file_id, line_no, kind, proof), one row a credential, lines counted from 1, proof as of proof(); with text=True
    instead (file_id, content), one row a file, its credentials masked. Null and empty contents hold none and stay as they are. No shuffle."""
    slim = files.select(F.col(key).alias("k"), F.col("content"), F.col("language").isNull().alias("config"))
    kind = files.schema[key].dataType.simpleString()

    def lines(batches):
        for batch in batches:
            ks, no, kinds, proofs = [], [], [], []
            for k, t, c in zip(*(x.to_pylist() for x in batch.columns)):
                last = line = 0
                for s, e, what in find(t, bool(c)):
                    line += t.count("\n", last, s)
                    last = s
                    ks.append(k), no.append(line + 1), kinds.append(what), proofs.append(proof(t[s:e], what))
            yield pa.RecordBatch.from_arrays([pa.array(ks, batch.schema.field(0).type), pa.array(no, pa.int32()), pa.array(kinds, pa.string()), pa.array(proofs, pa.string())], names=["k", "line_no", "kind", "proof"])

    def masked(batches):
        for batch in batches:
            texts = [redact(t, find(t, bool(c))) for t, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "content"])

    out = slim.mapInArrow(masked, f"k {kind}, content string") if text else slim.mapInArrow(lines, f"k {kind}, line_no int, kind string, proof string")
    return out.withColumnRenamed("k", key)
