"""Text expressions: tokens, names, redaction, domains. All are built-in functions of the JVM."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The words that keyword search leaves out.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such "
    "that the their then there these they this to was will with"
).split()


def _decomposed() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their ASCII bases, and full-width letters and digits and their ASCII forms."""
    marked = [(chr(i), unicodedata.normalize("NFD", chr(i))[0]) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1 and unicodedata.normalize("NFD", chr(i))[0].isascii() and chr(i).islower()]
    wide = [(chr(i), chr(i - 0xFEE0)) for i in range(0xFF10, 0xFF5B) if chr(i - 0xFEE0).isalnum() and not chr(i).isupper()]
    other = [("²", "2"), ("³", "3"), ("¹", "1"), ("ª", "a"), ("º", "o")]
    return "".join(a for a, _ in marked + wide + other), "".join(b for _, b in marked + wide + other)


MARKED, BASES = _decomposed()


def bm25_tokens(text: Column) -> Column:
    """Terms of keyword search: lower case, compatibility forms resolved, split at what is no ASCII word character, "_"
    or "-"; a mark splits the word after its letter; terms of one character and stop words are dropped. Latin text."""
    x = F.regexp_replace(F.lower(text), "([À-ɏ])", "$1 ")
    x = F.replace(F.replace(x, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    x = F.regexp_replace(F.translate(x, MARKED, BASES), r"[^\w\s-]", " ")
    return F.filter(F.split(x, r"[\s_-]+"), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def query_terms(text: str) -> list[str]:
    """The same terms of a query, on the driver."""
    x = re.sub("([À-ɏ])", r"\1 ", text.lower()).replace("ﬁ", "fi").replace("ﬂ", "fl")
    x = re.sub(r"[^\w\s-]", " ", x.translate(str.maketrans(MARKED, BASES)), flags=re.ASCII)
    return [t for t in re.split(r"[\s_-]+", x) if len(t) > 1 and t not in STOP_WORDS]


def embed_tokens(text: Column) -> Column:
    """Tokens of the hash embedding: no stop words, no least length."""
    return F.filter(F.split(F.lower(text), r"""[\s,.;:!?_/\-\(\)\[\]"']+"""), lambda t: t != "")


#: Combining marks that name normalisation drops, and letters with marks in either case with their bases.
_MARKS = "[̀-ͯ]"
_NAME_MARKED = "".join(chr(i) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(i))) > 1 and unicodedata.normalize("NFD", chr(i))[0].isascii())
_NAME_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _NAME_MARKED)


def normalize_name(name: Column) -> Column:
    """Without marks, spaces collapsed, without what is no letter or digit at either end, in lower case."""
    x = F.regexp_replace(F.translate(name, _NAME_MARKED, _NAME_BASES), _MARKS, "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def canonical_id(kind: Column, name: Column) -> Column:
    """``ent_<type>_<slug>``, the slug of a name without letters or digits being "unnamed"."""
    slug = F.regexp_replace(F.regexp_replace(normalize_name(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("ent_"), F.lower(kind), F.lit("_"), F.when(slug == "", "unnamed").otherwise(slug))


#: Legal forms that company names are compared without.
COMPANY_SUFFIXES = "corp corporation inc incorporated llc ltd limited gmbh co company".split()


def strip_company(name: Column) -> Column:
    return normalize_name(F.regexp_replace(name, rf"(?i)\b({'|'.join(COMPANY_SUFFIXES)})\b", " "))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.?!;])\s+"), lambda s: F.trim(s) != "")


MASK = "[REDACTED]"
#: What is masked in a text; in the last one the name of the parameter stays.
SECRET_PATTERNS = (
    r"(?i)bearer\s+[a-zA-Z0-9._~+/-]+=*",
    r"(?i)basic\s+[a-zA-Z0-9+/=]+",
    r"sk-[a-zA-Z0-9]{20,}",
    r"ghp_[a-zA-Z0-9]{20,}",
    r"ey[A-Za-z0-9_-]{10,}\.ey[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+",
)
SECRET_PARAMETER = r"(?i)([?&](?:api_key|token|access_token|secret|password|auth)=)[^&]+"
#: Keys whose values are masked whatever they are.
SENSITIVE_KEYS = (
    "password passwd passphrase pin otp secret secret_key token api_key apikey access_token refresh_token private_key "
    "authorization proxy-authorization auth cookie cookies set-cookie credentials cvv cvc ssn card_number credit_card"
).split()


def redact(text: Column) -> Column:
    for pattern in SECRET_PATTERNS:
        text = F.regexp_replace(text, pattern, MASK)
    return F.regexp_replace(text, SECRET_PARAMETER, "$1" + MASK)


def _masked(x):
    """A parsed JSON value with the values of sensitive keys masked, and of a field's value where the field is a password."""
    if isinstance(x, dict):
        secret = "password" in (x.get("type"), x.get("fieldType"), x.get("inputType")) or x.get("isSensitive") is True
        hide = lambda k: k.lower() in SENSITIVE_KEYS or secret and k.lower() in ("value", "text", "input")
        return {k: MASK if hide(k) else _masked(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_masked(v) for v in x]
    return _redacted(x) if isinstance(x, str) else x


def _redacted(text: str) -> str:
    for pattern in SECRET_PATTERNS:
        text = re.sub(pattern, MASK, text)
    return re.sub(SECRET_PARAMETER, r"\1" + MASK, text)


def _redacted_json(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(_masked(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return _redacted(text)


@F.pandas_udf(StringType())
def redact_json(s: pd.Series) -> pd.Series:
    """JSON with secrets masked at any depth, as canonical JSON; what isn't JSON is redacted as text. Any shape of object
    may come, so this is Python over Arrow batches."""
    return s.map(_redacted_json)


#: Words that a capability's name or description may not have.
BANNED_WORDS = "eval shell_exec arbitrary_code system_exec remote_shell command_execution".split()


def is_banned_capability(text: Column) -> Column:
    return text.rlike(rf"(?i)\b(?:{'|'.join(BANNED_WORDS)})\b")


#: Phrases of injected instructions; only the first of each is replaced.
INJECTIONS = (
    r"ignore (?:all|previous) instructions",
    r"you are now in developer mode",
    r"disregard policy",
    r"send (?:credentials|keys|secrets)",
    r"exfiltrate",
)
FILTERED = "[UNTRUSTED INSTRUCTION FILTERED]"


def sanitize(text: Column) -> Column:
    for pattern in INJECTIONS:
        text = F.regexp_replace(text, rf"(?is)^(.*?)(?:{pattern})", "$1" + FILTERED)
    return text


def has_injection(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(INJECTIONS))


#: Parts of a payload that may not leave.
BANNED_PARTS = "private_key password cookie session_secret auth_token pkcs8".split()


def may_leak(payload: Column) -> Column:
    low = F.lower(payload)
    found = F.lit(False)
    for part in BANNED_PARTS:
        found = found | F.contains(low, F.lit(part))
    return found


#: Fixed value: the classification of what may not leave at all.
SECRET = "SECRET"


def transfer_problem(payload: Column, classification: Column) -> Column:
    """Why a payload may not leave (null: it may): it is classified as secret, or has a part that may not leave."""
    return F.when(F.upper(classification) == SECRET, "secret").when(may_leak(payload), "leak")


def domain_of(target: Column) -> Column:
    """The host of an http(s) address in lower case; a bare host with a point, or localhost, without its port; else null."""
    bare = ~F.contains(target, F.lit("/")) & ~F.contains(target, F.lit(" ")) & (F.contains(target, F.lit(".")) | (target == "localhost"))
    host = F.lower(F.regexp_extract(target, r"^https?://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(target.rlike("^https?://"), F.nullif(host, F.lit(""))).when(bare, F.lower(F.split_part(target, F.lit(":"), F.lit(1))))


def domain_matches(domain: Column, pattern: str) -> Column:
    """``*``, the domain itself, or ``*.suffix`` at a point, its apex included."""
    pattern = pattern.lower()
    if pattern == "*":
        return domain.isNotNull()
    if pattern.startswith("*."):
        return (domain == pattern[2:]) | domain.endswith(pattern[1:])
    return domain == pattern


def target_matches(target: Column, pattern: str) -> Column:
    """``*``, the target itself, ``*.suffix`` of its domain, ``prefix:*`` or ``prefix*``."""
    if pattern == "*":
        return F.lit(True)
    if pattern.startswith("*."):
        return (target == pattern) | domain_matches(F.coalesce(domain_of(target), F.lower(target)), pattern)
    if pattern.endswith(":*"):
        return (target == pattern[:-2]) | target.startswith(pattern[:-1])
    if pattern.endswith("*"):
        return target.startswith(pattern[:-1])
    return target == pattern


def snippet(text: Column, length: int = 150) -> Column:
    return F.replace(F.substring(text, 1, length), F.lit("\n"), F.lit(" "))


def humanize(predicate: Column) -> Column:
    return F.replace(F.lower(predicate), F.lit("_"), F.lit(" "))


def fingerprint(public_key_base64: Column) -> Column:
    return F.concat(F.lit("agent_"), F.substring(F.sha2(F.unbase64(public_key_base64), 256), 1, 24))
