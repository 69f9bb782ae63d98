"""Credentials in source code and configuration: finding them and blanking them.

Spark joins and partitions the current contents; from their lines that may hold a literal of
interest candidates are taken with their surroundings; a character Markov model of the whole
corpus, the identifier beside a candidate and its path give features; patterns label a part of
the candidates weakly; logistic regression learns from all of these, by sums that Spark adds up, and
the score at which labelled candidates come out right, each by a model that has not seen it, decides for all.

A value under a name that says nothing is judged by its looks alone: a second regression sees how
surprising, long and mixed a value is, but neither name, prefix nor place, from which its labels
come. So what it has learnt of credentials with known names holds for those without.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import summed
from ..session import written

#: Parts of the labelled candidates (by hash), each of which is scored by a model of the others to set the threshold.
FOLDS = 5
#: The share of labelled candidates above the threshold that must be credentials.
PRECISION = 0.99

#: Words (in lower case) and marks of lines that may hold a candidate. They are found by plain
#: substring search over a whole text, and only their lines, and those that HOT_SHAPES find, are
#: looked at. Together they hold every line in which ``candidates_of_line`` finds anything; the last
#: marks are the letters that a pattern without case takes for i, k and s.
HOT_WORDS = ["pass", "pw", "secret", "token", "key", "auth", "cred", "bearer", "cookie", "session", "signature", "login", "log-in", "jwt", "shared_access", "sharedaccess"]
HOT_MARKS = ["AKIA", "ASIA", "AGPA", "AROA", "ABIA", "ACCA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "gldt-", "glrt-", "glcbt-", "glptt-", "glft-", "sk-", "sk_", "rk_", "xox", "xapp-", "AIza", "ya29.", "npm_", "pypi-", "hf_", "dop_v1_", "SG.", "eyJ", "-----BEGIN", "İ", "ı", "ſ", "K"]

#: Parts of a name that say that it may hold a secret.
_SECRET_WORD = re.compile(r"(?i)pass|pwd|pw|secret|token|key|auth|cred")

# The published shapes of credentials of common services.
SERVICE_TOKENS = (
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AROA|ABIA|ACCA)[A-Z2-7][A-Z0-9]{15}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{30,}",
    r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{22,}",
    r"(?<![A-Za-z0-9])gl(?:pat|dt|rt|cbt|ptt|ft)-[A-Za-z0-9_\-]{20,}",
    r"(?<![A-Za-z0-9_\-])sk-(?:[a-z]{2,8}-)*[A-Za-z0-9_]{16,}[A-Za-z0-9_\-]*",
    r"(?<![A-Za-z0-9])[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
    r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9\-]{10,}",
    r"(?<![A-Za-z0-9])xapp-\d-[A-Za-z0-9\-]{10,}",
    r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_\-]{35}",
    r"(?<![A-Za-z0-9])ya29\.[A-Za-z0-9_\-]{20,}",
    r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{30,}",
    r"(?<![A-Za-z0-9])pypi-[A-Za-z0-9_\-]{30,}",
    r"(?<![A-Za-z0-9])hf_[A-Za-z0-9]{30,}",
    r"(?<![A-Za-z0-9])dop_v1_[a-f0-9]{32,}",
    r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}",
    r"(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]{8,}={0,2}\.[A-Za-z0-9_\-]{8,}={0,2}\.[A-Za-z0-9_\-]{8,}",
)

_SERVICE = re.compile("|".join(SERVICE_TOKENS))
#: A literal in parts that are added up.
_PARTS = re.compile(r"(?P<q>[\"'`])(?P<first>[\w.\-]+)(?P=q)(?:\s*\+\s*(?P=q)[\w.\-]+(?P=q))+")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_USERINFO = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://([^\s/:@\"'`]*):([^\s/@\"'`]+)@(?=[\w\[.\-])")
_HEADER = re.compile(r"(?i)\b(authorization|proxy-authorization)\b[\"']?\s*[:=,]\s*[\"']?\s*(bearer|basic|token|digest|apikey)\s+([^\s\"'`,;)]+)")
_NAMED = re.compile(
    r"(?P<name>[A-Za-z_][A-Za-z0-9_.\-]{0,80})[\"'`\]]{0,2}"
    r"(?P<sep>\s*(?::\s*&?'?[A-Za-z_][\w<>&' ]{0,24}\s=|\bstring\s*=|\[\]\s*=|:=|=>|==?|(?<!:):(?!:)|\|)\s*|(?<=[\"'`])\s*,\s*(?=[\"'`])|\s+(?=\"))"
    r"(?:[rbuf]{0,2}(?P<q>[\"'`]))?(?P<val>(?(q)(?:(?!(?P=q))[^\\]|\\.){4,}|[^\s\"'`,;(){}\[\]<>]{4,}[^\s\"'`;]*))"
)
_PART = re.compile(r"(?i)(?:^|[;&?\s,])(?P<name>[A-Za-z][\w .\-]{0,30}?)=(?P<val>[^;&\s\"'`]{4,})")
_SAID = re.compile(r"(?i)\b(?P<name>password|passwd|passphrase|passcode|pwd|pw|secret|api key|access key|credentials?)(?:\s+(?:is|are|was|to|of|for now))?(?:\s*[:=]\s*|\s+)[`\"']?(?P<val>(?![^\s=]*=)[^\s`\"',;(){}:=.][^\s`\"',;(){}]{5,})")
_LOGIN = re.compile(r"(?i)\blog-?in\b.{0,60}?\bis\s+[^\s/]+\s*/\s*(?P<val>[^\s`\"',;]{6,})")
_USER_FLAG = re.compile(r"(?:^|\s)(?:-u|--user|--proxy-user)[\s=]+[\"']?[^\s:\"'$]+:([^\s\"'$]+)")
_STRONG = re.compile(r"(?i)pass(?:word|wd|phrase|code|_|\b|$)|pwd|(?:^|[_.\- ])pw(?:$|[_.\-\d ])|(?-i:Pw(?:$|[A-Z\d]))|bind_?pw|secret|credential|private_?key|signing_?key")
_KEYED = re.compile(r"(?i)api_?key|access_?key|account_?key|shared_?access|(?:^|_)key(?:_id)?$|_key|(?-i:[a-z]Key)|token|auth|bearer|jwt|cookie|session_?id|signature|(?:^|_)sas(?:_|$)|(?:^|_)sig$")
# Words that say that a name does not hold the credential itself.
_NOT_WORDS = r"ref|name|path|file|type|url|uri|len|length|count|max|min|num|limit|ttl|expir\w*|regex|pattern|prefix|suffix|hash|digest|etag|sha\d*|md5|checksum|integrity|fingerprint|field|env|var|policy|header|example|sample|dummy|placeholder|store|location|endpoint|provider|scheme|class|enabled|required|hint|label|column|index|version|icon|verify_with|certificate|cert"
_NOT_NAME = re.compile(rf"(?i)public|(?:^|_)(?:{_NOT_WORDS})(?:_|$|\d)|tokens(?:_|$)|tokeni[sz]|tokenless|keyboard|keyword|monkey|author(?!iz)")
#: Shapes of lines (in lower case) that may hold a candidate without any of HOT_WORDS or HOT_MARKS:
#: a value of 20 characters behind what parts names from values, a short name, a user's flag, and a word of _NOT_NAME before what
#: may part a name from its value.
HOT_SHAPES = (
    re.compile(r"[=>:|]\s*(?:[^\s\"'`,;(){}\[\]<>]{4}[^\s\"'`;]{16}|[rbuf]{0,2}[\"'`]\S{20})|[\"'`]\s*,\s*[rbuf]{0,2}[\"'`]\S{20}|\s[\"]\S{20}"),
    re.compile(r"(?<![a-z])(?:sas|sig)(?![a-z])"),
    re.compile(r"(?<!\S)-(?:u|-user|-proxy-user)[\s=]"),
    re.compile(rf"(?:(?<![a-z])(?:{_NOT_WORDS})(?![a-z])|public|(?<![a-z])expir)[a-z0-9_.\-]*[\"'`\]]{{0,2}}(?:\s*(?:[:=|]|string\s*=|\[\]\s*=)|(?<=[\"'`])\s*,|\s+\")"),
)
_PLACEHOLDER = re.compile(
    r"(?i)^(?:(?:replace|change|insert|enter|your|my|put|add|set|fill|example|sample|dummy|fake|test|todo|tbd|fixme|none|null|nil|true|false|undefined|redacted|masked|hidden|removed|secret|password|token|placeholder|n/?a|default)(?:[_\- .]?(?:me|this|it|in|here|with|api|key|token|password|passwd|secret|value|your|goes|real|change|later|placeholder))*|x{3,}|\*{3,}|\.{3,}|-+|#+|_+|<.*>|\[.*\]|\{\{.*\}\}|\$\{.*\}|\$\(.*\)|\$\w+|%\(.*\)s|%\w+%|@\w+@|\{\w*\}|#\{.*\})$"
)
_ONE_CHAR = re.compile(r"(?i)^(?:[a-z]{1,8}[_\-]){0,3}(.)\1{5,}$|(.)\2{9,}")
_REFERENCE = re.compile(
    r"getenv|environ|process\.env|env!|System\.|\bsecrets?\.|\bvault|\$\{|\$\(|\{\{|%\(|<[A-Za-z _\-]+>|^/?[a-z0-9_.\-]+(?:/[a-z0-9_.\-]+)+$|^(?:https?|file|arn|ssm|kms|op|gs|s3):|^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+$|\(\)?$|^[a-z_]+(?:\.[a-z_]+)+\(?$"
)
_REGEX_LIKE = re.compile(r"\[[^\]]*-[^\]]*\]|\\[dwsb]|\{\d+(?:,\d*)?\}|\(\?:|\.\*")
_UUID = re.compile(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
_HEX = re.compile(r"(?i)^[0-9a-f]{16,}$")
_DIGEST = re.compile(r"(?i)(?:^|=)(?:sha\d+|md5)[-:]|^data:|^ssh-|^ecdsa-|-----BEGIN (?:[A-Z]+ )?(?:PUBLIC KEY|CERTIFICATE)|AAAA[BCE]3Nza")
_TEST_PATH = re.compile(r"(?i)(?:^|/)(?:tests?|fixtures?|examples?|samples?|docs?)(?:/|$)")
# words, also run together with capitals, and numbers; letters without such order are no words
_WORD = r"(?:[A-Z]?[^\W\d_A-Z]{2,}(?:[A-Z][^\W\d_A-Z]{2,})*|[^\W\d_]|[A-Z]{2,14})"
_PLAIN = re.compile(rf"{_WORD}(?:[ _\-]+{_WORD})*[.:!?]*|[\d.,:]+")
#: Parts of one kind of letters or of digits, joined by marks, as in host names, versions and identifiers;
#: and what has marks that keys do not have.
_PART_OF = r"(?:[a-z]+|[A-Z]+|[A-Z][a-z]+|[0-9]+(?:T[0-9]+)?[A-Z]?|[a-z]+[0-9]{1,3}|[a-z]*(?:[A-Z][a-z]{2,})+[0-9]{0,3})"
_PARTED = re.compile(rf"[._/:@+\-]*{_PART_OF}(?:[._/:@+\-]+{_PART_OF})*[._/:@+\-]*|.*[^A-Za-z0-9+/_.~=\-].*|.*=[^=].*")
#: A named entry whose value is a field of its own on the next line.
_ENTRY = re.compile(r"(?i)\bname[\"']?\s*[:=]\s*[\"']?([\w.\-]+)[\"']?,?\s*$")
_VALUE = re.compile(r"(?i)^(\s*-?\s*[\"']?)value(?=[\"']?\s*[:=])")
_COMMENT = re.compile(r"^\s*(?:#(?!define|include)|//|--|/\*|\*|;|\"\"\")")
#: Languages in which a literal stands in quotes.
_CODE = {"py", "pyi", "rs", "go", "js", "java", "c"}
_CONFIG = {"conf", "ini", "toml", "yaml", "yml", "json", "env", "properties", "sh", "txt", "log"}

FEATURES = ["one", "strong_name", "key_name", "other_name", "service", "userinfo", "pem", "header", "placeholder", "reference", "uuid_or_digest", "hex", "surprise", "length", "classes", "digits", "plain_word", "test_path", "config", "spaces", "strong_literal", "key_literal", "other_literal", "mixed", "symbols", "separated"]
#: The features of a value's own looks; the labels that the regression over them learns from do not come from these.
LOOKS = ["one", "surprise", "length", "classes", "digits", "hex", "mixed", "symbols", "separated"]
#: The regressions by their features: over all, and over looks alone.
REGRESSIONS = [FEATURES, LOOKS]
#: Characters from which on a value under a name that says nothing is judged.
UNNAMED = 20

_ALPHABET = 97  # printable ASCII, and one place for all else


def character_counts(docs: DataFrame, text: str = "content") -> DataFrame:
    """(first, second, n): neighbouring characters of all texts by their places in the alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_ALPHABET * _ALPHABET, dtype=np.int64)
        for batch in batches:
            points = np.frombuffer("\n".join(t for t in batch.column(0).to_pylist() if t).encode("latin-1", "replace"), dtype=np.uint8)
            if len(points) > 1:
                at = np.where((points >= 32) & (points < 127), points - 31, 0).astype(np.int32)
                total += np.bincount(at[:-1] * _ALPHABET + at[1:], minlength=_ALPHABET * _ALPHABET)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((some // _ALPHABET).astype(np.int32)), pa.array((some % _ALPHABET).astype(np.int32)), pa.array(total[some])], names=["first", "second", "n"])

    return docs.select(text).mapInArrow(count, "first int, second int, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))


def surprises(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """-ln P(second | first), with a little added to every count."""
    table = np.full((_ALPHABET, _ALPHABET), 0.5)
    for a, b, n in counts:
        table[a, b] += n
    return -np.log(table / table.sum(axis=1, keepdims=True))


def _word_before(line: str, end: int) -> int:
    """Where the run of word characters, dots and hyphens that ends at ``end`` begins."""
    at = end
    while at and (line[at - 1].isalnum() or line[at - 1] in "_.-"):
        at -= 1
    return at


def name_before(line: str, start: int) -> str:
    """The identifier that a value at ``start`` is set beside: behind it stand marks, and perhaps a type and ``=``."""
    end = start
    while end and not (line[end - 1].isalnum() or line[end - 1] == "_"):
        end -= 1
    begin = _word_before(line, end)
    # a type such as "string" between the name and an equals sign
    if "=" in line[end:start] and line[begin:end].islower() and line[begin:end].isalpha():
        further = begin
        while further and line[further - 1] in " \t&:*":
            further -= 1
        if further < begin and further and (line[further - 1].isalnum() or line[further - 1] == "_"):
            end, begin = further, _word_before(line, further)
    name = line[begin:end].lstrip("0123456789.-")
    return name


def open_value(line: str) -> str:
    """The end of a line that names a secret whose value stands on the next line, from the name on; else empty."""
    text = line.rstrip()
    end = len(text)

    def back(*marks: str) -> bool:
        nonlocal end
        for mark in marks:
            if text.endswith(mark, 0, end):
                end -= len(mark)
                return True
        return False

    def spaces() -> None:
        nonlocal end
        while end and text[end - 1].isspace():
            end -= 1

    back("(")
    spaces()
    if back("=>", ":=", "=", ":"):
        spaces()
        back('"', "'")
        begin = _word_before(text, end)
        return text[begin:] if _SECRET_WORD.search(text, begin, end) else ""
    # an entry whose own name is the value of a field called name
    end = len(text)
    back(",")
    back('"', "'")
    stop, begin = end, _word_before(text, end)
    if not _SECRET_WORD.search(text, begin, stop):
        return ""
    end = begin
    back('"', "'")
    spaces()
    if not back("=", ":"):
        return ""
    spaces()
    back('"', "'")
    field = _word_before(text, end)
    return text[field:] if re.search(r"(?i)(?:^|[.\-])name$", text[field:end]) else ""


def candidates_of_line(line: str) -> list[tuple[int, int, str, str]]:
    """(start, end, name, how) of each literal of a line that may be a credential; no two overlap."""
    found: list[tuple[int, int, str, str]] = []

    def add(start: int, end: int, name: str, how: str) -> None:
        if all(end <= s or start >= e for s, e, _, _ in found):
            found.append((start, end, name, how))

    for m in _PEM.finditer(line):
        add(m.start(), m.end(), "", "pem")
    for m in _SERVICE.finditer(line):
        add(m.start(), m.end(), name_before(line, m.start()), "service")
    for m in _PARTS.finditer(line) if "+" in line else ():
        # the first part has the whole mark, so that its line is hot
        if m.group("first").startswith(tuple(HOT_MARKS)) and _SERVICE.fullmatch(re.sub(r"[\"'`\s+]", "", m.group())):
            add(m.start("first"), m.end("first"), name_before(line, m.start("first")), "service")
    for m in _USERINFO.finditer(line):
        add(m.start(2), m.end(2), m.group(1), "userinfo")
    for m in _HEADER.finditer(line):
        add(m.start(3), m.end(3), m.group(1), "header")
    for m in _USER_FLAG.finditer(line):
        add(m.start(1), m.end(1), "password", "userinfo")
    at = 0
    while m := _NAMED.search(line, at):
        name, start, end = m.group("name"), m.start("val"), m.end("val")
        at = start  # what is no candidate itself may hold one: a header in quotes, a pair behind a name
        for p in _PART.finditer(m.group("val")):
            if _STRONG.search(p.group("name")) or _KEYED.search(p.group("name")):
                add(start + p.start("val"), start + p.end("val"), p.group("name"), "named")
                at = start + p.end("val")
        if _STRONG.search(name) or _KEYED.search(name) or _NOT_NAME.search(name):
            add(start, end, name, "named")
            at = max(at, end)
        elif end - start >= 20 and not re.search(r"\s", m.group("val")):
            add(start, end, name, "other")
            at = max(at, end)
    for m in _LOGIN.finditer(line):
        add(m.start("val"), m.end("val"), "login", "said")
    for m in _SAID.finditer(line):
        add(m.start("val"), m.end("val"), m.group("name"), "said")
    return found


def features_of(line: str, start: int, end: int, name: str, how: str, path: str, extension: str, surprise: np.ndarray) -> list[float]:
    """The features of a candidate, in the order of FEATURES."""
    value = line[start:end]
    points = np.frombuffer(value.encode("latin-1", "replace"), dtype=np.uint8)
    at = np.where((points >= 32) & (points < 127), points - 31, 0)
    mean = float(surprise[at[:-1], at[1:]].mean()) if len(at) > 1 else 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9\s]"))
    flat = re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).replace("-", "_").replace(".", "_").replace(" ", "_")
    plain = bool(_PLAIN.fullmatch(value))
    # a bare word in code is an expression, not a literal
    bare = how in ("named", "other") and extension in _CODE and line[start - 1 : start] not in ("'", '"', "`", "=") and not _COMMENT.search(line)
    strong = bool(_STRONG.search(name)) or how == "said"
    keyed = bool(_KEYED.search(flat) or _KEYED.search(name))
    other = bool(_NOT_NAME.search(flat))
    placeholder = bool(_PLACEHOLDER.search(value) or _ONE_CHAR.search(value))
    reference = bare or bool(_REFERENCE.search(value) or _REGEX_LIKE.search(value)) and how not in ("service", "userinfo", "pem")
    digest = bool(_UUID.search(value) or _DIGEST.search(value))
    spaces = bool(re.search(r"\s", value)) and how != "pem"
    literal = not (placeholder or reference or digest or plain or spaces or other) and classes >= 2
    hexa = bool(_HEX.search(value))
    return [
        1.0,
        float(strong),
        float(keyed),
        float(other),
        float(how == "service"),
        float(how == "userinfo"),
        float(how == "pem"),
        float(how == "header"),
        float(placeholder),
        float(reference),
        float(digest),
        float(hexa),
        mean,
        math.log(len(value)),
        float(classes),
        sum(c.isdigit() for c in value) / len(value),
        float(plain),
        float(bool(_TEST_PATH.search(path or ""))),
        float((extension or "") in _CONFIG),
        float(spaces),
        float(strong and literal),
        float(keyed and not strong and literal and len(value) >= 16 and (classes >= 3 or hexa)),
        float(not strong and not keyed and literal),
        float(all(re.search(p, value) for p in ("[a-z]", "[A-Z]", "[0-9]"))),
        sum(not c.isalnum() for c in value) / len(value),
        # words, numbers and names of things are cut into parts; keys are not
        float(bool(_PARTED.fullmatch(value))),
    ]


def weak_label(x: list[float], how: str) -> int | None:
    """1 and 0 where patterns are sure enough, else None."""
    f = dict(zip(FEATURES, x, strict=True))
    if f["placeholder"] or f["reference"] or f["uuid_or_digest"]:
        return 0
    if f["service"] or f["pem"] or f["userinfo"] or f["header"]:
        return 1
    if f["other_name"] or f["spaces"] or f["plain_word"]:
        return 0
    if how == "other":
        # nothing about it says no: its looks decide
        return None if f["other_literal"] and f["digits"] and not (f["hex"] or f["separated"]) and f["length"] >= math.log(UNNAMED) else 0
    if f["key_literal"] or f["strong_literal"] and f["length"] >= math.log(8) and f["digits"]:
        return 1
    return None


def hot_lines(text: str) -> list[tuple[int, str, str]]:
    """(number, line, before) of the lines that may hold a candidate; ``before`` is the end of the line
    above where that leaves its value open, else empty."""
    low = text.lower()
    starts: set[int] = set()
    if len(low) != len(text):  # a letter whose lower case is longer: places would not agree
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    for where, words in ((low, HOT_WORDS), (text, HOT_MARKS), (text, ["://"])):
        for word in words:
            at = where.find(word)
            while at >= 0:
                starts.add(text.rfind("\n", 0, at) + 1)
                at = text.find("\n", at)  # one hit a line is enough
                at = where.find(word, at) if at >= 0 else -1
    for shape in HOT_SHAPES:
        hit = shape.search(low)
        while hit:
            starts.add(text.rfind("\n", 0, hit.start()) + 1)
            at = text.find("\n", hit.start())
            hit = shape.search(low, at) if at >= 0 else None
    found: dict[int, tuple[str, str]] = {}
    number, last = 1, 0
    for start in sorted(starts):
        number += text.count("\n", last, start)
        last = start
        end = text.find("\n", start)
        line = text[start : end if end >= 0 else len(text)]
        found[number] = (line, found[number][1] if number in found else "")
        if end >= 0 and (tail := open_value(line)):
            after = text.find("\n", end + 1)
            found[number + 1] = (text[end + 1 : after if after >= 0 else len(text)], tail)
    return [(n, line, before) for n, (line, before) in sorted(found.items())]


def live_paths(files: DataFrame) -> DataFrame:
    """(file_id, relative_path, extension): the paths of files that are not deleted, whether or not they have a current content."""
    live = files.where(~F.coalesce("deleted", F.lit(False)) & F.col("id").isNotNull() & F.col("relative_path").isNotNull())
    return live.groupBy(F.col("id").alias("file_id"), "relative_path").agg(F.min(F.lower("extension")).alias("extension"))


def line_candidates(current: DataFrame, surprise: np.ndarray, files: DataFrame) -> DataFrame:
    """(file_id, line_no, start, end, x, weak, path): candidates with features; line 0 is a relative path, which ``path`` has there."""
    shared = current.sparkSession.sparkContext.broadcast(surprise)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, path, extension, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                for no, line, before in [(0, path, "")] if content is None else hot_lines(content):
                    if (entry := _ENTRY.search(before)) and (value := _VALUE.match(line)):
                        before, line = entry.group(1), line[value.end() :]
                        skip = len(before) - value.end()
                    else:
                        skip = len(before)
                    line = before + line
                    for start, end, name, how in candidates_of_line(line):
                        # in a path only shapes that need no name beside them, and its key=value parts
                        if start < len(before) or no == 0 and how in ("other", "said"):
                            continue
                        x = features_of(line, start, end, name, how, path if no else "", extension, shared.value)
                        out.append((file_id, no, start - skip, end - skip, x, weak_label(x, how), None if no else path))
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [batch.column(0).type, pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file_id", "line_no", "start", "end", "x", "weak", "path"])

    every = current.select("file_id", "relative_path", "extension", "content").unionByName(live_paths(files).withColumn("content", F.lit(None).cast("string")))
    return every.mapInArrow(run, "file_id long, line_no long, start int, end int, x array<double>, weak int, path string")


def labelled_candidates(found: DataFrame) -> DataFrame:
    """(x, weak, fold, by_name): every labelled candidate; ``by_name`` where it shows how credentials look, with a label that does not come from its looks."""
    says_no = [F.col("x")[FEATURES.index(f)] == 0 for f in ("placeholder", "reference", "uuid_or_digest", "plain_word", "spaces", "pem")]
    by_name = reduce(Column.__and__, says_no, F.col("x")[FEATURES.index("length")] >= math.log(UNNAMED))
    fold = F.pmod(F.xxhash64("file_id", "line_no", "start"), F.lit(FOLDS)).cast("int")
    return found.where("weak is not null").select("x", "weak", fold.alias("fold"), by_name.alias("by_name"))


def _sums(labelled: DataFrame, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each regression a row a model: rows, credentials, loss, gradient and Hessian over all that it learns from.

    Row 0 is the model of all labelled candidates, row 1 + k that of all but fold k. The driver gets
    the sums only, as many for any input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((FOLDS + 1, 3 + len(r) + len(r) ** 2)) for r in REGRESSIONS]
        for batch in batches:
            every = batch.column(0).flatten().to_numpy().reshape(-1, len(FEATURES))
            label, fold, by_name = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            for total, names, w in zip(totals, REGRESSIONS, weights, strict=True):
                rows = by_name if names is LOOKS else np.ones(len(every), dtype=bool)
                x, y = every[rows][:, [FEATURES.index(f) for f in names]], label[rows].astype(float)[:, None]
                learns = np.column_stack([np.ones(len(x), dtype=bool), fold[rows][:, None] != np.arange(FOLDS)])
                z = x @ w.T
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                total[:, 0] += learns.sum(axis=0)
                total[:, 1] += (learns * y).sum(axis=0)
                total[:, 2] += (learns * (np.logaddexp(0, z) - y * z)).sum(axis=0)
                total[:, 3 : 3 + len(names)] += (learns * (p - y)).T @ x
                curve = learns * p * (1 - p)
                for m in range(FOLDS + 1):
                    total[m, 3 + len(names) :] += ((x * curve[:, m : m + 1]).T @ x).ravel()
        flat = np.concatenate([t.ravel() for t in totals])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "value"])

    flat = np.zeros(sum((FOLDS + 1) * (3 + len(r) + len(r) ** 2) for r in REGRESSIONS))
    for at, value in labelled.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value")).collect():
        flat[at] = value
    out = []
    for r in REGRESSIONS:
        size = (FOLDS + 1) * (3 + len(r) + len(r) ** 2)
        out.append(flat[:size].reshape(FOLDS + 1, -1))
        flat = flat[size:]
    return out


def fit_logistic(labelled: DataFrame, rounds: int = 100, ridge: float = 1.0) -> list[np.ndarray | None]:
    """The weights of each of REGRESSIONS, a row a model as in ``_sums``, by Newton's method with a ridge over all labelled candidates.

    A step that makes a model worse is halved. A regression without candidates of both labels is
    None; a model whose folds have only one takes the weights of all. Weights are rounded to eight
    decimals, so that the order in which Spark adds up does not show.
    """
    weights = [np.zeros((FOLDS + 1, len(r))) for r in REGRESSIONS]
    base, steps = [w.copy() for w in weights], [np.zeros_like(w) for w in weights]
    least = [np.full(FOLDS + 1, np.inf) for _ in REGRESSIONS]
    for _ in range(rounds):
        sums = _sums(labelled, weights)
        for i, total in enumerate(sums):
            k = len(REGRESSIONS[i])
            for m in range(FOLDS + 1):
                w = weights[i][m]
                loss = total[m, 2] + ridge / 2 * (w @ w)
                if loss > least[i][m] * (1 + 1e-9):
                    steps[i][m] /= 2
                else:
                    base[i][m], least[i][m] = w, loss
                    steps[i][m] = np.linalg.solve(total[m, 3 + k :].reshape(k, k) + ridge * np.eye(k), total[m, 3 : 3 + k] + ridge * w)
            weights[i] = base[i] - steps[i]
        if max(np.abs(s).max() for s in steps) < 1e-8 or not 0 < sums[0][0, 1] < sums[0][0, 0]:
            break
    out: list[np.ndarray | None] = []
    for w, total in zip(weights, sums, strict=True):
        both = (total[:, 1] > 0) & (total[:, 1] < total[:, 0])
        out.append(np.round(np.where(both[:, None], w, w[:1]), 8) if both[0] else None)
    return out


def thresholds(scored: DataFrame, precision: float = PRECISION) -> dict[int, float]:
    """For each ``kind`` of (kind, score, weak) the lowest score from which on at least ``precision`` of the
    labelled candidates are credentials, at least 0.5 and at most 0.9; 0.5 where there is none."""
    each = scored.groupBy("kind", (-F.col("score")).alias("down")).agg(F.count("*").alias("n"), F.sum("weak").alias("good"))
    fit = summed(each, ["kind"], ["down"], ["n", "good"]).where(F.col("good") / F.col("n") >= precision)
    found = {r["kind"]: -r["down"] for r in fit.groupBy("kind").agg(F.max("down").alias("down")).collect()}
    return defaultdict(lambda: 0.5, {k: min(0.9, max(0.5, s)) for k, s in found.items()})


def score_of(weights: np.ndarray, names: list[str]) -> Column:
    """The score of a candidate by a regression over some features."""
    # as one text: a column a term would take seconds to build
    linear = " + ".join(f"x[{FEATURES.index(f)}] * ({float(w)!r}D)" for f, w in zip(names, weights, strict=True))
    return F.expr(f"1 / (1 + exp(-({linear})))")


def unseen_scores(labelled: DataFrame, fitted: list[np.ndarray | None]) -> DataFrame:
    """(kind, score, weak): the score of every labelled candidate by the model that has not learnt from it, for each regression."""
    kinds = []
    for kind, (names, w) in enumerate(zip(REGRESSIONS, fitted, strict=True)):
        if w is not None:
            score = F.coalesce(*(F.when(F.col("fold") == k, score_of(w[1 + k], names)) for k in range(FOLDS)))
            rows = labelled.where("by_name") if names is LOOKS else labelled
            kinds.append(rows.select(F.lit(kind).alias("kind"), score.alias("score"), "weak"))
    return reduce(DataFrame.unionByName, kinds)


def credentials(files: DataFrame, docs: DataFrame, current: DataFrame) -> DataFrame:
    """(file_id, line_no, start, end, score, path): every credential with its place in its line.

    Defined cases: line 0 is a relative path, named by ``path``, of any file that is not deleted,
    also of one without a current content; lines end at ``\\n`` (a ``\\r`` before it stays
    part of the line); empty and null contents have no rows; several credentials in a line are
    several rows; very long lines are read whole; where no candidate is labelled there is no
    regression and the patterns decide; other columns are ignored.
    """
    counts = [(r["first"], r["second"], r["n"]) for r in character_counts(docs).collect()]
    found = written(line_candidates(current, surprises(counts), files), "credential-candidates")
    labelled = labelled_candidates(found)
    fitted = fit_logistic(labelled)
    if fitted[0] is None:
        return found.where("weak = 1").select("file_id", "line_no", "start", "end", F.lit(1.0).alias("score"), "path")
    least = thresholds(unseen_scores(labelled, fitted))
    scored = found.withColumn("score", score_of(fitted[0][0], FEATURES))
    # what a pattern is sure of stays one, however many other candidates the regression saw
    sure = F.coalesce(F.col("weak") == 1, F.lit(False))
    # a value under a name that says nothing: judged by its looks, as learnt from values whose names or prefixes say what they are
    unnamed = F.col("weak").isNull() & (F.col("x")[FEATURES.index("other_literal")] == 1)
    if fitted[1] is not None:
        scored = scored.withColumn("score", F.when(unnamed, score_of(fitted[1][0], LOOKS)).otherwise(F.col("score")))
        kept = (F.when(unnamed, F.col("score") >= least[1]).otherwise(F.col("score") >= least[0])) | sure
    else:
        kept = (~unnamed & (F.col("score") >= least[0])) | sure
    return scored.where(kept).select("file_id", "line_no", "start", "end", "score", "path")


def redacted(current: DataFrame, found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(file_id, relative_path, content) with each credential blanked: its letters and digits become ``x``.

    Length, quotes, punctuation and line ends stay, so the code around it parses as before. The
    body of a private key is blanked up to its closing marker, or to the end of the string or
    text that holds it. With ``files``, paths of files that are not deleted and have no current
    content are rows too, with a null content.
    """
    rows = current.select("file_id", "relative_path", "content")
    if files is not None:
        known = rows.select("file_id", "relative_path").distinct()
        rows = rows.unionByName(live_paths(files).select("file_id", "relative_path").join(known, ["file_id", "relative_path"], "left_anti").withColumn("content", F.lit(None).cast("string")))
    spans = found.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "start", "end", "path"))).alias("spans"))
    joined = rows.join(spans, "file_id", "left")
    body = re.compile(r"(-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----)(.*?)(-----END|[\"'`]|\Z)", re.S)

    def blank(text: str) -> str:
        return re.sub(r"[A-Za-z0-9]", "x", text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents = [], []
            for path, content, marks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                lines = (content or "").split("\n")
                pem, whole = False, path
                for m in marks or []:
                    if m["line_no"] == 0 and m["path"] != whole or m["line_no"] > 0 and content is None:
                        continue  # of another row of the file
                    line = path if m["line_no"] == 0 else lines[m["line_no"] - 1]
                    old = line[m["start"] : m["end"]]
                    if old.startswith("-----BEGIN"):
                        pem = True
                        continue
                    line = line[: m["start"]] + blank(old) + line[m["end"] :]
                    if m["line_no"] == 0:
                        path = line
                    else:
                        lines[m["line_no"] - 1] = line
                text = "\n".join(lines)
                if pem:
                    text = body.sub(lambda b: b.group(1) + re.sub(r"(\\[nr])|[A-Za-z0-9]", lambda c: c.group(1) or "x", b.group(2)) + b.group(3), text)
                paths.append(path)
                contents.append(text if content is not None else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string()), pa.array(contents, pa.string())], names=["file_id", "relative_path", "content"])

    return joined.select("file_id", "relative_path", "content", "spans").mapInArrow(run, "file_id long, relative_path string, content string")
