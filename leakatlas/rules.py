"""The ordered rule table: shipped rules, user rules, dialect and anchors.

Rules are configuration (tens of rows) and live on the driver. They enter a
plan only as literal patterns, so Spark compiles each regex once per task; a
joined pattern column would be recompiled on nearly every row.

The shipped rule table is derived from an MIT-licensed rule file; the notice is
kept in ``NOTICE``.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from . import schemas
from .patterns import derive_anchors, group_count, tokens

MAX_RULES = 2_000  # default bound of a rule file, which is configuration

# An anchor set is an AND of ORs of lower-case literals that any match of the
# rule must contain. No anchor set means: always try the rule.
Anchors = tuple[tuple[str, ...], ...]

IDENT = "[A-Za-z_][A-Za-z0-9_]*"

# Secret type and pattern of the 31 shipped rules. Their order is
# data, a lower position wins under "first".
SHIPPED: tuple[tuple[str, str], ...] = (
    ("XML Password", r"""(?i)<add[^>]*key\s*=\s*["']([^"']*(?:passwd|password|pass)[^"']*)["'][^>]*value\s*=\s*["']([^"']{4,})["']"""),
    ("XML Password", r"""(?i)<add[^>]*key\s*=\s*["']([^"']*passwd[^"']*)["'][^>]*value\s*=\s*["']([^"']{4,})["']"""),
    ("XML Username", r"""(?i)<add[^>]*key\s*=\s*["']([^"']*usuario[^"']*)["'][^>]*value\s*=\s*["']([^"']{3,})["']"""),
    ("SSH Host Key", r"""(?i)<add[^>]*key\s*=\s*["']([^"']*sshostKey[^"']*)["'][^>]*value\s*=\s*["']([^"']{10,})["']"""),
    ("Public Key", r"""(?i)([A-Za-z_][A-Za-z0-9_]*_PUBLIC_KEY)\s*[=:]\s*["']?([A-Za-z0-9_\-/+=]{16,})["']?"""),
    ("Private Key", r"""(?i)([A-Za-z_][A-Za-z0-9_]*_PRIVATE_KEY)\s*[=:]\s*["']?([A-Za-z0-9_\-/+=]{16,})["']?"""),
    ("Password", r"""(?i)([A-Za-z_][A-Za-z0-9_]*_(?:PASSWORD|PASSWD|PWD))\s*[=:]\s*["']?([A-Za-z0-9!@#$%^&*()_+\-=\[\]{};':"\\|,.<>\/?]{8,})["']?"""),
    ("AWS Access Key", r"""(?i)(aws[_-]?access[_-]?key[_-]?id|aws[_-]?secret[_-]?access[_-]?key)\s*[=:]\s*["']?(AKIA[0-9A-Z]{16})["']?"""),
    ("AWS Secret Key", r"""(?i)(aws[_-]?secret[_-]?access[_-]?key|aws[_-]?secret[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9/+=]{40,})["']?"""),
    ("GitHub Token", r"""(?i)(github[_-]?token|gh[_-]?token|ghp[_-]?token)\s*[=:]\s*["']?(ghp_[A-Za-z0-9]{36})["']?"""),
    ("GitHub OAuth Token", r"""(?i)(github[_-]?oauth[_-]?token|gho[_-]?token)\s*[=:]\s*["']?(gho_[A-Za-z0-9]{36})["']?"""),
    ("API Key", r"""(?i)([A-Za-z_][A-Za-z0-9_]*(?:[Aa]pi[_-]?[Kk]ey|[Aa]pi[Kk]ey))\s*[=:]\s*["']?([A-Za-z0-9_\-]{20,})["']?"""),
    ("Access Token", r"""(?i)["']?(access[_-]?token|auth[_-]?token|bearer[_-]?token|token)["']?\s*[=:]\s*["']?([A-Za-z0-9_\-\.]{20,})["']?"""),
    ("JWT Token", r"""(?i)(jwt[_-]?token|json[_-]?web[_-]?token)\s*[=:]\s*["']?(eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+)["']?"""),
    ("Private Key", r"(?i)(-----BEGIN\s+(RSA\s+)?PRIVATE\s+KEY-----)"),
    ("SSH Private Key", r"(?i)(-----BEGIN\s+(OPENSSH\s+)?PRIVATE\s+KEY-----)"),
    ("Public Key", r"(?i)(-----BEGIN\s+(RSA\s+)?PUBLIC\s+KEY-----)"),
    ("Google API Key", r"""(?i)(google[_-]?api[_-]?key|gcp[_-]?api[_-]?key)\s*[=:]\s*["']?(AIza[0-9A-Za-z\-_]{35})["']?"""),
    ("Google Client Secret", r"""(?i)(google[_-]?client[_-]?secret|gcp[_-]?client[_-]?secret)\s*[=:]\s*["']?([A-Za-z0-9_\-]{24,})["']?"""),
    ("Stripe Secret Key", r"""(?i)(stripe[_-]?secret[_-]?key|stripe[_-]?api[_-]?key)\s*[=:]\s*["']?(sk_(live|test)_[A-Za-z0-9]{24,})["']?"""),
    ("Stripe Publishable Key", r"""(?i)(stripe[_-]?publishable[_-]?key)\s*[=:]\s*["']?(pk_(live|test)_[A-Za-z0-9]{24,})["']?"""),
    ("Slack Token", r"""(?i)(slack[_-]?token|slack[_-]?api[_-]?token)\s*[=:]\s*["']?(xox[baprs]-[A-Za-z0-9\-]{10,})["']?"""),
    ("Discord Bot Token", r"""(?i)(discord[_-]?bot[_-]?token|discord[_-]?token)\s*[=:]\s*["']?([A-Za-z0-9\.\-]{59,})["']?"""),
    ("Secret Key", r"""(?i)["']?(secret[_-]?key|secret[_-]?access[_-]?key|app[_-]?secret)["']?\s*[=:]\s*["']?([A-Za-z0-9_\-]{16,})["']?"""),
    ("Database URI", r"""(?i)(mongodb[_-]?uri|postgres[_-]?uri|mysql[_-]?uri|database[_-]?uri|db[_-]?uri)\s*[=:]\s*["']?([a-z]+://[^\s"']+)["']?"""),
    ("Credentials", r"""(?i)["']?(credential|creds)["']?\s*[=:]\s*["']?([A-Za-z0-9_\-]{16,})["']?"""),
    ("Azure Storage Key", r"""(?i)(azure[_-]?storage[_-]?account[_-]?key|azure[_-]?storage[_-]?key)\s*[=:]\s*["']?([A-Za-z0-9+/=]{86}==)["']?"""),
    ("Twilio API Key", r"""(?i)(twilio[_-]?api[_-]?key|twilio[_-]?auth[_-]?token)\s*[=:]\s*["']?([A-Za-z0-9]{32})["']?"""),
    ("Mailgun API Key", r"""(?i)(mailgun[_-]?api[_-]?key)\s*[=:]\s*["']?(key-[A-Za-z0-9]{32})["']?"""),
    ("SendGrid API Key", r"""(?i)(sendgrid[_-]?api[_-]?key)\s*[=:]\s*["']?(SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43})["']?"""),
    ("Example Pattern", r"""(?i)(example[_-]?pattern)\s*[=:]\s*["']?([A-Za-z0-9]{10,})["']?"""),
)
SHIPPED_DISABLED = (12, 30)
PROVIDER_RULES = (7, 8, 9, 10, 13, 17, 18, 19, 20, 21, 22, 26, 27, 28, 29)
GENERIC_RULES = (11, 12, 23, 25)

# Own tuning data, one entry per shipped rule: literals every match contains,
# from common to telling. Rules that share their first sets share the tests, so
# text without an assignment, or without "key", is ruled out for all of them.
_SET = ("=", ":")
_XML = ("=",), ("<add",), ("value",)
_PEM = ("-----",), ("-----begin",), ("key",)
_KEY = _SET, ("key",)
_TOKEN = _SET, ("token",)
_ANCHORS: tuple[Anchors, ...] = (
    (*_XML, ("pass",)),
    (*_XML, ("passwd",)),
    (*_XML, ("usuario",)),
    (*_XML, ("sshostkey",)),
    (*_KEY, ("_public_key",)),
    (*_KEY, ("_private_key",)),
    (_SET, ("_passw", "_pwd")),
    (*_KEY, ("akia",), ("aws",)),
    (*_KEY, ("aws",), ("secret",)),
    (*_TOKEN, ("ghp_",)),
    (*_TOKEN, ("gho_",)),
    (*_KEY, ("apikey", "api_key", "api-key")),
    _TOKEN,
    (*_TOKEN, ("eyj",)),
    (*_PEM, ("private",)),
    (*_PEM, ("private",)),
    (*_PEM, ("public",)),
    (*_KEY, ("aiza",), ("google", "gcp")),
    (_SET, ("secret",), ("client",), ("google", "gcp")),
    (*_KEY, ("sk_live_", "sk_test_"), ("stripe",)),
    (*_KEY, ("pk_live_", "pk_test_"), ("stripe",)),
    (*_TOKEN, ("slack",), ("xox",)),
    (*_TOKEN, ("discord",)),
    (_SET, ("secret",), ("key", "app")),
    (_SET, ("://",), ("uri",)),
    (_SET, ("cred",), ("credential", "creds")),
    (*_KEY, ("azure",), ("storage",), ("==",)),
    (_SET, ("key", "token"), ("twilio",)),
    (*_KEY, ("mailgun",), ("key-",)),
    (*_KEY, ("sendgrid",), ("sg.",)),
    (_SET, ("pattern",), ("example",)),
)

# Characters a match can begin with, for rules that begin with literal words (and
# quotes, for those whose key may be quoted).
_STARTS: dict[int, str] = {
    7: "a", 8: "a", 9: "g", 10: "g", 12: "abt\"'", 13: "j", 17: "g", 18: "g", 19: "s", 20: "s", 21: "s",
    22: "d", 23: "as\"'", 24: "dmp", 25: "c\"'", 26: "a", 27: "t", 28: "m", 29: "s", 30: "e",
}
_XML_RULES, _HEADER_RULES = (0, 1, 2, 3), (14, 15, 16)

# Rules whose key starts with a free identifier: the literal tail of that key,
# the same as a check behind the identifier run, and the run's last character.
_IDENT_TAILS: dict[int, tuple[str, str, str]] = {
    4: (r"_PUBLIC_KEY", r"(?<=_PUBLIC_KEY)", "yY"),
    5: (r"_PRIVATE_KEY", r"(?<=_PRIVATE_KEY)", "yY"),
    6: (r"_(?:PASSWORD|PASSWD|PWD)", r"(?<=_(?:PASSWORD|PASSWD|PWD))", "dD"),
    11: (r"api[_-]?key", r"(?:(?<=api_?key)|(?<=api)-key)", "yYiI\u0130\u0131"),
}


# Letters that a case-insensitive Unicode match takes for an ASCII one.
_FOLDS = {"s": "\u017f", "k": "\u212a", "i": "\u0130\u0131"}
_FOLD_ALL = "".join(_FOLDS.values())


def _plain(pattern: str) -> str:
    """Part of a pattern that is matched without the rule's flags, hence fast."""
    return f"(?-iU:{pattern})"


def _linear_key(tail: str, tail_check: str, last_chars: str) -> str:
    """Equivalent of ``(IDENT + tail)`` that reads every identifier once.

    The tail is always followed by a separator, so a match exists only where
    an identifier run *ends* with the tail, and it starts at the run's first
    letter. A run is entered at its first character only; leading digits,
    which no identifier starts with, are group 1 and the key is group 2. Then
    the run is read possessively and looked back at. The cheap tests come
    first.
    """
    word = f"A-Za-z0-9_{_FOLD_ALL}"
    starts_run = _plain(f"(?=[{word}])(?<![{word}])([0-9]*+)(?=[A-Za-z_{_FOLD_ALL}])")
    not_bare_tail = rf"(?!{tail}\s*[=:])"
    run = _plain(f"[A-Za-z_{_FOLD_ALL}][{word}]*+(?<=[{last_chars}])")
    return rf"{starts_run}{not_bare_tail}({run}{tail_check})"


def _tag_scan(pattern: str) -> str:
    """Extraction form of a rule over ``<add ...`` tags.

    Up to the next ``>`` all ``<add`` are alike: if one begins a match, the
    first does. So what does not match is passed up to there as an empty
    match. A quoted key without an end is given up at once.
    """
    body = pattern.replace("([^\"']*", "((?=[^\"']*+[\"'])[^\"']*", 1)
    return f"{body}|<add[^>]*+"


def _first_chars(chars: str) -> str:
    """Look-ahead for the characters a match can start with.

    It fails on most positions at the price of one table lookup.
    """
    wide = "".join(dict.fromkeys(c + c.upper() + _FOLDS.get(c, "") for c in chars))
    return _plain(f"(?=[{wide}])")


@dataclass(frozen=True)
class Rule:
    """One detection rule.

    ``pattern`` is the portable text, ``spark_pattern`` what Spark runs.
    ``tier`` orders rules under ``resolve="specific"``.
    """

    rule_id: int
    pattern: str
    secret_type: str
    description: str | None = None
    disabled: bool = False
    anchors: Anchors = ()
    key_group: int = 1
    value_group: int = 2
    tier: int = 1
    spark_pattern: str = ""
    # The same matches for extraction, maybe among empty ones; and what stands
    # before the key in a match but is not part of it, as a replacement.
    scan_pattern: str = ""
    keep: str = ""


def shipped_rules() -> list[Rule]:
    rules = []
    for i, (secret_type, pattern) in enumerate(SHIPPED):
        body, key_group = pattern.removeprefix("(?i)"), 1
        scan = None
        if i in _IDENT_TAILS:
            key, rest = body[1:].split(r")\s*[=:]", 1)
            body, key_group = _linear_key(*_IDENT_TAILS[i]) + r"\s*[=:]" + rest, 2
        elif i in _STARTS:
            body = _first_chars(_STARTS[i]) + body
        elif i in _XML_RULES:
            scan = _tag_scan(body)
        # Unicode case folding and white space, as the rules are meant.
        flags = "(?iU)"
        rules.append(
            Rule(
                rule_id=i,
                pattern=pattern,
                secret_type=secret_type,
                description=f"{secret_type} header" if i in _HEADER_RULES else f"{secret_type} assignment",
                disabled=i in SHIPPED_DISABLED,
                anchors=_ANCHORS[i],
                key_group=key_group,
                value_group=key_group if i in _HEADER_RULES else key_group + 1,
                tier=0 if i in PROVIDER_RULES else 2 if i in GENERIC_RULES else 1,
                spark_pattern=flags + body,
                scan_pattern=flags + (scan or body),
                keep="$1" if i in _IDENT_TAILS else "",
            )
        )
    return rules


# --- user rules -----------------------------------------------------------


def translate_pattern(pattern: str) -> str:
    """Turn a rule file pattern into the Java dialect, or reject it.

    Rule files are written for an engine whose ``U`` flag and class set
    operators mean something else than in Java; silently running them would
    change the findings.
    """
    out, lead = [], ""
    for i, t in enumerate(tokens(pattern)):
        text = t.text
        if t.kind in ("flags", "open") and "U" in t.flags:
            raise ValueError(f"rule pattern uses the U flag, which Java reads differently: {pattern!r}")
        if text.startswith("[") and ("&&" in text or "~~" in text or re.search(r"[^\\\[^]--", text)):
            raise ValueError(f"rule pattern uses a class set operation: {pattern!r}")
        if i == 0 and t.kind == "flags" and "-" not in text:
            lead, text = text[2:-1], ""
        elif t.kind == "empty" and text == "$" and "m" not in t.flags:
            # Only a line feed ends a line, and "$" is the very end unless lines are asked for.
            text = r"\z"
        out.append(text.replace("(?P<", "(?<", 1) if t.kind == "open" else text)
    return f"(?{lead}dU){''.join(out)}"


def make_rule(
    rule_id: int,
    pattern: str,
    secret_type: str,
    description: str | None = None,
    disabled: bool = False,
    anchors: Anchors | None = None,
) -> Rule:
    """Rule from user configuration; anchors that are not given are derived from the pattern."""
    groups = group_count(pattern)
    anchors = derive_anchors(pattern) if anchors is None else anchors
    return Rule(
        rule_id=rule_id,
        pattern=pattern,
        secret_type=secret_type,
        description=description,
        disabled=bool(disabled),
        anchors=tuple(tuple(a.lower() for a in any_of) for any_of in anchors),
        key_group=min(1, groups),
        value_group=min(2, groups),
        spark_pattern=translate_pattern(pattern),
        scan_pattern=translate_pattern(pattern),
    )


def _roots(clause: tuple[str, ...]) -> set[str]:
    """Parts of three characters and more that all literals of a set have in common."""
    first = min(clause, key=len)
    parts = {first[i:j] for i in range(len(first)) for j in range(i + 3, len(first) + 1)}
    return {p for p in parts if all(p in other for other in clause)}


def shared_first(rules: Sequence[Rule], of: Iterable[int]) -> list[Rule]:
    """``rules`` with the anchors of those at positions ``of`` arranged to share tests.

    Sets that most rules name come first, and a word that the literals of several
    rules have in common ("key", say) becomes a set of its own: text without an
    assignment, or without that word, is ruled out for all of them at once.
    """
    out = list(rules)
    roots = [set().union(*map(_roots, r.anchors)) for r in rules]
    words = Counter(w for ws in roots for w in ws)
    for i in of:
        word = max(roots[i], key=lambda w: (words[w], len(w), w), default=None)
        if word is not None and words[word] > 1 and (word,) not in out[i].anchors:
            out[i] = replace(out[i], anchors=((word,), *out[i].anchors))
    uses = Counter(clause for r in out for clause in r.anchors)
    for i in of:
        out[i] = replace(out[i], anchors=tuple(sorted(out[i].anchors, key=lambda c: -uses[c])))
    return out


def _from_records(records: Iterable[dict], max_rules: int = MAX_RULES) -> list[Rule]:
    records = list(records)
    if len(records) > max_rules:
        raise ValueError(f"{len(records)} rules; a rule table may hold {max_rules}")
    by_pattern = {r.pattern: r for r in shipped_rules()}
    out, derived = [], []
    for i, rec in enumerate(records):
        if rec.get("pattern") is None or rec.get("secret_type") is None:
            raise ValueError(f"rule {i} lacks pattern or secret_type")
        known = by_pattern.get(rec["pattern"])
        if known:  # a shipped pattern keeps its anchors and its linear form
            out.append(
                replace(
                    known,
                    rule_id=i,
                    secret_type=rec["secret_type"],
                    description=rec.get("description"),
                    disabled=bool(rec.get("disabled")),
                )
            )
        else:
            if not rec.get("anchors"):
                derived.append(i)
            out.append(
                make_rule(
                    i,
                    rec["pattern"],
                    rec["secret_type"],
                    rec.get("description"),
                    bool(rec.get("disabled")),
                    tuple(tuple(a) for a in rec["anchors"]) if rec.get("anchors") else None,
                )
            )
    return shared_first(out, derived)


def rules_from_json(text: str) -> list[Rule]:
    """Rules from the text of a rule file (an ordered JSON array)."""
    return _from_records(json.loads(text))


def load_rules(spark: SparkSession, path: str, max_rules: int = MAX_RULES) -> list[Rule]:
    """Rules from a JSON rule file on any Hadoop path.

    The file is configuration and is read to the driver; one with more than
    ``max_rules`` rules is refused, not cut.
    """
    table = spark.read.schema(schemas.RULE_FILE).option("multiLine", True).json(path)
    return _from_records((r.asDict() for r in table.limit(max_rules + 1).collect()), max_rules)


def enabled(rules: Sequence[Rule] | None = None, include_disabled: bool = False) -> list[Rule]:
    """Rules that take part in a scan."""
    rules = shipped_rules() if rules is None else list(rules)
    return [r for r in rules if include_disabled or not r.disabled]


def rules_version(rules: Sequence[Rule] | None = None) -> str:
    """A name that changes whenever an enabled rule, its type or the order of rules does."""
    facts = [(r.pattern, r.secret_type) for r in enabled(rules)]
    return hashlib.sha256(json.dumps(facts).encode()).hexdigest()[:16]


def rules_table(spark: SparkSession, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rule table as a DataFrame: ``rule_id`` is the position in the file."""
    rows = [
        (r.rule_id, r.pattern, r.secret_type, r.description, r.disabled)
        for r in (shipped_rules() if rules is None else rules)
    ]
    return spark.createDataFrame(rows, schemas.RULES)
