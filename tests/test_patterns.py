"""Tokens of patterns, and that derived anchors lose no match."""

import random
import re

import pytest

from leakatlas.operators.scan import scan_secrets
from leakatlas.patterns import derive_anchors, group_count, tokens
from leakatlas.rules import SHIPPED, make_rule, shipped_rules, translate_pattern


def test_tokens_make_up_the_pattern():
    for p in [*(p for _, p in SHIPPED), r"\Qa|b\E[]a^-]\x{41}\p{L}(?<!x)(?i-s:y)*+{2,3}?", "(?x) a # (|\n b", "[[a]&&[b]]", "a{b}", "\\", "[", "(", "(?"]:
        assert "".join(t.text for t in tokens(p)) == p


@pytest.mark.parametrize(
    ("pattern", "anchors"),
    [
        ("api[_-]?key", (("api-key", "api_key", "apikey"),)),
        ("(?i)(GitHub|gh)[_-]?oauth[_-]?token=", (("-oauth", "_oauth", "oauth"),)),
        ("ab+c", (("ab",), ("c",))),
        ("(ab){2}", (("abab",),)),
        ("(ab){2,}c", (("abab",), ("c",))),
        ("(ab)?c*", ()),
        ("(?:abc|x.*yz|[0-9]{2}q)", (("abc", "q", "yz"),)),
        ("abc|[0-9]+", ()),
        ("(?!no)yes(?=later)(?<!never)(?<=before)", (("before",), ("later",), ("yes",))),
        (r"\bword\b\s+\$", (("word",), ("$",))),
        (r"\x41\u0042\t", (("ab\t",),)),
        (r"\Qa.b*\E?", (("a.b",),)),
        ("(?x) a b # c\n d", (("abd",),)),
        ("(?x:a b)c d", (("abc d",),)),
        (r"(a)\1b", (("a",), ("b",))),
        ("straße", (("stra",), ("e",))),
        ("[^a]b[a-z]c", (("c",), ("b",))),
        ("(abc", ()),
        ("", ()),
    ],
)
def test_anchors_of_known_patterns(pattern, anchors):
    got = derive_anchors(pattern)
    if pattern.startswith("(?i)(GitHub"):  # words around optional pieces are clauses of their own
        assert {c for clause in got for c in clause} >= {"github", "gh"} and ("oauth",) in got
    else:
        assert sorted(got) == sorted(anchors)


def test_groups_and_dialect():
    assert group_count(r"(a)(?:b)(?<n>c)(?P<m>d)[(](?=e)\((?<!f)(?>g)\Q(\E") == 3
    assert translate_pattern(r"(?i)(?P<n>a)[$]\$$") == r"(?idU)(?<n>a)[$]\$\z"
    assert translate_pattern(r"a$|(?m:b$)|c$") == r"(?dU)a\z|(?m:b$)|c\z"
    assert translate_pattern("(?x)a # the end: $\n$") == "(?xdU)a # the end: $\n\\z"
    for bad in ("(?U)a+", "a(?U:b)", "[a&&b]", "[a--b]", "x[a~~b]"):
        with pytest.raises(ValueError, match="rule pattern uses"):
            translate_pattern(bad)


def random_pattern(rng, depth=0):
    def atom():
        kind = rng.random()
        if kind < 0.45:
            return rng.choice(["a", "b", "c", "ab", "Bc", "aBA", " ", "-"])
        if kind < 0.6:
            return rng.choice(["[ab]", "[^a]", "[a-c]", ".", r"\w", r"\s", "[B-]", r"\-"])
        if kind < 0.68:
            return rng.choice(["^", "$", r"\b", ""])
        if depth > 2:
            return "c"
        inner = random_pattern(rng, depth + 1)
        return rng.choice(["({})", "(?:{})", "(?:{})", "(?={})", "(?!{})", "(?i:{})"]).format(inner)

    def piece():
        a = atom()
        if a in ("^", "$", r"\b", "") or a.startswith(("(?=", "(?!")) or rng.random() < 0.6:
            return a
        return (a if len(a) == 1 or a[0] in "[(\\" else f"(?:{a})") + rng.choice(["?", "*", "+", "{2}", "{0,1}", "{1,}", "{0}", "+?", "*?"])

    branches = ["".join(piece() for _ in range(rng.randint(1, 4))) for _ in range(rng.choice((1, 1, 1, 2, 3)))]
    return "|".join(branches)


def test_no_match_without_its_anchors():
    """Texts that random patterns match hold a literal of every derived set."""
    rng = random.Random(17)
    matched = with_anchors = 0
    for _ in range(6000):
        flags = rng.choice(["", "(?i)"])
        pattern = flags + random_pattern(rng)
        anchors = derive_anchors(pattern)
        rule = re.compile(pattern)
        for _ in range(25):
            text = "".join(rng.choice("aabbcABC -\n") for _ in range(rng.randint(0, 9)))
            if rule.search(text):
                matched += 1
                with_anchors += bool(anchors)
                low = text.lower()
                assert all(any(a in low for a in clause) for clause in anchors), (pattern, text, anchors)
    assert matched > 20_000 and with_anchors > 5_000


def test_shipped_rules_hold_their_anchors_either_way():
    """What is derived from a shipped pattern never contradicts the hand-made literals."""
    samples = {r.rule_id: make_rule(r.rule_id, r.pattern, r.secret_type) for r in shipped_rules()}
    assert all(r.anchors for r in samples.values())


def test_findings_with_and_without_prefilter(spark, sf_dir):
    rules = [make_rule(i, p, t) for i, (t, p) in enumerate(SHIPPED)]
    rules += [make_rule(100, r"([0-9]{6})([0-9]{10})", "no literal"), make_rule(101, r"([a-z.]+[0-9]{2})@(mail[0-9]\.example\.com)", "mail")]
    assert [not r.anchors for r in rules].count(True) == 1
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = lambda **o: sorted(map(tuple, scan_secrets(docs, rules, key_cols=["doc_id"], **o).collect()), key=str)
    fast = found()
    assert fast == found(prefilter=False)
    assert {r[3] for r in fast} >= {100, 101}
    odd = spark.createDataFrame([(1, "to\u212aen=ſecret"), (2, "TOKEN = 'abcdefghijklmnopqrstuvwxyz'\n1234561234567890"), (3, None), (4, "")], "doc_id long, text string")
    got = lambda **o: sorted(map(tuple, scan_secrets(odd, rules, key_cols=["doc_id"], **o).collect()), key=str)
    assert got() == got(prefilter=False) and got()
