"""Secret detection: rule application, precedence, counting and redaction.

Nothing in this module shuffles. A scan is one narrow stage: a literal
prefilter on the whole text, a split into lines, the same prefilter per line,
and only then the regexes of the rules whose anchors were seen.

Expressions are composed as Spark SQL text: a rule table unfolds to thousands
of nodes, which the JVM parses in one call. ``text`` arguments are therefore
column names or SQL expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..rules import Rule, enabled

DEFAULT_KEYS = ("repo_url", "path")

# Forms that read a secret from the environment.
ENV_REFERENCE_PATTERN = (
    r"os\.getenv|os\.environ|process\.env|System\.getenv|getenv\(|ENV\[|\$\{[A-Za-z_]"
)

# Non-ASCII letters that fold to ASCII ones in a case-insensitive match but are
# not lowered to them: text holding one cannot be ruled out by ASCII anchors.
FOLDING_LETTERS = ("\u017f", "\u212a", "\u0130", "\u0131")

# Anchor sets per rule that are tested on a whole text.
FILE_DEPTH = 2

RESOLVE_MODES = ("first", "specific", "all")
SCOPES = ("line", "file")
ENV_UNITS = ("value", "line")


def _lit(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _any(conditions: Iterable[str]) -> str:
    return "(" + " OR ".join(conditions) + ")"


def _contains_any(text: str, literals: Iterable[str]) -> str:
    return _any(f"contains({text}, {_lit(a)})" for a in literals)


# --- prefilter --------------------------------------------------------------


def _shared_tests(low: str, anchor_sets: Iterable[tuple]) -> str:
    """Disjunction over anchor sets with their common heads factored out.

    The head that most sets share comes first: text that passes mostly passes
    by it.
    """
    tails: dict[tuple, list[tuple]] = {}
    for anchors in anchor_sets:
        if not anchors:
            return "true"
        tails.setdefault(anchors[0], []).append(anchors[1:])
    by_use = sorted(tails.items(), key=lambda t: -len(t[1]))
    return _any(
        f"({_contains_any(low, head)} AND {_shared_tests(low, rest)})" for head, rest in by_use
    )


def _holds_folding_letter(text: str) -> str:
    return f"(octet_length({text}) <> char_length({text}) AND {_contains_any(text, FOLDING_LETTERS)})"


def _may_match(text: str, rules: Sequence[Rule], depth: int | None = None) -> str:
    """The test of :func:`may_match`; ``depth`` limits it to each rule's first anchors.

    All anchors pay off on a line. On a whole file, which often holds the
    common ones, they would cost a pass each for little.
    """
    if any(not r.anchors for r in rules):
        return f"({text} IS NOT NULL)"
    heads = list(dict.fromkeys(a for r in rules for a in r.anchors[0]))
    tests = f"exists(array(lower({text})), low -> {_shared_tests('low', [r.anchors[:depth] for r in rules])})"
    passes = f"({tests} OR {_holds_folding_letter(text)})"
    if all(a.upper() == a for a in heads):
        # Caseless heads are tested on the text as it is, before lowering it.
        return f"({_contains_any(text, heads)} AND {passes})"
    return passes


def may_match(text: str, rules: Sequence[Rule]) -> Column:
    """Lossless prefilter: false only where no rule can match ``text``."""
    return F.expr(_may_match(text, rules))


def _candidate_rules(text: str, rules: Sequence[Rule], prefilter: bool) -> str:
    """Positions in ``rules`` that are worth running on ``text``.

    Only asked of text that passed the prefilter, so the anchors are walked as
    one constant array instead of being unfolded into an expression per rule.
    """
    everything = f"sequence(0, {len(rules) - 1})"
    if not prefilter:
        return everything
    always = [i for i, r in enumerate(rules) if not r.anchors]
    if always and len(always) < len(rules):
        # Rules that nothing rules out don't drag the others along.
        some = _may_match(text, [r for r in rules if r.anchors])
        return f"CASE WHEN {some} THEN {_anchored_rules(text, rules, everything)} ELSE array({', '.join(map(str, always))}) END"
    return _anchored_rules(text, rules, everything)


def _anchored_rules(text: str, rules: Sequence[Rule], everything: str) -> str:

    def array(parts: Iterable[str]) -> str:
        return "array(" + ", ".join(parts) + ")"

    def anchors(sets: Iterable[Iterable[str]]) -> str:
        # The empty literal is in every text.
        return array([array(map(_lit, any_of)) for any_of in sets] or [array([_lit("")])])

    groups: dict[tuple, list[int]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.anchors[:FILE_DEPTH], []).append(i)
    table = array(
        "struct({} AS head, {} AS rules)".format(
            anchors(head),
            array(f"struct({i} AS i, {anchors(rules[i].anchors[FILE_DEPTH:])} AS tail)" for i in members),
        )
        for head, members in groups.items()
    )
    seen = "forall({}, any_of -> exists(any_of, a -> contains(low, a)))"
    members = f"transform(filter(g.rules, r -> {seen.format('r.tail')}), r -> r.i)"
    found = f"flatten(transform(filter({table}, g -> {seen.format('g.head')}), g -> {members}))"
    by_anchor = f"transform(array(lower({text})), low -> sort_array({found}))[0]"
    return f"CASE WHEN {_holds_folding_letter(text)} THEN {everything} ELSE {by_anchor} END"


def _per_rule(index: str, choices: Iterable[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN {choice}" for i, choice in enumerate(choices))
    return f"CASE {index} {whens} END"


# --- hits -------------------------------------------------------------------


def _priority(rule: Rule, resolve: str) -> int:
    return rule.rule_id if resolve != "specific" else rule.tier * 1_000_000 + rule.rule_id


def _pairs_of(text: str, rule: Rule) -> str:
    """Key and value of each match of one rule."""

    def groups(n: int) -> str:
        return f"regexp_extract_all({text}, {_lit(rule.scan_pattern)}, {n})"

    if rule.value_group == rule.key_group:
        return f"transform({groups(rule.key_group)}, k -> struct(k, k AS v))"
    # Both calls walk the same matches, so the arrays are aligned.
    pairs = f"zip_with({groups(rule.key_group)}, {groups(rule.value_group)}, (k, v) -> struct(k, v))"
    return pairs if rule.scan_pattern == rule.spark_pattern else f"filter({pairs}, p -> p.k <> '')"


def _matches_of(text: str, rule: Rule) -> str:
    """How often one rule matches."""
    if rule.scan_pattern == rule.spark_pattern:
        return f"regexp_count({text}, {_lit(rule.spark_pattern)})"
    keys = f"regexp_extract_all({text}, {_lit(rule.scan_pattern)}, {rule.key_group})"
    return f"size(filter({keys}, k -> k <> ''))"


def _rule_hits(text: str, rules: Sequence[Rule], resolve: str, prefilter: bool) -> str:
    pairs = _per_rule("i", [_pairs_of(text, r) for r in rules])
    facts = ", ".join(
        f"struct({r.rule_id} AS rule_id, {_lit(r.secret_type)} AS secret_type, {_priority(r, resolve)} AS priority)"
        for r in rules
    )
    # An optional group that took no part comes back empty: the key stands in.
    hit = (
        "named_struct('rule_id', r.rule_id, 'secret_type', r.secret_type, 'priority', r.priority, "
        "'key_name', p.k, 'value', if(p.v <> '', p.v, p.k))"
    )
    of_rule = f"transform(array(array({facts})[i]), r -> transform({pairs}, p -> {hit}))[0]"
    return f"flatten(transform({_candidate_rules(text, rules, prefilter)}, i -> {of_rule}))"


def rule_hits(
    text: str, rules: Sequence[Rule], resolve: str = "first", prefilter: bool = True
) -> Column:
    """Array of every hit of every rule on ``text``, in rule order.

    Elements are ``struct(rule_id, secret_type, priority, key_name, value)``.
    """
    return F.expr(_rule_hits(text, rules, resolve, prefilter))


def _precedence(hits: str) -> str:
    ranks = f"transform({hits}, x -> x.priority)"
    covered = f"exists({hits}, y -> y.priority < x.priority AND contains(y.value, x.value))"
    return (
        f"CASE WHEN size({hits}) > 1 AND array_min({ranks}) < array_max({ranks}) "
        f"THEN filter({hits}, x -> NOT {covered}) ELSE {hits} END"
    )


def rule_precedence(hits: str) -> Column:
    """Drop a hit whose value lies inside a value that a better rule captured.

    ``hits`` is the hit array of one line, so no shuffle is needed. Lines
    where a single rule fires, nearly all of them, are passed through
    untouched.
    """
    return F.expr(_precedence(hits))


def env_reference(line: str, pattern: str = ENV_REFERENCE_PATTERN) -> Column:
    """True where the line reads an environment variable."""
    return F.expr(f"rlike({line}, {_lit(pattern)})")


def _numbered_lines(text: str) -> str:
    # A one-character separator takes the JVM's non-regex split path.
    return (
        f"transform(split({text}, '\\n'), (raw, n) -> named_struct('line_no', n + 1, 'line', "
        f"CASE WHEN endswith(raw, '\\r') THEN left(raw, char_length(raw) - 1) ELSE raw END))"
    )


def _file_hits(
    text: str,
    rules: Sequence[Rule],
    resolve: str = "first",
    scope: str = "line",
    prefilter: bool = True,
    env_pattern: str = ENV_REFERENCE_PATTERN,
    env_by: str = "value",
) -> str:
    if resolve not in RESOLVE_MODES:
        raise ValueError(f"unknown resolve mode {resolve!r}")
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    if env_by not in ENV_UNITS:
        raise ValueError(f"unknown environment unit {env_by!r}")
    if not rules:
        raise ValueError("no enabled rule")
    env_text = "h.value" if env_by == "value" else "u.line"
    hits = _rule_hits("u.line", rules, resolve, prefilter)
    if resolve != "all":
        hits = f"transform(array({hits}), hs -> {_precedence('hs')})[0]"
    finding = (
        "named_struct('line_no', u.line_no, 'rule_id', h.rule_id, 'secret_type', h.secret_type, "
        "'key_name', h.key_name, 'value_sha256', sha2(h.value, 256), "
        f"'value_len', char_length(h.value), 'is_env_reference', rlike({env_text}, {_lit(env_pattern)}))"
    )
    of_unit = f"transform({hits}, h -> {finding})"
    if scope == "file":
        unit = f"named_struct('line_no', CAST(NULL AS INT), 'line', {text})"
        return f"transform(array({unit}), u -> {of_unit})[0]"
    lines = _numbered_lines(text)
    if prefilter:
        lines = f"filter({lines}, u -> {_may_match('u.line', rules)})"
    return f"flatten(transform({lines}, u -> {of_unit}))"


def file_hits(text: str, rules: Sequence[Rule], **options) -> Column:
    """All findings of one text as an array of structs, in line and rule order.

    NULL where the prefilter rules the whole text out. The matched value is
    hashed here and never leaves the expression. For the options see
    :func:`scan_secrets`.
    """
    hits = _file_hits(text, rules, **options)
    if not options.get("prefilter", True):
        return F.expr(hits)
    # Not a filter: in a projection the test stays where the text is spread out.
    return F.expr(f"CASE WHEN {_may_match(text, rules, FILE_DEPTH)} THEN {hits} END")


def scan_secrets(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    key_cols: Sequence[str] = DEFAULT_KEYS,
    text_col: str = "text",
    include_disabled: bool = False,
    **options,
) -> DataFrame:
    """Findings of the rule table over the text of every row.

    Output: the key columns, ``hit_no`` (position within the text),
    ``line_no`` (NULL for ``scope="file"``), ``rule_id``, ``secret_type``,
    ``key_name``, ``value_sha256``, ``value_len`` and ``is_env_reference``.

    Options: ``resolve="first"`` lets the earliest rule win on overlapping
    values, ``"specific"`` ranks provider rules above generic ones, ``"all"``
    keeps every hit; ``scope="file"`` matches across lines;
    ``prefilter=False`` runs every rule on everything, with equal findings;
    ``env_pattern`` replaces the forms that count as environment reads, and
    ``env_by`` says where they are looked for: in the captured ``"value"``, or
    anywhere in the ``"line"``, where one read also covers the secrets beside
    it.
    """
    hits = file_hits(text_col, enabled(rules, include_disabled), **options)
    return files.select(*key_cols, F.posexplode(hits).alias("hit_no", "h")).select(
        *key_cols, "hit_no", "h.*"
    )


# --- whole-text uses of the rules -------------------------------------------


def count_matches(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    *,
    text_col: str = "text",
    include_disabled: bool = False,
) -> DataFrame:
    """Matches per rule over whole texts, zero counts included."""
    active = enabled(rules, include_disabled)
    counts = _per_rule(
        "i", [_matches_of(text_col, r) for r in active]
    )
    per_text = (
        f"CASE WHEN {_may_match(text_col, active, FILE_DEPTH)} THEN "
        f"transform({_candidate_rules(text_col, active, True)}, i -> named_struct('i', i, 'n', {counts})) END"
    )
    found = (
        files.select(F.explode(F.expr(per_text)).alias("c"))
        .groupBy(F.col("c.i").alias("i"))
        .agg(F.sum("c.n").alias("n"))
    )
    table = files.sparkSession.createDataFrame(
        [(i, r.rule_id, r.secret_type) for i, r in enumerate(active)],
        "i int, rule_id int, secret_type string",
    )
    # At most one row per rule on both sides.
    return table.join(found, "i", "left").select(
        "rule_id", "secret_type", F.coalesce("n", F.lit(0)).alias("n_matches")
    )


def redact(
    text: str, rules: Sequence[Rule] | None = None, include_disabled: bool = True
) -> Column:
    """Replace every whole match, key and value, by ``[redacted:<rule_id>]``.

    Rules run in order, each on the text the previous one left. Masking only
    the value would leave a line that an earlier rule can match again.
    """
    active = enabled(rules, include_disabled)
    replaced = _per_rule(
        "i",
        [
            f"regexp_replace(acc, {_lit(r.spark_pattern)}, {_lit(f'{r.keep}[redacted:{r.rule_id}]')})"
            for r in active
        ],
    )
    masked = f"aggregate({_candidate_rules(text, active, True)}, {text}, (acc, i) -> {replaced})"
    return F.expr(f"CASE WHEN {_may_match(text, active, FILE_DEPTH)} THEN {masked} ELSE {text} END")
