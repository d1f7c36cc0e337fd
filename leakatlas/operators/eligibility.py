"""Which repositories are worth a full scan, and why the others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.domains import domain_label

# Skip words in report order.
SKIP_WORDS = (
    "doc", "docs", "documentation", "document",
    "report", "reports", "analysis", "analyses",
    "wiki", "guide", "guides", "tutorial", "tutorials",
    "example", "examples", "demo", "demos", "sample", "samples",
    "test", "tests", "testing", "spec", "specs",
    "archive", "archived", "backup", "backups",
    "old", "legacy", "deprecated", "obsolete",
    "random", "misc", "miscellaneous", "temp", "tmp",
)


# Words that hold an earlier word: whoever holds them holds that one first.
_ROOTS = tuple(w for i, w in enumerate(SKIP_WORDS) if not any(v in w for v in SKIP_WORDS[:i]))

# Report texts.
LIKELY = "' (likely documentation/report/analysis repo)"
NAME_CONTAINS = "Repository name contains '"
OWNER_IS = "Repository owner '"
OWNER_MATCHES = "' matches domain '"
SAME_COMPANY = "' (likely same company)"
DESCRIPTION_CONTAINS = "Repository description contains '"
TOPIC_IS = "Repository topic '"
TOPIC_INDICATES = "' indicates it's a "
TOPIC_END = " repository"
ARCHIVED = "Repository is archived"


def first_skip_word(text: Column, match: str = "substring") -> Column:
    """First skip word, in list order, found in the text; NULL when none is.

    ``substring`` finds ``doc`` in ``docker`` and ``old`` in ``cold``;
    ``token`` compares whole alphanumeric runs; the text is cut into them once
    for all words. Substring tests end at the first hit.
    """
    low = F.lower(text)
    if match == "token":
        # The common words come in the order of the list.
        words = F.array(*[F.lit(w) for w in SKIP_WORDS])
        return F.get(F.array_intersect(words, F.split(low, "[^a-z0-9]+")), F.lit(0))
    if match != "substring":
        raise ValueError(f"unknown match mode {match!r}")
    found = F.when(text.isNull(), F.lit(None).cast("string"))
    for w in _ROOTS:
        found = found.when(F.contains(low, F.lit(w)), w)
    return found


def skip_verdict(
    owner: Column,
    name: Column,
    description: Column,
    topics: Column,
    is_archived: Column,
    domain: Column,
    match: str = "substring",
) -> Column:
    """``struct(reason_class, reason)`` of the first failing rule, NULL when eligible.

    Order: name, owner, description, topics, archived. Later rules are not
    evaluated once one has failed.
    """

    def verdict(kind: str, *reason: Column | str) -> Column:
        parts = [F.lit(r) if isinstance(r, str) else r for r in reason]
        return F.struct(F.lit(kind).alias("reason_class"), F.concat(*parts).alias("reason"))

    name_word = first_skip_word(name, match)
    description_word = first_skip_word(description, match)
    topic_hits = F.filter(
        F.transform(
            topics, lambda t: F.struct(t.alias("topic"), first_skip_word(t, match).alias("word"))
        ),
        lambda h: h["word"].isNotNull(),
    )
    topic = F.get(topic_hits, F.lit(0))
    owner_low = F.lower(owner)
    # An empty label is contained in every owner.
    same_company = F.contains(owner_low, domain_label(domain))
    return F.coalesce(
        F.when(
            name_word.isNotNull(), verdict("name", NAME_CONTAINS, name_word, LIKELY)
        ),
        F.when(
            same_company,
            verdict(
                "owner",
                OWNER_IS, owner_low, OWNER_MATCHES, domain, SAME_COMPANY,
            ),
        ),
        F.when(
            description_word.isNotNull(),
            verdict("description", DESCRIPTION_CONTAINS, description_word, LIKELY),
        ),
        F.when(
            topic.isNotNull(),
            verdict(
                "topic",
                TOPIC_IS, topic["topic"], TOPIC_INDICATES, topic["word"], TOPIC_END,
            ),
        ),
        F.when(is_archived, verdict("archived", ARCHIVED)),
    )


def should_scan_repo(metadata: DataFrame, domain: str | Column, match: str = "substring") -> DataFrame:
    """Add ``should_scan``, ``reason_class`` and ``reason`` to repository metadata.

    ``metadata`` has ``owner, name, description, topics, is_archived``.
    """
    verdict = skip_verdict(
        F.col("owner"),
        F.col("name"),
        F.col("description"),
        F.col("topics"),
        F.col("is_archived"),
        F.lit(domain) if isinstance(domain, str) else domain,
        match,
    )
    return (
        metadata.withColumn("_v", verdict)
        .withColumns(
            {
                "should_scan": F.col("_v").isNull(),
                "reason_class": F.col("_v.reason_class"),
                "reason": F.col("_v.reason"),
            }
        )
        .drop("_v")
    )


def skip_summary(verdicts: DataFrame) -> DataFrame:
    """Repositories per reason class; eligible ones count as ``scanned``."""
    return verdicts.groupBy(F.coalesce("reason_class", F.lit("scanned")).alias("reason_class")).agg(
        F.count("*").alias("n_repos")
    )
