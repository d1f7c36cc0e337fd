"""Fixed schemas of the landed payloads and of the library's own tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Payload bodies, as DDL for from_json. Undeclared JSON fields are never parsed.
SEARCH_PAGE = (
    "total_count BIGINT, items ARRAY<STRUCT<html_url: STRING, url: STRING, repository: "
    "STRUCT<name: STRING, html_url: STRING, commits_url: STRING, owner: STRUCT<html_url: STRING>>>>"
)
COMMIT_LIST = "ARRAY<STRUCT<commit: STRUCT<committer: STRUCT<date: STRING>>>>"
REPO_INFO = "default_branch STRING, description STRING, archived BOOLEAN"
TOPICS = "names ARRAY<STRING>"
TREE = "tree ARRAY<STRUCT<type: STRING, path: STRING, sha: STRING>>"
BLOB = "encoding STRING, content STRING"
LANGUAGES = "MAP<STRING, BIGINT>"

RULES = T.StructType(
    [
        T.StructField("rule_id", T.IntegerType(), False),
        T.StructField("pattern", T.StringType(), False),
        T.StructField("secret_type", T.StringType(), False),
        T.StructField("description", T.StringType(), True),
        T.StructField("disabled", T.BooleanType(), False),
    ]
)

RULE_FILE = T.StructType(
    [
        T.StructField("pattern", T.StringType()),
        T.StructField("secret_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("disabled", T.BooleanType()),
        # Any of each inner list, lower case, is in every match.
        T.StructField("anchors", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

FETCH_LOG = T.StructType(
    [
        T.StructField("call", T.StringType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("status", T.IntegerType(), False),
        T.StructField("body", T.StringType(), True),
        T.StructField("ts", T.TimestampType(), True),
    ]
)
