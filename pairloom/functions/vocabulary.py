"""Fixed values.

These lists decide which words survive in an SQL template, and which texts mark
a pair as not translated. They must stay exactly as they are: results depend on
every entry.
"""

# The SQLite keywords a template keeps.
KEYWORDS = tuple(
    """
    ABORT ACTION ADD AFTER ALL ALTER ALWAYS ANALYZE AND ASC ATTACH AUTOINCREMENT
    BEFORE BEGIN BETWEEN BY
    CASCADE CASE CAST CHECK COLLATE COLUMN COMMIT CONFLICT CONSTRAINT CREATE CROSS
    CURRENT CURRENT_DATE CURRENT_TIME CURRENT_TIMESTAMP
    DATABASE DEFAULT DEFERRABLE DEFERRED DELETE DESC DETACH DISTINCT DO DROP
    EACH ELSE END ESCAPE EXCEPT EXCLUDE EXCLUSIVE EXISTS EXPLAIN
    FAIL FILTER FIRST FOLLOWING FOR FOREIGN FROM FULL
    GENERATED GLOB GROUP GROUPS HAVING
    IF IGNORE IMMEDIATE IN INDEX INDEXED INITIALLY INNER INSERT INSTEAD INTERSECT INTO IS ISNULL
    JOIN KEY LAST LEFT LIKE LIMIT MATCH MATERIALIZED
    NATURAL NO NOT NOTHING NOTNULL NULL NULLS
    OF OFFSET ON OR ORDER OTHERS OUTER OVER
    PARTITION PLAN PRAGMA PRECEDING PRIMARY QUERY
    RAISE RANGE RECURSIVE REFERENCES REGEXP REINDEX RELEASE RENAME REPLACE RESTRICT
    RETURNING RIGHT ROLLBACK ROW ROWS
    SAVEPOINT SELECT SET TABLE TEMP TEMPORARY THEN TIES TO TRANSACTION TRIGGER
    UNBOUNDED UNION UNIQUE UPDATE USING
    VACUUM VALUES VIEW VIRTUAL WHEN WHERE WINDOW WITH WITHOUT
    """.split()
)

# The SQLite functions a template keeps when a bracket follows.
FUNCTIONS = tuple(
    """
    AVG COUNT MAX MIN SUM GROUP_CONCAT SUBSTR TRIM LTRIM RTRIM LENGTH REPLACE UPPER LOWER INSTR
    COALESCE IFNULL IIF NULLIF DATE TIME DATETIME JULIANDAY STRFTIME ABS RANDOM ROUND
    """.split()
)

# Words after which a reserved word is taken to be a table name.
TABLE_WORDS = ("FROM", "JOIN", "INTO", "UPDATE", "TABLE")

# What counts as quoted, taken out in this order.
QUOTED = (r"'[^']*'", r'"[^"]*"', r"`[^`]*`", r"\[[^\]]*\]")

# Signs that all become "=", and the signs a template keeps.
EQUALISED = r">=|<=|[:/+\-<>]"
KEPT_SIGNS = r"[(),*/+=\-<>]"

# How a model says that it gave up.
UNTRANSLATED = "Unable to translate this query"
NULL_SELECT = "select null"

# Fields of one mapped pair, with guidance and without.
GUIDED_FIELDS = (
    "source_dataset", "source_db_id", "source_query", "source_question",
    "tables_columns_replacement", "thought",
    "target_db_id", "target_query", "target_question",
)
ZEROSHOT_FIELDS = (
    "source_dataset", "source_db_id", "source_query", "source_question",
    "target_db_id", "target_query", "target_question",
)

# Why an attempt failed.
ERROR_CLASSES = (
    "empty_output", "fields_mismatch", "db_id_matching", "recitation",
    "max_token", "invalid_escape", "json_decode", "unexpected",
)

# The text of a prompt. The places hold, in order: base text, source id, source DDL,
# target id, target DDL, sample rows, questions.
PROMPT_FORMAT = """%s

## Generate the query for the following query:

# Source schema
{
    "db_id": "%s",
    "schema": "%s"
}

# Target schema
{
    "db_id": "%s",
    "schema": "%s"
}

# Target sample data
%s

# Source query:
%s

#Output:

"""

# The text of a judge prompt: base text, target DDL, pairs.
RATING_FORMAT = """%s

## Rate the following questions and sql:

# Source schema
"%s"


# Input pairs
%s

# Output:

"""
NO_SCHEMA = "None"

# Labels.
NOT_AVAILABLE = "N/A"
NULL_QUERY = "Null_Query"
BAD_SCHEMA_FILE = "schemas.json files are not valid JSON"
EMPTY_SCHEMA_FILE = "schemas.json files are empty"

# Default limits.
QUESTIONS_PER_PROMPT = 10
ATTEMPTS_PER_PROMPT = 3
FAILURE_LIMIT = 100
RATING_FAILURES = 5
QUERY_SECONDS = 30
PREVIEW_ROWS = 50
