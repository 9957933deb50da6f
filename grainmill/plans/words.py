"""Word lists and SQL pieces shared by the text queries."""

from __future__ import annotations

from grainmill.functions.text import WORD

# fixed values: two stop lists
STOP_ENGLISH = (
    "a an and are as at be been but by for from had has have he her his i if in is it its not of on or our "
    "she so than that the their them then there these they this to was we were what when which who will "
    "with would you your"
).split()
STOP_OTHER = (
    "aber als am auch auf aus bei das dem den der des die du ein eine el ella en er es et für il ich im la las "
    "le les los mit nicht on ou par para por pour que qui se sich sie son sur un una une und von war y zu"
).split()


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


WORD_SQL = WORD.replace("'", "''")
STOP_SQL = sql_list(STOP_ENGLISH + STOP_OTHER)


def tokens_sql(source: str, columns: str = "id", text: str = "text", name: str = "tokens") -> str:
    """CTE body: one row per word of `source`."""
    return f"{name} as (select {columns}, unnest(regexp_extract_all(lower({text}), '{WORD_SQL}')) as word from {source})"
