"""One query per operator over its whole table, with the SQL that states the same rows where SQL can."""

from tunelake.llm import queries_filter, queries_format, queries_store, queries_text, queries_vectors  # noqa: F401
from tunelake.llm.registry import QUERIES  # noqa: F401
