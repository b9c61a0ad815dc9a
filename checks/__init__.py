"""Independent SQL for the registered queries, run by another engine on the same tables."""

from checks.result_sql import SQL as _RESULTS
from checks.text_sql import SQL as _TEXTS

SQL = {**_RESULTS, **_TEXTS}
