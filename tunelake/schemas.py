"""Schemas of the tables the operators read and write, as Spark DDL."""

RAW_LINE = "value string, file string, seq bigint"
EXAMPLE = (
    "example_id string, seq bigint, prompt string, response string, score double, source string, issue string, "
    "writer string, batch_id bigint"
)
QUARANTINED = f"{EXAMPLE}, status string"
LOG_LINE = "run_id string, seq bigint, line string"
ADAPTER = "model string, name string, epoch int, matrix string, row int, values array<double>"
