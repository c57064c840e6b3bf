"""Queries on delivered messages."""

from __future__ import annotations

from ..operators.delivery import surplus_copies
from ..registry import Registry, table

registry = Registry()


@registry.query(
    "p3_found",
    """
    SELECT delivery_id FROM (
      SELECT delivery_id, row_number() OVER (
        PARTITION BY message_id
        ORDER BY coalesce(input_tokens, output_tokens, cache_read_input_tokens, cache_creation_input_tokens) IS NULL,
                 coalesce(input_tokens, 0)::HUGEINT + coalesce(output_tokens, 0) + coalesce(cache_read_input_tokens, 0)
                   + coalesce(cache_creation_input_tokens, 0) DESC,
                 received_at NULLS LAST, delivery_id) AS place
      FROM log_messages WHERE message_id IS NOT NULL)
    WHERE place > 1
    """,
)
def p3_found(spark, directory):
    return surplus_copies(table(spark, directory, "log_messages"))
