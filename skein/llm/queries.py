"""The pN queries of the training-data operators."""

from __future__ import annotations

from ..registry import Registry, table
from . import sql
from .abuse import abuse_rates, abuse_scores
from .authored import not_written_here
from .conversations import conversations
from .leaks import leaked_items
from .packing import packed_documents, packing_checks
from .pieces import file_pieces

registry = Registry()


@registry.query("p1_found", sql.P1_FOUND)
def p1_found(spark, directory):
    return file_pieces(table(spark, directory, "files"), table(spark, directory, "slices"), table(spark, directory, "symbols"))


@registry.query("p2_found", sql.P2_FOUND)
def p2_found(spark, directory):
    return conversations(table(spark, directory, "log_messages"), table(spark, directory, "log_blocks"))


@registry.query("p4_found", sql.P4_FOUND)
def p4_found(spark, directory):
    return not_written_here(table(spark, directory, "files"), table(spark, directory, "file_heads"), table(spark, directory, "symbols"))


@registry.query("p5_containers")
def p5_containers(spark, directory):
    return packed_documents(table(spark, directory, "documents"))


@registry.query("p5_packing_checks", sql.P5_CHECKS)
def p5_packing_checks(spark, directory):
    return packing_checks(packed_documents(table(spark, directory, "documents")))


@registry.query("p6_found", sql.P6_FOUND)
def p6_found(spark, directory):
    return leaked_items(table(spark, directory, "documents"), table(spark, directory, "eval_items")).select("doc_id", "item_id")


@registry.query("p7_found")
def p7_found(spark, directory):
    scores = abuse_scores(table(spark, directory, "documents"), table(spark, directory, "abuse_labels"))
    return scores.where("abusive").select("doc_id").distinct()


@registry.query("p7_rates")
def p7_rates(spark, directory):
    return abuse_rates(abuse_scores(table(spark, directory, "documents"), table(spark, directory, "abuse_labels")))
