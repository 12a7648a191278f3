"""The rewriting plan: messages in, rewritten messages, change log and savings out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from context_shaper.operators import rewrite as R
from context_shaper.session import stage


@dataclass(frozen=True)
class Optimized:
    """Lazy results of one rewriting run."""

    rewritten: DataFrame
    figures: DataFrame
    points: DataFrame | None
    options: R.RewriteOptions

    @property
    def messages(self) -> DataFrame:
        """conv_id, out_idx, idx, role, text, placed, changed, tokens_after."""
        if self.points is None:
            return self.rewritten.select(
                "conv_id", F.col("idx").alias("out_idx"), "idx", "role", "text", "placed",
                "changed", "tokens_after",
            )
        return R.prune(self.rewritten, self.points, self.options)

    @property
    def changes(self) -> DataFrame:
        return R.change_log(self.figures, self.points)

    @property
    def savings(self) -> DataFrame:
        return R.savings(self.figures, self.points)

    @property
    def digests(self) -> DataFrame | None:
        return None if self.points is None else R.prune_digests(self.rewritten, self.points, self.options)


def optimize(
    messages: DataFrame, options: R.RewriteOptions = R.RewriteOptions(), staged: bool = True
) -> Optimized:
    """Rewrite every conversation.

    With ``staged`` one pass over the texts writes the narrow figures table to the shared
    folder; decisions, change log and savings come from it alone.  Decisions are staged too:
    knowing their size, the planner broadcasts small ones, so that writing the new texts takes
    one more pass and no shuffle of texts, and shuffles when they are large.
    """
    prepared = R.prepare(messages, options)
    narrow = R.figures_only(prepared)
    if staged:
        narrow = stage(narrow, "figures")
    decisions = R.decide(narrow, options)
    if staged:
        decisions = stage(decisions, "decisions")
    figures = R.apply_decisions(narrow, decisions, options)
    points = None
    if options.runs("prune-history"):
        points = R.prune_points(figures, options)
        if staged:
            points = stage(points, "prune-points")
    return Optimized(R.apply_decisions(prepared, decisions, options), figures, points, options)
