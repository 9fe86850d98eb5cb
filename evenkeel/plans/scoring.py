"""Scoring: every branch scored, blended and aligned to the wanted ids."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from evenkeel.functions.naming import DEFAULT, Naming
from evenkeel.functions.scalar import clip01
from evenkeel.operators.blend import weighted_blend
from evenkeel.operators.encode import PreprocessState, apply_preprocessor
from evenkeel.operators.joins import align_to_ids, join_branch_scores
from evenkeel.operators.models import Fitted


@dataclass(frozen=True)
class Branch:
    """A model with the preprocessing it was fitted on and its weight in the blend."""

    model: Fitted
    state: PreprocessState
    weight: float

    def score(self, features: DataFrame, name: str, naming: Naming = DEFAULT) -> DataFrame:
        ready = apply_preprocessor(features, self.state, (naming.key,))
        return self.model.score(ready, name).select(naming.key, name)


def score_blend(
    ids: DataFrame,
    branches: Mapping[str, tuple[Branch, DataFrame]],
    naming: Naming = DEFAULT,
) -> DataFrame:
    """key, score for every id. Each branch brings its own feature table."""
    scored = [b.score(df, name, naming) for name, (b, df) in branches.items()]
    joined = join_branch_scores(scored[0], scored[1:], naming.key)
    weights = {name: b.weight for name, (b, _) in branches.items()}
    blended = joined.select(naming.key, clip01(weighted_blend(weights)).alias("score"))
    return align_to_ids(ids, blended, naming.key)
