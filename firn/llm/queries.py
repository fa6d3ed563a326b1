"""Loads every module of this package, so that its queries are registered."""

from firn.llm import (  # noqa: F401
    exact,
    jaccard,
    language,
    licenses,
    matrix,
    mixing,
    packing,
    resample,
    runs,
    secrets,
    shards,
    simhash,
    toxicity,
)
from firn.llm.lines import ORACLES, QUERIES  # noqa: F401
