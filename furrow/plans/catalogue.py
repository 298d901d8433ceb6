"""All queries over the reference's operators, by SURVEY id, with their DuckDB twins."""

from __future__ import annotations

from furrow.plans import core, kernels, space  # noqa: F401  they list their queries
from furrow.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "I5_profile_score"
