"""All queries of this subpackage and the pipeline, for the driver's contract."""

import corpus_pipeline  # noqa: F401

from leakatlas.llm import queries  # noqa: F401
from leakatlas.llm.registry import ORACLES, QUERIES  # noqa: F401
