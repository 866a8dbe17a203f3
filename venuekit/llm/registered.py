"""All registered queries of this package, the pipeline included."""

import corpus_pipeline
from venuekit.llm.queries import ORACLES, QUERIES

QUERIES["pipeline"] = corpus_pipeline.run

__all__ = ["ORACLES", "QUERIES"]
