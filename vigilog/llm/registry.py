"""All queries of this subpackage with their oracles: one per operator, and the pipeline."""

import corpus_pipeline

from . import queries

QUERIES = queries.QUERIES | {"pipeline": corpus_pipeline.run}
ORACLES = queries.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
