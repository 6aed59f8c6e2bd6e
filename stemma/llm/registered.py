"""All queries of this subpackage with the pipeline on top of it."""

import corpus_pipeline

from stemma.llm.queries import QUERIES as _OPERATORS
from stemma.llm.queries import SQL as _SQL

QUERIES = _OPERATORS | {"pipeline": corpus_pipeline.run}
SQL = _SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
