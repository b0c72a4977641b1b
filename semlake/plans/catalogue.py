"""The query catalogue: name -> callable, and name -> DuckDB SQL."""

from semlake.plans import maintenance, ordered, stores, structures, texts, vectors

_PARTS = (vectors, texts, ordered, maintenance, stores, structures)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
