"""The registered queries over the driver's tables (``queries.QUERIES``) and
the DuckDB SQL that states their expected results (``queries.ORACLE_SQL``,
built with the helpers in ``oracle``)."""
