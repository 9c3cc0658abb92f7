"""DataFrame -> DataFrame operators: validate, ingest, project, report, audit, profile."""
